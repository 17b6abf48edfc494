"""BPE transducer, edit-aware counts, and the range coder's token files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from corpusmith.llm import bpe, editcount, rangecoder
from tokenizers import Tokenizer

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return editcount.PieceCounts(PATH, PATTERN)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_transducer_equals_merges(own, reference):
    r = random.Random(1)
    for _ in range(600):
        text = "".join(r.choice("abcdeé日本 \n\t'sst012!?..__--😀aaaaa") for _ in range(r.randint(0, 50)))
        assert ids(own.encode(text)) == reference.encode_ordinary(text)
        assert "".join(own.decode(own.encode(text), step=3)) == text
    tokens = own.bytes_of
    for _ in range(1500):
        piece = r.choice(tokens) + r.choice(tokens) + r.choice(tokens)
        assert own.machine.encode(piece) == reference._core_bpe.encode_single_piece(piece)
    long = "a" * 60_000 + "ab" * 9_000
    assert ids(own.encode(long)) == reference.encode_ordinary(long)


def test_transducer_emits_before_the_end(own):
    machine = bpe.Transducer(own.machine.ranks)
    for _ in range(900):  # each time one arc more
        machine.encode(b"internationalisations" * 40)
    assert max(len(pending) for _, pending in machine.keys) < 64
    assert sum(1 for out, _ in machine.arcs.values() if out) > 0


def test_machine_starts_anew_when_it_grows(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 5)
    machine = bpe.Transducer(own.machine.ranks)
    for word in ("restructuring", "unbelievable", "zzyzx"):
        assert machine.encode(word.encode()) == reference._core_bpe.encode_single_piece(word.encode())


def test_utf8_stream_by_single_bytes():
    text = "aé日😀 z"
    stream = bpe.Utf8Stream()
    assert "".join(stream.feed(bytes([b])) for b in text.encode()) + stream.close() == text
    cut = bpe.Utf8Stream()
    assert cut.feed("é".encode()[:1]) == "" and cut.close() == "�"
    assert bpe.Utf8Stream().feed(b"\xff\x80a") == "��a"


def test_encode_documents(docs, no_docs, wide_docs, own, reference):
    rows = bpe.encode_documents(docs, PATH, PATTERN).collect()
    texts = sorted((r.text or "") for r in docs.collect())
    assert sorted(r.decoded for r in rows) == texts
    assert all(ids(r.ids) == reference.encode_ordinary(r.decoded) and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert bpe.encode_documents(no_docs, PATH, PATTERN, digest=True).count() == 0
    assert bpe.encode_documents(wide_docs, PATH, PATTERN, digest=True).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_edits_equal_a_full_count(own, pieces):
    r = random.Random(3)
    for _ in range(250):
        text = "".join(r.choice("abé \n\t's12.!  't") for _ in range(r.choice([0, 1, 5, 50, 900])))
        tree = editcount.CountTree(text, own.pattern, pieces)
        for _ in range(r.randint(1, 10)):
            at, gone = r.randint(0, len(text) + 1), r.choice([0, 0, 1, 3, 20, 400])
            new = "".join(r.choice("abé \n\t's12.!  't") for _ in range(r.choice([0, 0, 1, 2, 9, 300])))
            place = min(at, len(text))
            text = text[:place] + new + text[place + gone :]
            tree.edit(at, gone, new)
            assert [p for leaf in tree.leaves for p in leaf] == own.pattern.findall(text)
            assert tree.total == own.count(text) and len(tree) == len(text)
    assert tree.tokens_before(len(text)) == tree.total


def test_edits_touch_little(own, pieces):
    text = "the quick brown fox jumps over it. " * 4000
    tree = editcount.CountTree(text, own.pattern, pieces)
    for at in (5, 50_000, 100_000):
        tree.edit(at, 3, "new words")
    assert tree.recounted < 500


def standard(n):
    return [(n // 3, 0, " as amended,"), (n // 2, 5, ""), (2 * n // 3, 7, "x 2nd ed.")]


def edited(text, edits):
    for at, gone, new in edits:
        at = min(at, len(text))
        text = text[:at] + new + text[at + gone :]
    return text


def test_edit_query_against_full_counts(docs, no_docs, wide_docs, own):
    got = sorted((r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in editcount.count_with_edits(docs, PATH, PATTERN).collect())
    texts = [r.text or "" for r in docs.collect()]
    want = sorted((own.count(t), own.count(edited(t, standard(len(t)))), len(edited(t, standard(len(t))))) for t in texts)
    assert got == want
    assert editcount.count_with_edits(no_docs, PATH, PATTERN).count() == 0
    assert editcount.count_with_edits(wide_docs, PATH, PATTERN).count() == docs.count()


def test_edit_column(spark, own):
    rows = [(1, "one two three", [(4, 3, "2"), (0, 0, "> ")]), (2, "abc", None), (3, None, [(0, 9, "x y")]), (4, "abc", [(1, None, None), None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at: int, removed: int, inserted: string>>")
    trees = editcount.build_trees(df, PATH, PATTERN).join(df.select("doc_id", "edits"), "doc_id")
    got = {r.doc_id: (r.n_tokens, r.n_edits) for r in editcount.apply_edits(trees, PATH, PATTERN).collect()}
    assert got == {1: (own.count("> one 2 three"), 2), 2: (own.count("abc"), 0), 3: (own.count("x y"), 1), 4: (own.count("abc"), 1)}


def test_batches_of_edits_to_stored_trees(spark, own, tmp_path):
    """Trees are written, edited by a table of edits, written again and edited again; no step sees the texts."""
    r = random.Random(5)
    alphabet = "abé \n\t's12.!  't"
    texts = {i: "".join(r.choice(alphabet) for _ in range(r.choice([0, 3, 80, 4000]))) for i in range(12)}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    editcount.build_trees(df, PATH, PATTERN).write.parquet(f"{tmp_path}/0")
    for turn in range(3):
        edits = [(d, k, r.randint(0, 4100), r.choice([0, 2, 300]), "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 40])))) for d in range(0, 14, 2) for k in range(r.randint(1, 6))]
        shuffled = spark.createDataFrame(r.sample(edits, len(edits)), "doc_id long, seq int, at int, removed int, inserted string")
        editcount.apply_edits(spark.read.parquet(f"{tmp_path}/{turn}"), PATH, PATTERN, shuffled).write.parquet(f"{tmp_path}/{turn + 1}")
        for d in texts:
            texts[d] = edited(texts[d], [e[2:] for e in edits if e[0] == d])
        trees = spark.read.parquet(f"{tmp_path}/{turn + 1}")
        assert {x.doc_id: x.text for x in editcount.texts_of(trees).collect()} == texts
        assert {x.doc_id: (x.n_tokens, x.n_chars) for x in trees.collect()} == {d: (own.count(t), len(t)) for d, t in texts.items()}
        assert {x.doc_id for x in trees.filter("recounted_chars > 0").collect()} <= set(range(0, 14, 2))


def test_stored_trees_split_only_touched_leaves(own, pieces):
    tree = editcount.CountTree("the quick brown fox jumps over it. " * 4000, own.pattern, pieces)
    again = editcount.CountTree.stored(*tree.rows(), own.pattern, pieces)
    again.edit(70_000, 3, "new words")
    assert len(again.leaves.made) < 6 < len(again.leaves) and again.recounted < 200
    assert again.total == own.count(again.text())


def test_range_coder_round_trip():
    r = np.random.default_rng(0)
    blocks = [r.integers(0, 65536, n) for n in (0, 1, 2, 50, 700)] + [np.minimum(r.zipf(1.3, 900), 49407), np.zeros(2048, int), np.tile(r.integers(0, 49000, 7), 200)]
    coded = rangecoder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[6]) < 40 and len(coded[7]) < 200  # repetition is predicted
    alone = rangecoder.encode_blocks([blocks[5]])[0]
    assert alone == coded[5]  # a block does not depend on its neighbours


def test_damage_is_noticed():
    docs = [(i, np.arange(i, i + 3000).astype(np.uint16)) for i in range(3)]
    data = bytearray(rangecoder.write_file(docs))
    assert [(d, x.tolist()) for d, x in rangecoder.read_file(bytes(data))] == [(d, x.tolist()) for d, x in docs]
    for at in (2, 30, len(data) - 200):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            rangecoder.read_file(bytes(bad))


def test_mixture_is_below_the_entropy_of_single_ids():
    r = np.random.default_rng(5)
    words = [r.integers(3, 3000, n).astype(np.uint16) for n in r.integers(1, 4, 4000)]
    docs = [(i, np.concatenate([words[min(k, 4000) - 1] for k in r.zipf(1.2, 400)])) for i in range(500)]
    ids = np.concatenate([x for _, x in docs])
    data = rangecoder.write_file(docs)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(data) < 0.95 * -(share * np.log2(share)).sum() / 8 * len(ids)  # directory and order 0's table included
    assert rangecoder.HEAD.unpack_from(data)[2] > 100  # a small file has many blocks still, which are coded together
    assert all((a == b).all() for (_, a), (_, b) in zip(docs, rangecoder.read_file(data), strict=True))


def test_token_files(docs, no_docs, wide_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)  # as the library makes it
    files = rangecoder.write_tokens(docs, path, bucket_bytes=4_000)
    assert files.select("bucket").distinct().count() > 4
    got = sorted(rangecoder.read_tokens(files, digest=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][1:] == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    at, by_id = 0, {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        want = [*plain.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert rangecoder.read_tokens(rangecoder.write_tokens(no_docs, path)).count() == 0
    assert rangecoder.read_tokens(rangecoder.write_tokens(wide_docs, path)).columns == ["doc_id", "start", "n_tokens", "ids"]


def test_words_between_spaces_are_encoded_as_in_the_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain, r = rangecoder._Words(path), Tokenizer.from_file(path), random.Random(4)
    texts = ["ÁÇ é́ x", "a\x1cb c d\te\r\nf'S it's 'RE İstanbul ΣΑΣ Σ", "<|endoftext|> a <|startoftext|>", "a <|endoftext|> b", "<|ENDOFTEXT|> <|", "x ́y\n̈z", "   ", "e ̧́", "Hi... Hi, hi!? can't. don't, it's; x.y, é. É.", "İ. ǅ, ß! ﬁ."]
    texts += ["".join(r.choice(["ab", "Ab", "é", "İ", "ſ", " ", " ", "\n", ".", ",", "!?", "'s", "'", "<|", "|>", "<|endoftext|>", "\u0301", "12"]) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    monkey = rangecoder._Words(path)
    monkey.MOST = 50  # clears its words again and again
    for text in texts:
        want = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert own.encode(text, 2).tolist() == want, text
        assert monkey.encode(text, 2).tolist() == want, text


def test_pieces_of_latin_texts_are_those_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain, r = rangecoder._Words(path), Tokenizer.from_file(path), random.Random(7)
    texts = [f"a{c}b{c}1{c}.{c} {c}" for c in map(chr, range(256))] + ["", "'", "'s", "s'", "'s", "'", "r", "'re", "ll", "'l", "l", "x's'S", "x''s", "'ll'LLe", "Été's"]
    texts += ["".join(r.choice(["a", "S", "re", "LL", "v", "e", "'", "'", "''", "!", " ", "d", "É", "9", "\n", "m", "<|", "½"]) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    got = own.encode_all(rangecoder.pa.array([None, *texts]).slice(1), 2)  # texts without a blank between them stand side by side
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], text
    assert own.encode_all([None], 2)[0].tolist() == [2] and own.encode_all([], 2) == []


def test_a_piece_is_merged_once(monkeypatch):
    """Neither the case nor the marks of a word send its letters to the library again."""
    sent = []

    class Counting:
        def __init__(self, inner):
            self.__dict__["inner"] = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return self.inner.encode_batch_fast(texts, **how)

    class Maker:
        from_file = staticmethod(lambda path: Counting(Tokenizer.from_file(path)))

        def __new__(cls, model):
            return Counting(Tokenizer(model))

    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["reading", "été", "lanterns", "übermut"]
    marks = ["", ".", "***", "###", "%%%", "$$$.", "&&&", "1", "22", "!?", "'s", "-"]
    text = " ".join(form + mark for mark in marks for word in words for form in (word, word.title(), word.upper()))
    monkeypatch.setattr(rangecoder, "Tokenizer", Maker)
    ids = rangecoder._Words(path).encode(text, 2)
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]
    assert sum(map(len, sent)) < 2 * sum(map(len, words + marks))


def test_carries_run_through_digits():
    """A number that grows by a carry changes digits that were given out before."""
    coder = rangecoder._Encoder(np.array([9, 9]), rangecoder.Shares.even())
    digits = np.array([[1, 5], [0xFF_FFFF, 6], [0xFF_FFFF, 7], [1 << 24, 8]], np.uint64)
    coder.put(digits, np.ones((4, 2), bool))
    assert coder.finish() == [bytes([0, 0, 2] + [0] * 12), bytes([0, 0, 5, 0, 0, 6, 0, 0, 7, 0, 0, 8, 0, 0, 0])]


def test_blocks_of_many_lengths_with_rare_ids():
    r = np.random.default_rng(2)
    blocks = [np.where(r.random(n) < 0.02, r.integers(0, 65536, n), r.integers(0, 3, n)).astype(np.uint16) for n in [*range(70), 500, 501, 3000]]
    shares = rangecoder.Shares.of(np.concatenate(blocks))
    coded = rangecoder.encode_blocks(blocks, shares)
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode_blocks(coded, [len(b) for b in blocks], shares), strict=True))
    assert coded[72] == rangecoder.encode_blocks([blocks[72]], shares)[0]
