"""Language identification, language-model scores, and the permutation index."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from corpusmith.llm import langid, mixlm, permutation
from pyspark.sql import functions as F

from .conftest import DOCS, LEXICON, make_docs


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(2)
    scores, moves = r.normal(size=(4, 2, 3)), r.normal(size=(3, 3))
    valid = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    got = langid.marginals(scores, moves, valid)
    for s, n in ((0, 4), (1, 2)):
        want = np.zeros((4, 3))
        for path in product(range(3), repeat=n):
            weight = math.exp(sum(scores[i, s, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, y in enumerate(path):
                want[i, y] += weight
        assert np.allclose(got[:, s], want / want[0].sum())


def test_language_accuracy_and_switching(spark, docs, no_docs, wide_docs):
    rows = make_docs(240, seed=8)
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.held_out): r for r in langid.identify(df).collect()}
    right = total = 0
    for doc_id, text, lang, *_ in rows:
        held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2
        r = got[doc_id, held]
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und" and r.score == 0
        elif held and lang:
            total += 1
            right += r.lang_pred == lang
    assert total > 30 and right / total > 0.95
    model = langid.fit(langid.sample_words(df))
    known = langid._Potentials(model)
    mixed = " ".join(LEXICON["de"][:10] + LEXICON["fr"][:10])
    post, _, _ = langid.predict_words(model, known, [mixed])
    labels = [model.languages[i] for i in post.argmax(axis=1)]
    assert labels[:8] == ["de"] * 8 and labels[12:] == ["fr"] * 8
    assert langid.identify(no_docs).count() == 0
    kept = langid.keep_identified(wide_docs)
    assert kept.columns == wide_docs.columns
    assert kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())


def test_nothing_to_learn_gives_und(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 9)], DOCS)
    assert langid.identify(df).first().lang_pred == "und"


def test_a_long_text_is_one_chain():
    """Posteriors and expected moves of 10,000 words, cut into pieces, are those of the uncut chain."""
    r = np.random.default_rng(5)
    for k in (2, 6):
        table, moves = 2 * r.normal(size=(60, k)), 2 * r.normal(size=(k, k))
        counts = np.array([1, 0, 52, 48, 49, 10_000, 96, 3])
        flat, pairs, want_pairs, at = r.integers(0, 60, counts.sum()), np.zeros((k, k)), np.zeros((k, k)), 0
        post = langid.chains(table, flat, counts, moves, pairs)
        for n in counts:
            if n:
                want = langid.marginals(table[flat[at : at + n]][:, None, :], moves, np.ones((n, 1), bool), pairs=want_pairs)
                assert np.allclose(post[at : at + n], want[:, 0], atol=1e-9)
            at += n
        assert np.allclose(pairs, want_pairs) and abs(pairs.sum() - np.maximum(counts - 1, 0).sum()) < 1e-6


def test_expected_moves_equal_enumeration():
    r = np.random.default_rng(9)
    scores, moves, got, want, total = r.normal(size=(4, 1, 3)), r.normal(size=(3, 3)), np.zeros((3, 3)), np.zeros((3, 3)), 0.0
    langid.marginals(scores, moves, np.ones((4, 1), bool), pairs=got)
    for path in product(range(3), repeat=4):
        weight = math.exp(sum(scores[i, 0, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += weight
        for a, b in zip(path, path[1:], strict=False):
            want[a, b] += weight
    assert np.allclose(got, want / total)


def test_seventy_languages_are_all_learned(spark):
    r = np.random.default_rng(1)
    words = [["".join(chr(97 + x) for x in r.integers(0, 26, 6)) for _ in range(12)] for _ in range(70)]
    rows = [(70 * i + j, " ".join(r.choice(words[j], 20)), f"l{j:02}", "s", 9) for i in range(8) for j in range(70)]
    got = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    langs = {d: lang for d, _, lang, *_ in rows}
    assert len({g.lang_pred for g in got}) == 70
    assert sum(g.lang_pred == langs[g.doc_id] for g in got if g.held_out) > 0.9 * sum(g.held_out for g in got)


def test_words_of_code_switched_text_are_labelled(spark, docs, no_docs):
    model = langid.fit(langid.sample_words(docs))
    text = " ".join(LEXICON["de"][:10] + ["12"] + LEXICON["fr"][:10])
    mixed = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, [tuple(w) for w in r.words]) for r in langid.label_words(mixed, model).collect()), key=lambda r: r[0])
    assert [len(w) for _, w in got] == [21, 21, 0, 0] and got[0] == got[1]
    assert [w for w, _, _ in got[0][1]] == text.split() and got[0][1][10][1:] == ("und", 0.0)
    assert [x for _, x, _ in got[0][1]][:8] == ["de"] * 8 and [x for _, x, _ in got[0][1]][13:] == ["fr"] * 8
    assert langid.label_words(no_docs, model).count() == 0


def test_the_sample_is_bounded_by_rows_and_keeps_whole_texts(spark):
    rows = [(i, f"w{i} " * 500, f"l{i % 3}", "s", 9) for i in range(90)] + [(None, "no id", "l0", "s", 1)] * 5
    got = langid.sample_words(spark.createDataFrame(rows, DOCS), docs_each=7)
    assert sorted(got) == ["l0", "l1", "l2"] and all(len(v) <= 7 and all(len(t) in (500, 2) for t in v) for v in got.values())
    again = langid.sample_words(spark.createDataFrame(rows[::-1], DOCS).repartition(4), docs_each=7)
    assert again == got


def test_a_document_without_a_clear_language_goes(spark):
    rows = make_docs(120, seed=8)
    df = spark.createDataFrame(rows, DOCS)
    assert langid.keep_identified(df, least=1.01).count() == 0
    assert langid.keep_identified(spark.createDataFrame([(1, "some text", None, "s", 9)], DOCS)).count() == 0


def test_base_score_and_counts(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    train = Counter(w for d, t in rows if not held(d) for w in mixlm.tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted((-1 if d is None else d, held(d), len(mixlm.tokens(t)), sum(w in train for w in mixlm.tokens(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in mixlm.tokens(t)), 6)) for d, t in rows)
    found = mixlm.score_documents(docs).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == want
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in found)
    assert mixlm.score_documents(no_docs).count() == 0


def plainly_told(rows, held):
    """Shares, codes and spelled words of each document, token by token with dictionaries."""
    texts = [mixlm.tokens(t) for _, t in rows]
    grams = lambda x, n: [tuple((["<"] * 2 + x)[i - n + 3 : i + 3]) for i in range(len(x))]
    counts = [Counter(), Counter(), Counter()]
    for (d, _), x in zip(rows, texts, strict=True):
        for n in (1, 2, 3):
            counts[n - 1].update(grams(x, n) if not held(d) else [])
    total, n_docs, out = sum(counts[0].values()), sum(not held(d) for d, _ in rows), []
    for (d, _), x in zip(rows, texts, strict=True):
        own = [Counter(grams(x, n)) if not held(d) else Counter() for n in (1, 2, 3)]
        past, share, codes, spelled, levels, c = [Counter(), Counter(), Counter()], 0.0, [], [], [3, 3], [0, 0, 0]
        for i in range(len(x)):
            one = c[0] if i else n_docs - (not held(d))
            two = c[1] if i else 0
            every = max(1, total - (0 if held(d) else len(x)) + i)
            c = [counts[n][g] - own[n][g] + past[n][g] for n in range(3) for g in [grams(x[: i + 1], n + 1)[i]]]
            level = 3
            for order, seen, context, shorter in ((2, c[2], two, one), (1, c[1], one, two), (0, c[0], every, one)):
                if context:
                    size = lambda v, most: min(most, int(math.log2(max(1, v))))
                    codes.append((seen > 0) + 2 * order + 8 * size(context, 15) + 128 * size(shorter, 7) + 1024 * (4 * levels[-1] + levels[-2]))
                    if seen:
                        share += math.log10(seen / context)
                        level = order
                        break
            if level == 3:
                spelled.append(x[i] + b"\n")
            levels.append(level)
            for n in range(3):
                past[n][grams(x[: i + 1], n + 1)[i]] += 1
        out.append((round(share, 6), codes, b"".join(spelled)))
    return sorted(out)


@pytest.mark.parametrize(("block", "per_slice"), [(1 << 20, 1 << 20), (300, 500)])
def test_what_tells_a_token_against_dictionaries(spark, monkeypatch, block, per_slice):
    """In one block and slice, and in many of both."""
    rows = [(r[0], r[1]) for r in make_docs(50, seed=13) if not (r[1] and len(r[1]) > 10_000)]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    monkeypatch.setattr(mixlm, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = mixlm.pack_blocks(df, mixlm.crc_mod(F.col("doc_id"), 7) == 2).cache()
    total, n_docs = blocks.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    slices = max(1, 2 * total // per_slice)
    assert (blocks.count() > 4) == (slices > 4) == (block == 300)
    elsewhere = mixlm.count_elsewhere(blocks, slices)
    types = elsewhere.agg(F.sum("types")).first()[0]
    assert types == len({w for d, t in rows if not held(d) for w in mixlm.tokens(t)})
    found = mixlm.describe(blocks, elsewhere, slices, total, types, n_docs).collect()
    got = sorted((round(r.shares, 6), np.frombuffer(r.codes, "<u2").tolist(), bytes(r.spelled)) for r in found)
    assert got == plainly_told(rows, held)


def test_mixing_against_one_document_at_a_time():
    r = np.random.default_rng(8)
    x, gates, bits = r.normal(size=(4, 900)).astype(np.float32), r.integers(0, 3, 900), r.integers(0, 2, 900)
    doc = np.sort(r.integers(0, 5, 900))
    start = r.normal(size=(3, 4)) / 3
    want = np.zeros(6)
    for d in range(5):
        w, own = start.copy(), np.flatnonzero(doc == d)
        moves = np.zeros_like(w)
        for i, j in enumerate(own):
            if i and math.log2(i // mixlm.FIRST + 1) % 1 == 0 and i % mixlm.FIRST == 0:
                w, moves = w + np.clip(mixlm.RATE * moves, -0.25, 0.25), np.zeros_like(w)
            p = 1 / (1 + math.exp(-(w[gates[j]] @ x[:, j])))
            want[d] += math.log(p if bits[j] else 1 - p)
            moves[gates[j]] += (bits[j] - p) * x[:, j]
    assert np.allclose(mixlm.mix(x, gates, bits, doc, 6, start), want, atol=1e-3)
    assert not mixlm.mix(x[:, :0], gates[:0], bits[:0], doc[:0], 2, start).any()


def test_spelled_bits_are_a_code_of_the_bytes():
    code = mixlm.huffman(np.bincount(np.frombuffer("en le la élan".encode(), np.uint8), minlength=256) + 1)
    start, _, bits = code
    paths = ["".join(map(str, bits[a:b])) for a, b in zip(start, start[1:], strict=False)]
    assert abs(sum(2.0 ** -len(p) for p in paths) - 1) < 1e-12 and len(set(paths)) == 256 and len(paths[ord("e")]) < 8
    raw = np.frombuffer("élan\nb\n".encode(), np.uint8)
    slots, bits, owner = mixlm._spelled_bits(raw, code)
    assert "".join(map(str, bits)) == "".join(paths[c] for c in raw) and owner.tolist() == [i for i, c in enumerate(raw) for _ in paths[c]]
    again, _, place = mixlm._spelled_bits(np.frombuffer("b\nélan\n".encode(), np.uint8), code)
    cut, at = int((owner < 6).sum()), int((place < 2).sum())
    assert all((a[:cut] == b[at:]).all() and (a[cut:] == b[:at]).all() for a, b in zip(slots, again, strict=True))  # words stand alone
    assert mixlm._spelled_bits(raw[:0], code)[1].size == 0


def test_counts_of_any_size_are_packed():
    n = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert mixlm._unpack(mixlm._pack(n), len(n)).tolist() == n.tolist() and mixlm._unpack(b"", 0).size == 0
    r = np.random.default_rng(1)
    for size in (0, 1, 3, 40, 5000):
        keys = np.unique(np.append(r.integers(0, 1 << 32, size), [0, (1 << 32) - 1] if size else [])).astype(np.int64)
        assert mixlm._unpack_sorted(mixlm._pack_sorted(keys), len(keys)).tolist() == keys.tolist()


def test_a_spelled_word_has_a_probability(spark):
    """Over all words of up to two letters of a small alphabet and the rest, chances sum to no more than one."""
    docs = spark.createDataFrame([(i, f"red green blue {a}{b}") for i, (a, b) in enumerate(product("abc", "xyz"))], "doc_id long, text string")
    blocks = mixlm.pack_blocks(docs, F.lit(False))
    total, n = blocks.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    model = mixlm.fit(mixlm.describe(blocks, mixlm.count_elsewhere(blocks, 1), 1, total, 20, n))
    chance = lambda w: math.exp(mixlm.probabilities(model, [b""], [w.encode() + b"\n"], np.array([False]))[0])
    letters = "abcxyz"
    known = sum(map(chance, ["", *letters, *map("".join, product(letters, letters))]))
    assert 0.1 < known < 1.0001


def test_a_repeated_document_is_told_apart(spark):
    r = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + k) for k in r.integers(0, 26, 7))
    texts = [" ".join(word() for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), *((100 + i, texts[i]) for i in range(10))], "doc_id long, text string")
    got = {r.doc_id: r.bits_per_byte for r in mixlm.score_documents(df, F.col("doc_id") < 0).collect()}
    twice = [got[i] for i in (*range(10), *range(100, 110))]
    assert max(twice) < 0.5 * min(got[i] for i in range(10, 60))


def test_held_out_text_scores_above_the_base(spark):
    """On the given documents: what is learned from the others, spelling included, beats the add-one unigram."""
    found = mixlm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    score, base = sum(r.score for r in found), sum(r.base_score for r in found)
    assert score < 0 and base < 0 and score > 0.9 * base


def test_language_model_on_odd_tables(spark, docs, no_docs, wide_docs):
    assert mixlm.score_documents(wide_docs).columns == mixlm.score_documents(docs).columns
    one = mixlm.score_documents(spark.createDataFrame([(9, "all held out"), (9, None)], "doc_id long, text string"), F.lit(True)).collect()
    assert [(r.train_tokens, r.n_known) for r in one] == [(0, 0)] * 2 and all(math.isfinite(r.score) and r.score < 0 for r in one)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    x = (centres[r.integers(12, size=900)] + 0.7 * r.normal(size=(900, 16))).astype(np.float32)
    x[100:400] = x[100]  # one vector on a third of all rows
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (None, x[0].tolist(), 0), (1020, [float("inf")] * 16, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)


def test_permutation_search(vectors):
    found = permutation.search(vectors, F.col("vec_id") % 20 == 0).collect()
    data = {r.vec_id: np.array(r.embedding, np.float64) for r in vectors.collect() if r.vec_id is not None and r.vec_id < 900}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == [i for i in ids.tolist() if i % 20 == 0]
    hit = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in {r.vec_id for r in rows}
        assert all(abs(r.score - data[q] @ data[r.vec_id]) < 1e-9 for r in rows)
        order = [(-r.score, r.vec_id) for r in rows]
        assert order == sorted(order)
        s = x @ data[q]
        s[ids == q] = -np.inf
        hit += len({r.vec_id for r in rows} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit / (20 * len(by)) >= 0.9


def test_search_of_little_and_nothing(spark):
    ddl = "vec_id long, embedding array<float>, rank int"
    few = spark.createDataFrame([(20, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (40, [1.0, 0.0], 1)], ddl)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in permutation.search(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 40, 1.0), (20, 2, 1, 0.5), (20, 3, 2, 0.5), (40, 1, 20, 1.0), (40, 2, 1, 0.5), (40, 3, 2, 0.5)]
    assert permutation.search(spark.createDataFrame([], ddl), F.col("vec_id") % 20 == 0).count() == 0


def test_footrule_distance():
    r = np.random.default_rng(3)
    x, pivots = r.normal(size=(30, 8)), r.normal(size=(20, 8))
    order = permutation.places(x, pivots)
    for row, v in zip(order, x, strict=True):
        assert [int(p) for p in np.argsort(row)] == sorted(range(20), key=lambda p: -(v @ pivots[p]))
    got = permutation.footrule(order, order[0])
    assert got.tolist() == [sum(abs(int(a) - int(b)) for a, b in zip(order[0], row, strict=True)) for row in order] and got[0] == 0


def recall(spark, df, every):
    """Recall at 20 and exact products a query, as a share of the candidates, against brute force."""
    found = defaultdict(set)
    for r in permutation.search(df, F.col("vec_id") % every == 0).collect():
        found[r.query_id].add(r.vec_id)
    rows = df.select("vec_id", "embedding").toArrow()
    ids, x = rows.column(0).to_numpy(), np.stack(rows.column(1).to_numpy()).astype(np.float64)
    at = {int(d): i for i, d in enumerate(ids.tolist())}
    hit = 0
    for q in found:
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        hit += len(found[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    return hit / (20 * len(found))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    assert recall(spark, df, 20) >= 0.95


def test_recall_and_work_on_a_large_table(spark, tmp_path):
    """200,000 vectors of many blocks, made as label means and noise; a hundredth of them is compared exactly."""
    r, n = np.random.default_rng(2), 200_000
    centres = 0.03 * r.normal(size=(10, 64))
    x = centres[r.integers(10, size=n)] + 0.125 * r.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.astype(np.float32).ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    assert recall(spark, spark.read.parquet(str(tmp_path / "v.parquet")), 5000) >= 0.95
    assert permutation.reranked(2000) <= 0.2 * 2000 and permutation.reranked(n) < 0.01 * n


def test_scores_are_of_the_original_doubles(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 8)) + 1e-9 * r.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for row in permutation.search(df, F.col("vec_id") % 20 == 0).collect():
        assert row.score == np.einsum("j,j->", x[row.query_id], x[row.vec_id]) or abs(row.score - x[row.query_id] @ x[row.vec_id]) < 1e-14


def test_number_signs_are_no_letters():
    from corpusmith.llm.langid import letters_of

    assert letters_of(["½", "²", "①", "Ⅷ", "Ab1", "été", "ʼn"]) == ["", "", "", "", "ab", "été", "ʼn"]
