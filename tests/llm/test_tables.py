"""TIFF pages, source mixing, personal data, and the pipeline."""

import hashlib
import math
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpusmith.llm import bpe, mixing, pii, resemblance, tiff

from .conftest import DOCS, make_docs


def test_tiff_round_trips():
    r = np.random.default_rng(0)
    for compression in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for predictor in (False, True):
            for tile in (0, 16):
                pages = [(r.integers(0, 256, (int(r.integers(1, 90)), int(r.integers(1, 70)))) // r.integers(1, 100)).astype(np.uint8) for _ in range(2)]
                back = list(tiff.read(tiff.write(pages, compression, predictor, 32, tile)))
                assert len(back) == 2 and all((a == b.pixels[:, :, 0]).all() for a, b in zip(pages, back, strict=True))
    for n in (1, 255, 256, 509, 510, 511, 512, 513, 3836, 3837, 3838, 3839, 3840, 20_000):
        for k in (2, 256):
            data = r.integers(0, k, n).astype(np.uint8).tobytes()
            assert tiff.unlzw(tiff.lzw(data), n) == data and tiff.unpackbits(tiff.packbits(data), n) == data


def test_packbits_known_bytes():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    data = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22") + b"\xaa" * 10
    assert tiff.unpackbits(packed, 24) == data
    assert tiff.unpackbits(tiff.packbits(data), 24) == data


def big_endian(pixels, depth=16):
    """A page written by hand: big-endian, two rows, 16 bits, old deflate, predictor."""
    raw = zlib.compress(np.diff(pixels.astype(">u2"), axis=1, prepend=np.zeros((2, 1), ">u2")).astype(">u2").tobytes())
    tags = [(256, 3, pixels.shape[1]), (257, 3, 2), (258, 3, depth), (259, 3, 32946), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, len(raw)), (317, 3, 2)]
    body = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    return b"MM\0*" + struct.pack(">I", 8 + len(raw)) + raw + struct.pack(">H", len(tags)) + body + b"\0\0\0\0"


def test_tiff_pages_and_damage(spark):
    pixels = np.array([[1, 300, 65535, 7], [9, 9, 8, 0]])
    good = tiff.write([np.full((3, 5), 7, np.uint8), np.zeros((2, 2), np.uint8)])
    loop = bytearray(good)
    at = struct.unpack_from("<I", good, 4)[0]
    n = struct.unpack_from("<H", good, at)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    files = [("a", good), ("b", big_endian(pixels)), ("c", b"junk"), ("d", None), ("e", good[:40]), ("f", bytes(loop)), ("a", good)]
    rows = tiff.decode_pages(spark.createDataFrame(files, "path string, content binary")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.path].append(r)
    assert [sorted(r.page for r in by["a"])] == [[0, 0, 1, 1]]
    assert np.array_equal(np.frombuffer(by["b"][0].pixels, "<u2").reshape(2, 4), pixels)
    assert all(by[k][0].page is None and by[k][0].error for k in "cde")
    assert [r.page for r in by["f"]] == [0, None]
    assert tiff.decode_pages(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_more_pages_than_sixteen_bits_count():
    """Every directory is a page, however many there are."""
    page = tiff.write([np.zeros((1, 1), np.uint8)], tiff.PLAIN)
    at = struct.unpack_from("<I", page, 4)[0]
    n = struct.unpack_from("<H", page, at)[0]
    entry, count = page[at : at + 2 + 12 * n], 70_000
    chain = [entry + struct.pack("<I", len(page) + (i + 1) * (len(entry) + 4) if i + 1 < count else 0) for i in range(count)]
    data = bytearray(page) + b"".join(chain)
    struct.pack_into("<I", data, 4, len(page))
    assert sum(1 for _ in tiff.read(bytes(data))) == count


def test_texts_as_tiff_beside_columns_of_its_own_names(docs, wide_docs):
    key = lambda rows: sorted((r.doc_id or -1, r.payload_sha256, r.feature) for r in rows)
    assert key(tiff.texts_as_tiff(wide_docs.withColumn("pages", wide_docs.ids).withColumn("feature", wide_docs.ids)).collect()) == key(tiff.texts_as_tiff(docs).collect())


def test_texts_as_tiff(docs, no_docs, monkeypatch):
    by = {r.doc_id: r.text for r in docs.collect()}
    found = tiff.texts_as_tiff(docs).collect()
    for r in found:
        data = (by[r.doc_id] or "").encode()
        full = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        media = tiff.store(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert tiff.texts_as_tiff(no_docs).count() == 0
    monkeypatch.setattr(tiff, "PAGE_ROWS", 3)
    data = bytes(range(256)) * 4
    assert b"".join(p.pixels.tobytes() for p in tiff.read(tiff.store(data))) == data


def fill(sizes, share=1.5, repeat=2):
    """The targets by resharing step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if each * weight[s] > repeat * sizes[s]}
        if not full:
            return target | {s: each * weight[s] for s in open_}
        for s in full:
            target[s] = repeat * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("block", [16, 8192])
def test_mix_against_brute_force_and_sql(docs, block):
    got = mixing.mix_sources(docs, block=block).toPandas()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    target, taken = fill(sizes), defaultdict(int)
    assert len(got) == docs.count()
    for r in got.itertuples():
        source = r.source if isinstance(r.source, str) else None
        assert r.source_size == sizes[source] and abs(r.target - target[source]) < 1e-6 and r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(mixing.mix_sql(block=block)).fetchall()
    key = lambda r: tuple((x is None or x != x, 0 if x is None or x != x else x) for x in (r[0], r[1], r[4], r[6], r[7]))
    mine = sorted(got[["doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "n_slots"]].itertuples(index=False), key=key)
    assert list(map(key, mine)) == [key(r) for r in sorted(want, key=key)]
    assert all((r.first_slot >= 0) == (r.taken > 0) == (r.n_slots > 0) for r in got.itertuples())


def test_mix_schedule_interleaves(docs, no_docs):
    placed, pieces, slots = mixing.plan_mix(docs, block=16)
    rows = slots.orderBy("slot").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sid].append(r)
    for own in by.values():
        assert [r["rank"] for r in own] == list(range(len(own)))
    # Low discrepancy: in every run of slots from the first each source is within a logarithm of its target's share.
    target = {r.sid: r.target for r in placed.select("sid", "target").distinct().collect()}
    seen, total = defaultdict(int), sum(target.values())
    for r in rows[: len(rows) // 2]:
        seen[r.sid] += 1
        n = r.slot + 1
        assert abs(seen[r.sid] - n * target[r.sid] / total) <= 3 + 3.53 * math.log(n + 1)
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.repeat_documents(no_docs).count() == 0
    pieces = mixing.mixed_pieces(docs, block=16).collect()
    assert all(r.word_from < r.word_to for r in pieces)


def test_repeat_documents(docs, wide_docs):
    mix = mixing.mix_sources(docs).filter("taken > 0").collect()
    want = defaultdict(int)
    for r in mix:
        want[r.doc_id] += -(-r.taken // r.size)
    got = defaultdict(int)
    for r in mixing.repeat_documents(docs).collect():
        got[r.doc_id] += 1
    assert got == want
    assert mixing.repeat_documents(wide_docs).columns == wide_docs.columns


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_patterns_on_random_text():
    r = np.random.default_rng(6)
    for alphabet in ("ab@.-_ ", "0123456789.  ", "0459- +().", "a1@.+ 4é-"):
        for _ in range(2500):
            text = "".join(r.choice(list(alphabet), int(r.integers(0, 60))))
            assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("x 4111 1111 1111 1111 y 4111111111111112")[:1] == [("card", 2, 21)]


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "+1" * 50_000, "a@" * 50_000, "1." * 50_000):
        pii.base_spans(text)


def test_disclosing_terms(spark):
    rows = [(i, f"Ask Quentin Zweig at q.zweig@corp.example about the {w} report", "en", "s", 1) for i, w in enumerate(["first", "second", "third", "fourth"])]
    rows += [(10 + i, f"the {w} report about the house at noon: ask anyone", "en", "s", 1) for i, w in enumerate(["first", "second", "red", "blue", "green", "grey"])]
    rows += [rows[0], (99, None, "en", "s", 1), (100, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    text = rows[1][1]
    terms = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[1].spans.split(",")) if k == "term"}
    assert terms == {"Quentin", "Zweig"}
    assert got[1].base == pii.joined(plain_spans(text)) and got[1].spans.startswith(got[1].base)
    assert all(got[i].spans == "" for i in (10, 11, 99, 100))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[1] == "Ask [TERM] [TERM] at [EMAIL] about the second report" and clean[10] == rows[4][1] and clean[99] is None


def test_an_entity_of_one_document_has_disclosing_terms(spark):
    rows = [(1, "ask Quentin Zweig at q.zweig@corp.example", "en", "s", 1)]
    rows += [(10 + i, "please ask about the house at noon", "en", "s", 1) for i in range(12)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert got[1].spans == "email:21:41,term:4:11,term:12:17"
    assert all(got[10 + i].spans == "" for i in range(12))
    assert {r.doc_id: r.text for r in pii.sanitise(df).collect()}[1] == "ask [TERM] [TERM] at [EMAIL]"


def test_disclosing_terms_anywhere_in_the_corpus(spark):
    filler = " ".join(["the house is by the river and people walk there"] * 8)
    rows = [(1, f"Zweig wrote. {filler} q.zweig@corp.example {filler} ask zweig", "en", "s", 1), (2, f"Zweig works here. {filler} q.zweig@corp.example", "en", "s", 1), (3, f"we met zweig, {filler}", "en", "s", 1)]
    rows += [(10 + i, filler, "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    cut = lambda d, t: [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[d].spans.split(",") if s) if k == "term"]
    assert cut(3, rows[2][1]) == ["zweig"] and got[3].base == ""
    assert cut(1, rows[0][1]).count("Zweig") == cut(1, rows[0][1]).count("zweig") == 1
    assert all(got[10 + i].spans == "" for i in range(400))


def test_personal_data_edge_tables(docs, no_docs, wide_docs):
    assert pii.find_personal_data(no_docs).count() == 0
    assert pii.sanitise(no_docs).count() == 0
    assert pii.find_personal_data(docs).count() == docs.count()
    assert pii.sanitise(wide_docs).columns == wide_docs.columns and pii.sanitise(wide_docs).count() == docs.count()
    mine = {r.doc_id: r.base for r in pii.find_personal_data(docs).collect()}
    assert all(mine[r.doc_id] == pii.joined(plain_spans(r.text or "")) for r in docs.collect() if r.doc_id is not None)


def pipeline_rows():
    """Documents of every awkward kind, with null ids (one with the text of a named document), a repeated row, near copies
    and a document that differs from its copy in its source alone."""
    rows = make_docs(60, seed=21)
    words = rows[7][1].split() + rows[8][1].split()
    rows += [(500, " ".join(words), "en", "src0", 9), (501, " ".join([*words[:-2], "other", "end"]), "en", "src1", 9), (502, " ".join(words[: len(words) // 2]), "de", None, 9)]
    return [*rows, rows[2], (None, rows[9][1], "de", "src9", 1), (None, rows[9][1], "de", "src9", 1)]


def test_pipeline_against_its_stages_done_plainly(spark, tmp_path):
    import corpus_pipeline

    rows = pipeline_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    named = {r[0]: r for r in rows if r[0] is not None and any(c.isalpha() for c in r[1] or "")}
    sets = {d: set(resemblance.shingles(r[1], 5).tolist()) for d, r in named.items()}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    up = {d: d for d in named}
    while True:
        less = {a: min(up[b] for b in named if alike(sets[a], sets[b])) for a in named}
        if less == up:
            break
        up = less
    assert sum(up[d] != d for d in up) >= 2
    kept = [named[d] for d in named if up[d] == d] + [r for r in rows if r[0] is None and any(c.isalpha() for c in r[1])]
    found = pii.find_personal_data(spark.createDataFrame(kept, DOCS)).select("doc_id", "key", "spans").distinct().collect()
    keys = {(r[0], r[1]): r.key for r in spark.createDataFrame(kept, DOCS).selectExpr("doc_id", "text", "xxhash64(text) AS key").collect()}
    spans = {(r.doc_id, r.key): r.spans for r in found}
    clean = [(d, pii.redact(t, spans[d, keys[d, t]]) if spans[d, keys[d, t]] else t, source) for d, t, _, source, _ in kept]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([c[0] for c in clean], pa.int64()), "text": [c[1] for c in clean], "source": pa.array([c[2] for c in clean], pa.string())}))
    taken = con.execute(f"SELECT doc_id, source, size, taken FROM ({mixing.mix_sql()}) WHERE taken > 0").fetchall()
    times = defaultdict(int)
    for d, source, size, n in taken:
        times[d, source] += -(-n // size)
    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = {(d, source): t for d, t, source in clean}
    want = sorted((-1 if k[0] is None else k[0], len(own.encode(text[k])) // 4, hashlib.sha256(text[k].encode()).hexdigest()) for k, n in times.items() for _ in range(n))
    mine = sorted((-1 if d != d or d is None else int(d), n, h) for d, n, h in got[["doc_id", "n_tokens", "decoded_sha256"]].itertuples(index=False, name=None))
    assert mine == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "source_mix", "encode"]


def test_pipeline_of_nothing_and_of_wide_tables(spark, tmp_path, wide_docs, no_docs):
    import corpus_pipeline

    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    wide_docs.limit(20).write.parquet(f"{tmp_path}/wide/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/wide/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/wide")
        assert docs.columns == wide_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, f"{tmp_path}/wide").count() == docs.count()


def test_mix_follows_the_slots(spark, docs):
    """The pipeline's documents stand in the order of the slots that take them."""
    _, pieces, slots = mixing.plan_mix(docs, block=64, whole=True)
    first = {}
    for r in mixing._taken(pieces, slots).groupBy("doc_id", "first", "pass").min("slot").collect():
        first.setdefault(r.doc_id, []).append(r["min(slot)"])
    order = [r.doc_id for r in mixing.repeat_documents(docs, block=64).collect()]
    at = {d: iter(sorted(x)) for d, x in first.items()}
    got = [next(at[d]) for d in order if d in at and len(first[d]) < 3]
    assert got == sorted(got) and len(order) == sum(map(len, first.values()))


def test_one_row_on_a_third_of_the_table(spark):
    """Equal rows, rows without an id, and an id on many texts are mixed like any others."""
    rows = [(7, "one two three four", "en", "a", 1)] * 300 + [(None, f"w{i} x y", "en", "b", 1) for i in range(300)] + [(8, f"z{i}", "en", f"s{i % 50}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = sorted(map(str, con.execute(f"SELECT doc_id, size, source, taken, first_slot, n_slots FROM ({mixing.mix_sql(block=16)})").fetchall()))
    got = mixing.mix_sources(df, block=16).select("doc_id", "size", "source", "taken", "first_slot", "n_slots").collect()
    assert sorted(str(tuple(r)) for r in got) == want
