"""The segmented index: pruned answers against every score, states after random writes against an index made anew, and
writers that die or come second."""

import random

import numpy as np
import pyarrow as pa
import pytest
from corpusmith.operators import blockmax, lexical
from corpusmith.scratch import new_folder
from corpusmith.sources import segments
from corpusmith.sources.segments import Conflict, Segment, SegmentedIndex, put_new
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, text string, games array<string>"
WORDS = "river stone walk bright garden people music water table singing copper winter lamp".split()


def made(n, seed, first=0):
    r = random.Random(seed)
    out = []
    for i in range(first, first + n):
        text = " ".join(r.choice(WORDS[: 2 + i % len(WORDS)]) + r.choice(["", "", "s", str(i % 7)]) for _ in range(r.choice([0, 1, 5, 20, 60])))
        out.append((f"c{i:04d}", text or None, r.choice([["a"], ["b"], ["a", "b"], [], None])))
    return out


QUESTIONS = [(1, "bright river walks", None), (2, "the stone", "a"), (3, "garden garden lamp winters copper3 music", "b"), (4, "", None), (5, "absent", None), (6, " ".join(WORDS), None), (7, "water", "c")]


def expected(spark, rows, n):
    """Every score by the plain index, cut and filtered afterwards."""
    chunks = spark.createDataFrame(rows, CHUNKS).withColumn("text", F.coalesce("text", F.lit("")))
    index = lexical.build_index(chunks)
    asked = spark.createDataFrame(QUESTIONS, "qid long, question string, game string")
    games = chunks.select("chunk_id", F.coalesce("games", F.array().cast("array<string>")).alias("games"))
    allowed = asked.select("qid", "game").crossJoin(games).filter("game IS NULL OR array_contains(games, game)").select("qid", "chunk_id")
    return hits(lexical.search(index, asked, n, allowed=allowed))


def hits(df):
    return sorted((r["qid"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


def searched(spark, index, n=6):
    return hits(index.search(spark.createDataFrame(QUESTIONS, "qid long, question string, game string"), n, facet="game"))


def test_adds_drops_and_merges_equal_an_index_made_anew(spark):
    r = random.Random(4)
    index, live = SegmentedIndex(spark, new_folder(spark, "ix"), part_tokens=700), {}
    for step in range(5):
        rows = made(70, step, step * 55) + [(None, "no id", None)]
        rows += [rows[0]]
        new = {x[0]: x for x in rows if x[0] and x[0] not in live}
        assert index.add(spark.createDataFrame(rows, CHUNKS)) == len(new)
        live.update(new)
        gone = r.sample(sorted(live), 20)
        assert index.drop(spark.createDataFrame([(g,) for g in gone] + [("never",)], "chunk_id string")) == 20
        for g in gone:
            del live[g]
        if step in (1, 4):
            assert searched(spark, index) == expected(spark, list(live.values()), 6)
    went = index.merge()
    assert went >= segments.FANOUT and searched(spark, index) == expected(spark, list(live.values()), 6)
    assert index.stats(index.manifest()[1])[0] == len(live) == index.chunks().count()
    assert index.vacuum() > 0 and searched(spark, index) == expected(spark, list(live.values()), 6)
    assert index.add(spark.createDataFrame(list(live.values()), CHUNKS)) == 0
    assert index.drop(index.chunks()) == len(live) and searched(spark, index) == []


def test_an_empty_index(spark):
    index = SegmentedIndex(spark, new_folder(spark, "ix"))
    assert index.manifest() == (0, []) and searched(spark, index) == []
    assert index.add(spark.createDataFrame([], CHUNKS)) == 0 and index.merge() == 0 and index.drop(spark.createDataFrame([], "chunk_id string")) == 0


def test_a_writer_that_dies_leaves_the_last_manifest(spark, monkeypatch):
    index = SegmentedIndex(spark, new_folder(spark, "ix"))
    index.add(spark.createDataFrame(made(30, 1), CHUNKS))
    before, found = index.manifest(), searched(spark, index)
    monkeypatch.setattr(SegmentedIndex, "_write_blocks", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        index.add(spark.createDataFrame(made(30, 2, 500), CHUNKS))
    monkeypatch.undo()
    assert index.manifest() == before and searched(spark, index) == found
    assert index.vacuum() == 1 and searched(spark, index) == found


def test_the_second_writer_begins_anew(spark, monkeypatch):
    """Another writer adds the same chunks, and more, between a writer's reading and its commit."""
    path = new_folder(spark, "ix")
    index, other = SegmentedIndex(spark, path), SegmentedIndex(spark, path)
    rows = made(40, 3)
    commit, tried = SegmentedIndex._commit, []

    def late(self, version, now):
        if self is index and not tried:
            tried.append(version)
            other.add(spark.createDataFrame(rows[:25], CHUNKS))
        commit(self, version, now)

    monkeypatch.setattr(SegmentedIndex, "_commit", late)
    assert index.add(spark.createDataFrame(rows, CHUNKS)) == 15 and tried == [0]
    version, found = index.manifest()
    assert version == 2 and sorted(s.chunks for s in found) == [15, 25] and index.chunks().count() == 40
    with pytest.raises(Conflict):
        commit(index, 1, [Segment("x", 1, 1, 1)])
    assert not put_new(spark, f"{path}/manifest/000000002.json", "{}") and index.manifest()[0] == 2


def test_blocks_hold_what_they_were_made_from():
    r = np.random.default_rng(2)
    for n in (1, 127, 128, 129, 5000):
        ords = np.sort(r.choice(200_000, n, replace=False))
        tfs, lengths = r.integers(1, 400, n), r.integers(1, 90_000, 200_000)
        table = blockmax.part_blocks(3, ["t"], np.zeros(n, int), ords, tfs, lengths, [["a"] if i % 5 == 0 else None for i in range(200_000)]).to_pandas()
        part = blockmax._Part(table, 300.0)
        got = [part.open("t", b) for b in range(len(part.lists["t"].n))]
        assert (np.concatenate([g[0] for g in got]) == ords).all()
        value = np.concatenate([g[1] for g in got])
        assert np.allclose(value, blockmax.impact(tfs, lengths[ords], 300.0))
        assert (part.lists["t"].high[ords // blockmax.RUN] >= value - 1e-12).all()
        assert (part.allowed["a"] == np.arange(0, 200_000, 5)).all()


def test_few_postings_are_scored_where_lengths_and_terms_differ(spark):
    """A rare term sets the edge; the frequent ones are only looked up."""
    r = random.Random(8)
    rows = [(f"c{i}", " ".join(["often"] * r.randint(1, 3) + ["filler"] * r.randint(10, 200) + (["rare"] * 3 if i % 400 == 0 else [])), None) for i in range(8000)]
    index = SegmentedIndex(spark, new_folder(spark, "ix"), part_tokens=10**9)
    index.parts_for = lambda tokens: 1
    index.add(spark.createDataFrame(rows, CHUNKS))
    asked = spark.createDataFrame([(1, "rare often filler")], "qid long, question string")
    counted = index.answers(asked, 5).filter("ord < 0").first()
    assert counted["scored"] < 0.02 * 16_000 and counted["opened"] < 0.6 * 16_000
    plain = lexical.search(lexical.build_index(spark.createDataFrame(rows, CHUNKS)), asked, 5)
    assert hits(index.search(asked, 5)) == hits(plain)


def test_merge_opens_blocks_many_at_once(spark, tmp_path, monkeypatch):
    """Segments are taken apart in messages of many blocks, and however many these are the chunks' terms are the same."""
    from corpusmith.sources import segments

    index = segments.SegmentedIndex(spark, f"{tmp_path}/many", "long")
    texts = [(i, " ".join(f"w{j}" for j in range(15) for _ in range(1 + (i + j) % 3) if (i * 5 + j) % 4), ["a"]) for i in range(300)] + [(300, "", ["b"])]
    index.add(spark.createDataFrame(texts, "chunk_id long, text string, games array<string>"))
    read = lambda: {r.chunk_id: sorted(r.terms) for r in index._terms(index.manifest()[1]).collect()}
    whole = read()
    assert whole == {i: sorted(text.split()) for i, text, _ in texts}
    monkeypatch.setattr(segments, "OPENED", 2)
    assert read() == whole


def test_blocks_are_made_once_and_pack_as_one_by_one(spark, tmp_path):
    rng = np.random.default_rng(2)
    key = np.unique(np.minimum(rng.zipf(1.3, 40_000), 9000) * 200_000 + rng.integers(0, 200_000, 40_000))
    code, ords = key // 200_000 - 1, key % 200_000
    tfs = np.minimum(rng.zipf(1.3, len(key)), 100_000)
    table = blockmax.part_blocks(0, [f"t{i}" for i in range(9000)], code, ords, tfs, rng.integers(1, 70_000, 200_000), [["a"] if i % 5 == 0 else None for i in range(200_000)])
    rows = [r for r in table.to_pylist() if not r["term"].startswith(blockmax.MARK)]
    at = 0
    for r in rows:
        own = slice(at, at + r["n"])
        o, t, at = ords[own], tfs[own], at + r["n"]
        runs = np.unique(o // blockmax.RUN)
        assert (r["term"], r["first"], r["last"]) == (f"t{code[own][0]}", o[0], o[-1]) and len(set(code[own])) == 1
        assert (r["ords"], r["tfs"], r["runs"]) == (blockmax._packed(o - o[0]), blockmax._packed(t), blockmax._packed(runs - o[0] // blockmax.RUN))
        assert r["tops"] == blockmax._packed(np.array([t[o // blockmax.RUN == x].max() for x in runs])) and bool(r["facets"]) == bool((o % 5 == 0).any())
    assert at == len(key)

    made = spark.sparkContext.accumulator(0)

    def again(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    index = SegmentedIndex(spark, str(tmp_path / "once"), "long")
    blocks = spark.createDataFrame(table.slice(0, 500).to_pandas(), blockmax.BLOCKS_DDL).mapInPandas(again, blockmax.BLOCKS_DDL)
    index._write_blocks("s1", blocks, 100)
    assert made.value == 500 and index._blocks(["s1"]).count() == 500


def test_no_loop_over_blocks(monkeypatch):
    """Blocks are unpacked together, with the numbers of one after another, whatever their widths."""
    r = np.random.default_rng(3)
    values = [r.integers(0, top, n) for top, n in ((200, 7), (60_000, 128), (1 << 20, 1), (1, 5), (256, 64), (3, 1), (65_536, 2))]
    begin = np.cumsum([0, *map(len, values)])[:-1]
    packed = blockmax._packed_all(np.concatenate(values), begin)
    assert packed.to_pylist() == [blockmax._packed(v) for v in values]
    for some, own in ((packed, values), (packed.slice(1, 4), values[1:5]), (packed.cast(pa.large_binary()), values), (packed.slice(0, 0), [])):
        n = np.array([len(v) for v in own], np.int64)
        assert blockmax._unpacked_all(some, n).tolist() == [int(y) for v in own for y in v]
    words = [f"w{i}" for i in range(300)]
    rows = [{"part": 0, "ord": i, "terms": r.choice(words, 40).tolist(), "games": ["x"]} for i in range(500)]
    schema = pa.schema([("part", pa.int32()), ("ord", pa.int32()), ("terms", pa.list_(pa.string())), ("games", pa.list_(pa.string()))])
    table, calls = blockmax.encode(pa.Table.from_pylist(rows, schema)).to_pandas(), []
    real = blockmax._unpacked
    monkeypatch.setattr(blockmax, "_unpacked", lambda *a: calls.append(a) or real(*a))
    part = blockmax._Part(table, 40.0)
    assert len(part.lists) == 300 and len(calls) <= 2  # lengths and one facet
    lengths = {t: sum(int(x) for x in a.n) for t, a in part.lists.items()}
    assert lengths == {w: sum(w in row["terms"] for row in rows) for w in words}
