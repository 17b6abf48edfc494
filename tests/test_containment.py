"""Containment against Python's own ``in``, and hit rates where passages are short, begin inside words or end at points."""

import random

from corpusmith.operators import containment


def pairs(spark, texts, passages, **kw):
    a = spark.createDataFrame(texts, "tid long, text string").repartition(3)
    b = spark.createDataFrame(passages, "pid string, passage string")
    return sorted((r["tid"], r["pid"]) for r in containment.holds(a, b, "tid", "text", "pid", "passage", **kw).collect())


def expected(texts, passages):
    return sorted((t, p) for t, text in texts for p, passage in passages if text is not None and passage is not None and passage in text)


def test_equals_in(spark):
    r = random.Random(6)
    texts = [(i, "".join(r.choice("ab é😀.\n") for _ in range(r.randint(0, 90)))) for i in range(120)] + [(500, None), (501, ""), (502, "ab" * 50_000), (502, "ab" * 50_000)]
    cuts = [t[i : i + r.choice([1, 2, 5, 40, 80])] for _, t in texts[:120] if t for i in [r.randrange(len(t))]]
    passages = [(f"p{i}", c) for i, c in enumerate(cuts)] + [("none", None), ("empty", ""), ("p0", cuts[0]), ("long", "ab" * 60), ("longer", "ab" * 60 + "c"), ("absent", "zzz")]
    want = expected(texts, passages)
    assert pairs(spark, texts, passages) == want
    assert pairs(spark, texts, passages, part_bytes=300) == want  # many automata
    assert pairs(spark, texts, []) == [] and pairs(spark, [], passages) == []


def test_hit_rates_of_short_passages(spark, tmp_path):
    """One word, a piece inside words, five words before a point, a long passage: all four are found."""
    from corpusmith.queries import QUERIES

    spark.createDataFrame([(0, "alpha beta gamma. one two three four five, six", "en", "s", 1), (1, "the unbelievable story of a river", "en", "s", 1), (2, "nothing here at all", "fr", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "gamma"), (1, "believ"), (2, "one two three four five"), (3, "the unbelievable story of a river")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["gold_hit_rate"](spark, str(tmp_path)).filter("game IS NULL AND category IS NULL").collect()
    assert [r["n"] for r in rows] == [4]
