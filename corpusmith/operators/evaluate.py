"""Evaluation of retrieval and of gates, as grouped aggregates over all records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import text as T

THRESHOLDS = (0.7, 0.8, 0.9)
SHIP_RATE = 0.01


def norm_url(url: Column) -> Column:
    return F.regexp_replace(T.strip(url), r"/+$", "")


def gold_hits(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """gold with rank: the first hit whose URL or title is the gold one's, null if none.

    Two equi-joins, on the URL and on the title, in place of one on either."""
    url = hits.select("qid", norm_url(F.col("url")).alias("_u"), "rank")
    title = hits.select("qid", F.col("title").alias("_t"), "rank")
    keyed = gold.select("qid", norm_url(F.col("source_url")).alias("_u"), F.col("source_title").alias("_t"))
    found = keyed.join(url, ["qid", "_u"]).select("qid", "rank").unionByName(keyed.join(title, ["qid", "_t"]).select("qid", "rank"))
    return gold.join(found.groupBy("qid").agg(F.min("rank").alias("rank")), "qid", "left")


def hit_rates(ranked: DataFrame) -> DataFrame:
    """Overall, per game and per category in one pass: game, category, n, hits, hit_rate, mean_rank (of hits)."""
    hit = F.col("rank").isNotNull().cast("int")
    return ranked.groupingSets([[], [F.col("game")], [F.col("category")]], F.col("game"), F.col("category")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("hit_rate"), F.avg("rank").alias("mean_rank"), F.grouping_id().alias("level"))


def totals(answers: DataFrame, foreign: str = "foreign_tags") -> DataFrame:
    """One row over all answers: n, errors, and leaks (answers whose sources carry a foreign tag)."""
    return answers.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.coalesce(F.col(foreign), F.lit("")) != "").alias("leaks"))


def case_sets(**sets: DataFrame) -> DataFrame:
    """The sets under one another with their names in ``kind``; columns that a set does not have are null in it."""
    named = [df.withColumn("kind", F.lit(kind)) for kind, df in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def first_of(cases: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first n cases in ``order``; all of them for None."""
    return cases if n is None else cases.orderBy(order).limit(n)


def rate(condition: Column) -> Column:
    """An aggregate: the share of rows where the condition holds, 0 without rows."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(0.0))


def sweep(records: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Each gate record at each threshold: blocked, escalated, declined."""
    t = F.col("threshold")
    rows = records.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    again = D.replay(F.col("check1"), F.col("check2"), F.col("tier"), t)
    blocked = F.coalesce(F.col("topic.choice") == "off_topic", F.lit(False)) & D.at_least(F.col("topic.confidence"), t)
    return rows.withColumns({"blocked": blocked, "_a": again}).withColumns({"escalated": F.col("_a.escalated"), "declined": F.col("_a.declined")}).drop("_a")


def ship_threshold(swept: DataFrame, field: str) -> DataFrame:
    """One row: the lowest threshold whose rate over gold records is at most SHIP_RATE, 'disable' if none is; without
    records the lowest of all."""
    per = swept.filter("kind = 'gold'").groupBy("threshold").agg(rate(F.col(field)).alias("r"))
    return per.agg(F.coalesce(F.min(F.when(F.col("r") <= SHIP_RATE, F.col("threshold"))).cast("string"), F.when(F.count("*") == 0, str(min(THRESHOLDS))).otherwise("disable")).alias("threshold"))


def gate_summary(swept: DataFrame) -> DataFrame:
    """The grid of rates per threshold."""
    mean = lambda kind, field: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col(field).cast("int"))), F.lit(0.0))
    return swept.groupBy("threshold").agg(mean("gold", "blocked").alias("gold_blocked"), mean("off_topic", "blocked").alias("off_topic_caught"), mean("gold", "declined").alias("gold_declined"), mean("not_covered", "declined").alias("not_covered_declined"), mean("follow_up", "blocked").alias("follow_up_blocked"), mean("follow_up", "declined").alias("follow_up_declined"), mean("gold", "escalated").alias("gold_escalated"))


def format_distribution(records: DataFrame) -> DataFrame:
    """Counts of the format hints, zeros included."""
    choice = F.col("format.choice")
    return records.agg(*[F.count_if(F.coalesce(choice == f, F.lit(False))).alias(f) for f in D.FORMATS], F.count_if(choice.isNull() | ~choice.isin(list(D.FORMATS))).alias("none"))


def within_budget(cases: DataFrame, cap: int, order: str = "i", calls: str = "calls", bucket: int = 100_000) -> DataFrame:
    """The cases whose calls, summed in order, stay within the cap; the case that would pass it is dropped, with all after.

    Sums are taken in ranges of ``order`` (a dense number) and the ranges added up, so no task holds all cases."""
    ranged = cases.withColumn("_b", F.floor(F.col(order) / bucket))
    totals = ranged.groupBy("_b").agg(F.sum(calls).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(starts, "_b").withColumn("running", F.col("_s") + F.sum(calls).over(inside)).filter(F.col("running") <= cap).drop("_b", "_s")


def tag_histogram(hits: DataFrame, game: str = "game") -> DataFrame:
    """qid, tags: each question's hits counted by label, sorted."""
    counts = hits.groupBy("qid", game).agg(F.count("*").alias("n"))
    return counts.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(game, "n")))).alias("tags"))
