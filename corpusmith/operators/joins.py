"""Joins and set operations of the build: latest record wins, prefer-left merge, incremental load, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SetupError
from ..scratch import materialise


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key by ``order`` (for example file name and line)."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return records.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def retry_set(records: DataFrame, order: list[str]) -> DataFrame:
    """Titles whose last record is a timeout, sorted."""
    last = records.groupBy("title").agg(F.max_by("error", F.struct(*order)).alias("error"))
    return last.filter(F.col("error").startswith("timeout:")).select("title").orderBy("title")


def prefer_left(left: DataFrame, right: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Full outer merge: a key's first right-hand row (by ``order``) takes the left row's columns where there is one;
    its later rows keep their own; left rows without a right one are appended. ``source`` says which side gave it.

    ``left`` has each key once (see ``latest``)."""
    numbered = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    mine = left.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_left_{c}") for c in columns], F.lit(True).alias("_left"))
    joined = numbered.join(mine, (F.col(key) == F.col("_key")) & (F.col("_n") == 1), "full_outer")
    taken = F.col("_left").isNotNull()
    return joined.select(F.coalesce(key, "_key").alias(key), *[F.when(taken, F.col(f"_left_{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.when(taken & F.col("_n").isNull(), "left_only").when(taken, "left").otherwise("right").alias("source"))


def new_rows(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows with a key that the store lacks; rows without a key are skipped."""
    return rows.filter(F.col(key).isNotNull()).join(store.select(key), key, "left_anti")


def siblings(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """pageid and its chunks in id order, for every page that was hit."""
    pages = hits.select("pageid").filter(F.col("pageid").isNotNull()).distinct()
    found = chunks.join(pages, "pageid", "left_semi").groupBy("pageid")
    return found.agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("chunks"))


def point_get(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of the named ids; null and unknown ids give none."""
    return chunks.join(ids.select("chunk_id").filter(F.coalesce(F.col("chunk_id"), F.lit("")) != "").distinct(), "chunk_id", "left_semi")


def in_batches(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``batch`` numbers of ``size`` rows in order. Rows are numbered within ranges of the order, which are then added
    up, so no task holds all rows."""
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    # Written once: a second evaluation could cut the ranges elsewhere.
    ranged = materialise(ranged, "batches").withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m") - F.shiftleft("_p", 33))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))  # a row per partition
    return ranged.join(F.broadcast(starts), "_p").withColumn("batch", F.floor((F.col("_s") + F.col("_i")) / size).cast("long")).drop("_p", "_i", "_s", "_m")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def check_unique(rows: DataFrame, key: str, expected: int | None = None) -> int:
    """The number of rows, after checking that keys are unique and, where given, that the number is as expected."""
    n, keys = rows.agg(F.count("*"), F.count_distinct(F.col(key))).first()
    if expected is not None and n != expected:
        raise SetupError(f"{n} rows where {expected} were expected")
    if n != keys:
        raise SetupError(f"{key} repeats, for example {duplicate_keys(rows, key).first()[0]!r}")
    return n


def zip_strict(*arrays: Column) -> Column:
    """arrays_zip of arrays of one length; others fail the job."""
    same = [F.size(arrays[0]) == F.size(a) for a in arrays[1:]]
    ok = F.lit(True)
    for s in same:
        ok = ok & s
    return F.when(ok, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays differ in length")))


def health(rows: DataFrame | None, error: str | None = None) -> dict:
    """status ok, missing or error, and the number of rows."""
    if error:
        return {"status": "error", "rows": None, "detail": error}
    if rows is None:
        return {"status": "missing", "rows": 0}
    return {"status": "ok", "rows": rows.count()}
