"""The limiter on typed state against its batch form, over several starts, from admissions before, and what idle keys leave."""

import random

from corpusmith.streaming import keyed, stateful
from pyspark.sql import functions as F

REQUESTS = "key string, s long"


def test_starts_equal_the_batch_and_idle_keys_leave_nothing(spark, tmp_path):
    r = random.Random(3)
    rows = sorted({(f"k{r.randint(0, 3)}", 1_700_000_000 + r.randint(0, 900)) for _ in range(260)}, key=lambda x: x[1])
    rows += [("late", 1_700_009_000)]
    df = spark.createDataFrame(rows, REQUESTS).withColumn("ts", F.timestamp_seconds("s"))
    before = spark.createDataFrame([("k0", 1_699_999_990), ("k0", 1_699_999_995), ("k1", 1_699_999_000), ("gone", 1_699_999_999)], REQUESTS).withColumn("ts", F.timestamp_seconds("s"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "10 seconds")
    for lot, (a, b) in enumerate(((0, 450), (450, 901), (901, 99_999))):
        part = df.filter(F.col("s").between(1_700_000_000 + a, 1_700_000_000 + b - 1))
        part.select("key", "ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with keyed.rocksdb(spark):
            limited = keyed.limit_stream(stream, "key", "ts", 2, 60.0, before)
            limited.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
        if lot == 1:
            held = {x.key for x in spark.read.format("statestore").option("stateVarName", "hits").load(f"{tmp_path}/cp").select("key.key").collect()}
            assert held and "gone" not in held
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("key", "ts", "allowed").collect()))
    whole = stateful.limit(df.select("key", "ts").unionByName(before.filter("key = 'k0'").select("key", "ts")), "key", "ts", 2, 60.0).filter("ts >= '2023-11-14 22:13:20'")
    assert got == sorted(map(tuple, whole.select("key", "ts", "allowed").collect()))
    assert {x[2] for x in got} == {True, False}
    held = {x.key for x in spark.read.format("statestore").option("stateVarName", "hits").load(f"{tmp_path}/cp").select("key.key").collect()}
    assert held == {"late"}  # the timers of all others have passed
