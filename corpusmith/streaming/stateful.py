"""Keyed state on streams and in batch: the sliding-window rate limiter, idempotent loads, windowed counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Limiter:
    """At most ``most`` admissions per key in ``window`` seconds; a refusal leaves no trace. Without a positive ``most``
    all are admitted. Keys without recent admissions are swept once per window."""

    def __init__(self, most: int | None, window: float = 60.0):
        self.most, self.window, self.hits, self.swept = most, window, {}, 0.0

    def allow(self, key: str, now: float) -> bool:
        if not self.most or self.most <= 0:
            return True
        if now - self.swept >= self.window:
            self.swept = now
            for old in [k for k, h in self.hits.items() if not h or h[-1] <= now - self.window]:
                del self.hits[old]
        own = self.hits.setdefault(key, deque())
        return _admit(own, now, self.most, self.window)


def _admit(own: deque, now: float, most: int, window: float) -> bool:
    while own and own[0] <= now - window:
        own.popleft()
    if len(own) >= most:
        return False
    own.append(now)
    return True


def limit(requests: DataFrame, key: str, ts: str, most: int, window: float = 60.0, order: str | None = None) -> DataFrame:
    """``requests`` and allowed, in time order per key (ties by ``order``).

    Greedy admission depends on each decision before it, so a key is one sequence; it is read in sorted batches with at
    most ``most`` times in memory, however many requests the key has."""
    columns = [*requests.columns]
    sort = [key, ts, *([order] if order else [])]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = object(), deque()
        for frame in frames:
            allowed = []
            for k, now in zip(frame[key], frame["_now"], strict=True):
                if k != last:
                    last, own = k, deque()
                allowed.append(_admit(own, now, most, window))
            yield frame.drop(columns="_now").assign(allowed=allowed)

    timed = requests.withColumn("_now", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return timed.repartition(key).sortWithinPartitions(*sort).mapInPandas(run, f"{ddl}, allowed boolean").select(*columns, "allowed")


def stream_limit(requests: DataFrame, key: str, ts: str, most: int, window: float = 60.0) -> DataFrame:
    """The limiter on a stream: key, ts, allowed. The state of a key is its last admissions; it times out one window
    after the watermark has passed the newest. ``requests`` carries a watermark on ``ts``."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(ts)
        now = rows[ts].astype("int64") / 1e9 if str(rows[ts].dtype).endswith("[ns]") or "ns" in str(rows[ts].dtype) else rows[ts].astype("int64") / 1e6
        allowed = [_admit(own, t, most, window) for t in now]
        state.update((list(own),))
        until = int((max(own, default=0) + window) * 1000)
        if until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame({key: rows[key], ts: rows[ts], "allowed": allowed})

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, allowed boolean", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark; works in batch too."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def load_new(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Append rows whose key ``path`` lacks, exactly once per key: a micro-batch is deduplicated and anti-joined with
    what is stored, so replaying it after a failure adds nothing. Runs what is available and stops."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        rows.select(batch.columns).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def body_guard(parts: DataFrame, request: str, seq: str, size: str, most: int = 1 << 20) -> DataFrame:
    """Requests whose parts, summed in order, pass ``most`` bytes: request, refused_at (the part)."""
    running = F.sum(size).over(Window.partitionBy(request).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_r", running).filter(F.col("_r") > most).groupBy(request).agg(F.min(seq).alias("refused_at"))
