"""The rate limiter on typed keyed state: a list of admissions, an event-time timer that clears it, a start from a batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import _admit

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which typed state needs; later ones do as before."""
    was = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class RateLimiter(StatefulProcessor):
    """At most ``most`` admissions of a key in ``window`` seconds; a refusal leaves no trace. ``hits`` holds the admissions
    of the last window. A timer stands one window after the newest; once the watermark has passed it, nothing is left of
    the key."""

    def __init__(self, ts: str, most: int, window: float):
        self.ts, self.most, self.window = ts, most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.hits = handle, handle.getListState("hits", "at double")

    def _keep(self, own: deque) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if own:
            self.hits.put([(at,) for at in own])
            self.handle.registerTimer(int((own[-1] + self.window) * 1000) + 1)
        else:
            self.hits.clear()

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        known = sorted([at for (at,) in self.hits.get()] + [initialState["at"]])
        self._keep(deque(known[-self.most :]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        own = deque(at for (at,) in self.hits.get())
        for at in sorted(row[self.ts] for row in rows):
            yield Row(**{"key": key[0], self.ts: at, "allowed": _admit(own, _seconds(at), self.most, self.window)})
        self._keep(own)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.hits.clear()
        return iter([])

    def close(self) -> None:
        pass


def _seconds(at: datetime) -> float:
    return at.timestamp()


def limit_stream(requests: DataFrame, key: str, ts: str, most: int, window: float = 60.0, admitted: DataFrame | None = None) -> DataFrame:
    """The limiter on a stream with a watermark on ``ts``: key, ts, allowed. ``admitted`` (key, ts), a batch, gives the
    admissions before the first start. Start the query within ``rocksdb``. A batch's requests of one key are sorted in
    memory, as each decision hangs on those before it."""
    kind = requests.schema[key].dataType.simpleString()
    start = None
    if admitted is not None:
        start = admitted.select(key, F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("at")).withColumn("at", F.col("at") / 1e6).groupBy(key)
    found = requests.select(key, ts).groupBy(key).transformWithState(RateLimiter(ts, most, window), f"key {kind}, {ts} timestamp, allowed boolean", "Append", "EventTime", initialState=start)
    return found.withColumnRenamed("key", key)
