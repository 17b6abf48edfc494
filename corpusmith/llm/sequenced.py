"""Changes of each client applied in sequence, gaps waited for and then jumped, by keyed streaming state.

Changes carry a number n per client and come late, twice or never. A stateful streaming query keeps, per client, a map
from n to the change that is held and one value with the next number and the present city and balance. Batches are fed
one after another, each by a new start of the query on the same checkpoint. In every batch each client that is known from
an earlier one gets a clock row, so that a gap expires even where the client has no change.

What a client's batch does does not hang on the order in which its rows reach the task, clock row included: numbers leave
the map only by being applied, and new rows are applied once all are in, so of the rows with one new number the first by
day and change_id is held and the others are rejected. So a task holds a bounded part of a client's rows and leaves the
rest to the state store; a client with a third of all rows is one sequence, as the rule says, but nothing of it is held
whole.

A call for a key costs far more than its few rows, and each column of them adds to it. So what a change sets, what comes
out and what the state holds are one JSON text each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..scratch import new_folder
from .common import materialise

#: New rows of one client that a task holds before they go to the state store.
FRESH = 20_000
#: The clock of the start after the last batch: whatever is held has expired.
ENDED = 2_000_000_000

COLUMNS = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
_FED = "client_id long, change_id long, n long, day int, sets string"
_OUT = "change_id long, client_id long, n long, kind int, missed long, city string, balance double"
REJECTED, APPLIED, DELETED = 0, 1, 2
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A store is closed and its local copy removed when its task ends: the next start opens it from the checkpoint anyway.
_SETTINGS = {
    _PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: A held change: change_id, day, what it sets, batch in which it came.
Held = tuple[int, int, str, int]


def _first(a: Held, b: Held) -> bool:
    """Whether ``a`` comes before ``b``: by day, change_id and, for rows that share both, by op, city and balance, nulls
    first."""

    def order(change: Held) -> list:
        sets = json.loads(change[2])
        return [change[1], change[0], *((x is not None, x) for x in (sets.get(c) for c in ("op", "city", "balance")))]

    for x, y in zip(order(a), order(b), strict=True):
        if x != y:
            return x[0] < y[0] if isinstance(x, tuple) and x[0] != y[0] else x < y
    return False


_ROW = Row("found")


class SequencedApplier(StatefulProcessor):
    """Per client: ``held`` n -> change, ``at`` the next number, how many are held, a lower bound of their days, and the
    present values. A row without n is the clock, its day the largest day of earlier batches."""

    def __init__(self, batch: int, patience: int, fresh: int = FRESH) -> None:
        self.batch, self.patience, self.limit = batch, patience, fresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "n long", "change string")
        self.at = handle.getValueState("at", "now string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        client, was = key[0], self.at.get()
        self.next, self.n_held, self.earliest, self.city, self.balance = before = json.loads(was[0]) if was else [1, 0, 0, None, None]
        fresh: dict[int, Held] = {}
        for _, change_id, n, day, sets in rows:
            if n is None:
                if self.n_held and self.earliest + self.patience <= day:
                    yield from self._jump(client, day)
                    for n in [n for n in fresh if n < self.next]:
                        yield self._rejected(client, n, fresh.pop(n))
                continue
            change: Held = (change_id, day, sets, self.batch)
            known = fresh.get(n)
            if known is None and n >= self.next and self.n_held:
                known = self._held(n)
            if n < self.next or known and known[3] < self.batch:
                yield self._rejected(client, n, change)
                continue
            if known:
                late = change if _first(known, change) else known
                yield self._rejected(client, n, late)
                if late is change:
                    continue
                if n not in fresh:
                    self._taken(n)
            fresh[n] = change
            if len(fresh) > self.limit:
                self._hold(fresh)
        while self.next in fresh or self.n_held:
            change = fresh.pop(self.next, None) or self._taken(self.next)
            if change is None:
                break
            yield self._applied(client, self.next, change)
        self._hold(fresh)
        now = [self.next, self.n_held, self.earliest, self.city, self.balance]
        if was is None or now != before:
            self.at.update((json.dumps(now),))

    def _jump(self, client: Any, clock: int) -> Iterator[Row]:
        """While a held change has waited out, next jumps to the smallest held number. So everything held up to the
        largest number that has waited out is applied in order, and what follows that without a gap. Rows of this batch
        that are in the map already take no part; those whose number was jumped are rejected."""
        numbers, own, last, rest = [], [], 0, ENDED
        for (n,), (text,) in self.held.iterator():
            _, day, *_, batch = json.loads(text)
            if batch == self.batch:
                own.append(n)
                continue
            numbers.append(n)
            if day + self.patience <= clock:
                last = max(last, n)
            else:
                rest = min(rest, day)
        self.earliest = min(rest, self.earliest) if own else rest
        if last:
            order = np.sort(np.array(numbers, np.int64))
            at = np.searchsorted(order, last, "right")
            for n in order[:at].tolist():
                yield self._applied(client, n, self._taken(n))
            for n in order[at:].tolist():
                if n != self.next:
                    break
                yield self._applied(client, n, self._taken(n))
            for n in own:
                if n < self.next:
                    yield self._rejected(client, n, self._taken(n))

    def _held(self, n: int) -> Held | None:
        found = self.held.getValue((n,))
        return tuple(json.loads(found[0])) if found else None

    def _taken(self, n: int) -> Held | None:
        change = self._held(n) if self.n_held else None
        if change is not None:
            self.held.removeKey((n,))
            self.n_held -= 1
        return change

    def _hold(self, fresh: dict[int, Held]) -> None:
        for n, change in fresh.items():
            self.held.updateValue((n,), (json.dumps(change),))
            self.earliest = min(self.earliest, change[1]) if self.n_held else change[1]
            self.n_held += 1
        fresh.clear()

    def _applied(self, client: Any, n: int, change: Held) -> Row:
        sets = json.loads(change[2])
        op, city, balance = sets.get("op"), sets.get("city"), sets.get("balance")
        if op == "I":
            self.city, self.balance = city, balance
        elif op == "U":
            self.city = self.city if city is None else city
            self.balance = self.balance if balance is None else balance
        elif op == "D":
            self.city = self.balance = None
        missed, self.next = n - self.next, n + 1
        return self._row(change[0], client, n, DELETED if op == "D" else APPLIED, missed, self.city, self.balance)

    @classmethod
    def _rejected(cls, client: Any, n: int, change: Held) -> Row:
        return cls._row(change[0], client, n, REJECTED, 0, None, None)

    @staticmethod
    def _row(change_id: int, client: Any, n: int, kind: int, missed: int, city: str | None, balance: float | None) -> Row:
        return _ROW(json.dumps({"change_id": change_id, "client_id": client, "n": n, "kind": kind, "missed": missed, "city": city, "balance": balance}))

    def close(self) -> None:
        pass


def dense_rank(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the dense rank of ``value`` per ``key`` (nulls first), without a task that holds a key: pairs
    are numbered in ranges, and a key's counts in the ranges before are added."""
    pairs = df.select(F.col(key).alias("_k"), F.col(value).alias("_v")).distinct()
    ranges = materialise(pairs.repartitionByRange("_k", "_v").withColumn("_range", F.spark_partition_id()), "ranks")
    inside = ranges.withColumn("_n", F.row_number().over(Window.partitionBy("_range", "_k").orderBy("_v")))
    counts = ranges.groupBy("_k", "_range").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_k").alias("_ok"), F.col("_range").alias("_or"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    ranked = inside.join(offsets, F.col("_k").eqNullSafe(F.col("_ok")) & (F.col("_range") == F.col("_or")))
    ranked = ranked.select("_k", "_v", (F.col("_n") + F.col("_before")).cast("long").alias(name))
    return df.join(ranked, F.col(key).eqNullSafe(F.col("_k")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_k", "_v")


def numbered(changes: DataFrame, batches: int = 8, first_day: int = 19723, days: int = 160) -> DataFrame:
    """The rows to feed: client_id, change_id, n, day, op, city, balance, batch (1 to ``batches``).

    Rows that repeat count once; only the table's nine columns are read. n is seq's dense rank per client (nulls first,
    null clients are one client). Then rows without valid_at or change_id and those whose crc32 is a multiple of 11
    vanish; the others come up to 6 days late. Days before the first go to batch 1."""
    rows = dense_rank(changes.select(*COLUMNS).distinct(), "client_id", "seq", "n")
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    day = (F.unix_date(F.col("valid_at").cast("date")) + 2 * (h % 4)).cast("int")
    rows = rows.filter(F.col("valid_at").isNotNull() & F.col("change_id").isNotNull() & (h % 11 != 0)).withColumn("day", day)
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * F.lit(batches) / F.lit(days)))).cast("int")
    return rows.select("client_id", "change_id", "n", "day", "op", "city", "balance", batch.alias("batch"))


def _move(spark: SparkSession, source: str, target: str) -> bool:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.exists(a):
        return False
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")
    return True


def apply_in_sequence(rows: DataFrame, batches: int = 8, patience: int = 5, fresh: int = FRESH) -> DataFrame:
    """change_id, client_id, n, status (applied or rejected), batch, missed, city, balance, current of every row of
    ``rows`` (client_id, change_id, n, day, op, city, balance, batch).

    Batches run in order. At a batch's start, while a client's earliest held day + ``patience`` lies not after the largest
    day of earlier batches, its next number jumps to the smallest held one; after the last batch, whatever the days. Ops
    other than I, U and D apply without setting anything. ``current`` marks a client's last applied row unless it deletes.
    An empty table gives an empty result. Batches, checkpoint and results stay in a new folder under spark.checkpoint.dir
    until ``scratch.release``."""
    spark = rows.sparkSession
    folder = new_folder(spark, "sequenced")
    rows = materialise(rows, "changes")
    days = {r["batch"]: r["day"] for r in rows.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    clock = F.lit(ENDED)
    for b in range(2, batches + 1):
        clock = F.when(F.col("batch") == b, max((d for k, d in days.items() if k < b), default=-ENDED)).otherwise(clock)
    known = rows.groupBy("client_id").agg(F.min("batch").alias("since"))
    clocks = known.select("client_id", F.explode(F.sequence(F.col("since") + 1, F.lit(batches + 1))).alias("batch"))
    fed = rows.unionByName(clocks.withColumn("day", clock.cast("int")), allowMissingColumns=True)
    fed = fed.withColumn("sets", F.when(F.col("n").isNotNull(), F.to_json(F.struct("op", "city", "balance"))))
    fed.select(*(c.split()[0] for c in _FED.split(", ")), "batch").write.partitionBy("batch").parquet(f"{folder}/batches")
    for b in range(1, batches + 2):
        if _move(spark, f"{folder}/batches/batch={b}", f"{folder}/in/batch={b}"):
            _start(spark, folder, b, patience, fresh)
    schema = f"{_OUT}, batch int"
    out = spark.read.schema(schema).parquet(f"{folder}/out") if days else spark.createDataFrame([], schema)
    ends = out.filter(F.col("kind") != REJECTED).groupBy("client_id").agg(F.max("n").alias("_end")).withColumnRenamed("client_id", "_client")
    out = out.join(ends, F.col("client_id").eqNullSafe(F.col("_client")) & (F.col("n") == F.col("_end")), "left")
    status = F.when(F.col("kind") == REJECTED, "rejected").otherwise("applied")
    current = F.col("_end").isNotNull() & (F.col("kind") == APPLIED)
    return out.select("change_id", "client_id", "n", status.alias("status"), "batch", "missed", "city", "balance", current.alias("current"))


def _start(spark: SparkSession, folder: str, batch: int, patience: int, fresh: int) -> None:
    """One start of the query on the folder's checkpoint: it reads what has come since the start before, and ends."""
    was = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        fed = spark.readStream.schema(_FED).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        found = fed.groupBy("client_id").transformWithState(SequencedApplier(batch, patience, fresh), "found string", "Append", "None")
        sink = found.select(F.from_json("found", _OUT).alias("r")).select("r.*", F.lit(batch).alias("batch")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
