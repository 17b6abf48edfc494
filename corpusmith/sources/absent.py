"""A table that takes only rows whose key it lacks, without reading the keys it holds.

Every file of the table has a line in its key list: the range of its keys' hashes and a Bloom filter of them. A batch is
tried against the list, and only files that may hold one of its keys are read and anti-joined. Rows are written first and
become part of the table by their files' lines in the list, which appear together; what a dead writer left is not read.
One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise
from .files import hadoop

#: Bits a key (about one key in 10^5 is taken for another), probes of a key, rows of a file, and keys of a batch up to which
#: their hashes (8 bytes each) go to the tasks that try the list; a larger batch is joined with all keys.
BITS, PROBES, FILE_ROWS, MOST_KEYS = 24, 12, 500_000, 2_000_000

_LIST = "batch string, file string, n long, low long, high long, bits binary"


@dataclass(frozen=True)
class Inserted:
    """Rows that a batch added, files that were read for it, and files that the table had."""

    added: int
    read: int
    files: int


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash in a filter of ``bits`` (a power of two), one row a probe."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def key_filter(hashes: np.ndarray) -> bytes:
    bits = 1 << max(6, int(BITS * len(hashes) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[_places(hashes, bits).ravel()] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_hold(data: bytes, hashes: np.ndarray) -> bool:
    found = np.frombuffer(data, np.uint8)
    at = _places(hashes, 8 * len(found))
    return bool((found[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0).any())


class KeyedTable:
    """``schema`` in DDL; ``key`` is the column that tells rows apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _list(self) -> DataFrame:
        place, system = hadoop(self.spark, f"{self.path}/keys")
        return self.spark.read.schema(_LIST).parquet(f"{self.path}/keys") if system.exists(place) else self.spark.createDataFrame([], _LIST)

    def read(self) -> DataFrame:
        """The rows of every batch that was put in the list."""
        paths = [f"{self.path}/rows/{r['batch']}" for r in self._list().select("batch").distinct().collect()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def insert(self, batch: DataFrame) -> Inserted:
        """Add the rows whose key is not stored; of repeats within the batch one, and none without a key."""
        rows = batch.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = materialise(rows.select(*columns, F.xxhash64(self.key).alias("_h")), "batch")
        files, total = self._possible(rows)
        if files:
            known = self.spark.read.schema(self.schema).parquet(*files).select(F.col(self.key).alias("_known"))
            rows = materialise(rows.join(known, F.col(self.key) == F.col("_known"), "left_anti"), "absent")
        n = rows.count()
        if n:
            self._write(rows, -(-n // FILE_ROWS), columns)
        return Inserted(n, len(files), total)

    def _possible(self, rows: DataFrame) -> tuple[list[str], int]:
        """The files that may hold a key of the rows, and how many files there are."""
        listed = self._list()
        total = listed.count()
        if not total:
            return [], 0
        if rows.count() > MOST_KEYS:
            return [r["file"] for r in listed.select("file").collect()], total
        shared = self.spark.sparkContext.broadcast(np.sort(rows.select("_h").toArrow()["_h"].to_numpy()))

        def tried(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = shared.value
            for frame in frames:
                found = []
                for line in frame.to_pylist():
                    inside = hashes[np.searchsorted(hashes, line["low"]) : np.searchsorted(hashes, line["high"], "right")]
                    if len(inside) and may_hold(line["bits"], inside):
                        found.append(line["file"])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["file"])

        return [r["file"] for r in listed.select("file", "low", "high", "bits").mapInArrow(tried, "file string").collect()], total

    def _write(self, rows: DataFrame, files: int, columns: list[str]) -> None:
        name = uuid.uuid4().hex
        rows.repartitionByRange(files, "_h").sortWithinPartitions("_h").select(*columns).write.parquet(f"{self.path}/rows/{name}")

        def line(key: tuple, hashes: pd.DataFrame) -> pd.DataFrame:
            h = hashes["h"].to_numpy()
            return pd.DataFrame({"batch": [name], "file": [key[0]], "n": [len(h)], "low": [int(h.min())], "high": [int(h.max())], "bits": [key_filter(h)]})

        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{name}")
        lines = stored.select(F.col("_metadata.file_path").alias("file"), F.xxhash64(self.key).alias("h")).groupBy("file").applyInPandas(line, _LIST)
        lines.coalesce(1).write.mode("append").parquet(f"{self.path}/keys")


def load_absent(stream: DataFrame, table: KeyedTable, checkpoint: str):
    """Insert what a stream brings, micro-batch by micro-batch, and stop when all there is was read. A micro-batch that runs
    again after a failure, or from a lost checkpoint, adds nothing."""
    sink = lambda batch, _: table.insert(batch) and None
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
