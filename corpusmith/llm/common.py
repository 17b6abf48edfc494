"""What the operators of this subpackage share: table access, shared scratch space, word splitting."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise

T = TypeVar("T")

#: A word is a maximal run of bytes outside the six ASCII blanks; the same pattern in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes per Arrow batch handed to Python. Whole texts stay whole; long ones make smaller batches.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what one Python worker is handed at once. A session whose limits are looser gets these, the same for every
    operator of this package, as plans read them when they run; tighter limits of the user's stay."""
    for key, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= value:
            spark.conf.set(name, str(value))


@contextmanager
def gc_off() -> Iterator[None]:
    """The garbage collector rests, as large tables are not garbage, and goes on as before afterwards."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def without_gc(frames: Iterable[T]) -> Iterator[T]:
    """The frames, with the garbage collector at rest until the last one is done."""
    with gc_off():
        yield from frames


_kept: dict[tuple, object] = {}


def worker_cache(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the one object asked for last. Workers serve one operator after
    another, so an older one's tables are let go before new ones are built."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        _kept[key] = make()
    return _kept[key]


def release_worker_cache() -> None:
    """Let go of what another operator kept in this worker."""
    if _kept:
        _kept.clear()
        gc.collect()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batches(out: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in out:
        yield pa.RecordBatch.from_pydict(columns, schema=schema)
