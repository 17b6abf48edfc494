"""The chunk store: a Parquet table of chunks with vectors, loaded incrementally."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SetupError
from ..functions.vectors import hash_embedding
from ..operators.joins import new_rows
from .files import hadoop, read_table


class Refreshed:
    """A table that is kept in memory until its files change: ``get`` compares the names, sizes and times of the files
    under ``path`` and loads anew where they differ from those of the last loading."""

    def __init__(self, spark: SparkSession, path: str, load: Callable[[], DataFrame]):
        self.spark, self.path, self.load = spark, path, load
        self.seen: tuple | None = None
        self.table: DataFrame | None = None

    def state(self) -> tuple:
        place, system = hadoop(self.spark, self.path)
        found, out = system.listFiles(place, True), []
        while found.hasNext():
            file = found.next()
            out.append((str(file.getPath()), file.getLen(), file.getModificationTime()))
        return tuple(sorted(out))

    def get(self) -> DataFrame:
        now = self.state()
        if self.table is None or now != self.seen:
            if self.table is not None:
                self.table.unpersist()
            self.spark.catalog.refreshByPath(self.path)
            self.table, self.seen = self.load().persist(), now
        return self.table


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        return read_table(self.spark, self.path, self.schema, "the chunk store", "build it first")

    def exists(self) -> bool:
        try:
            self.read()
        except SetupError:
            return False
        return True

    def add(self, chunks: DataFrame, embed: Callable[[Column], Column] = hash_embedding) -> int:
        """Append chunks whose id is not stored yet (known ids are never updated; of repeats within ``chunks`` one is
        taken; rows without a page are skipped) and give their number."""
        rows = chunks.filter(F.col("pageid").isNotNull()).dropDuplicates(["chunk_id"])
        if self.exists():
            rows = new_rows(rows, self.read(), "chunk_id")
        vector = embed(F.col("text")).cast("array<float>")
        columns = [c.split()[0] for c in self.schema.split(", ")]
        full = rows.withColumn("embedding", vector).select(*columns)
        before = self.read().count() if self.exists() else 0
        full.write.mode("append").parquet(self.path)
        return self.read().count() - before

    def drop(self) -> None:
        """Remove the table; one that never was is no error, any other failure is."""
        place, system = hadoop(self.spark, self.path)
        system.delete(place, True)

    def rebuild(self, chunks: DataFrame, embed: Callable[[Column], Column] = hash_embedding) -> int:
        """Drop and load anew, after the input was found not to be empty."""
        if chunks.isEmpty():
            raise SetupError("there are no chunks to index")
        self.drop()
        return self.add(chunks, embed)
