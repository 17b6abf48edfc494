"""Which texts hold which passages, by automata over the passages' beginnings and a check of the whole passage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

#: Characters of a passage that the automaton knows, and bytes of passages behind one automaton (and in one broadcast).
FRAGMENT, PART_BYTES = 64, 8 << 20


class Finder:
    """The passages that a text holds. The automaton finds where a passage's first FRAGMENT characters stand; passages
    that share them are tried there in turn, each by one comparison."""

    def __init__(self, passages: list[str], fragment: int = FRAGMENT):
        self.passages, self.empty = passages, [i for i, p in enumerate(passages) if not p]
        heads: dict[str, list[int]] = {}
        for i, p in enumerate(passages):
            if p:
                heads.setdefault(p[:fragment], []).append(i)
        self.automaton = ahocorasick.Automaton()
        for head, group in heads.items():
            self.automaton.add_word(head, (len(head), group))
        if heads:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[int]:
        found = set(self.empty)
        if len(self.automaton):
            for end, (size, group) in self.automaton.iter(text):
                found.update(i for i in group if i not in found and text.startswith(self.passages[i], end + 1 - size))
        return sorted(found)


def holds(texts: DataFrame, passages: DataFrame, text_id: str, text: str, passage_id: str, passage: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``text_id``, ``passage_id`` of every pair whose text holds the passage, wherever it begins and ends.

    Passages are dealt to as many parts as keep each under about ``part_bytes`` (counted first); each part is broadcast
    and the texts go past it whole, so beside the pairs nothing is shuffled. The empty passage is in every text, a null
    passage or text in no pair; rows that repeat give their pairs as often."""
    spark = texts.sparkSession
    own = materialise(passages.select(F.col(passage_id).alias("pid"), F.col(passage).cast("string").alias("passage")).filter("passage IS NOT NULL"), "passages")
    parts = max(1, -(-(own.agg(F.sum(F.octet_length("passage"))).first()[0] or 0) // part_bytes))
    schema = pa.schema([("row", pa.int64()), ("at", pa.int64())])
    kinds = texts.schema[text_id].dataType.simpleString(), own.schema["pid"].dataType.simpleString()
    rows = texts.select(F.col(text_id).alias("tid"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")

    def past(part: int) -> DataFrame:
        held = own.filter(F.pmod(F.xxhash64("passage", "pid"), F.lit(parts)) == part) if parts > 1 else own
        table = held.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((table["pid"], table["passage"].to_pylist()))

        def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, known = shared.value
            find = Finder(known)
            for frame in frames:
                hits = [(row, at) for row, value in enumerate(frame.column(1).to_pylist()) for at in find(value)]
                pairs = pa.RecordBatch.from_pylist([dict(zip(schema.names, hit, strict=True)) for hit in hits], schema=schema)
                yield pa.RecordBatch.from_arrays([frame.column(0).take(pairs["row"]), ids.take(pairs["at"]).combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids.take(pairs["at"])], names=["tid", "pid"])

        return rows.mapInArrow(run, f"tid {kinds[0]}, pid {kinds[1]}")

    found = reduce(DataFrame.unionByName, [past(p) for p in range(parts)])
    return found.select(F.col("tid").alias(text_id), F.col("pid").alias(passage_id))
