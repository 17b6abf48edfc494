"""SimHash near-duplicate linking by ball hashing that meets in the middle.

Fingerprints within 3 bits are linked. The radius is odd, so one bit is set aside by a mask: the 64 bits are cut into
two halves, and for each half in turn the other half is hashed alone. Each fingerprint emits the kept half itself and
all its variants at one bit, half of the radius 2 that is left. Fingerprints that meet at a variant are verified:

* bits that differ in both halves: at most 3 in all, so one half has exactly one of them, and the other, kept half
  has one or two, which meet in the middle. In a bucket these are fingerprints whose set-aside halves differ in
  exactly one bit; any such two are within 1 + 2 bits.
* bits that differ in one half only: the kept half is equal, and both sit unflipped in its bucket; their set-aside
  halves are compared directly, again by variants at one bit on one side and two on the other.

Both rules look a value up among the bucket's own values, so a bucket costs its length times a constant however many
fingerprints meet there, and the links kept are a spanning forest of each bucket. Equal fingerprints are one vertex,
so exact copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, materialise, release_worker_cache
from .components import components, one_per

HALF = 32
_LOW = (1 << HALF) - 1
SEED = 42
#: One-bit masks of a half, and masks of one and two bits, by which a bucket's values are looked up.
ONE = [1 << i for i in range(HALF)]
TWO = [a | b for a, b in combinations(ONE, 2)]


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash of word shingles, A-Z lowered, repeats counted; fewer words than ``width`` are one shingle and no
    words give 0. A bit is set if it is set in over half of the XXH64 values (seed 42)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return majority(digests(words, width))


def digests(words: list[bytes], width: int) -> bytes:
    """The XXH64 values (seed 42, big-endian, one after another) of the shingles of some words, repeats included; fewer
    words than ``width`` are one shingle."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends, digest = (ends - lengths).tolist(), ends.tolist(), xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1 :], strict=False)])


def majority(raw: bytes) -> int:
    """The fingerprint of some shingles' values."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (long, two's complement). A null text has no words."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        for frame in frames:
            values = np.array([fingerprint(text or "", width) for text in column(frame, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(values)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _bucket_links(kept: list[int], aside: list[int], names: list[int], centre: int) -> list[tuple[int, int]]:
    """A spanning forest of one bucket's verified links. kept/aside: the halves of each fingerprint in ``names``."""
    groups: dict[int, int] = {}
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((names[i], names[j]))

    for i, value in enumerate(aside):  # equal halves aside: the kept ones are within two bits
        link(groups.setdefault(value, i), i)
    exact = {aside[i]: i for i in range(len(names)) if kept[i] == centre}
    if len(groups) <= 24:
        values = list(groups)
        for a, b in combinations(values, 2):
            if (distance := (a ^ b).bit_count()) == 1:
                link(groups[a], groups[b])
            elif distance <= 3 and a in exact and b in exact:
                link(exact[a], exact[b])
        return links
    for value, i in groups.items():
        for flip in ONE:
            if (j := groups.get(value ^ flip)) is not None and j < i:
                link(j, i)
    if len(exact) > 1:
        middle: dict[int, int] = {}
        for value, i in exact.items():
            for flip in (0, *ONE):
                other = middle.setdefault(value ^ flip, i)
                link(other, i)  # within 1 + 1 bits
        for value, i in exact.items():
            for flip in TWO:
                if (j := middle.get(value ^ flip)) is not None:
                    link(j, i)  # within 1 + 2 bits
    return links


def _linker(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key; a bucket may span frames, so the last one of a frame waits for the next."""
    rest: list[tuple[np.ndarray, np.ndarray]] = []

    def of(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        many = np.flatnonzero(ends - starts > 1)
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            key, own = int(keys[s]), fps[s:e].view(np.uint64)
            low, high = (own & np.uint64(_LOW)).tolist(), (own >> np.uint64(HALF)).tolist()
            kept, aside = (low, high) if key >> HALF == 0 else (high, low)
            edges += _bucket_links(kept, aside, fps[s:e].tolist(), key & _LOW)
        made = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": made[:, 0], "v": made[:, 1]})

    for frame in frames:
        keys, fps = frame["key"].to_numpy(), frame["fp"].to_numpy()
        if not len(keys):
            continue
        if rest and keys[-1] == rest[0][0][0]:  # all of the open bucket: put together when it ends
            rest.append((keys, fps))
            continue
        keys, fps = (np.concatenate([*(r[k] for r in rest), x]) for k, x in enumerate((keys, fps)))
        last = int(np.searchsorted(keys, keys[-1], "left"))
        yield of(keys[:last], fps[:last])
        rest = [(keys[last:], fps[last:])]
    if rest:
        yield of(*(np.concatenate([r[k] for r in rest]) for k in range(2)))


def link_fingerprints(reps: DataFrame) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) at 1 to 3 bits; a spanning set, not all pairs."""
    low, high = F.col("fp").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned("fp", HALF)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(bit).cast("long") for bit in ONE])
    keys = F.concat(F.transform(flips, lambda bit: low.bitwiseXOR(bit)), F.transform(flips, lambda bit: high.bitwiseXOR(bit).bitwiseOR(F.lit(1 << HALF))))
    variants = reps.select("fp", F.explode(keys).alias("key"))
    spread = variants.repartition("key").sortWithinPartitions("key", "fp")
    return spread.mapInPandas(_linker, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp, component: the least doc_id that can be reached over links of at most three bits.

    Defined cases: null or blank texts share fingerprint zero and link like any other; null doc_ids carry no name (a
    group of null ids only has component null); repeated rows are returned as often as they occur.
    """
    marks = materialise(fingerprints(docs, width), "simhash")
    reps = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-reps")
    roots = components(link_fingerprints(reps))
    named = reps.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("fp", "component")
    return marks.join(named, "fp").select("doc_id", "fp", "component")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """The documents with one of each group of near duplicates: the one with the least doc_id, one of its rows if they
    repeat. Rows without an id name no group and stay."""
    groups = near_duplicates(docs, width)
    kept = groups.filter("doc_id = component").select("doc_id").distinct()
    found = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return one_per(found, ["doc_id"], [F.xxhash64("text")]).unionByName(docs.filter("doc_id IS NULL"))
