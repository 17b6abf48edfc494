"""Documents whose sets of word shingles are alike: Jaccard similarity of a stated share or more, computed exactly.

Candidates come from two sides. SimHash ball hashing (``simhash.link_fingerprints``) gives the texts whose fingerprints are
equal or within three bits. A similarity of 0.8 lies four to fourteen bits apart as a rule, where no ball is small enough
to emit, so others meet in buckets of min-hash bands (Broder; BANDS bands of ROWS values): a pair of similarity s shares none
with chance (1 - s**ROWS) ** BANDS, which is 3e-6 at 0.8. Every link is then verified on the whole sets. Equal sets are
one vertex, so exact copies never meet each other. A bucket's members are compared with its leader first, the one
that meets most others over all buckets; after that, only members whose components still differ, each with each. So
every pair that shares a bucket is verified or already connected. A group of copies close to one text costs its length;
a bucket of copies that stay apart costs the square of its members, inside one task and without making rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bound_batches, column, materialise, release_worker_cache
from .components import components, one_per

BANDS, ROWS, SEED = 24, 4, 42
#: Shingles that are hashed at once.
BLOCK = 4096
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, size=(BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct XXH64 values (seed 42) of the word shingles, A-Z lowered; fewer words than ``width`` are one
    shingle and no words none."""
    return _sketch(text, width)[0]


def _sketch(text: str, width: int) -> tuple[np.ndarray, int]:
    """The set of shingles, and the fingerprint of all of them."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64), 0
    raw = simhash.digests(words, width)
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64)), simhash.majority(raw)


def bands(values: np.ndarray) -> list[int]:
    """The keys of the buckets of a set of shingles; the empty set has none."""
    if not len(values):
        return []
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(values), BLOCK):
        np.minimum(least, (_FACTORS * values[at : at + BLOCK]).min(axis=1), out=least)
    raw = least.tobytes()
    size = ROWS * 8
    return np.array([xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, tkey (hash of the text), vertex (hash of the set), size, fp (SimHash), bands."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("vertex", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        for frame in frames:
            sketches = [_sketch(text or "", width) for text in column(frame, "text")]
            sets, fps = [s for s, _ in sketches], np.array([f for _, f in sketches], np.uint64).view(np.int64)
            vertex = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            rest = [pa.array(vertex), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array(list(map(bands, sets)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), *rest], schema=schema)

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, tkey long, vertex long, size long, fp long, bands array<long>")


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """vertex, own (the set) of ``members`` (doc_id, tkey, vertex), one row of each."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("vertex", pa.int64()), ("own", pa.list_(pa.int64()))])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        for frame in frames:
            own = [shingles(text or "", width).view(np.int64) for text in column(frame, "text")]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(own, pa.list_(pa.int64()))], schema=schema)

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), F.col("text").cast("string"))
    return source.join(members, ["doc_id", "tkey"]).select("vertex", "text").mapInArrow(run, "vertex long, own array<long>").dropDuplicates(["vertex"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of ``percent`` hundredths or more."""
    a, b = sets.select(F.col("vertex").alias("u"), F.col("own").alias("a")), sets.select(F.col("vertex").alias("v"), F.col("own").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").filter(both * 100 >= (F.size("a") + F.size("b") - both) * percent).select("u", "v")


def _settler(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket (vertex, root, own): links between members whose components differ, a spanning forest of them."""

    def run(group: pa.Table) -> pa.Table:
        names, own = group["vertex"].to_numpy(), group["own"].combine_chunks()
        ends = own.value_lengths().to_numpy().cumsum()
        places = np.unique(own.flatten().to_numpy(), return_inverse=True)[1]
        starts, sizes = ends - own.value_lengths().to_numpy(), own.value_lengths().to_numpy().astype(np.int64)
        group_of = np.unique(group["root"].to_numpy(), return_inverse=True)[1]
        has, links = np.zeros(int(places.max()) + 1, np.int64), []
        for i in range(len(names)):
            if (group_of == group_of[i]).all():
                break
            mine = places[starts[i] : ends[i]]
            has[mine] = 1
            both = np.add.reduceat(has[places[starts[i] :]], starts[i:] - starts[i])  # sets in buckets are not empty
            has[mine] = 0
            alike = (both * 100 >= (sizes[i:] + sizes[i] - both) * percent) & (group_of[i:] != group_of[i])
            for j in (np.flatnonzero(alike) + i).tolist():
                if group_of[j] != group_of[i]:
                    links.append((names[i], names[j]))
                    group_of[group_of == group_of[j]] = group_of[i]
        made = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"u": made[:, 0], "v": made[:, 1]})

    return run


def _by_fingerprint(reps: DataFrame) -> DataFrame:
    """u, v: a spanning set of the links between sets whose SimHash fingerprints are equal or within three bits. Empty sets
    are one vertex and need none."""
    full = reps.filter("size > 0").select("vertex", "fp")
    first = materialise(full.groupBy("fp").agg(F.min("vertex").alias("lead")), "alike-fingerprints")
    near = simhash.link_fingerprints(first.select("fp"))
    one, two = (first.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead")) for c in ("u", "v"))
    pairs = near.join(one, "u").join(two, "v").select(F.col("u_lead").alias("a"), F.col("v_lead").alias("b"))
    pairs = pairs.unionByName(full.join(first, "fp").filter("vertex <> lead").select(F.col("vertex").alias("a"), F.col("lead").alias("b")))
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _alike_in_size(a: str, b: str, percent: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, component: the least doc_id that can be reached over links of ``percent`` hundredths or more.

    Null or blank texts are one group. Null doc_ids carry no name; repeated rows are returned as often as they occur.
    """
    marks = materialise(_sketches(docs, width), "alike")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("least")
    reps = materialise(marks.groupBy("vertex").agg(first, F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands")).select("vertex", "least.doc_id", "least.tkey", "size", "fp", "bands"), "alike-reps")
    met = reps.select("vertex", "size", F.explode("bands").alias("bucket"))
    hits = met.join(met.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket")
    hits = materialise(hits, "alike-hits")
    crowd = hits.groupBy("vertex").agg(F.sum("n").alias("crowd"))
    leaders = hits.join(crowd, "vertex").groupBy("bucket").agg(F.max(F.struct("crowd", "vertex", "size")).alias("top")).select("bucket", F.col("top.vertex").alias("lead"), F.col("top.size").alias("lead_size"))
    tried = hits.join(leaders, "bucket").filter((F.col("vertex") != F.col("lead")) & _alike_in_size("size", "lead_size", percent))
    tried = tried.select(F.greatest("vertex", "lead").alias("u"), F.least("vertex", "lead").alias("v"))
    tried = materialise(tried.unionByName(_by_fingerprint(reps)).distinct(), "alike-tried")
    used = hits.select("vertex").union(tried.select("u")).union(tried.select("v")).distinct()
    sets = materialise(_sets(docs, reps.join(used, "vertex").select("doc_id", "tkey", "vertex"), width), "alike-sets")
    links = materialise(_verified(tried, sets, percent), "alike-links")
    roots = components(links)
    named = hits.join(roots, "vertex", "left").select("bucket", "vertex", "size", F.coalesce("root", "vertex").alias("root"))
    split = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    more = named.join(split, "bucket").join(sets, "vertex").groupBy("bucket").applyInArrow(_settler(percent), "u long, v long")
    roots = components(roots.select(F.col("vertex").alias("u"), F.col("root").alias("v")).unionByName(more))
    named = reps.join(roots, "vertex", "left").select("vertex", "doc_id", F.coalesce("root", "vertex").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("vertex", "component")
    return marks.join(named, "vertex").select("doc_id", "component")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of near duplicates: the one with the least doc_id, one of its rows if they
    repeat. Rows without an id name no group and stay."""
    named = docs.filter("doc_id IS NOT NULL")
    kept = near_duplicates(named, width, percent).filter("doc_id = component").select("doc_id").distinct()
    found = named.join(kept, "doc_id", "left_semi")
    return one_per(found, ["doc_id"], [F.xxhash64("text")]).unionByName(docs.filter("doc_id IS NULL"))
