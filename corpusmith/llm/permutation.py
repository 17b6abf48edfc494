"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by the order of the pivots, largest inner product
first, kept as each pivot's place in that order. Classes of equal vectors are dealt to blocks by hash, and a block
posts each of its vectors in the inverted files of the vector's first ``POSTS`` pivots. A query opens the files of its
own first ``PROBES`` pivots in every block; what the files hold is ranked once by Spearman footrule distance between
the orders, and only the nearest by it are reranked by the exact inner product: about ``reranked(n)`` of n vectors, a
share that falls with the square root of n.

Equal vectors are posted once, with the smallest ids that could be asked for, so a vector that many rows repeat costs
one entry. Blocks and slices of the queries are bounded, so a task holds at most ``PART`` entries and ``ASK`` queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Pivots: a place in the order is one byte.
PIVOTS = 256
#: Files that a vector is posted in, and files that a query opens.
POSTS, PROBES = 8, 32
#: Vectors reranked for a query: at least LEAST, and GROWTH times the square root of their number.
LEAST, GROWTH = 400, 2.5
#: Entries and queries of one task.
PART, ASK = 8_000, 8_192


def sound(embedding: str = "embedding"):
    """Vectors that take part: not null, not zero, all components finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(embedding).isNotNull() & fine & F.exists(embedding, lambda x: x != 0)


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of each pivot (column) in the order of each vector (row), nearest first; ties to the first pivot."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return out


def footrule(entries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Spearman footrule distance of each entry's order to the query's: how far the pivots' places lie apart in all."""
    return (np.maximum(entries, query) - np.minimum(entries, query)).sum(axis=1, dtype=np.uint32)


def reranked(n: int) -> int:
    """How many of ``n`` vectors are compared exactly with a query."""
    return max(LEAST, math.ceil(GROWTH * math.sqrt(n)))


def search_block(vectors: np.ndarray, entries: np.ndarray, asked: np.ndarray, orders: np.ndarray, top: int, keep: int, posts: int, probes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the block's best by footrule, as places in the block, and their exact inner products: the ``top``
    and all that tie with the last of them. Files that hold fewer than ``keep`` vectors are made up for by the others."""
    n = len(vectors)
    row, pivot = np.nonzero(entries < posts)
    files = np.split(row[np.argsort(pivot, kind="stable")], np.cumsum(np.bincount(pivot, minlength=entries.shape[1]))[:-1])
    for i in range(len(asked)):
        hit = np.zeros(n, bool)
        for file in np.flatnonzero(orders[i] < probes).tolist():
            hit[files[file]] = True
        found = np.flatnonzero(hit)
        if len(found) < keep:
            found = np.arange(n)
        if len(found) > keep:
            found = found[np.argpartition(footrule(entries[found], orders[i]), keep - 1)[:keep]]
        scores = np.einsum("ij,j->i", vectors[found], asked[i])
        if len(found) > top:
            good = scores >= np.partition(scores, len(scores) - top)[len(scores) - top]
            found, scores = found[good], scores[good]
        yield i, found, scores


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def search(vectors: DataFrame, is_query, top: int = 20, pivots: int = PIVOTS, posts: int = POSTS, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's nearest other rows by inner product, ties to smaller ids.

    ``is_query`` is a condition on the rows. Vectors that are null, zero, or hold null or non-finite components take no
    part; neither do rows without an id. Of rows that repeat an id each is a candidate; a query never finds its own id.
    A table without sound vectors gives no rows. All vectors must have one length. At most 256 pivots.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("q")).filter(sound("vec") & F.col("id").isNotNull())
    rows = materialise(rows.withColumn("h", F.xxhash64("vec")), "perm-rows")
    # Classes of equal vectors, each with the ids that a top list could need: the smallest top + 1.
    small = Window.partitionBy("vec").orderBy("id")
    heads = rows.select("id", "vec", "h").withColumn("n", F.row_number().over(small)).filter(F.col("n") <= top + 1)
    classes = heads.groupBy("vec").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("h").alias("h"))
    classes = materialise(classes, "perm-classes")
    n = classes.count()
    chosen = [r[0] for r in classes.orderBy("h", "cls").limit(min(256, pivots)).select("vec").collect()]
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(np.array(chosen, np.float64))  # at most 256 vectors
    blocks = -(-n // PART)
    share = reranked(n) / blocks  # of a block; its number among the nearest varies as a sum of chances does
    keep = max(top + 1, math.ceil(share + (4 * math.sqrt(share) + 4 if blocks > 1 else 0)))

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["vec"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"cls": frame["cls"], "vec": [v.tobytes() for v in x], "ord": [o.tobytes() for o in places(x, shared.value)]})

    ddl = "cls long, vec binary, ord binary"
    block = F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(blocks)).cast("int")
    posted = classes.select("cls", "vec").mapInPandas(place, ddl)
    asked = rows.filter("q").select("vec").distinct().join(classes.select("cls", "vec"), "vec").select("cls", "vec").mapInPandas(place, ddl)
    asked = materialise(asked, "perm-asked")
    slices = max(1, -(-asked.count() // ASK))
    posted = posted.withColumn("block", block).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("cls", F.lit(2)), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            entries = entries.sort_values("cls")
            ids, own = entries["cls"].to_numpy(), queries["cls"].to_numpy()
            x, q = _matrix(entries["vec"], np.float64), _matrix(queries["vec"], np.float64)
            for i, found, scores in search_block(x, _matrix(entries["ord"], np.uint8), q, _matrix(queries["ord"], np.uint8), top + 1, keep, posts, probes):
                out.append(pd.DataFrame({"qcls": own[i], "cls": ids[found], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"qcls": [], "cls": [], "score": []})

    met = posted.groupBy("block", "slice").cogroup(asked.groupBy("block", "slice")).applyInPandas(meet, "qcls long, cls long, score double")
    best = Window.partitionBy("qcls").orderBy(F.desc("score"), "cls")
    hits = met.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= top + 1).drop("n")
    # A class stands for its ids; of a query class the top + 1 rows serve every one of its queries.
    hits = hits.join(classes.select("cls", "ids"), "cls").select("qcls", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("qcls").orderBy(F.desc("score"), "vec_id")
    lists = hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= top + 1).groupBy("qcls").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("hits"))
    queries = rows.filter("q").select(F.col("id").alias("query_id"), "vec").join(classes.select(F.col("cls").alias("qcls"), "vec"), "vec").select("query_id", "qcls")
    mine = F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    out = queries.join(lists, "qcls").select("query_id", F.posexplode(mine).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
