"""A persisted vector index: coarse cells as a partitioned table, with statistics that keep cells from being read.

Centres come from spherical k-means over a bounded sample; every row lies in the folder of its nearest centre. Statistics
hold, per cell and facet, the rows and the largest angle between centre and row. A query goes to the nearest cells that
hold its facet, whose files alone are read; distances are those of the original vectors in double precision. Since an
angle to a row is at least the angle to its centre less the cell's radius, a second step can read just the cells that may
still hold a nearer row, which makes the answer exact (``exact``), at the price of more files where cells overlap.

Rows are appended into the same cells; the centres stay until ``create`` is called again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SetupError
from ..operators.dense import _membership
from ..operators.joins import new_rows
from ..scratch import materialise
from .files import hadoop, replacing

#: Numbers of the sample that centres are fitted on (rows x dimensions), the most cells, and rows of a cell to a task.
SAMPLE_NUMBERS, MOST_CELLS, PIECE = 4_000_000, 4096, 50_000
#: Cells that a query visits at least, as a share of all, and rows of its facet that they hold, as a multiple of n. The share
#: is for vectors without clusters (of 2,000 such in 64 dimensions 0.6 of the cells hold 95 % of the ten nearest); where
#: there are clusters a few ``probes`` do.
PROBE_SHARE, DEPTH = 0.65, 20
#: Distances of a cell's queries and rows that are held at once.
DISTANCES = 1_000_000
ALL = ""  # the facet of every row


class CellIndex:
    """``key`` and ``dim``: type of the ids and length of the vectors. Null vectors, those of other lengths, zero and
    non-finite ones have no direction: they are not stored and find nothing."""

    def __init__(self, spark: SparkSession, path: str, key: str = "string"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"id {key}, vec array<double>, games array<string>, cell int"

    # -- writing

    @staticmethod
    def _rows(store: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        games = F.coalesce(F.col("games"), F.array().cast("array<string>")) if "games" in store.columns else F.array().cast("array<string>")
        rows = store.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.array_compact(games).alias("games"))
        whole = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & whole & F.exists("vec", lambda x: x != 0))

    def create(self, store: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding", cells: int | None = None, seed: int = 7) -> int:
        """Fit centres and write all rows, in place of what was there; gives the number of rows. ``cells``: about
        twice the square root of the rows, at most MOST_CELLS."""
        rows = materialise(self._rows(store, id_col, vec_col).withColumn("id", F.col("id").cast(self.key)).dropDuplicates(["id"]), "vectors")
        n, dim, most = rows.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
        if not n or dim != most:
            raise SetupError("vectors are missing or of different lengths")
        k = min(MOST_CELLS, cells or max(1, round(2 * n**0.5)))
        sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(k, SAMPLE_NUMBERS // dim)).select(array_to_vector("vec").alias("features"))
        sample = materialise(sample, "sample")
        centres = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=8).fit(sample).clusterCenters() if k > 1 else [np.ones(dim)]
        with replacing(self.spark, self.path) as fresh:
            table = [(i, (c / np.linalg.norm(c)).tolist()) for i, c in enumerate(centres)]
            self.spark.createDataFrame(table, "cell int, centre array<double>").coalesce(1).write.parquet(f"{fresh}/centres")
            self._append(rows, fresh)
        return n

    def add(self, store: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding") -> int:
        """Append rows whose id is not stored into their cells and give their number."""
        rows = self._rows(store, id_col, vec_col).withColumn("id", F.col("id").cast(self.key)).dropDuplicates(["id"])
        rows = materialise(new_rows(rows, self.rows().select("id"), "id"), "vectors")
        dim = len(self.centres()[0])
        if rows.filter(F.size("vec") != dim).limit(1).count():
            raise SetupError(f"vectors must have {dim} dimensions")
        n = rows.count()
        if n:
            self._append(rows, self.path)
        return n

    def _append(self, rows: DataFrame, path: str) -> None:
        centres = self.centres(path)
        shared = self.spark.sparkContext.broadcast(centres)

        def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["vec"].to_numpy())
                    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ shared.value.T
                    cell = near.argmax(1)
                    yield frame.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1)))

        placed = materialise(rows.mapInPandas(place, f"id {self.key}, vec array<double>, games array<string>, cell int, angle double"), "placed")
        # A cell's rows go to as many tasks as they need; its folder gets so many files.
        placed.drop("angle").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell", "id").write.mode("append").partitionBy("cell").option("compression", "zstd").parquet(f"{path}/rows")
        facets = placed.select("cell", "angle", F.explode(F.concat(F.array(F.lit(ALL)), F.array_distinct("games"))).alias("facet"))
        facets.groupBy("cell", "facet").agg(F.count("*").alias("rows"), F.max("angle").alias("radius")).coalesce(1).write.mode("append").parquet(f"{path}/stats")

    # -- reading

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def centres(self, path: str | None = None) -> np.ndarray:
        place = f"{path or self.path}/centres"
        if not hadoop(self.spark, place)[1].exists(hadoop(self.spark, place)[0]):
            raise SetupError(f"there is no vector index at {self.path}; create it first")
        return np.array([r["centre"] for r in self.spark.read.schema("cell int, centre array<double>").parquet(place).orderBy("cell").collect()])

    def stats(self) -> DataFrame:
        """cell, facet, rows, radius; at most MOST_CELLS rows a facet."""
        found = self.spark.read.schema("cell int, facet string, rows long, radius double").parquet(f"{self.path}/stats")
        return found.groupBy("cell", "facet").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))

    def files(self, cells: Iterable[int] | None = None) -> int:
        """Files that a search of these cells reads (of all, where none are named)."""
        rows = self.rows() if cells is None else self.rows().filter(F.col("cell").isin(list(cells)))
        return rows.select("_metadata.file_path").distinct().count()

    def plan(self, queries: DataFrame, n: int, qid: str, vec_col: str, facet: str | None, probes: int | None = None) -> DataFrame:
        """qid, vec, facet, cell, bound, first: a query's cells that hold its facet, with the least angle that a row there
        can have, and whether the first step visits them."""
        centres = self.centres()
        probes = probes or max(4, int(PROBE_SHARE * len(centres)))
        asked = queries.select(F.col(qid).alias("qid"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(F.col(facet).cast("string"), F.lit(ALL)).alias("facet") if facet else F.lit(ALL).alias("facet"))
        asked = asked.filter(F.col("qid").isNotNull() & (F.size("vec") == centres.shape[1]) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
        per = self.stats().groupBy("facet").agg(F.collect_list(F.struct("cell", "rows", "radius")).alias("cells"))
        shared = self.spark.sparkContext.broadcast(centres)
        kind = asked.schema["qid"].dataType.simpleString()

        def choose(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for q, vec, name, cells in zip(frame["qid"], frame["vec"], frame["facet"], frame["cells"], strict=True):
                    number, rows, radius = (np.array([c[k] for c in cells]) for k in ("cell", "rows", "radius"))
                    angle = np.arccos(np.clip(shared.value[number] @ (vec / np.linalg.norm(vec)), -1, 1))
                    order = np.argsort(angle, kind="stable")
                    before = np.cumsum(rows[order]) - rows[order]
                    first = np.zeros(len(order), bool)
                    first[order] = (np.arange(len(order)) < probes) | (before < DEPTH * n)
                    yield pd.DataFrame({"qid": [q] * len(order), "vec": [vec] * len(order), "facet": name, "cell": number.astype(np.int32), "bound": np.maximum(0.0, angle - radius), "first": first})

        return asked.join(per, "facet").select("qid", "vec", "facet", "cells").mapInPandas(choose, f"qid {kind}, vec array<double>, facet string, cell int, bound double, first boolean")

    def _visit(self, pairs: DataFrame, n: int) -> DataFrame:
        """qid, chunk_id, distance: each cell's n nearest of its queries, with ties at nine decimals; where pairs have an
        ``edge``, none farther than it."""
        cells = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # at most MOST_CELLS
        kind = pairs.schema["qid"].dataType.simpleString()
        pieces = self.stats().filter(F.col("facet") == ALL).select("cell", F.ceil(F.col("rows") / PIECE).cast("int").alias("pieces"))
        rows = self.rows().filter(F.col("cell").isin(cells)).join(F.broadcast(pieces), "cell")
        rows = rows.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
        asked = pairs.join(F.broadcast(pieces), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("cell", "piece", "qid", "vec", "facet", F.col("edge") if "edge" in pairs.columns else F.lit(None).cast("double").alias("edge"))

        def nearest(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(rows) and len(asked):
                x, q = (np.stack(frame["vec"].to_numpy()) for frame in (rows, asked))
                x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
                ids, qids, facets, edges = rows["id"].to_numpy(), asked["qid"].to_numpy(), asked["facet"].to_numpy(), asked["edge"].to_numpy(np.float64)
                names = sorted(set(facets) - {ALL})
                held = dict(zip(names, _membership(rows["games"], names), strict=True)) | {ALL: np.ones(len(ids), bool)}
                for name in sorted(set(facets)):
                    at, own = np.flatnonzero(held[name]), np.flatnonzero(facets == name)
                    step = max(1, DISTANCES // max(1, len(at)))
                    for some in (own[k : k + step] for k in range(0, len(own) if len(at) else 0, step)):
                        distance = 1 - q[some] @ x[at].T
                        near = np.round(distance, 9)
                        kept = near <= np.where(np.isnan(edges[some]), np.inf, np.round(edges[some], 9))[:, None]
                        if len(at) > n:
                            kept &= near <= np.partition(near, n - 1, axis=1)[:, n - 1 : n]
                        i, j = np.nonzero(kept)
                        out.append((qids[some[i]], ids[at[j]], distance[i, j]))
            return pd.DataFrame(dict(zip(("qid", "chunk_id", "distance"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {"qid": [], "chunk_id": [], "distance": []})

        return rows.groupBy("cell", "piece").cogroup(asked.groupBy("cell", "piece")).applyInPandas(nearest, f"qid {kind}, chunk_id {self.key}, distance double")

    def search(self, queries: DataFrame, n: int, qid: str = "qid", vec_col: str = "embedding", facet: str | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """qid, chunk_id, distance, rank: the n nearest found by cosine distance, ties (at nine decimals) to the smaller id;
        with ``facet``, a column of the queries, among rows that list its value in games (null: all). ``exact`` goes on to
        every cell that its bound does not rule out."""
        pairs = materialise(self.plan(queries, n, qid, vec_col, facet, probes), "pairs")
        found = materialise(self._visit(pairs.filter("first"), n), "near")
        if exact:
            far = found.groupBy("qid").agg(F.sort_array(F.collect_list("distance")).alias("d")).select(F.col("qid").alias("_q"), F.when(F.size("d") >= n, F.get("d", n - 1)).alias("edge"))
            rest = pairs.filter("NOT first").join(far, F.col("qid") == F.col("_q"), "left")
            rest = rest.filter(F.col("edge").isNull() | (F.col("bound") <= F.acos(F.greatest(F.lit(-1.0), 1 - F.col("edge"))) + 1e-6)).drop("_q")
            found = found.unionByName(self._visit(materialise(rest, "rest"), n))
        order = Window.partitionBy("qid").orderBy(F.round("distance", 9), "chunk_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
