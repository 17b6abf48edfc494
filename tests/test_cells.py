"""The cell index against every distance: exact answers with facets, recall of the first step, files, appends, bad vectors."""

import numpy as np
import pytest
from corpusmith.errors import SetupError
from corpusmith.operators import dense
from corpusmith.scratch import new_folder
from corpusmith.sources.cells import CellIndex
from pyspark.sql import functions as F

STORE = "chunk_id long, embedding array<float>, games array<string>"


def hits(df):
    return sorted((r["qid"], r["rank"], r["chunk_id"], round(r["distance"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(25, 16)) * 3
    rows = [(i, (centres[i % 25] + r.normal(size=16)).tolist(), [["a"], ["b"], ["a", "b"], []][i % 4] + (["rare"] if i % 25 == 7 else [])) for i in range(1500)]
    rows += [(5000 + i, rows[3][1], ["a"]) for i in range(40)] + [(9000, None, ["a"]), (9001, [0.0] * 16, ["a"]), (9002, [float("nan")] + [1.0] * 15, None)]
    store = spark.createDataFrame(rows, STORE)
    index = CellIndex(spark, new_folder(spark, "cells"), "long")
    assert index.create(store.filter("chunk_id < 1200 OR chunk_id >= 5000"), cells=24) == 1240
    assert index.add(store) == 300 and index.add(store) == 0
    asked = [(i, rows[i * 31][1], [None, "a", "rare", "none"][i % 4]) for i in range(32)] + [(90, [0.0] * 16, None), (91, None, None)]
    return store, index, spark.createDataFrame(asked, "qid long, embedding array<float>, facet string")


def test_exact_equals_every_distance(made):
    store, index, asked = made
    want = hits(dense.top_k(asked, store, 10, facet="facet"))
    assert hits(index.search(asked, 10, facet="facet", exact=True, probes=2)) == want and want
    assert hits(index.search(asked.drop("facet"), 60, exact=True, probes=1)) == hits(dense.top_k(asked, store, 60))


def test_first_step_reads_few_files_and_recalls(made):
    store, index, asked = made
    pairs = index.plan(asked.filter("qid = 2"), 10, "qid", "embedding", "facet", probes=3)
    cells = [r["cell"] for r in pairs.filter("first").collect()]
    assert len(cells) < 24 and index.files(cells) < 0.5 * index.files()
    want = {x[::2] for x in hits(dense.top_k(asked, store, 10, facet="facet"))}
    found = {x[::2] for x in hits(index.search(asked, 10, facet="facet", probes=3))}
    assert len(want & found) >= 0.95 * len(want)


def test_recall_on_the_given_vectors(spark):
    store = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = CellIndex(spark, new_folder(spark, "cells"), "long")
    index.create(store)
    asked = store.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "qid")
    want = {x[::2] for x in hits(dense.top_k(asked, store, 10))}
    found = {x[::2] for x in hits(index.search(asked, 10))}
    assert len(want & found) >= 0.95 * len(want)


def test_no_index_and_wrong_lengths(spark, made):
    with pytest.raises(SetupError):
        CellIndex(spark, new_folder(spark, "cells")).centres()
    with pytest.raises(SetupError):
        made[1].add(spark.createDataFrame([(77_777, [1.0, 2.0], None)], STORE))
    with pytest.raises(SetupError):
        CellIndex(spark, new_folder(spark, "cells")).create(spark.createDataFrame([], STORE))


def test_visits_send_nothing_beyond_the_edge(spark, tmp_path):
    """Where the n-th best is known, a cell sends what may still be nearer, not n rows a query (F11, F13)."""
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(300)]
    store = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = CellIndex(spark, str(tmp_path / "cells"), "long")
    index.create(store, cells=8)
    asked = store.filter("chunk_id < 9").withColumnRenamed("chunk_id", "qid")
    pairs = index.plan(asked, 300, "qid", "embedding", None).withColumn("edge", F.lit(0.4))
    got = {(r.qid, r.chunk_id) for r in index._visit(pairs, 300).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(int(q), int(i)) for q, i in np.argwhere(1 - x[:9] @ x.T <= 0.4)}
