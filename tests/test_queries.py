"""Every registered query with SQL gives the same rows in DuckDB over the smallest driver tables."""

import math
import os

import duckdb
import pytest
from corpusmith.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{round(x, 6) + 0.0:g}" if isinstance(x, float) else f"{x:g}" if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 10**6 else str(x)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        found = con.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        assert got == rows(columns, found.fetchall())
    else:
        assert got[1]


def test_only_found_documents_are_cut(spark):
    """The chunks of found pages, without cutting the others (F18)."""
    from corpusmith.queries import chunk_rows

    found = spark.createDataFrame([(3,), (5,), (5,)], "pageid long")
    some, every = (rows.select("chunk_id", "pageid", "text") for rows in (chunk_rows(spark, "/root/testdata/sf0.001", found), chunk_rows(spark, "/root/testdata/sf0.001")))
    assert sorted(some.collect()) == sorted(every.filter("pageid IN (3, 5)").collect()) != []
