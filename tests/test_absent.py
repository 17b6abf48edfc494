"""Insert-if-absent: the same keys as a set, few files read, replays and dead writers."""

import random

import numpy as np
import pytest
from corpusmith.scratch import new_folder
from corpusmith.sources import absent
from corpusmith.sources.absent import Inserted, KeyedTable, load_absent

ROWS = "id string, v int"


def keys(table):
    return sorted(r["id"] for r in table.read().collect())


def test_batches_equal_a_set(spark, monkeypatch):
    r, seen = random.Random(5), set()
    table = KeyedTable(spark, new_folder(spark, "keyed"), ROWS, "id")
    assert keys(table) == [] and table.insert(spark.createDataFrame([(None, 1)], ROWS)) == Inserted(0, 0, 0)
    for step in range(4):
        if step == 3:
            monkeypatch.setattr(absent, "MOST_KEYS", 5)  # too many keys to send: joined with all
        ids = [f"k{r.randrange(600)}" for _ in range(120)] + [None]
        done = table.insert(spark.createDataFrame([(i, step) for i in ids], ROWS))
        new = {i for i in ids if i} - seen
        assert done.added == len(new) and done.files == step
        seen |= new
    assert keys(table) == sorted(seen)


def test_replays_add_nothing_and_other_files_stay_shut(spark, tmp_path):
    table = KeyedTable(spark, new_folder(spark, "keyed"), ROWS, "id")
    batches = [[(f"b{b}-{i}", i) for i in range(200)] for b in range(6)]
    for b in batches:
        assert table.insert(spark.createDataFrame(b, ROWS)).read == 0  # no key is there: no file is read
    assert table.insert(spark.createDataFrame(batches[2], ROWS)) == Inserted(0, 1, 6)  # a replay opens its own file
    spark.createDataFrame(batches[4] + [("new", 1)], ROWS).write.parquet(f"{tmp_path}/in")
    for cp in ("one", "one", "lost"):
        load_absent(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/{cp}").awaitTermination(120)
    assert len(keys(table)) == 1201 == len(set(keys(table)))


def test_what_a_dead_writer_left_is_not_read(spark, monkeypatch):
    table = KeyedTable(spark, new_folder(spark, "keyed"), ROWS, "id")
    table.insert(spark.createDataFrame([("a", 1)], ROWS))
    monkeypatch.setattr(absent, "key_filter", None)
    with pytest.raises(Exception):  # noqa: B017
        table.insert(spark.createDataFrame([("b", 1)], ROWS))
    monkeypatch.undo()
    assert keys(table) == ["a"] and table.insert(spark.createDataFrame([("b", 2), ("a", 2)], ROWS)).added == 1


def test_filters_hold_their_keys_and_few_others():
    r = np.random.default_rng(1)
    h = r.integers(-(2**63), 2**63 - 1, 20_000)
    data = absent.key_filter(h)
    assert all(absent.may_hold(data, h[i : i + 1]) for i in range(0, 20_000, 97))
    others = r.integers(-(2**63), 2**63 - 1, 20_000)
    assert sum(absent.may_hold(data, others[i : i + 1]) for i in range(20_000)) <= 3
