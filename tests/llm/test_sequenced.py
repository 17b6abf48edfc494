"""The sequenced applier against the rule read out row by row, one client after another, with plain lists."""

import math
import random
import zlib
from datetime import date, datetime

import pytest
from corpusmith.llm import sequenced
from corpusmith.llm.queries import op12_sequenced_changes
from pyspark.sql import functions as F

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def by_hand(rows, batches=8):
    """(change_id, client_id, status, batch, missed, city, cents, current) of each row, sorted."""
    rows = list(dict.fromkeys(rows))
    seqs = {}
    for r in rows:
        seqs.setdefault(r[1], set()).add(r[2])
    rank = {(c, s): i + 1 for c, found in seqs.items() for i, s in enumerate(sorted(found, key=lambda x: (x is not None, x)))}
    fed = {b: [] for b in range(1, batches + 2)}
    for change_id, client, seq, op, at, _, _, city, balance in rows:
        if at is None or change_id is None or (h := zlib.crc32(str(change_id).encode())) % 11 == 0:
            continue
        day = (at.date() - date(1970, 1, 1)).days + 2 * (h % 4)
        fed[max(1, min(8, 1 + (day - 19723) * 8 // 160))].append((day, change_id, client, rank[client, seq], op, city, balance))
    state, out, largest = {}, [], None

    def apply(client, batch, missed):
        s = state[client]
        change_id, _, op, city, balance = s["held"].pop(s["next"])
        s["next"] += 1
        if op == "I":
            s["city"], s["balance"] = city, balance
        elif op == "U":
            s["city"], s["balance"] = s["city"] if city is None else city, s["balance"] if balance is None else balance
        elif op == "D":
            s["city"] = s["balance"] = None
        s["last"] = (len(out), op)
        out.append([change_id, client, "applied", batch, missed, s["city"], None if s["balance"] is None else math.floor(100 * s["balance"] + 0.5), False])

    def run_on(client, batch, missed=0):
        while state[client]["next"] in state[client]["held"]:
            apply(client, batch, missed)
            missed = 0

    for batch in range(1, batches + 2):
        for client, s in state.items():
            while s["held"] and (batch > batches or min(x[1] for x in s["held"].values()) + 5 <= largest):
                was, s["next"] = s["next"], min(s["held"])
                run_on(client, batch, s["next"] - was)
        nulls_first = [(x[0], x[1], *((y is not None, y or 0 if i else y or "") for i, y in enumerate((x[4], 0, x[6])) if i != 1), (x[5] is not None, x[5] or "")) for x in fed[batch]]
        for _, (day, change_id, client, n, op, city, balance) in sorted(zip(nulls_first, fed[batch], strict=True), key=lambda x: (x[1][0], x[1][1], x[0])):
            s = state.setdefault(client, {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
            if n in s["held"] or n < s["next"]:
                out.append([change_id, client, "rejected", batch, 0, None, None, False])
            else:
                s["held"][n] = (change_id, day, op, city, balance)
                run_on(client, batch)
        largest = max([largest or 0, *(x[0] for x in fed[batch])])
    for s in state.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][7] = True
    return sorted(map(tuple, out), key=str)


def changes(n, seed, clients):
    r = random.Random(seed)
    seqs, out = {}, []
    for i in range(n):
        client = r.choice(clients) if r.random() < 0.6 else clients[0]
        seq = seqs[client] = seqs.get(client, -1) + r.choice([0, 1, 1, 1, 2])
        day = min(151, max(0, int(i * 150 / n) + r.choice([0, 0, 0, 0, -9, 4])))
        at = None if r.random() < 0.03 else datetime.fromordinal(date(2024, 1, 1).toordinal() + day)
        out.append((i, client, seq, r.choice("IUUUUDx") if r.random() > 0.02 else None, at, "s", None, r.choice([None, "A", "Bé"]), r.choice([None, 1.005, -3.255, 1e6])))
    out += r.sample(out, n // 10) + [(None, clients[0], 3, "U", datetime(2024, 2, 1), None, None, None, None)]
    r.shuffle(out)
    return out


def got(df):
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long")
    return sorted(map(tuple, df.select("change_id", "client_id", "status", "batch", "missed", "city", cents, "current").collect()), key=str)


@pytest.mark.parametrize("fresh", [1, sequenced.FRESH])
def test_equals_the_rule(spark, fresh):
    rows = changes(600, 7, [0, 1, 2, 3, 4, 5, 6, None])
    out = sequenced.apply_in_sequence(sequenced.numbered(spark.createDataFrame(rows, SCHEMA)), fresh=fresh)
    found = got(out)
    assert found == by_hand(rows)
    assert {r[2] for r in found} == {"applied", "rejected"} and any(r[4] > 0 for r in found) and any(r[3] == 9 for r in found)


def test_empty_batches_extra_columns_and_one_row(spark):
    """Nothing between the first days and the last: clocks still run in the batches between."""
    rows = [(i, i % 3, s, "I", datetime(2024, m, d), "s", None, f"c{i}", 1.0) for i, (s, m, d) in enumerate([(0, 1, 1), (5, 1, 2), (1, 1, 3), (7, 5, 20), (9, 1, 4), (3, 5, 21), (12, 1, 5), (2, 1, 1)])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("n", "day", "batch", "clock", "_k", "_range", "held")})
    assert got(sequenced.apply_in_sequence(sequenced.numbered(df))) == by_hand(rows)
    one = [(4, 9, 100, "D", datetime(2024, 5, 30), None, None, None, None)]
    assert got(sequenced.apply_in_sequence(sequenced.numbered(spark.createDataFrame(one, SCHEMA)))) == by_hand(one)


def test_empty_table(spark):
    out = sequenced.apply_in_sequence(sequenced.numbered(spark.createDataFrame([], SCHEMA)))
    assert out.count() == 0 and "current" in out.columns


def test_dense_rank_of_a_hot_key(spark):
    rows = [(1 if i % 3 else i, i * 7 % 50) for i in range(900)] + [(None, None), (None, 4), (1, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    found = {(r["k"], r["v"]): r["n"] for r in sequenced.dense_rank(df, "k", "v", "n").collect()}
    for key in {k for k, _ in rows}:
        values = sorted({v for k, v in rows if k == key}, key=lambda x: (x is not None, x))
        assert [found[key, v] for v in values] == list(range(1, len(values) + 1))


def test_query_equals_the_rule(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/client_changes.parquet").select(*sequenced.COLUMNS).collect()]
    out = op12_sequenced_changes(spark, sf)
    assert sorted(map(tuple, out.collect()), key=str) == by_hand(rows)
