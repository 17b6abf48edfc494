"""Collocations against plain counts of every phrase, under wide and narrow sketches."""

import random
import re
from collections import Counter

import duckdb
import pytest
from corpusmith.llm import collocation
from corpusmith.llm.queries import ORACLES, op13_collocations
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_hand(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in often.items():
        if any(len(q) > len(p) and g == lang and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in often.items()):
            continue
        score, _, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((g, i + 1, p.decode(), -a, left, right, n[g], -s) for g, rest in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rest)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = ["the", "The", "of", "river", "é", "É", "stone-age", "x y", "ß", "1", " ", "a", "b", "c"]
    out = []
    for i in range(150):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", " \r\n", "  "]) for _ in range(r.randint(0, 40)))
        out.append((i, text, r.choice(["en", "en", "fr", None, "und", ""]), "s", None))
    out += [(200, None, "en", None, None), (201, "", None, None, None), (202, " .,\n", "fr", None, None), (203, "New York City " * 3000, "en", None, None), (204, "x " * 5000 + ".", "fr", None, None)]
    return out + out[:9]


@pytest.mark.parametrize("width,least,top", [(1 << 16, 3, 2000), (1 << 20, 5, 7), (64, 2, 2000), (3000, 300, 2000)])
def test_equals_plain_counts(spark, rows, width, least, top):
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    found = got(collocation.collocations(df, least=least, top=top, width=width))
    assert found == by_hand(rows, least, top=top) and found


def test_empty_and_clashing_columns(spark, rows):
    none = spark.createDataFrame([], DOCS)
    assert got(collocation.collocations(none)) == []
    assert got(collocation.collocations(spark.createDataFrame([(1, None, None, None, None)], DOCS))) == []
    df = spark.createDataFrame(rows, DOCS)
    wide = df.withColumns({c: F.lit(1) for c in ("a", "k", "l", "r", "n", "size", "phrase", "rank", "block", "w")})
    assert got(collocation.collocations(wide, least=4, width=4096)) == got(collocation.collocations(df, least=4, width=1 << 14))


def test_sketch_never_falls_short(spark, rows):
    """Every phrase that reaches the count has its bits set, and few others have under a wide sketch."""
    import numpy as np
    import pyarrow as pa

    df = spark.createDataFrame(rows, DOCS).repartition(4)
    layout = collocation.Layout(1 << 16, 5)
    bits = collocation.frequent_cells(df, layout, 10)
    words = collocation.split_words(pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]))
    h, seen = words.hash, 0
    for size in range(1, 6):
        h = h if size == 1 else words.longer(h, size)
        mine = h[words.whole(size)]
        unique, back, n = np.unique(mine, return_inverse=True, return_counts=True)
        kept = np.ones(len(unique), bool)
        for places in layout.places(size, unique):
            kept &= (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
        assert kept[n >= 10].all()
        seen += (kept & (n < 10)).sum()
    assert seen <= 20


def test_products_beyond_64_bits(spark):
    """1000 a n passes 2^63 in decimals: scores of large counts are floored, not rounded."""
    row = spark.sql("SELECT (cast(1000 * cast(a as decimal(15,0)) as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) s FROM VALUES (99999999999L, 9999999999999L, 100000000007L, 100000000003L) t(a, n, l, r)").first()
    assert row["s"] == 1000 * 99999999999 * 9999999999999 // (100000000007 * 100000000003)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got(op13_collocations(spark, sf)) == sorted(con.execute(ORACLES["op13_collocations"]).fetchall())


def test_sketch_grows_with_the_text(spark, monkeypatch):
    """As the text grows sixteenfold, the sketch lets no larger share of the rare phrases through to the exact count."""
    import numpy as np

    monkeypatch.setattr(collocation, "WIDTH", 1 << 10)
    r = random.Random(5)

    def set_share(n):
        docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefghij") + str(r.randrange(4000)) for _ in range(500)), "en", "s", None) for i in range(n)], DOCS)
        seen = []
        monkeypatch.setattr(collocation, "frequent_cells", lambda d, layout, least, real=real: seen.append((layout, real(d, layout, least))) or seen[0][1])
        assert collocation.phrase_counts(docs, least=10).filter("size > 1").count() == 0
        layout, bits = seen[0]
        (at, cells), *_ = layout.rows(3)
        return np.unpackbits(bits, bitorder="little")[at : at + cells].mean()

    real = collocation.frequent_cells
    assert set_share(10) < 0.05 and set_share(160) < 0.05
    assert [collocation.sketch_width(x << 30, 100).bit_length() - 1 for x in (0, 1, 10, 1000)] == [10, 22, 25, 26]
