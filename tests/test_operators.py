"""Retrieval, fusion, parsing, joins, streaming and plans on small literal tables."""

import gzip
import hashlib
import json
import os
import random
import socket
import sqlite3
import subprocess
import tarfile
import zipfile

import pytest
from corpusmith import config, schemas
from corpusmith.errors import ConfigError, SetupError
from corpusmith.functions import facets as FA
from corpusmith.functions import vectors as V
from corpusmith.operators import chunking, dense, evaluate, fusion, html, joins, lexical, prompts, wikitext
from corpusmith.plans import build, hybrid
from corpusmith.sources import api, files
from corpusmith.sources.store import ChunkStore, Refreshed
from corpusmith.streaming import stateful
from pyspark.sql import functions as F

HITS = "qid string, rank int, chunk_id string, pageid long, title string, game string, heading string, url string, text string"


def hits(spark, rows):
    """(page, heading, text) in rank order for one question."""
    return spark.createDataFrame([("q", i, f"{p}-{i:04d}", p, f"T{p}", "XG", h, f"u/{p}", t) for i, (p, h, t) in enumerate(rows, 1)], HITS)


def test_cap_keeps_the_infobox(spark):
    df = hits(spark, [(1, "a", "x"), (1, "b", "x"), (1, "Infobox ", "x"), (2, "c", "x"), (1, "infobox", "y")])
    assert [r.chunk_id for r in fusion.cap_per_page(df, 9, 2).orderBy("rank").collect()] == ["1-0001", "1-0003", "2-0004"]
    assert fusion.cap_per_page(df, 2, 2).count() == 2 and fusion.cap_per_page(df, 9, 0).count() == 0


def test_cap_against_a_plain_version(spark):
    r = random.Random(4)
    for _ in range(3):
        rows = [(r.randint(1, 4), r.choice(["a", "infobox"]), r.choice(["t", "[X] y > infobox: z"])) for _ in range(25)]
        k, cap = r.randint(1, 12), r.randint(1, 3)
        kept = set()
        for page in {p for p, _, _ in rows}:
            own = [i for i, x in enumerate(rows) if x[0] == page]
            box = [i for i in own if rows[i][1] == "infobox" or "> infobox:" in rows[i][2]][:1]
            kept |= set((box + [i for i in own if i not in box])[:cap])
        want = [f"{rows[i][0]}-{i + 1:04d}" for i in sorted(kept)][:k]
        assert [x.chunk_id for x in fusion.cap_per_page(hits(spark, rows), k, cap).orderBy("rank").collect()] == want


def test_rrf_order_and_ties(spark):
    rows = [("q", 0, i, c) for i, c in enumerate("abc", 1)] + [("q", 1, i, c) for i, c in enumerate("bd", 1)]
    fused = fusion.rrf(spark.createDataFrame(rows, "qid string, list_id int, rank int, chunk_id string")).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == ["b", "a", "d", "c"]
    assert abs(fused[0].score - (1 / 62 + 1 / 61)) < 1e-12


@pytest.mark.parametrize(("bf", "bu", "want"), [(0.378, 0.256, True), (0.296, 0.239, False), (None, 0.25, True), (None, None, False), (0.3, None, False)])
def test_starved(spark, bf, bu, want):
    df = spark.createDataFrame([(bf, bu)], "f double, u double")
    assert df.select(fusion.starved(F.col("f"), F.col("u")).alias("s")).first().s is want


def test_merge_fragmented(spark):
    df = hits(spark, [(1, "a", "[XG] T1 > a: one"), (2, "b", "prose"), (1, "c", "[XG] T1 > c: two")])
    chunks = spark.createDataFrame([(1, f"1-{i:04d}", f"[XG] T1 > h: line {i}") for i in range(4)] + [(2, "2-0000", "prose"), (3, "3-0000", "x")], "pageid long, chunk_id string, text string")
    got = fusion.merge_fragmented(df, chunks).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["1-merged", "2-0002"]
    assert got[0].text == "[XG] T1 > combined: h: line 0\nh: line 1\nh: line 2\nh: line 3" and got[0].heading == "combined"
    short = fusion.merge_fragmented(df, chunks, max_chars=20).orderBy("rank").first()
    assert short.text.endswith("h: line 0\nh: line 1")
    assert fusion.merge_fragmented(df, chunks, max_chars=1).orderBy("rank").first().text.endswith(": h: line 0")


def test_stemmer_and_bm25_against_sqlite(spark):
    r = random.Random(2)
    words = "connect connected connection relational hopping hoped agreed plastered Rhéa generalization electricity adoption the of sky skies trouble".split()
    rows = [(str(i), " ".join(r.choice(words) for _ in range(r.randint(3, 30)))) for i in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(t, tokenize='porter unicode61')")
    con.executemany("INSERT INTO d(rowid, t) VALUES (?, ?)", [(int(i), t) for i, t in rows])
    index = lexical.build_index(spark.createDataFrame(rows, "chunk_id string, text string"), stemmed=True)
    questions = ["the connections of Rhea", "hopping electrical agreement", "skies troubled generalizations"]
    got = lexical.search(index, spark.createDataFrame(list(enumerate(questions)), "qid int, question string"), 40).collect()
    for qid, question in enumerate(questions):
        terms = [w for w in question.lower().split() if w not in ("the", "of")]
        want = dict(con.execute("SELECT rowid, -bm25(d) FROM d WHERE d MATCH ?", [" OR ".join(f'"{t}"' for t in terms)]).fetchall())
        mine = {int(x.chunk_id): x.score for x in got if x.qid == qid}
        assert set(mine) == set(want) and all(abs(mine[k] - v) < 1e-6 for k, v in want.items())


def test_dense_blocks_and_facets(spark, monkeypatch):
    rows = [(f"c{i}", [float(i % 5), float(i % 3), 1.0], ["a"] if i % 2 else ["b"]) for i in range(40)] + [("zero", [0.0, 0.0, 0.0], ["a"]), ("none", None, ["a"])]
    store = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, games array<string>")
    asked = spark.createDataFrame([(i, [float(i), 1.0, 1.0], "a" if i % 2 else None) for i in range(7)], "qid int, embedding array<float>, facet string")
    one = dense.top_k(asked, store, 3, facet="facet").orderBy("qid", "rank").collect()
    monkeypatch.setattr(dense, "BLOCK", 2)
    assert dense.top_k(asked, store, 3, facet="facet").orderBy("qid", "rank").collect() == one
    assert all(int(r.chunk_id[1:]) % 2 for r in one if r.qid % 2) and len(one) == 21
    assert dense.top_k(asked.limit(0), store, 3).count() == 0


WIKI = """{{XC1 enemy data|lv=12|hp = 300 <ref>x</ref>|place={{XC1|Colony 9|the colony}}|third}}
'''Bunnit''' lives in {{XC1|Colony 9}} [[File:a.png|thumb]] and [[Plains|the plains]].<ref name=a /> <!-- no -->

== Drops ==
Much.


More.
=== Rare ===
A [[gem]].
== Empty ==
[[Category:Enemies (XC1)]]
"""


def test_wikitext(spark):
    pages = spark.createDataFrame([("Bunnit", 1, WIKI), ("R", 2, " #REDIRECT [[x]] " + "y" * 60), ("S", 3, "short"), ("D", 4, "{{disambig}}" + "y" * 60), ("N", 5, None)], "title string, pageid long, wikitext string")
    row = wikitext.parse_pages(pages, "https://w/").collect()
    assert [r.pageid for r in row] == [1]
    row = row[0]
    assert (row.game, row.games, row.url) == ("XC1", ["XC1"], "https://w/Bunnit")
    assert [(f.k, f.v) for f in row.infoboxes[0].fields] == [("lv", "12"), ("hp", "300"), ("place", "the colony"), ("1", "third")]
    nested = "{{XC1|a}}{{other|{{XC1|[[b|c]]}}}} d {{XC1|x=1|T|[[p|q]] s}} {{open {{XC1|z}}" + "{{" * 50
    assert wikitext.render_links(nested, ["XC1"]) == "a{{other|c}} d q s {{open z" + "{{" * 50
    assert wikitext.render_links("{{keep|{{in|1}}}} {{XC1|u}}", ["XC1"]) == "{{keep|{{in|1}}}} u"
    assert wikitext.plain("[[a|[[b]] c]] " + "[[x|y]]" * 3000) == "b c " + "y" * 3000
    assert [(s.heading, s.text) for s in row.sections] == [("Introduction", "Bunnit lives in Colony 9  and the plains."), ("Drops", "Much.\n\nMore.\nRare\nA gem.")]


PAGE = """<div class="mw-parser-output"><div class="toc">no</div><table class="infobox"><tr><th></th><th>Base</th><th>Scaling</th></tr>
<tr><th>HP</th><td>10</td><td></td></tr><tr><th>STR</th><td></td><td>5 scaling</td></tr><tr><td>extra<td>more</tr></table>
<p>First <b>bold</b> , text<p>Second <a>link</a> 's end<h2><span class="mw-headline">Drops</span><span class="mw-editsection">edit</span></h2>
<table><tr><th>Item</th><th>Rate</th></tr><tr><td>Gem</td><td>5%</td></tr><tr><td>Coin</td><td></td></tr></table>
<div><ul><li>one<li>two</ul></div><h3>Spawn points</h3><table><tr><th>x</th><td>1</td></tr></table><script>bad()</script><h2></h2><p>tail</div>"""


def read_page(spark, *pages):
    rows = html.read_pages(spark.createDataFrame(list(enumerate(pages)), "n int, html string")).orderBy("n").collect()
    return [([b.asDict() for b in r.factblocks], [x.asDict() for x in r.sections]) for r in rows]


def test_html(spark):
    (blocks, sections), nothing, none = read_page(spark, PAGE, "", None)
    assert nothing == none == ([], [])
    assert blocks == [{"heading": "infobox", "lines": ["HP: 10 base.", "STR: 5 scaling, extra, more."]}, {"heading": "Drops", "lines": ["Gem - Rate: 5%.", "Coin."]}]
    assert sections == [{"heading": "Introduction", "text": "First bold, text Second link's end"}, {"heading": "Drops", "text": "one two"}, {"heading": "Spawn points", "text": "tail"}]


def test_html_tables(spark):
    """Headers in two rows, a table inside a cell, columns already said, a header row alone, and a head group."""
    pages = (
        "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><th>Name</th><th>Rate </th><th></th></tr><tr><td>x</td><td> 5 </td><td>y</td><td>z</td></tr></tbody></table>",
        "<table><tr><th>k</th><td>v<table><tr><th>in</th><td>side</td></tr></table></td></tr></table>",
        "<table><tr><th></th><th>Base</th></tr><tr><th>HP</th><td>10 base</td></tr><tr><th>MP</th><td></td></tr><tr><td></td><td>more</td></tr></table>",
        "<table><tr><th>only</th><th>heads</th></tr></table><table><tr><td>loose</td></tr></table><h2> </h2><h3>H</h3><table class='x infobox-y'><tr><th>a</th><td>b</td></tr></table>",
    )
    got = [blocks for blocks, _ in read_page(spark, *pages)]
    assert got[0] == [{"heading": "Introduction", "lines": ["x - Rate: 5; y; z."]}]
    assert got[1] == [{"heading": "Introduction", "lines": ["k: v in side."]}]
    assert got[2] == [{"heading": "Introduction", "lines": ["HP: 10 base, more."]}]
    assert got[3] == [{"heading": "infobox", "lines": ["a: b."]}]


def test_html_grid_cap(spark):
    rows = "".join(f"<tr><td>n{i}</td><td>{'v' * 400}</td></tr>" for i in range(60))
    lines = read_page(spark, f"<table><tr><th>Name</th><th>V</th></tr>{rows}</table>")[0][0][0]["lines"]
    assert len(lines) == 40 and all(len(x) <= 322 and x.endswith("….") for x in lines)


def test_chunks(spark):
    article = ("T", 7, "XG", ["XG"], "u", [("box", [("lv", "3"), ("hp", " "), ("note", " ".join("abcdefgh"))])], [(None, ["f1", "f2"]), ("Stats", ["  "])], [("Intro", "one two three"), ("Blank", "")])
    df = spark.createDataFrame([article], schemas.ARTICLES)
    got = [(r.chunk_id, r.heading, r.text) for r in chunking.chunk_articles(df, 10, 2).orderBy("chunk_id").collect()]
    assert got[0] == ("7-0000", "infobox", "[XG] T > infobox: box. Level: 3. Note: a b")
    assert got[1][2].startswith("[XG] T > infobox: a b c") and got[2] == ("7-0002", "infobox", "[XG] T > infobox: f1 f2")
    assert got[3] == ("7-0003", "Intro", "[XG] T > Intro: one two three") and len(got) == 4
    with pytest.raises(ConfigError):
        config.chunk_params({"chunk_max_tokens": 5, "chunk_overlap": 5})


def test_joins(spark):
    log = spark.createDataFrame([("a", "timeout: x", 1), ("a", None, 2), ("b", None, 1), ("b", "timeout: y", 2), ("c", "missingtitle", 1)], "title string, error string, o int")
    assert [r.title for r in joins.retry_set(log, ["o"]).collect()] == ["b"]
    left = spark.createDataFrame([("1", "L1"), ("9", "L9")], "key string, v string")
    right = spark.createDataFrame([("1", "R1", 1), ("1", "R1b", 2), ("2", "R2", 3)], "key string, v string, o int")
    got = sorted((r.key, r.v, r.source) for r in joins.prefer_left(left, right, "key", ["v"], "o").collect())
    assert got == [("1", "L1", "left"), ("1", "R1b", "right"), ("2", "R2", "right"), ("9", "L9", "left_only")]
    rows = spark.range(103)
    batches = joins.in_batches(rows, 25, ["id"]).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("m")).orderBy("batch").collect()
    assert [(r.batch, r.n, r.m) for r in batches] == [(i, min(25, 103 - 25 * i), 25 * i) for i in range(5)]
    with pytest.raises(SetupError):
        joins.check_unique(rows.union(rows.limit(1)), "id")
    with pytest.raises(Exception, match="differ in length"):
        spark.range(1).select(joins.zip_strict(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).collect()


def test_sources_and_prompts(spark):
    df = hits(spark, [(1, "a", "[XG] T > a: text one"), (2, "b", "two"), (1, "c", "three"), (3, "d", "four")])
    cards = prompts.source_cards(df).orderBy("n").collect()
    assert [(r.url, r.relevance, r.tier) for r in cards] == [("u/1", 1.0, "high"), ("u/2", 0.5, "med"), ("u/3", 0.0, "low")] and cards[0].snippet == "text one"
    asked = spark.createDataFrame([("q", "Who?", None), ("none", "What?", "XG")], "qid string, question string, game string")
    got = {r.qid: r.prompt for r in prompts.build_prompts(asked, df).collect()}
    assert "[1] [T1 (XG)] three\nSource: u/1" in got["q"] and "from [1] to [3]" in got["q"] and got["q"].endswith("Question: Who?")
    assert prompts.WORDING["nothing"] in got["none"] and "about XG (XG)" in got["none"]


def test_answer_events(spark):
    rows = [("a", "fast", "x" * 20 + '"', False, "[1]", None), ("b", None, "", True, None, None), ("c", "fast", "t", False, "[]", "bad")]
    df = spark.createDataFrame(rows, "qid string, tier string, answer string, declined boolean, sources string, error string")
    by = {}
    for r in prompts.answer_events(df).orderBy("qid", "seq").collect():
        by.setdefault(r.qid, []).append((r.kind, json.loads(r.payload)))
    assert by == {"a": [("tier", "fast"), ("text", "x" * 16), ("text", 'xxxx"'), ("sources", [1])], "b": [("declined", True), ("sources", [])], "c": [("error", "bad")]}


def test_evaluation(spark):
    gold = spark.createDataFrame([("q", "XG", "item", "u/2/ ", None), ("z", "XG", "item", "u/9", "T9")], "qid string, game string, category string, source_url string, source_title string")
    ranked = evaluate.gold_hits(gold, hits(spark, [(1, "a", "x"), (2, "b", "x"), (2, "c", "x")]))
    overall = evaluate.hit_rates(ranked).filter("level = 3").first()
    assert (overall.n, overall.hits, overall.hit_rate, overall.mean_rank) == (2, 1, 0.5, 2.0)


def test_limiter_matches_stream_and_plain(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"k{r.randint(0, 3)}", 1_700_000_000 + r.randint(0, 400), i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, s long, i int").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.i: x.allowed for x in stateful.limit(df, "key", "ts", 2, 60.0, "i").collect()}
    own, want = stateful.Limiter(2, 60.0), {}
    for key, s, i in sorted(rows, key=lambda x: (x[1], x[2])):
        want[i] = own.allow(key, float(s))
    assert got == want and 0 < sum(want.values()) < 300
    assert all(stateful.Limiter(None).allow("a", 0) for _ in range(9))
    df.select("key", "ts").dropDuplicates(["key", "ts"]).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
    query = stateful.stream_limit(stream, "key", "ts", 2, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = stateful.limit(spark.read.parquet(f"{tmp_path}/in"), "key", "ts", 2, 60.0)
    assert sorted(map(tuple, spark.table("limited").select("key", "ts", "allowed").collect())) == sorted(map(tuple, batch.select("key", "ts", "allowed").collect()))


def test_incremental_stream_is_idempotent(spark, tmp_path):
    write = lambda rows, n: spark.createDataFrame(rows, "id string, v int").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda cp: stateful.load_new(spark.readStream.schema("id string, v int").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", "id", f"{tmp_path}/{cp}").awaitTermination(120)
    write([("a", 1), ("b", 1), ("a", 1), (None, 1)], 1)
    run("cp")
    write([("b", 2), ("c", 2)], 2)
    run("cp")
    run("other")  # all of it again, from a lost checkpoint
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


class Service:
    """A transport that pages, throttles and fails as told."""

    def __init__(self, replies):
        self.replies, self.asked = list(replies), []

    def __call__(self, params):
        self.asked.append(params)
        reply = self.replies.pop(0)
        return reply if isinstance(reply, tuple) else (200, {}, json.dumps(reply))


def test_api_client():
    waits = []
    pages = [{"query": {"allpages": [{"title": "A", "pageid": 1}]}, "continue": {"apcontinue": "B"}}, (429, {"Retry-After": "500"}, ""), {"error": {"code": "maxlag"}}, (200, {}, "<html>"), {"query": {"allpages": [{"title": "B", "pageid": 2}]}}]
    client = api.Client(Service(pages), delay=0.5, sleep=waits.append)
    assert [t["title"] for t in api.titles(client)] == ["A", "B"]
    assert waits == [0.5, 120, 6, 12, 0.5] and client.transport.asked[-1]["apcontinue"] == "B"
    with pytest.raises(api.StillFailing):
        api.Client(Service([(500, {}, "")] * 6), sleep=waits.append).get({})
    assert api.fetch_html(api.Client(Service([(404, {}, "")]), sleep=waits.append), "X")["error"].startswith("request:")
    assert api.fetch_html(api.Client(Service([{"error": {"code": "missingtitle"}}]), sleep=waits.append), "X")["error"] == "missingtitle"


def test_files_and_store(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("B", None)], schemas.TITLES)
    assert files.write_jsonl(rows, f"{tmp_path}/t", "gzip") == 2
    assert files.read_jsonl(spark, f"{tmp_path}/t", schemas.TITLES).count() == 2
    with pytest.raises(SetupError):
        files.require_input(rows.limit(0), "titles", "harvest first")
    chunk = lambda i, p, t: (i, p, "T", "XG", ["XG"], "h", "u", t)
    make = lambda *r: spark.createDataFrame(list(r), schemas.CHUNKS)
    store = ChunkStore(spark, f"{tmp_path}/store", schemas.VECTORS)
    with pytest.raises(SetupError):
        store.read()
    assert store.add(make(chunk("a", 1, "x"), chunk("a", 1, "x"), chunk("n", None, "x"))) == 1
    assert store.add(make(chunk("a", 1, "changed"), chunk("b", 1, "y"))) == 1
    assert {r.chunk_id: r.text for r in store.read().collect()} == {"a": "x", "b": "y"}
    assert store.rebuild(make(chunk("a", 1, "changed"))) == 1 and store.read().first().text == "changed"
    store.drop()
    store.drop()
    assert not store.exists()


def test_corpus_build_and_hybrid(spark, tmp_path):
    wiki = lambda name, code: f"{{{{{code} place infobox|lv=3}}}} {name} is a quiet place with a long river and many old stones in it."
    pages = [("River", 1, [(((wiki("River", "XG"),),),)]), ("Stone", 2, [(((wiki("Stone", "XC1"),),),)]), ("Gone", 3, [((("#redirect [[x]]",),),)])]
    spark.createDataFrame(pages, schemas.PAGES).write.json(f"{tmp_path}/pages")
    records = [("Stone", 2, "<p>Rendered stone page about towers.</p>", wiki("Stone", "XC1"), None), ("Extra", 4, "<p>Only rendered tower.</p>", None, None), ("Bad", 5, None, None, "timeout: x")]
    spark.createDataFrame(records, schemas.HTML_RECORDS).write.json(f"{tmp_path}/html")
    pipe = build.Pipeline(spark, str(tmp_path), config.load_config(), "https://w/")
    done = dict(pipe.run("build"))
    assert done["parse"] == {"left": 1, "left_only": 1, "right": 1} and done["chunk"] == done["embed"] == done["bm25"]
    assert [s for s, _ in pipe.run("rebuild", dry=True)] == ["parse", "chunk", "embed_fresh", "bm25"]
    with pytest.raises(SetupError):
        pipe.run("harvest_moon")
    asked = spark.createDataFrame([(1, "where is the tower", None), (2, "river stones", "XG"), (3, "rendered tower", "XC2")], "qid int, question string, game string")
    cfg = config.load_config(top_k=3, starved_gap=0.05)
    got = hybrid.retrieve(asked, pipe.store.read(), pipe.index(), cfg)
    rows = got.orderBy("qid", "rank").collect()
    assert {r.title for r in rows if r.qid == 1} >= {"Stone", "Extra"}
    assert {r.title for r in rows if r.qid == 2} == {"River"} and all(r.relaxed for r in rows if r.qid == 3) and any(r.qid == 3 for r in rows)
    assert hybrid.prompt_hits(got, pipe.store.read(), cfg).count() <= len(rows)


def test_grounding(spark):
    make = lambda tier, rows: spark.createDataFrame([(q, tier, 1, f"{q}-{tier}") for q in rows], "qid int, tier string, rank int, chunk_id string")
    verdicts = lambda rows: spark.createDataFrame(rows, "qid int, verdict string, confidence double")
    out = hybrid.ground(make("fast", [1, 2, 3]), verdicts([(1, "answered", 0.9), (2, "not_covered", 0.9), (3, "not_covered", 0.9)]), make("scholar", [1, 2, 3]), verdicts([(2, "answered", 0.9), (3, "not_covered", 0.95)]))
    assert sorted((r.qid, r.tier, r.escalated, r.declined) for r in out.collect()) == [(1, "fast", False, False), (2, "scholar", True, False), (3, "scholar", True, True)]


def test_config(tmp_path):
    assert config.apply_tier(config.DEFAULTS, "scholar")["top_k"] == 96 and config.apply_tier({"a": 1}, "x") == {"a": 1}
    (tmp_path / "c.json").write_text('{"top_k": 3}')
    assert config.load_config(str(tmp_path / "c.json"))["top_k"] == 3
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ConfigError):
        config.load_config(str(tmp_path / "bad.json"))
    (tmp_path / ".env").write_text("A='x y'\n# no\nB=2\n")
    env = {"B": "kept"}
    assert config.load_env(str(tmp_path / ".env"), env) == {"A": "x y", "B": "2"} and env == {"B": "kept", "A": "x y"}
    assert FA.DEFAULT.every == "series" and V.BUCKETS == 256


def wiki_service(awake):
    """Makes a client of a service with three pages: titles in two parts, wikitext, and rendered pages of which one times out
    until the file ``awake`` is there."""
    texts = {t: f"{{{{XG place infobox|lv={i}}}}} {t} is a quiet place with a long river and many old stones." for i, t in enumerate(("Mill", "River", "Tower"))}

    def send(params):
        reply = {}
        if params["action"] == "parse":
            if params["page"] == "Tower" and not os.path.exists(awake):
                return 503, {}, ""
            reply["parse"] = {"title": params["page"], "pageid": sorted(texts).index(params["page"]), "text": f"<p>{params['page']} as it is shown.</p>", "wikitext": texts[params["page"]]}
        elif "list" in params:
            more = "apcontinue" in params
            reply["query"] = {"allpages": [{"title": t, "pageid": i} for i, t in enumerate(sorted(texts)) if (i > 1) == more]}
            reply |= {} if more else {"continue": {"apcontinue": "T"}}
        else:
            reply["query"] = {"pages": [{"title": t, "pageid": sorted(texts).index(t), "revisions": [{"slots": {"main": {"content": texts[t]}}}]} for t in params["titles"].split("|")]}
        return 200, {}, json.dumps(reply)

    return lambda: api.Client(send, delay=0, sleep=lambda s: None)


def test_build_from_the_service_on(spark, tmp_path):
    awake = f"{tmp_path}/awake"
    root = f"{tmp_path}/root"
    pipe = build.Pipeline(spark, root, config.load_config(), "https://w/", make_client=wiki_service(awake))
    assert dict(pipe.run("harvest")) == {"harvest": 3} and [r.title for r in pipe.titles().orderBy("title").collect()] == ["Mill", "River", "Tower"]
    assert dict(pipe.run("fetch_wikitext")) == {"fetch_wikitext": 3} == dict(pipe.run("fetch_wikitext"))
    assert dict(pipe.run("fetch"))["fetch"] == {"timeout": 1}
    open(awake, "w").close()
    assert dict(pipe.run("retry_timeouts")) == {"retry_timeouts": 1} and dict(pipe.run("retry_timeouts")) == {"retry_timeouts": 0}
    records = files.read_jsonl(spark, f"{root}/html", schemas.HTML_RECORDS, numbered=True)
    assert joins.retry_set(records, ["file_name", "line"]).count() == 0 and records.filter("title = 'Tower'").count() == 2
    assert max(r.file_name for r in records.collect()).startswith("block=09000/")
    assert dict(pipe.run("build"))["parse"] == {"left": 3}
    api.fetch_batches(spark, spark.createDataFrame([("Mill",), ("New",)], "title string"), root + "/html", failing_service, blocks=api.EXTRA)
    assert {r.title: r.file_name[:11] for r in files.read_jsonl(spark, f"{root}/html", schemas.HTML_RECORDS).filter("error = 'missingtitle'").collect()} == {"New": "block=01000"}
    with files.run_lock(spark, root), pytest.raises(SetupError):
        pipe.run("parse")
    with pytest.raises(SetupError):
        build.Pipeline(spark, root, {}, "").run("harvest")
    assert pipe.run("all", dry=True)[0] == ("harvest", None)


def failing_service():
    return api.Client(lambda params: (200, {}, json.dumps({"error": {"code": "missingtitle"}})), delay=0, sleep=lambda s: None)


def test_records_keep_their_lines(spark, tmp_path):
    rows = [{"title": f"t{i}", "pageid": i} for i in range(300)]
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/a.jsonl", "w") as out:
        out.write("\n".join(json.dumps(r) for r in rows[:200]) + "\n\nnot json\n")
    with gzip.open(f"{tmp_path}/in/b.jsonl.gz", "wt") as out:
        out.write("\n".join(json.dumps(r) for r in rows[200:]))
    got = files.read_jsonl(spark, f"{tmp_path}/in", schemas.TITLES, numbered=True).orderBy("file_name", "line").collect()
    assert [r.title for r in got] == [r["title"] for r in rows]
    assert files.read_jsonl(spark, f"{tmp_path}/in", schemas.TITLES).count() == 300


def test_tables_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (3, 5):
        with files.replacing(spark, path) as fresh:
            spark.range(n).write.parquet(fresh)
        assert spark.read.parquet(path).count() == n
    with pytest.raises(ZeroDivisionError), files.replacing(spark, path) as fresh:
        spark.range(9).write.parquet(fresh)
        raise ZeroDivisionError
    assert spark.read.parquet(path).count() == 5 and sorted(os.listdir(tmp_path)) == ["t"]
    seen = Refreshed(spark, path, lambda: spark.read.parquet(path))
    first = seen.get()
    assert seen.get() is first and first.count() == 5
    with files.replacing(spark, path) as fresh:
        spark.range(7).write.parquet(fresh)
    assert seen.get() is not first and seen.get().count() == 7


def test_an_index_that_does_not_fit_is_not_put_in_place(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one two"), ("b", "two three")], "chunk_id string, text string")
    index = lexical.build_index(rows)
    index.materialise(f"{tmp_path}/bm25", rows)
    with pytest.raises(SetupError):
        lexical.build_index(rows.limit(1)).materialise(f"{tmp_path}/bm25", rows)
    broken = lexical.Index(index.postings.unionByName(index.postings), index.frequencies, index.stats, False)
    with pytest.raises(SetupError):
        broken.materialise(f"{tmp_path}/bm25", rows)
    assert spark.read.parquet(f"{tmp_path}/bm25/postings").count() == 4
    asked = spark.createDataFrame([(1, "two")], "qid int, question string")
    part = lexical.build_index(rows, asked=lexical.query_terms(asked, "qid", "question"))
    assert [r.term for r in part.frequencies.collect()] == ["two"]
    assert lexical.search(part, asked).collect() == lexical.search(index, asked).collect()


def test_archives(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "f").write_text("x")
    with tarfile.open(tmp_path / "good.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "src" / "f", "d/f")
    with tarfile.open(tmp_path / "bad.tar", "w") as tar:
        tar.add(tmp_path / "src" / "f", "../f")
    digest = hashlib.sha256((tmp_path / "good.tar.gz").read_bytes()).hexdigest()
    assert files.extract_archive(str(tmp_path / "good.tar.gz"), str(tmp_path / "out"), digest) == 1 and (tmp_path / "out/d/f").read_text() == "x"
    for name, check in (("bad.tar", None), ("good.tar.gz", "0" * 64)):
        with pytest.raises(SetupError):
            files.extract_archive(str(tmp_path / name), str(tmp_path / "other"), check)
    assert not (tmp_path / "other").exists() and not (tmp_path / "f").exists()


def test_zip_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as made:
        made.writestr("d/", "")
        made.writestr("d/f", "x")
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    for name, member in (("up.zip", "../f"), ("link.zip", link)):
        with zipfile.ZipFile(tmp_path / name, "w") as made:
            made.writestr("fine", "y")
            made.writestr(member, "/etc/passwd")
        with pytest.raises(SetupError):
            files.extract_archive(str(tmp_path / name), str(tmp_path / "other"))
    digest = hashlib.sha256((tmp_path / "good.zip").read_bytes()).hexdigest()
    assert files.extract_archive(str(tmp_path / "good.zip"), str(tmp_path / "out"), digest) == 1 and (tmp_path / "out/d/f").read_text() == "x"
    assert not (tmp_path / "other").exists()


def test_a_dead_runs_lock_is_taken_over(spark, tmp_path):
    ended = subprocess.Popen(["true"])
    ended.wait()
    lock = tmp_path / ".lock"
    lock.write_text(json.dumps({"host": socket.gethostname(), "pid": ended.pid}))
    with files.run_lock(spark, str(tmp_path)):
        assert json.loads(lock.read_text())["pid"] == os.getpid()
    assert not lock.exists()
    for owner in ({"host": "elsewhere", "pid": ended.pid}, {"host": socket.gethostname(), "pid": os.getpid()}, {}):
        lock.write_text(json.dumps(owner))
        with pytest.raises(SetupError), files.run_lock(spark, str(tmp_path)):
            pass
        assert json.loads(lock.read_text()) == owner


def test_evaluation_sets_and_totals(spark):
    gold, off = spark.createDataFrame([(1, "q", "XG"), (2, "r", None)], "i int, question string, game string"), spark.createDataFrame([(3, "hi")], "i int, question string")
    cases = evaluate.case_sets(gold=gold, off_topic=off)
    assert sorted((r.kind, r.i, r.game) for r in cases.collect()) == [("gold", 1, "XG"), ("gold", 2, None), ("off_topic", 3, None)]
    assert [r.i for r in evaluate.first_of(cases, 2, "i").collect()] == [1, 2] and evaluate.first_of(cases, None, "i").count() == 3
    said = spark.createDataFrame([(None, "XC1"), ("down", None), (None, "")], "error string, foreign_tags string")
    assert tuple(evaluate.totals(said).first()) == (3, 1, 1) and tuple(evaluate.totals(said.limit(0)).first()) == (0, 0, 0)
    hit = FA.main_hit(F.split("terms", " "), F.split("titles", ","))
    rows = spark.createDataFrame([("old mill", "The Old Mill (XG),x"), ("old mill", "Old,Mill")], "terms string, titles string")
    assert [r[0] for r in rows.select(hit).collect()] == [True, False]


def test_embedders(spark):
    from corpusmith.functions import vectors as V

    def gone():
        raise ImportError("no such package")

    embed = V.first_that_loads(gone, lambda: V.hash_embedding)
    with pytest.raises(SetupError, match="no such package"):
        V.first_that_loads(gone)
    row = spark.createDataFrame([("river", None)], "q string, n string").select(embed(F.col("q")), V.with_instruction(embed, "find: ")(F.col("q")), V.hash_embedding(F.lit("find: river")), V.with_instruction(embed, "find: ")(F.col("n"))).first()
    assert row[0] != row[1] == row[2] and row[3] is None


def test_command_line(spark, tmp_path, capsys):
    from corpusmith.__main__ import main

    pages = [("River", 1, [((("{{XG place infobox|lv=3}} The river is a quiet place with many old stones in it.",),),)])]
    spark.createDataFrame(pages, schemas.PAGES).write.json(f"{tmp_path}/pages")
    spark.createDataFrame([], schemas.HTML_RECORDS).write.json(f"{tmp_path}/html")
    build_ = ["build", "--root", str(tmp_path), "--base-url", "https://w/"]
    assert main([*build_, "--dry-run", "build"]) == 0 and capsys.readouterr().out.count("step") == 4
    assert main([*build_, "build"]) == 0 and main([*build_, "harvest"]) == 2
    assert main(["ask", "--root", str(tmp_path), "-q", "old stones", "--tier", "thinking", "--k", "3"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["tier"] == "thinking" and said["sources"][0]["title"] == "River"


def test_everyday_pages_need_no_tokenizer():
    """Everyday pages give the tree that the tokenizer gives; pages with anything else go to it."""
    from corpusmith.queries import MADE_PAGE

    def told(page):
        builder = html._Builder()
        builder.feed(page)
        builder.close()
        return builder.root

    odd = ["a < b", "<!-- c --><p>x</p>", "<script>if (a<b) x</script>", '<a href="a>b">x</a>', "<p a=\">", "</ p>", "<A HREF=x>y</A>"]
    plain = [MADE_PAGE, "", "a &amp; b", "<P Class='x &lt; y' nowrap>a<br/>b &nbsp", '<td colspan="" id="toc">\n</td >']
    for page in odd + plain:
        assert html.tree(page) == told(page), page
    assert all(html._everyday(page) is None for page in odd) and all(html._everyday(page) is not None for page in plain)


def test_made_pages_are_dealt_to_all_cores(spark):
    """A table in one file is parsed by all cores, not by one task."""
    from corpusmith import queries

    sf = "/root/testdata/sf0.001"
    assert queries.made_pages(spark, sf).rdd.getNumPartitions() == queries.made_articles(spark, sf).rdd.getNumPartitions() == 4


def test_dense_memory_does_not_follow_the_batch(spark, monkeypatch):
    """However many rows a message brings, distances to a block are held for so many of them alone."""
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=4).round(1).tolist()) for i in range(300)]
    store = spark.createDataFrame([(i, v, ["a", "b"][: 1 + i % 2]) for i, v in vectors], "chunk_id long, embedding array<double>, games array<string>").coalesce(1)
    asked = spark.createDataFrame([(i, v, "b" if i % 2 else None) for i, v in vectors[:150]], "qid long, embedding array<double>, game string")
    read = lambda: {(r.qid, r.rank): (r.chunk_id, round(r.distance, 9)) for r in dense.top_k(asked, store, 5, facet="game").collect()}
    whole = read()
    monkeypatch.setattr(dense, "ROWS", 7)
    assert read() == whole and len(whole) == 150 * 5


def test_second_list_is_cut_before_questions_get_it(spark):
    """The ten smallest ids of a label are found once a label, not once for every question: no join lies below a window
    over all rows of a question's label."""
    from corpusmith import queries

    plan = queries.two_lists(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert any("windowspecdefinition(label" in line for line in windows) and sum("windowspecdefinition(qid" in line for line in windows) == 1


def test_asked_index_writes_asked_tokens_alone(spark, monkeypatch):
    """Of the texts only asked tokens are written; lengths, frequencies and scores are those of the whole texts, with a
    list of terms or without."""
    texts = spark.createDataFrame([(1, "It's the mill's mill of wind"), (2, "wind and water"), (3, None), (4, "don\\t walk"), (5, "")], "chunk_id long, text string")
    asked = spark.createDataFrame([("mill",), ("wind",), ("t",), ("no'ne",), ("back\\",)], "term string")
    kept = []
    monkeypatch.setattr(lexical, "materialise", lambda df, name: kept.append((name, df)) or df)
    read = lambda index: ({tuple(r) for r in index.postings.collect()}, {tuple(r) for r in index.frequencies.collect()}, index.stats.first())
    listed = read(lexical.build_index(texts, asked=asked))
    assert {t for r in dict(kept)["terms"].collect() for t in r.terms or ()} == {"mill", "wind", "t"}
    monkeypatch.setattr(lexical, "LISTED_TERMS", 2)
    assert read(lexical.build_index(texts, asked=asked)) == listed
    assert listed[0] == {r for r in read(lexical.build_index(texts))[0] if r[0] in {"mill", "wind", "t"}}


def test_scores_are_summed_where_the_postings_lie(spark, monkeypatch):
    """Between the join and the sum of a chunk's scores nothing is shuffled, and the scores are those of the shuffled join."""
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(12) if (i * 7 + j) % 5)) for i in range(40)], "chunk_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 3} w{q + 3}") for q in range(8)], "qid long, question string")
    index = lexical.build_index(texts)
    found = lexical.scores(index, lexical.query_terms(asked, "qid", "question"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    above = found._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[0]
    assert "BroadcastHashJoin" in plan and "Exchange" not in above
    read = lambda df: {(r.qid, r.chunk_id): round(r.score, 9) for r in df.collect()}
    near = read(found)
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 1)
    assert read(lexical.scores(index, lexical.query_terms(asked, "qid", "question"))) == near and len(near) > 100


def test_best_of_many_questions_makes_no_row_a_pair(spark, monkeypatch):
    """Parts and blocks give what scores of all pairs give, ties included, and only the best leave a task (F3)."""
    draw = random.Random(5)
    names = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.choices(names, range(30, 0, -1), k=draw.randrange(0, 25))) for _ in range(150)]
    texts += texts[:40]  # ties
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(draw.choices(names, k=draw.randrange(0, 6)))) for i in range(40)], "qid long, question string")
    terms = lexical.query_terms(asked, "qid", "question")
    index = lexical.build_index(chunks, asked=terms)
    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(lexical, "PART_POSTINGS", 200)
    got = {(r.qid, r.rank): (r.chunk_id, round(r.score, 9)) for r in lexical.best(index, terms, 5).collect()}
    every = {(r.qid, r.rank): (r.chunk_id, round(r.score, 9)) for r in lexical.top(lexical.scores(index, terms), 5).collect()}
    assert got == every and len(got) > 100
    sent = []
    monkeypatch.setattr(lexical, "top", lambda found, n: sent.append(found.count()) or found)
    lexical.search(index, asked, 5)
    assert sent[0] < lexical.scores(index, terms).count() / 2


def test_overlap_score_reads_the_question_once_a_passage(spark):
    """No expression for each word of a passage stands in the plan; words, repeats and nulls count as before (F3)."""
    rows = spark.createDataFrame([("The dog", " the cat\tthe  dog\n"), (None, "a b"), ("a", None), ("", " "), ("É x", "é É y")], "q string, p string")
    scored = rows.select(V.overlap_score(F.col("q"), F.col("p")).alias("s"))
    assert [r.s for r in scored.collect()] == [3.0, 0.0, None, 0.0, 2.0]
    assert "lambda" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_counted_in_their_rows(spark):
    """No aggregate holds the pairs of term and chunk (F23); empty and null texts have none, an id that stands twice is added up."""
    rows = [("a", "x y x"), ("b", ""), ("c", None), ("d", "z"), ("e", "y x y y")]
    index = lexical.build_index(spark.createDataFrame(rows, "chunk_id string, text string"))
    assert "Aggregate" not in index.postings._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(index.postings.collect()) == [("x", "a", 2, 3), ("x", "e", 1, 4), ("y", "a", 1, 3), ("y", "e", 3, 4), ("z", "d", 1, 1)]
    again = lexical.build_index(spark.createDataFrame([("a", "x y"), ("a", "y y")], "chunk_id string, text string"))
    assert sorted(again.postings.collect()) == [("x", "a", 1, 2), ("y", "a", 3, 2)]
