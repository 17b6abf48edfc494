"""The corpus build: raw pages to articles, chunks, store and lexical index, a table per step."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import chunk_params
from ..errors import SetupError
from ..functions import facets
from ..functions.vectors import hash_embedding
from ..operators import html, joins, lexical, wikitext
from ..operators.chunking import chunk_articles
from ..scratch import materialise
from ..sources import api
from ..sources.files import page_text, read_jsonl, read_table, replacing, require_input, run_lock, write_jsonl
from ..sources.store import ChunkStore

STEPS = ("harvest", "fetch_wikitext", "fetch", "parse", "chunk", "embed", "bm25")
#: Step lists under one name: everything from the service on, and everything from the fetched records on.
METAS = {"all": STEPS, "build": STEPS[3:], "rebuild": ("parse", "chunk", "embed_fresh", "bm25")}


def articles(pages: DataFrame, records: DataFrame, base_url: str, cat: facets.Catalogue = facets.DEFAULT) -> DataFrame:
    """Raw wikitext pages (title, pageid, revisions) and rendered records (schemas.HTML_RECORDS, file_name) merged:
    rendered articles win, by page id (title where there is none). Every record is parsed, by its own wikitext where its
    rendering gives nothing; of several records of a page the last that gave an article counts, in the order of
    ``file_name`` and ``line`` (see ``read_jsonl``; without them, of the rows as they come).
    ``source`` tells where an article came from: right is wikitext."""
    key = lambda: F.coalesce(F.col("pageid").cast("string"), F.concat(F.lit("t:"), F.col("title")))
    place = lambda df: F.struct(F.col("file_name") if "file_name" in df.columns else F.lit("").alias("file_name"), F.col("line") if "line" in df.columns else F.monotonically_increasing_id().alias("line"))
    order = place(pages)
    raw = pages.select("title", "pageid", page_text().alias("wikitext"), order.alias("_o"))
    own = wikitext.parse_pages(raw, base_url, cat).withColumn("key", key())
    own = own.join(raw.withColumn("key", key()).groupBy("key").agg(F.min("_o").alias("_o")), "key")
    place_of = place(records)
    good = records.filter("error IS NULL").select("title", "pageid", "html", "wikitext", place_of["file_name"].alias("_file"), place_of["line"].alias("_line"), F.monotonically_increasing_id().alias("_id"))
    good, at = materialise(good, "records"), ("_file", "_line", "_id")
    made = materialise(html.parse_records(good, base_url, cat, at), "rendered")
    rest = good.filter("wikitext IS NOT NULL").join(made.select("_id"), "_id", "left_anti")
    made = made.unionByName(wikitext.parse_pages(rest.select("title", "pageid", "wikitext", *at), base_url, cat, keep=at))
    rendered = joins.latest(made.withColumn("key", key()), ["key"], list(at)).drop(*at)
    columns = [c for c in rendered.columns if c != "key"]
    return joins.prefer_left(rendered, own, "key", columns, "_o").drop("key")


class Pipeline:
    """Runs steps over folders under ``root``; each step reads the table of the one before and replaces its own."""

    def __init__(self, spark: SparkSession, root: str, cfg: Mapping[str, Any], base_url: str, cat: facets.Catalogue = facets.DEFAULT, embed: Callable[[Column], Column] = hash_embedding, make_client: Callable[[], api.Client] | None = None):
        self.make_client = make_client
        self.spark, self.root, self.cfg, self.base_url, self.cat, self.embed = spark, root, cfg, base_url, cat, embed

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, schema: str) -> DataFrame:
        return read_table(self.spark, self.path(name), schema, name, f"run the step that makes {name}")

    @property
    def store(self) -> ChunkStore:
        return ChunkStore(self.spark, self.path("store"), schemas.VECTORS)

    @property
    def client(self) -> Callable[[], api.Client]:
        if self.make_client is None:
            raise SetupError("a client of the service is needed for this step")
        return self.make_client

    def harvest(self) -> int:
        with replacing(self.spark, self.path("titles")) as fresh:
            return write_jsonl(api.titles_table(self.spark, self.client), fresh)

    def titles(self) -> DataFrame:
        return require_input(read_jsonl(self.spark, self.path("titles"), schemas.TITLES), "titles", "run harvest")

    def fetch_wikitext(self) -> int:
        return api.fetch_wikitext(self.spark, self.titles(), self.path("pages"), self.client).count()

    def fetch(self) -> dict[str, int]:
        records = api.fetch_batches(self.spark, self.titles(), self.path("html"), self.client)
        return {r["kind"]: r["n"] for r in api.error_counts(records).collect()}

    def retry_timeouts(self) -> int:
        return api.retry_timeouts(self.spark, self.path("html"), self.client)

    def parse(self) -> dict[str, int]:
        pages = read_jsonl(self.spark, self.path("pages"), schemas.PAGES, numbered=True)
        records = read_jsonl(self.spark, self.path("html"), schemas.HTML_RECORDS, numbered=True)
        with replacing(self.spark, self.path("articles")) as fresh:
            articles(pages, records, self.base_url, self.cat).write.parquet(fresh)
            counts = {r["source"]: r["count"] for r in self.spark.read.parquet(fresh).groupBy("source").count().collect()}
            if not counts:
                raise SetupError("no page parses; the articles that were there stay")
        return counts

    def chunk(self) -> int:
        size, overlap = chunk_params(self.cfg)
        source = require_input(self.table("articles", schemas.ARTICLES), "articles", "run parse")
        with replacing(self.spark, self.path("chunks")) as fresh:
            chunk_articles(source, size, overlap).write.parquet(fresh)
        return self.table("chunks", schemas.CHUNKS).count()

    def embed_step(self, fresh: bool = False) -> int:
        chunks = require_input(self.table("chunks", schemas.CHUNKS), "chunks", "run chunk")
        return self.store.rebuild(chunks, self.embed) if fresh else self.store.add(chunks, self.embed)

    def bm25(self) -> int:
        """From the store, not the chunks, so that both indexes hold the same ids; checked before it replaces the old."""
        rows = self.store.read()
        n = joins.check_unique(rows, "chunk_id")
        lexical.build_index(rows, stemmed=True).materialise(self.path("bm25"), rows)
        return n

    def index(self) -> lexical.Index:
        names = {"postings": "term STRING, chunk_id STRING, tf BIGINT, dl BIGINT", "frequencies": "term STRING, df BIGINT", "stats": "n BIGINT, avgdl DOUBLE"}
        return lexical.Index(*(self.table(f"bm25/{n}", s) for n, s in names.items()), True)

    def run(self, what: str, dry: bool = False) -> list[tuple[str, Any]]:
        """Run a step or a list of steps under the root's lock and give each one's result; ``dry`` only names them."""
        steps = METAS.get(what, (what,))
        known = {"harvest": self.harvest, "fetch_wikitext": self.fetch_wikitext, "fetch": self.fetch, "retry_timeouts": self.retry_timeouts, "parse": self.parse, "chunk": self.chunk, "embed": self.embed_step, "embed_fresh": lambda: self.embed_step(True), "bm25": self.bm25}
        if unknown := [s for s in steps if s not in known]:
            raise SetupError(f"no step {unknown[0]!r}; there are {', '.join([*known, *METAS])}")
        if dry:
            return [(s, None) for s in steps]
        with run_lock(self.spark, self.root):
            return [(s, known[s]()) for s in steps]
