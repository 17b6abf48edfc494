"""A paginated, throttled wiki API as a Spark data source, and resumable batch fetches.

The transport is a callable from request parameters to (status, headers, body), so that everything but the network is
testable; ``urllib_transport`` is the plain one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..errors import SetupError
from ..operators import joins
from ..schemas import HTML_RECORDS, PAGES, TITLES
from ..scratch import materialise
from .files import read_jsonl, write_block

Transport = Callable[[dict], tuple[int, dict, str]]
#: The longest wait that a server may ask for, in seconds.
MAX_WAIT = 120


class StillFailing(SetupError):
    """The service kept failing in ways that may pass."""


def urllib_transport(url: str, agent: str) -> Transport:
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    def send(params: dict) -> tuple[int, dict, str]:
        try:
            with urlopen(Request(f"{url}?{urlencode(params)}", headers={"User-Agent": agent}), timeout=60) as reply:
                return reply.status, dict(reply.headers), reply.read().decode()
        except HTTPError as error:
            return error.code, dict(error.headers), ""

    return send


def wait_for(header: str | None, backoff: int) -> int:
    try:
        return min(int(header), MAX_WAIT) if header is not None else min(backoff, MAX_WAIT)
    except ValueError:
        return min(backoff, MAX_WAIT)


@dataclass
class Client:
    """GET with retries: waits 3, 6, 12, ... seconds (or as asked) on 429, 5xx, network errors, bodies that are not
    JSON and replication lag; other 4xx raise at once; sleeps ``delay`` after a success."""

    transport: Transport
    delay: float = 1.0
    maxlag: int = 5
    sleep: Callable[[float], None] = field(default=time.sleep)

    def get(self, params: dict, max_retries: int = 6) -> dict:
        backoff, why = 3, ""
        for _ in range(max_retries):
            header = None
            try:
                status, headers, body = self.transport({**params, "format": "json", "maxlag": self.maxlag})
                header = {k.lower(): v for k, v in headers.items()}.get("retry-after")
                if status == 429 or status >= 500:
                    why = f"status {status}"
                elif status >= 400:
                    raise SetupError(f"the service refused the request with status {status}")
                else:
                    reply = json.loads(body)
                    if (reply.get("error") or {}).get("code") != "maxlag":
                        self.sleep(self.delay)
                        return reply
                    why = "maxlag"
            except (OSError, ValueError) as error:
                why = f"{type(error).__name__}: {error}"
            self.sleep(wait_for(header, backoff))
            backoff *= 2
        raise StillFailing(f"gave up after {max_retries} tries: {why}")


def titles(client: Client, redirects: str = "nonredirects") -> Iterator[dict]:
    """All titles of the main namespace, page by page."""
    params: dict = {"action": "query", "list": "allpages", "apnamespace": 0, "aplimit": "max", "apfilterredir": redirects}
    more: dict = {}
    while True:
        reply = client.get({**params, **more})
        for page in reply.get("query", {}).get("allpages", []):
            yield {"title": page["title"], "pageid": page["pageid"]}
        more = reply.get("continue") or {}
        if not more:
            return


def fetch_html(client: Client, title: str) -> dict:
    """A page's rendered HTML and wikitext, or a record of what went wrong; never raises."""
    record = dict.fromkeys(("title", "pageid", "html", "wikitext", "error")) | {"title": title}
    try:
        reply = client.get({"action": "parse", "page": title, "prop": "text|wikitext", "formatversion": 2})
    except StillFailing as error:
        return record | {"error": f"timeout: {error}"}
    except SetupError as error:
        return record | {"error": f"request: {error}"}
    if reply.get("error"):
        return record | {"error": reply["error"].get("code", "unknown")}
    parsed = reply.get("parse")
    if not parsed:
        return record | {"error": "no-parse"}
    return record | {"title": parsed.get("title", title), "pageid": parsed.get("pageid"), "html": parsed.get("text"), "wikitext": parsed.get("wikitext")}


#: Ranges of block numbers: a fetch of the whole list, passes over other lists, and retries, whose records win.
FETCH, EXTRA, RETRY = (0, 999), (1000, 8999), (9000, 99_999)


def titles_table(spark: SparkSession, make_client: Callable[[], Client], redirects: str = "nonredirects") -> DataFrame:
    """``titles`` as a table that Spark reads: one partition, as each page of the list names the next."""

    class Reader(DataSourceReader):
        def read(self, partition):
            return ((row["title"], row["pageid"]) for row in titles(make_client(), redirects))

    class Titles(DataSource):
        @classmethod
        def name(cls):
            return "wiki_titles"

        def schema(self):
            return TITLES

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Titles)
    return spark.read.format("wiki_titles").load()


def fetch_pages(client: Client, names: list[str]) -> list[dict]:
    """The raw wikitext records of up to 50 titles, in one request."""
    reply = client.get({"action": "query", "prop": "revisions", "rvprop": "content", "rvslots": "main", "formatversion": 2, "titles": "|".join(names)})
    return [{"title": p["title"], "pageid": p.get("pageid"), "revisions": p.get("revisions")} for p in reply.get("query", {}).get("pages", [])]


def _fetch(todo: DataFrame, out: str, schema: str, records: Callable[[Client, list[str]], list[dict]], make_client: Callable[[], Client], batch: int, batches: int, parallel: int, blocks: tuple[int, int]) -> int:
    """Fetch titles batch by batch, a block of ``batches`` of them at a time, and give the number of blocks. A block is
    written whole or not at all, so a run that is broken off loses one. Titles are numbered in one task: the service's
    pace, not Spark, bounds how many there are."""
    n = Window.orderBy("title")
    numbered = materialise(todo.withColumn("b", F.floor((F.row_number().over(n) - 1) / batch)), "titles-to-fetch")
    last = numbered.agg(F.max("b")).first()[0]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, columns = make_client(), [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            for _, part in frame.groupby("b"):
                made = pd.DataFrame(records(client, part["title"].tolist()), columns=columns)
                yield made.astype({"pageid": "Int64"})

    for low in range(0, (last if last is not None else -1) + 1, batches):
        part = numbered.filter((F.col("b") >= low) & (F.col("b") < low + batches)).repartitionByRange(parallel, "b").sortWithinPartitions("title")
        write_block(part.mapInPandas(run, schema), out, *blocks)
    return 0 if last is None else -(-(last + 1) // batches)


def _known(spark: SparkSession, out: str, schema: str, condition: str) -> DataFrame | None:
    try:
        return read_jsonl(spark, out, schema).filter(condition).select("title").distinct()
    except AnalysisException as error:  # nothing was fetched yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def fetch_wikitext(spark: SparkSession, names: DataFrame, out: str, make_client: Callable[[], Client], batch: int = 50, batches: int = 20, parallel: int = 1) -> DataFrame:
    """Fetch the wikitext of every title that ``out`` has no record of, and return all records. A request that keeps
    failing stops the run; a restart goes on with what is missing."""
    done = _known(spark, out, PAGES, "true")
    todo = names.select("title").distinct()
    _fetch(todo if done is None else todo.join(done, "title", "left_anti"), out, PAGES, fetch_pages, make_client, batch, batches, parallel, FETCH)
    return read_jsonl(spark, out, PAGES)


def fetch_batches(spark: SparkSession, names: DataFrame, out: str, make_client: Callable[[], Client], batch: int = 100, parallel: int = 1, batches: int = 10, blocks: tuple[int, int] = FETCH) -> DataFrame:
    """Fetch the rendered page of every title that ``out`` has no record of without a timeout, and return all records.

    Work already written is found by an anti-join, so a restart goes on where it stopped. ``parallel`` tasks share the
    service's patience. A pass over another list takes its blocks from ``EXTRA``."""
    done = _known(spark, out, HTML_RECORDS, "error IS NULL OR NOT startswith(error, 'timeout:')")
    todo = names.select("title").distinct()
    pages = lambda client, part: [fetch_html(client, t) for t in part]
    _fetch(todo if done is None else todo.join(done, "title", "left_anti"), out, HTML_RECORDS, pages, make_client, batch, batches, parallel, blocks)
    return read_jsonl(spark, out, HTML_RECORDS)


def retry_timeouts(spark: SparkSession, out: str, make_client: Callable[[], Client], batch: int = 100, parallel: int = 1) -> int:
    """Fetch again the titles whose latest record is a timeout, into the blocks of ``RETRY``, and give their number."""
    records = read_jsonl(spark, out, HTML_RECORDS, numbered=True)
    todo = materialise(joins.retry_set(records, ["file_name", "line"]).select("title"), "timeouts")
    pages = lambda client, part: [fetch_html(client, t) for t in part]
    _fetch(todo, out, HTML_RECORDS, pages, make_client, batch, 10, parallel, RETRY)
    return todo.count()


def error_counts(records: DataFrame) -> DataFrame:
    """kind, n: failures by their first word."""
    return records.filter("error IS NOT NULL").groupBy(F.regexp_extract("error", r"^([^:]*)", 1).alias("kind")).agg(F.count("*").alias("n"))
