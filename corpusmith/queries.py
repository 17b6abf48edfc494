"""The registered queries over the driver's tables, each beside the DuckDB SQL that must give the same rows.

Documents play pages (facet = lang), their 120-word windows with an overlap of 20 are the chunks, benchmark passages
are questions, embeddings a store of vectors with label as facet, events a request log, labels outcomes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import decisions as D
from .functions import facets as FA
from .functions import text as T
from .functions import vectors as V
from .operators import chunking, containment, dense, evaluate, fusion, joins, lexical, prompts, wikitext
from .scratch import materialise, new_folder
from .sources.absent import KeyedTable
from .sources.cells import CellIndex
from .sources.segments import SegmentedIndex
from .streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SIZE, OVERLAP = 120, 20
WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
BASE_URL = "https://corpus.example/"


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in a few files dealt to all cores, where its rows cost more than moving them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 <= cores else df


# ---------------------------------------------------------------------------------------------- text

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@register("tokens_per_doc", f"SELECT doc_id, len({TOKENS.format('text')})::BIGINT AS n_tokens FROM documents")
def tokens_per_doc(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@register(
    "stopword_fallback",
    f"""WITH t AS (SELECT item_id, {TOKENS.format('text')} AS a FROM benchmark),
    u AS (SELECT item_id, a, list_filter(a, lambda x: x NOT IN ({STOP})) AS f FROM t)
    SELECT item_id, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE a END, ' ') AS terms FROM u""",
)
def stopword_fallback(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.content_tokens(F.col("text")), " ").alias("terms"))


WINDOWS_SQL = f"""w AS (SELECT doc_id, text, {WORDS.format('text')} AS ws FROM documents),
win AS (
  SELECT doc_id, 0 AS ordinal, trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS text FROM w WHERE len(ws) BETWEEN 1 AND {{size}}
  UNION ALL
  SELECT doc_id, i::INT AS ordinal, array_to_string(list_slice(ws, i * {{step}} + 1, i * {{step}} + {{size}}), ' ') AS text
  FROM w, unnest(range(0, greatest(0, ceil((len(ws) - {{size}}) / {{step}}.0)::BIGINT + 1))) AS r(i) WHERE len(ws) > {{size}})"""
CHUNKS_SQL = (
    "WITH "
    + WINDOWS_SQL.format(size=SIZE, step=SIZE - OVERLAP)
    + """, chunks AS (SELECT printf('%s-%04d', win.doc_id::VARCHAR, ordinal) AS chunk_id, win.doc_id AS pageid, 'doc ' || win.doc_id AS title, lang AS game,
  CASE WHEN ordinal % 5 = 2 THEN 'infobox' ELSE 'text' END AS heading, 'https://corpus.example/' || win.doc_id AS url,
  '[' || lang || '] doc ' || win.doc_id || ' > ' || CASE WHEN ordinal % 5 = 2 THEN 'infobox' ELSE 'text' END || ': ' || win.text AS text, ordinal
  FROM win JOIN documents d USING (doc_id))"""
)


def chunk_rows(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The chunks of the documents, or of those whose pageid stands in ``of``: others are not cut."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    if of is not None:
        docs = docs.join(of.select(F.col("pageid").alias("doc_id")).distinct(), "doc_id", "left_semi")
    cut = chunking.chunk_texts(docs, "doc_id", "text", SIZE, OVERLAP)
    heading = F.when(F.col("ordinal") % 5 == 2, "infobox").otherwise("text")
    title = F.concat(F.lit("doc "), F.col("doc_id"))
    return cut.select(
        F.format_string("%s-%04d", F.col("doc_id").cast("string"), F.col("ordinal")).alias("chunk_id"),
        F.col("doc_id").alias("pageid"),
        title.alias("title"),
        F.col("lang").alias("game"),
        heading.alias("heading"),
        F.concat(F.lit(BASE_URL), F.col("doc_id")).alias("url"),
        F.concat(T.breadcrumb(F.col("lang"), title, heading), F.col("text")).alias("text"),
        "ordinal",
    )


@register("word_windows", "WITH " + WINDOWS_SQL.format(size=600, step=520) + " SELECT doc_id, ordinal::INT AS ordinal, md5(text) AS window_md5 FROM win")
def word_windows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunk_texts(docs, "doc_id", "text", 600, 80).select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), F.md5("text").alias("window_md5"))


@register("chunk_table", CHUNKS_SQL + " SELECT chunk_id, pageid, title, game, heading, url, md5(text) AS text_md5 FROM chunks")
def chunk_table(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("chunk_id", "pageid", "title", "game", "heading", "url", F.md5("text").alias("text_md5"))


LABEL_SQL = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LABELS.items()) + " ELSE upper(left(k, 1)) || lower(substr(k, 2)) END"


@register(
    "infobox_render",
    f"""WITH f AS (SELECT p_partkey, p_name, unnest([{{'i': 1, 'k': 'lv', 'v': p_size::VARCHAR}}, {{'i': 2, 'k': 'BRAND name', 'v': p_brand}},
      {{'i': 3, 'k': 'exp', 'v': CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_type END}}]) AS s FROM part),
    g AS (SELECT p_partkey, p_name, s.i AS i, s.k AS k, s.v AS v FROM f WHERE trim(s.v) <> '')
    SELECT p_partkey, '[XG] ' || p_name || ' > infobox: part data. ' || string_agg({LABEL_SQL.replace('CASE k', 'CASE lower(k)')} || ': ' || v || '.', ' ' ORDER BY i) AS line
    FROM g GROUP BY p_partkey, p_name""",
)
def infobox_render(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    field = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    fields = F.array(field("lv", F.col("p_size").cast("string")), field("BRAND name", F.col("p_brand")), field("exp", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_type"))))
    return part.select("p_partkey", T.render_fields(F.lit("XG"), F.col("p_name"), F.lit("part data"), fields).alias("line"))


STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
COLLAPSE = r"trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"
BARE = f"CASE WHEN instr(text, ' > ') > 0 THEN {STRIP.format(chr(115) + 'ubstr(text, instr(text, chr(32) || chr(62) || chr(32)) + 3)')} ELSE {STRIP.format('text')} END"
CUT = "CASE WHEN length(t) <= {n} THEN t ELSE CASE WHEN rtrim(regexp_extract(left(t, {n}), '(?s)^(.*) [^ ]*$', 1)) <> '' THEN rtrim(regexp_extract(left(t, {n}), '(?s)^(.*) [^ ]*$', 1)) ELSE left(t, {n}) END || '…' END"


@register("breadcrumb_strip", CHUNKS_SQL + f" SELECT chunk_id, md5({BARE}) AS bare_md5 FROM chunks")
def breadcrumb_strip(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("chunk_id", F.md5(T.strip_breadcrumb(F.col("text"))).alias("bare_md5"))


@register("snippet", CHUNKS_SQL + rf", s AS (SELECT chunk_id, {COLLAPSE.format(chr(114) + 'egexp_replace(text, ' + chr(39) + r'^\[[^\]]*\][^:]*:\s*' + chr(39) + ', ' + chr(39) * 2 + ')')} AS t FROM chunks) SELECT chunk_id, {CUT.format(n=200)} AS snippet FROM s")
def snippet(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("chunk_id", T.snippet(F.col("text")).alias("snippet"))


@register("passages", CHUNKS_SQL + f", s AS (SELECT chunk_id, title, game, {COLLAPSE.format(BARE)} AS t FROM chunks) SELECT chunk_id, title || ' (' || game || '): ' || {CUT.format(n=300)} AS passage FROM s")
def passages(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("chunk_id", T.passage(F.col("title"), F.col("game"), F.col("text"), 300).alias("passage"))


@register("line_clip", rf"SELECT doc_id, CASE WHEN length(text) <= 320 THEN text ELSE regexp_replace(left(text, 320), '[\x20\x09-\x0D]+$', '') || '…' END AS line FROM documents")
def line_clip(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text")).alias("line"))


@register("title_to_url", "SELECT p_partkey, 'https://corpus.example/' || replace(p_name, ' ', '_') AS url FROM part")
def title_to_url(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.title_url(F.col("p_name"), BASE_URL).alias("url"))


@register(
    "text_normalise",
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(replace(text, chr(8203), ''), '[\s\x{00a0}\x{0b}]+', ' ', 'g'), ' ') AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(regexp_replace(t, ' +([,.;:!?)\]]|''s\b)', '\1', 'g'), '([(\[]) +', '\1', 'g')) AS text_md5 FROM n""",
)
def text_normalise(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("text_md5"))


@register("path_scrub")
def path_scrub(spark, sf_dir):
    """Look-behind has no DuckDB form; see tests/test_text.py."""
    message = F.concat(F.lit("cannot open C:\\data\\"), F.col("event_type"), F.lit(".txt or /var/log/"), F.col("event_type"), F.lit(".log for "), F.col("user_id"))
    return read(spark, sf_dir, "events").select("event_id", T.scrub_paths(message).alias("message"))


@register("host_parse", r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host FROM pages")
def host_parse(spark, sf_dir):
    header = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return read(spark, sf_dir, "pages").select("page_id", T.host_name(header).alias("host"))


@register(
    "client_key",
    r"""WITH h AS (SELECT p_partkey, p_size % 2 = 0 AS trusted, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN ' , ' || p_brand ELSE replace(p_name || ' ' || p_type, ' ', ' , ') END AS fwd, p_brand FROM part)
    SELECT p_partkey, CASE WHEN trusted AND trim(split_part(fwd, ',', 1), ' ') <> '' THEN trim(split_part(fwd, ',', 1), ' ') ELSE p_brand END AS client FROM h""",
)
def client_key(spark, sf_dir):
    size = F.col("p_size")
    forwarded = F.when(size % 7 == 0, F.lit(None)).when(size % 5 == 0, F.concat(F.lit(" , "), "p_brand")).otherwise(F.regexp_replace(F.concat_ws(" ", "p_name", "p_type"), " ", " , "))
    return read(spark, sf_dir, "part").select("p_partkey", T.client_key(forwarded, F.col("p_brand"), size % 2 == 0).alias("client"))


@register("redirect_stub_filter", f"SELECT doc_id FROM documents WHERE NOT (lower({STRIP.format('text')}) LIKE '#redirect%') AND length({STRIP.format('text')}) >= 50")
def redirect_stub_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(~wikitext.dropped(F.col("text"))).select("doc_id")


@register("retry_wait", "SELECT event_id, least(coalesce(CASE WHEN event_id % 4 = 0 THEN (event_id % 300)::INT WHEN event_id % 4 = 1 THEN NULL ELSE NULL END, (3 * pow(2, event_id % 7))::INT), 120)::INT AS wait FROM events")
def retry_wait(spark, sf_dir):
    header = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 300).cast("string")).when(F.col("event_id") % 4 == 1, F.lit("soon"))
    return read(spark, sf_dir, "events").select("event_id", T.retry_wait(header, (3 * F.pow(F.lit(2), F.col("event_id") % 7)).cast("int")).cast("int").alias("wait"))


@register("sse_encode", r"""SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: {"n":' || length(text) || '}' || chr(10) || chr(10) AS event FROM conversations""")
def sse_encode(spark, sf_dir):
    payload = F.to_json(F.struct(F.length("text").alias("n")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.sse_encode(F.col("role"), payload).alias("event"))


@register("sse_parse", "SELECT conv_id, turn, role AS kind, length(text)::INT AS n FROM conversations")
def sse_parse(spark, sf_dir):
    block = T.sse_encode(F.col("role"), F.to_json(F.struct(F.length("text").alias("n"))))
    parsed = read(spark, sf_dir, "conversations").withColumn("e", T.sse_parse(block))
    return parsed.select("conv_id", "turn", F.col("e.kind").alias("kind"), F.get_json_object("e.payload", "$.n").cast("int").alias("n"))


@register(
    "citation_markers",
    r"""WITH m AS (SELECT event_id, list_transform(regexp_extract_all('see [' || (event_id % 9) || '] and [2][' || (event_id % 5) || '] or [77]', '\[(\d{1,3})\]', 1), lambda x: x::INT) AS a FROM events),
    v AS (SELECT event_id, list_filter(a, lambda x: x BETWEEN 1 AND 6) AS a FROM m)
    SELECT event_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS cited FROM v""",
)
def citation_markers(spark, sf_dir):
    answer = F.concat(F.lit("see ["), F.col("event_id") % 9, F.lit("] and [2]["), F.col("event_id") % 5, F.lit("] or [77]"))
    cited = T.citations(answer, F.lit(6))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(cited.cast("array<string>"), ",").alias("cited"))


#: What may stand before an address: nothing, blanks, other schemes, other spellings.
SCHEMES = ("", " ", "javascript:", "HTTPS://x.example/?", "//", "data:text/html,", "ftp://")


@register(
    "safe_href",
    rf"""WITH l AS (SELECT page_id, unnest(list_concat([url], regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages),
    n AS (SELECT page_id, [{", ".join(f"'{x}'" for x in SCHEMES)}][(length(href) % {len(SCHEMES)} + 1)::INT] || href AS href FROM l)
    SELECT page_id, href AS given, CASE WHEN regexp_matches(trim(href, ' '), '(?i)^https?://') THEN trim(href, ' ') ELSE '#' END AS href FROM n""",
)
def safe_href(spark, sf_dir):
    links = F.concat(F.array("url"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    given = read(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("href"))
    given = given.select("page_id", F.concat(F.element_at(F.array(*map(F.lit, SCHEMES)), F.length("href") % len(SCHEMES) + 1), "href").alias("given"))
    return given.select("page_id", "given", T.safe_href(F.col("given")).alias("href"))


@register(
    "source_name",
    r"""WITH l AS (SELECT page_id, unnest(list_concat([url], list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: 'https://w.example/wiki' || replace(x, 'e', '_') || '%20x?a=/1#b'))) AS url FROM pages)
    SELECT page_id, url, url_decode(replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1), '_', ' ')) AS name FROM l""",
)
def source_name(spark, sf_dir):
    made = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda x: F.concat(F.lit("https://w.example/wiki"), F.replace(x, F.lit("e"), F.lit("_")), F.lit("%20x?a=/1#b")))
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.concat(F.array("url"), made)).alias("url"))
    return links.select("page_id", "url", T.source_name(F.col("url")).alias("name"))


# ------------------------------------------------------------------------------------- facets, filters


def faceted(docs: DataFrame) -> DataFrame:
    """Memberships: the language, English for every seventh document, none (all) for every eleventh."""
    games = F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.when(F.col("doc_id") % 7 == 0, F.array(F.col("lang"), F.lit("en"))).otherwise(F.array(F.col("lang")))))
    return docs.withColumn("games", games)


LANGS = FA.Catalogue(bases=("de", "en", "es", "fr"), aliases={"EN-GB": "en"}, umbrella="EU", episodes=("de", "fr"), phrases=((r"\benglish\b", "en"), (r"\bgerman\b", "de"), (r"\bfrench\b", "fr")))
GAMES_SQL = "CASE WHEN doc_id % 11 = 0 THEN ['de', 'en', 'es', 'fr'] WHEN doc_id % 7 = 0 THEN list_sort(list_distinct([lang, 'en'])) ELSE [lang] END"


def effective(docs: DataFrame) -> DataFrame:
    """An empty set is every facet."""
    every = F.array(*map(F.lit, LANGS.bases))
    return faceted(docs).withColumn("games", F.when(F.size("games") > 0, F.array_sort("games")).otherwise(every))


@register("facet_filter", f"SELECT doc_id FROM documents WHERE list_contains({GAMES_SQL}, 'fr')")
def facet_filter(spark, sf_dir):
    return effective(read(spark, sf_dir, "documents")).filter(FA.facet_condition(F.col("games"), "fr", LANGS)).select("doc_id")


@register("facet_serialise", f"SELECT doc_id, array_to_string({GAMES_SQL}, ',') AS games FROM documents")
def facet_serialise(spark, sf_dir):
    return effective(read(spark, sf_dir, "documents")).select("doc_id", F.array_join("games", ",").alias("games"))


@register("facet_flags", "SELECT doc_id, " + ", ".join(f"list_contains({GAMES_SQL}, '{g}') AS g_{g}" for g in LANGS.bases) + " FROM documents")
def facet_flags(spark, sf_dir):
    return faceted(read(spark, sf_dir, "documents")).select("doc_id", *[c.alias(n) for n, c in FA.flags(F.col("games"), LANGS).items()])


@register(
    "facet_fallback",
    """WITH l AS (SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN 'EU' WHEN 1 THEN split_part(text, ' ', 1) WHEN 2 THEN NULL ELSE lang END AS label FROM documents)
    SELECT doc_id, label, CASE WHEN label = 'EU' THEN 'de,fr' WHEN label IN ('de', 'en', 'es', 'fr') THEN label ELSE 'de,en,es,fr' END AS games FROM l""",
)
def facet_fallback(spark, sf_dir):
    kind = F.col("n_chars") % 4
    label = F.when(kind == 0, "EU").when(kind == 1, F.get(F.split("text", " "), 0)).when(kind == 2, F.lit(None)).otherwise(F.col("lang"))
    labelled = read(spark, sf_dir, "documents").select("doc_id", label.alias("label"))
    return labelled.select("doc_id", "label", F.array_join(FA.fallback_memberships(F.col("label"), LANGS), ",").alias("games"))


@register(
    "input_validation_quarantine",
    """SELECT conv_id, turn, CASE WHEN length(text) > 2000 THEN 'question too long' WHEN turn % 5 = 4 THEN 'unknown facet' WHEN turn > 6 THEN 'too many turns' END AS reason
    FROM conversations""",
)
def input_validation_quarantine(spark, sf_dir):
    game = F.when(F.col("turn") % 5 == 4, "zz").otherwise("")
    reason = D.valid_request(F.col("text"), game, F.col("turn"), F.lit(0), LANGS.bases)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"))


@register(
    "foreign_tags",
    """SELECT source, string_agg(lang, ',' ORDER BY lang) FILTER (lang <> 'en') AS foreign_tags FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source""",
)
def foreign_tags(spark, sf_dir):
    tags = read(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("tags"))
    found = F.array_join(FA.foreign(F.col("tags"), F.lit("en"), LANGS.bases), ",")
    return tags.select("source", F.nullif(found, F.lit("")).alias("foreign_tags"))


#: Parts of made wikitext; a document has those whose bits of its number, times a prime, are set.
WIKI_PARTS = ("{{de place infobox|hp=3}}", "{{en data|x}}", "{{fr|x}} {{other|b}}", "[[Category: Things (FR)]]", "[[category:German things|x]]", "[[Category:Es (old) things (es)]]", "{{EU}} and {{eu}}", "plain English words")
WIKI_TITLES = ("Thing", "Thing (en-gb)", "Thing (EU)", "Thing (old) (DE)", "Thing (EU1&2)", "Thing (new)")


def wiki_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made wikitext pages, one per document: any of the parts under any of the titles."""
    bits = F.col("doc_id") * 37 % 2 ** len(WIKI_PARTS)
    parts = [F.when(F.expr(f"shiftright(doc_id * 37 % {2 ** len(WIKI_PARTS)}, {i})").bitwiseAND(F.lit(1)) == 1, part) for i, part in enumerate(WIKI_PARTS)]
    title = F.element_at(F.array(*map(F.lit, WIKI_TITLES)), (F.col("doc_id") % len(WIKI_TITLES) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.when(bits != 0, F.concat_ws(" ", *parts)).alias("wikitext"))


#: Codes are compared in upper case; the languages are their own canonical form through the aliases.
CASELESS = FA.Catalogue(bases=LANGS.bases, aliases={"EN-GB": "en", "EN": "en", "DE": "de", "FR": "fr", "ES": "es"}, umbrella="EU", episodes=("de", "fr"), phrases=LANGS.phrases)


#: The rules of labels and memberships over made pages: codes by title, template, category and phrase.
FACETS_SQL = f"""WITH pages AS (SELECT doc_id, [{", ".join(f"'{t}'" for t in WIKI_TITLES)}][(doc_id % {len(WIKI_TITLES)} + 1)::INT] AS title,
    CASE WHEN doc_id * 37 % {2 ** len(WIKI_PARTS)} <> 0 THEN concat_ws(' ', {", ".join(f"CASE WHEN (doc_id * 37 % {2 ** len(WIKI_PARTS)}) >> {i} & 1 = 1 THEN '{part}' END" for i, part in enumerate(WIKI_PARTS))}) END AS wikitext FROM documents),
t AS (SELECT *, regexp_extract_all(title, '\\(([^()]+)\\)', 1) AS suffixes, list_transform(regexp_extract_all(coalesce(wikitext, ''), '\\{{\\{{\\s*([^|{{}}\\n]+)', 1), lambda x: trim(x)) AS names,
    regexp_extract_all(coalesce(wikitext, ''), '(?i)\\[\\[\\s*Category\\s*:\\s*([^\\]|\\n]+)', 1) AS cats FROM pages),
code AS (SELECT {{'EN-GB': 'en', 'EN': 'en', 'DE': 'de', 'FR': 'fr', 'ES': 'es'}}::MAP(VARCHAR, VARCHAR) AS of),
u AS (SELECT t.*, of,
    list_filter(list_transform(suffixes, lambda x: of[upper(trim(x))]), lambda x: x IS NOT NULL) AS own,
    list_bool_or(list_transform(suffixes, lambda x: regexp_matches(upper(replace(x, ' ', '')), '^EU([1-3](&[1-3])+)?$'))) AS wide,
    list_transform(names, lambda n: list_filter(list_transform(regexp_split_to_array(n, '\\s+'), lambda w: of[upper(w)]), lambda x: x IS NOT NULL)[1]) AS name_codes,
    list_filter(list_transform(cats, lambda c: coalesce(list_filter(list_transform(regexp_extract_all(c, '\\(([^()]+)\\)', 1), lambda x: of[upper(trim(x))]), lambda x: x IS NOT NULL)[-1],
        CASE WHEN regexp_matches(c, '(?i)\\benglish\\b') THEN 'en' WHEN regexp_matches(c, '(?i)\\bgerman\\b') THEN 'de' WHEN regexp_matches(c, '(?i)\\bfrench\\b') THEN 'fr' END)), lambda x: x IS NOT NULL) AS cat_codes
    FROM t, code),
v AS (SELECT *, list_filter(name_codes, lambda x, i: x IS NOT NULL AND (contains(lower(names[i]), 'infobox') OR regexp_matches(lower(names[i]), ' (data|stats)$'))) AS all_structured,
    coalesce(list_bool_or(list_transform(names, lambda n: contains(lower(n), 'infobox'))), false) AS boxed,
    list_filter(name_codes, lambda x: x IS NOT NULL) AS all_codes, coalesce(list_bool_or(list_transform(names, lambda n: upper(n) = 'EU')), false) AS generic FROM u),
w AS (SELECT *, list_distinct(all_structured) AS structured, list_distinct(cat_codes) AS kinds, CASE WHEN len(list_distinct(all_codes)) = 1 AND NOT generic THEN all_codes[1] END AS lone,
    CASE WHEN len(list_filter(list_distinct(cat_codes), lambda x: x NOT IN ('de', 'fr'))) = 0 THEN 'EU' ELSE 'series' END AS several FROM v)"""


@register(
    "derive_facet",
    FACETS_SQL
    + """ SELECT doc_id, CASE WHEN len(own) > 0 THEN own[1] WHEN wide THEN 'EU' WHEN coalesce(wikitext, '') = '' THEN 'series' WHEN len(structured) = 1 THEN structured[1]
    WHEN boxed AND len(list_filter(kinds, lambda x: x IN ('de', 'fr'))) >= 2 THEN several WHEN boxed AND len(cat_codes) > 0 THEN cat_codes[1]
    WHEN len(kinds) = 1 THEN kinds[1] WHEN len(kinds) >= 2 THEN several ELSE coalesce(lone, 'series') END AS label FROM w""",
)
def derive_facet(spark, sf_dir):
    return wiki_rows(spark, sf_dir).select("doc_id", FA.derive_label(F.col("title"), F.col("wikitext"), CASELESS).alias("label"))


@register(
    "derive_facets",
    FACETS_SQL
    + """, s AS (SELECT *, list_sort(list_distinct(flatten(list_transform(suffixes, lambda x: CASE WHEN of[upper(trim(x))] IS NOT NULL THEN [of[upper(trim(x))]] WHEN upper(trim(x)) = 'EU' THEN ['de', 'fr']
        WHEN regexp_matches(upper(replace(x, ' ', '')), '^EU[1-3](&[1-3])+$') THEN list_transform(regexp_extract_all(x, '[1-3]'), lambda d: 'EU' || d) ELSE [] END)))) AS by_title, list_distinct(list_concat(all_structured, cat_codes)) AS found FROM w)
    SELECT doc_id, array_to_string(CASE WHEN len(by_title) > 0 THEN by_title WHEN len(found) > 0 THEN list_sort(found) WHEN lone IS NOT NULL THEN [lone] ELSE [] END, ',') AS games FROM s""",
)
def derive_facets(spark, sf_dir):
    return wiki_rows(spark, sf_dir).select("doc_id", F.array_join(FA.derive_memberships(F.col("title"), F.col("wikitext"), CASELESS), ",").alias("games"))


@register(
    "wikitext_strip_refs",
    r"""WITH w AS (SELECT doc_id, replace(replace(replace(text, ', ', '<Ref name="a b" />, '), '. ', '<ref>see ' || chr(10) || '<b>this</b></REF>. '), 'en', 'e<ref group=x>n</ref>n') AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(regexp_replace(t, '<ref[^>]*?/>', '', 'gi'), '<ref[^>]*?>.*?</ref>', '', 'gis')) AS text_md5, length(t) AS n_before FROM w""",
)
def wikitext_strip_refs(spark, sf_dir):
    put = lambda text, at, what: F.replace(text, F.lit(at), F.lit(what))
    marked = put(put(put(F.col("text"), ", ", '<Ref name="a b" />, '), ". ", "<ref>see \n<b>this</b></REF>. "), "en", "e<ref group=x>n</ref>n")
    rows = read(spark, sf_dir, "documents").select("doc_id", marked.alias("t"))
    return rows.select("doc_id", F.md5(wikitext.strip_refs(F.col("t"))).alias("text_md5"), F.length("t").cast("long").alias("n_before"))


HTML_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"


@register("html_to_text", f"SELECT page_id, md5({HTML_TEXT}) AS text_md5 FROM pages")
def html_to_text(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.collapse(bare)).alias("text_md5"))


#: Made pages with tables: an infobox of labelled rows with column names, a grid under a heading, and prose.
MADE_PAGE = (
    "<div class=\"mw-parser-output\"><table class=\"infobox wide\"><tr><th></th><th>Base</th><th> Max </th></tr><tr><th>Size</th><td>{size}</td><td>{price} max</td></tr>"
    "<tr><th>Kind</th><td></td><td>{type}</td></tr><tr><td>also</td><td>{brand}</td></tr><tr><th></th><td>lost</td></tr></table><p>The <b>{name}</b> , by {brand}</p>"
    "<h2><span class=\"mw-headline\">Where</span></h2><table><thead><tr><th>Name</th><th>Rate</th><th></th></tr></thead><tr><td>{name}</td><td>{size}%</td><td>{type}</td></tr><tr><td>{brand}</td><td></td><td></td></tr></table>"
    "<ul><li>{type}</ul><h3>Spawn points</h3><table><tr><th>x</th><td>1</td></tr></table><div class=\"navbox\"><p>no</p></div>"
)


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"size": F.col("p_size").cast("string"), "price": F.floor("p_retailprice").cast("string"), "type": F.col("p_type"), "brand": F.col("p_brand"), "name": F.col("p_name")}
    page = F.lit(MADE_PAGE)
    for key, value in values.items():
        page = F.replace(page, F.lit("{" + key + "}"), value)
    return spread(read(spark, sf_dir, "part")).select("p_partkey", page.alias("html"))


@register(
    "html_tables",
    """WITH l AS (SELECT p_partkey, unnest([
        {'n': 1, 'h': 'infobox', 'l': 'Size: ' || p_size || ' base, ' || floor(p_retailprice)::INT || ' max.'},
        {'n': 2, 'h': 'infobox', 'l': 'Kind: ' || p_type || CASE WHEN contains(lower(p_type), 'max') THEN '' ELSE ' max' END || ', also, ' || p_brand || '.'},
        {'n': 3, 'h': 'Where', 'l': p_name || ' - Rate: ' || p_size || '%; ' || p_type || '.'}, {'n': 4, 'h': 'Where', 'l': p_brand || '.'}]) AS x FROM part)
    SELECT p_partkey, x.n::INT AS n, x.h AS heading, x.l AS line FROM l""",
)
def html_tables(spark, sf_dir):
    from .operators import html

    blocks = html.read_pages(made_pages(spark, sf_dir)).select("p_partkey", F.explode("factblocks").alias("b"))
    lines = blocks.select("p_partkey", F.when(F.col("b.heading") == "infobox", 0).otherwise(2).alias("from"), "b.heading", F.posexplode("b.lines").alias("i", "line"))
    return lines.select("p_partkey", (F.col("from") + F.col("i") + 1).cast("int").alias("n"), "heading", "line")


@register(
    "html_page_sections",
    """SELECT p_partkey, unnest(['Introduction', 'Where']) AS heading, unnest(['The ' || p_name || ', by ' || p_brand, p_type]) AS text FROM part""",
)
def html_page_sections(spark, sf_dir):
    from .operators import html

    return html.read_pages(made_pages(spark, sf_dir)).select("p_partkey", F.explode("sections").alias("s")).select("p_partkey", "s.heading", "s.text")


#: Made wikitext: an infobox whose fields hold links, references and templates, and two levels of sections.
MADE_WIKI = (
    "{{EN place infobox|Size={size}|place={{EN|{brand}|the {brand} works}}<ref name=a />|{type}|empty= }}\n'''{name}''' is by [[{brand}|its maker]]. [[File:x.png|thumb]]<ref>no [[x]]</ref>\n"
    "{| class=x\n| gone\n|}\n== Use ==\nFor [[{type}]] {{other|not shown}}work.\n\n\n\n=== More ===\n[https://x.example/{size} A page].\n== Gone ==\n<!-- {name} -->\n[[Category:{type}]]"
)


def made_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"size": F.col("p_size").cast("string"), "type": F.col("p_type"), "brand": F.col("p_brand"), "name": F.col("p_name")}
    text = F.lit(MADE_WIKI)
    for key, value in values.items():
        text = F.replace(text, F.lit("{" + key + "}"), value)
    pages = spread(read(spark, sf_dir, "part")).select(F.col("p_name").alias("title"), F.col("p_partkey").alias("pageid"), text.alias("wikitext"))
    return wikitext.parse_pages(pages, BASE_URL, CASELESS)


@register(
    "merged_articles",
    """WITH c AS (SELECT *, p_partkey % 8 AS k FROM part)
    SELECT p_partkey AS pageid, CASE WHEN k IN (0, 7) THEN 'right' WHEN k = 6 THEN 'left_only' ELSE 'left' END AS source,
      CASE WHEN k IN (0, 7) THEN p_name || ' is a thing that is made by ' || p_brand || ' and told of at length.'
        WHEN k = 3 THEN p_name || ' of the record is known by its wikitext alone, of ' || p_type || '.' WHEN k = 4 THEN 'Second ' || p_name ELSE 'First ' || p_name END AS intro
    FROM c""",
)
def merged_articles(spark, sf_dir):
    """Pages of eight kinds: without a record, with a good one, with a good one before one that holds a navigation box
    alone, with an empty rendering beside its wikitext, with two good ones, with an error after a good one, without a raw
    page, and with a rendering and wikitext that both hold nothing."""
    from .plans import build

    rows = spread(read(spark, sf_dir, "part")).withColumn("k", F.col("p_partkey") % 8)
    raw = F.concat(F.lit("'''"), "p_name", F.lit("''' is a thing that is made by "), "p_brand", F.lit(" and told of at length."))
    slots = F.struct(F.struct(F.struct(raw.alias("content")).alias("main")).alias("slots"))
    pages = rows.filter("k <> 6").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("pageid"), F.array(slots).alias("revisions"))
    said = lambda word: F.concat(F.lit(f"<div><p>{word} "), "p_name", F.lit("</p></div>"))
    own = F.concat("p_name", F.lit(" of the record is known by its wikitext alone, of "), "p_type", F.lit("."))
    record = lambda line, html, text, error=None: F.struct(F.lit(line).cast("long").alias("line"), html.cast("string").alias("html"), text.cast("string").alias("wikitext"), F.lit(error).cast("string").alias("error"))
    none, navigation = F.lit(None), F.lit('<div><table class="navbox"><tr><th>a</th><td>b</td></tr></table></div>')
    good = record(0, said("First"), none)
    more = F.when(F.col("k") == 0, F.array().cast("array<struct<line:bigint,html:string,wikitext:string,error:string>>")).when(F.col("k") == 2, F.array(good, record(1, navigation, none))).when(F.col("k") == 3, F.array(record(0, F.lit(" "), own)))
    more = more.when(F.col("k") == 4, F.array(good, record(1, said("Second"), none))).when(F.col("k") == 5, F.array(good, record(1, none, none, "timeout: late"))).when(F.col("k") == 7, F.array(record(0, F.lit(""), F.lit("#REDIRECT [[x]]")))).otherwise(F.array(good))
    records = rows.select(F.col("p_name").alias("title"), F.col("p_partkey").alias("pageid"), F.explode(more).alias("r"), F.lit("f").alias("file_name")).select("title", "pageid", "r.*", "file_name")
    found = build.articles(pages, records, BASE_URL, CASELESS)
    return found.select("pageid", "source", F.get("sections", 0)["text"].alias("intro"))


ARTICLES_SQL = """WITH a AS (SELECT p_partkey AS pageid, p_name AS title, 'en' AS game, 'https://corpus.example/' || replace(p_name, ' ', '_') AS url,
    [{'k': 'Size', 'v': p_size::VARCHAR}, {'k': 'place', 'v': 'the ' || p_brand || ' works'}, {'k': '1', 'v': p_type}, {'k': 'empty', 'v': ''}] AS fields,
    [{'h': 'Introduction', 't': p_name || ' is by its maker.'}, {'h': 'Use', 't': 'For ' || p_type || ' work.' || chr(10) || chr(10) || 'More' || chr(10) || 'A page.'}] AS parts FROM part)"""


@register("wikitext_articles", ARTICLES_SQL + " SELECT pageid, title, game, url, array_to_string(list_transform(fields, lambda f: f.k || '=' || f.v), ';') AS fields, array_to_string(list_transform(parts, lambda s: s.h || '=' || s.t), ';') AS sections FROM a")
def wikitext_articles(spark, sf_dir):
    pair = lambda x, a, b: F.concat(x[a], F.lit("="), x[b])
    fields = F.array_join(F.transform(F.get("infoboxes", 0)["fields"], lambda f: pair(f, "k", "v")), ";")
    parts = F.array_join(F.transform("sections", lambda x: pair(x, "heading", "text")), ";")
    return made_articles(spark, sf_dir).select("pageid", "title", "game", "url", fields.alias("fields"), parts.alias("sections"))


@register(
    "chunk_articles",
    ARTICLES_SQL
    + f""", f AS (SELECT *, '[en] ' || title || ' > infobox: EN place infobox. ' || array_to_string(list_transform(list_filter(fields, lambda f: trim(f.v) <> ''), lambda f: {LABEL_SQL.replace('CASE k', 'CASE lower(f.k)').replace('(k', '(f.k').replace(' k', ' f.k')} || ': ' || f.v || '.'), ' ') AS box FROM a),
    b AS (SELECT pageid, title, 0 AS o, 'infobox' AS heading, box AS t, string_split(box, ' ') AS ws FROM f
      UNION ALL SELECT pageid, title, 1, parts[1].h, parts[1].t, regexp_extract_all(parts[1].t, '\\S+') FROM f UNION ALL SELECT pageid, title, 2, parts[2].h, parts[2].t, regexp_extract_all(parts[2].t, '\\S+') FROM f),
    w AS (SELECT pageid, title, o, heading, t, ws, unnest(range(0, greatest(0, ceil((len(ws) - 8) / 6.0)::BIGINT) + 1)) AS i FROM b),
    c AS (SELECT pageid, heading, CASE WHEN heading = 'infobox' AND i = 0 THEN '' ELSE '[en] ' || title || ' > ' || heading || ': ' END || CASE WHEN len(ws) <= 8 THEN t ELSE array_to_string(ws[i * 6 + 1 : i * 6 + 8], ' ') END AS text,
      row_number() OVER (PARTITION BY pageid ORDER BY o, i) - 1 AS n FROM w)
    SELECT printf('%s-%04d', pageid::VARCHAR, n) AS chunk_id, heading, text FROM c""",
)
def chunk_articles(spark, sf_dir):
    return chunking.chunk_articles(made_articles(spark, sf_dir), 8, 2).select("chunk_id", "heading", "text")


@register("html_sections")
def html_sections(spark, sf_dir):
    """The tree walk has no SQL form; tests hold it against literal pages."""
    from .operators import html

    pages = spread(read(spark, sf_dir, "pages")).select(F.col("url").alias("title"), F.col("page_id").alias("pageid"), "html", F.lit(None).cast("string").alias("wikitext"))
    return html.parse_records(pages, BASE_URL).select("pageid", F.posexplode("sections").alias("n", "section")).select("pageid", "n", "section.heading", "section.text")


@register(
    "tag_mismatch",
    FACETS_SQL + """, h AS (SELECT u.doc_id, own[1] AS hint, CASE d.n_chars % 3 WHEN 0 THEN 'series' ELSE d.lang END AS tag FROM u JOIN documents d USING (doc_id))
    SELECT doc_id, hint, tag FROM h WHERE hint IS NOT NULL AND hint <> tag AND tag <> 'series'""",
)
def tag_mismatch(spark, sf_dir):
    tags = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, "series").otherwise(F.col("lang")).alias("tag"))
    rows = wiki_rows(spark, sf_dir).join(tags, "doc_id").withColumn("hint", FA.title_hint(F.col("title"), CASELESS))
    return rows.filter(F.col("hint").isNotNull() & (F.col("hint") != F.col("tag")) & (F.col("tag") != CASELESS.every)).select("doc_id", "hint", "tag")


@register(
    "main_hit",
    """SELECT p_partkey, coalesce(list_bool_or(list_transform([p_type || ' ' || p_name, p_brand, upper(p_name)], lambda t: len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 2 AND NOT contains(lower(t), w))) = 0)), false)
    AND len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 2)) > 0 AND p_size % 3 <> 0 AS hit FROM part""",
)
def main_hit(spark, sf_dir):
    question = F.concat(F.lit("What is the "), F.col("p_name"), F.lit("?"))
    titles = F.when(F.col("p_size") % 3 != 0, F.array(F.concat_ws(" ", "p_type", "p_name"), "p_brand", F.upper("p_name"))).otherwise(F.array("p_brand", "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", FA.main_hit(FA.subject_terms(question), titles).alias("hit"))


@register("subject_terms", "SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), lambda t: length(t) > 2), ' ') AS terms FROM part")
def subject_terms(spark, sf_dir):
    question = F.concat(F.lit("What is the "), F.col("p_name"), F.lit("?"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(FA.subject_terms(question), " ").alias("terms"))


# ---------------------------------------------------------------------------------------------- joins


@register("full_outer_prefer_left", "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'label ' || quality ELSE 'doc ' || lang END AS value, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id IS NULL THEN 'left_only' WHEN l.doc_id IS NOT NULL THEN 'left' ELSE 'right' END AS source FROM documents d FULL OUTER JOIN labels l USING (doc_id)")
def full_outer_prefer_left(spark, sf_dir):
    left = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label "), F.col("quality")).alias("value"))
    right = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("lang")).alias("value"), F.col("source").alias("o"))
    return joins.prefer_left(left, right, "doc_id", ["value"], "o").select("doc_id", "value", "source")


@register("last_record_wins", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def last_record_wins(spark, sf_dir):
    return joins.latest(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@register("retry_set", "WITH l AS (SELECT 'user ' || user_id AS title, max_by(event_type, (ts, event_id)) AS e FROM events GROUP BY user_id) SELECT title FROM l WHERE e = 'click'")
def retry_set(spark, sf_dir):
    error = F.when(F.col("event_type") == "click", "timeout: slow").when(F.col("event_type") == "view", "missingtitle")
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("user "), F.col("user_id")).alias("title"), error.alias("error"), "ts", "event_id")
    return joins.retry_set(rows, ["ts", "event_id"])


@register("batching", "WITH b AS (SELECT event_id, event_type, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS batch FROM events) SELECT batch::BIGINT AS batch, count(*) AS n, count(*) FILTER (event_type = 'click') AS errors FROM b GROUP BY batch")
def batching(spark, sf_dir):
    rows = joins.in_batches(read(spark, sf_dir, "events").select("event_id", "event_type"), 50, ["event_id"])
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("errors"))


@register("incremental_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_anti_join(spark, sf_dir):
    return joins.new_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@register("insert_if_absent", "SELECT DISTINCT md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def insert_if_absent(spark, sf_dir):
    """Texts come in three batches with their copies; the table keeps each once."""
    table = KeyedTable(spark, new_folder(spark, "keyed"), "text_md5 string, doc_id long", "text_md5")
    docs = read(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    for i in range(3):
        table.insert(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == i))
    return table.read().select("text_md5")


@register("sibling_lookup", CHUNKS_SQL + ", h AS (SELECT doc_id AS pageid FROM labels WHERE toxic = 1) SELECT pageid, count(*) AS n, md5(string_agg(chunk_id, ',' ORDER BY chunk_id)) AS ids_md5 FROM chunks WHERE pageid IN (SELECT pageid FROM h) GROUP BY pageid")
def sibling_lookup(spark, sf_dir):
    hits = read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("pageid"))
    found = joins.siblings(hits, chunk_rows(spark, sf_dir))
    return found.select("pageid", F.size("chunks").cast("long").alias("n"), F.md5(F.array_join(F.transform("chunks", lambda c: c["chunk_id"]), ",")).alias("ids_md5"))


@register("point_get", CHUNKS_SQL + " SELECT chunk_id, md5(text) AS text_md5 FROM chunks WHERE ordinal = 0 AND pageid IN (SELECT doc_id FROM labels)")
def point_get(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").select(F.format_string("%s-0000", F.col("doc_id").cast("string")).alias("chunk_id"))
    ids = ids.unionByName(spark.createDataFrame([(None,), ("",), ("nowhere-0000",)], "chunk_id string"))
    return joins.point_get(ids, chunk_rows(spark, sf_dir)).select("chunk_id", F.md5("text").alias("text_md5"))


@register("duplicate_key_check", "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_key_check(spark, sf_dir):
    return joins.duplicate_keys(read(spark, sf_dir, "documents").select("text"), "text").select(F.md5("text").alias("text_md5"), "n")


@register("count_parity", "SELECT count(*) AS n, count(DISTINCT doc_id) AS keys, count(*) = count(DISTINCT doc_id) AS ok FROM documents")
def count_parity(spark, sf_dir):
    n, keys = F.count("*"), F.count_distinct(F.col("doc_id"))
    return read(spark, sf_dir, "documents").agg(n.alias("n"), keys.alias("keys"), (n == keys).alias("ok"))


@register("health_counts", "SELECT 'documents' AS name, 'ok' AS status, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', 'ok', count(*) FROM embeddings")
def health_counts(spark, sf_dir):
    of = lambda name: read(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.when(F.col("n") > 0, "ok").otherwise("missing").alias("status"), "n")
    return of("documents").unionByName(of("embeddings"))


@register("exact_dedupe_first_seen", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def exact_dedupe_first_seen(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@register("positional_zip", "SELECT vec_id, sum(a * b)::DOUBLE AS dot FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS a, unnest(list_reverse(embedding))::DOUBLE AS b FROM embeddings) GROUP BY vec_id")
def positional_zip(spark, sf_dir):
    both = joins.zip_strict(F.col("a"), F.col("b"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), F.reverse(F.col("embedding").cast("array<double>")).alias("b"))
    return rows.select("vec_id", F.aggregate(both, F.lit(0.0), lambda s, x: s + x["a"] * x["b"]).alias("dot"))


# ------------------------------------------------------------------------------------------- lexical


def documents_index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> lexical.Index:
    """The index of the documents for the terms of the benchmark questions."""
    asked = lexical.query_terms(benchmark_questions(spark, sf_dir), "qid", "question", stemmed)
    return lexical.build_index(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", stemmed, asked)


def every_term(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.build_index(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


POSTINGS_SQL = rf"""tok AS (SELECT doc_id, {TOKENS.format('text')} AS a FROM documents), dls AS (SELECT doc_id, len(a) AS dl FROM tok),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(a) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls)"""
BM25_SQL = (
    "WITH "
    + POSTINGS_SQL
    + rf""", qt AS (SELECT item_id AS qid, {TOKENS.format('text')} AS a FROM benchmark),
q AS (SELECT qid, unnest(CASE WHEN len(list_filter(a, lambda x: x NOT IN ({STOP}))) > 0 THEN list_filter(a, lambda x: x NOT IN ({STOP})) ELSE a END) AS term FROM qt),
qq AS (SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL),
sc AS (SELECT qid, post.doc_id AS chunk_id, sum(qtf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qq JOIN dfs USING (term) JOIN post USING (term) JOIN dls ON dls.doc_id = post.doc_id, st GROUP BY ALL)"""
)


@register("postings", "WITH " + POSTINGS_SQL + " SELECT term, doc_id, tf FROM post")
def postings(spark, sf_dir):
    return every_term(spark, sf_dir).postings.select("term", F.col("chunk_id").alias("doc_id"), "tf")


@register("document_frequencies", "WITH " + POSTINGS_SQL + " SELECT term, df FROM dfs")
def document_frequencies(spark, sf_dir):
    return every_term(spark, sf_dir).frequencies


@register("corpus_stats", "WITH " + POSTINGS_SQL + " SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, sf_dir):
    return every_term(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


TOP = "row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)"


@register("bm25_topk", BM25_SQL + f", r AS (SELECT qid, chunk_id, score, {TOP} AS rank FROM sc) SELECT qid, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return lexical.search(documents_index(spark, sf_dir), benchmark_questions(spark, sf_dir), 20).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register(
    "bm25_topk_faceted",
    BM25_SQL + f", f AS (SELECT sc.* FROM sc JOIN documents d ON d.doc_id = sc.chunk_id WHERE lang = 'en'), r AS (SELECT qid, chunk_id, score, {TOP} AS rank FROM f) SELECT qid, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20",
)
def bm25_topk_faceted(spark, sf_dir):
    allowed = read(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return lexical.search(documents_index(spark, sf_dir), benchmark_questions(spark, sf_dir), 20, allowed=allowed).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def segmented(spark: SparkSession, sf_dir: str, *texts: DataFrame) -> SegmentedIndex:
    """A segmented index of the documents, or of the given tables one after another, with their languages as facets."""
    index = SegmentedIndex(spark, new_folder(spark, "segments"), "long")
    for rows in texts or (read(spark, sf_dir, "documents"),):
        index.add(spread(rows.select(F.col("doc_id").alias("chunk_id"), "text", F.array_compact(F.array("lang")).alias("games"))))
    return index


@register("bm25_blockmax_topk", BM25_SQL + f", r AS (SELECT qid, chunk_id, score, {TOP} AS rank FROM sc) SELECT qid, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20")
def bm25_blockmax_topk(spark, sf_dir):
    return segmented(spark, sf_dir).search(benchmark_questions(spark, sf_dir), 20).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register(
    "bm25_blockmax_faceted",
    BM25_SQL
    + f""", f AS (SELECT sc.* FROM sc JOIN documents d ON d.doc_id = sc.chunk_id WHERE qid % 3 = 2 OR lang = CASE qid % 3 WHEN 0 THEN 'en' ELSE 'fr' END),
    r AS (SELECT qid, chunk_id, score, {TOP} AS rank FROM f) SELECT qid, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20""",
)
def bm25_blockmax_faceted(spark, sf_dir):
    """A third of the questions asks for each of two facets, a third for all."""
    facet = F.when(F.col("qid") % 3 == 0, "en").when(F.col("qid") % 3 == 1, "fr")
    hits = segmented(spark, sf_dir).search(benchmark_questions(spark, sf_dir).withColumn("game", facet), 20, facet="game")
    return hits.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register(
    "bm25_segments",
    BM25_SQL.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))") + f", r AS (SELECT qid, chunk_id, score, {TOP} AS rank FROM sc) SELECT qid, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20",
)
def bm25_segments(spark, sf_dir):
    """The documents come source by source in five segments, which are merged; the toxic ones are dropped after that: the
    same ranks as over an index of what is left."""
    docs = read(spark, sf_dir, "documents")
    turn = F.pmod(F.xxhash64("source"), F.lit(5))
    index = segmented(spark, sf_dir, *(docs.filter(turn == i) for i in range(5)))
    index.merge()
    index.drop(read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("chunk_id")))
    return index.search(benchmark_questions(spark, sf_dir), 20).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register("bm25_stemmed_topk")
def bm25_stemmed_topk(spark, sf_dir):
    """Stemming has no SQL form; tests hold it against SQLite's full-text search."""
    return lexical.search(documents_index(spark, sf_dir, True), benchmark_questions(spark, sf_dir), 20)


# ------------------------------------------------------------------------------------------- vectors


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.array(F.col("label").cast("string")).alias("games"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").cast("string").alias("facet"))


COSINE_SQL = """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT qid, vec_id AS chunk_id, ql, label, list_cosine_distance(qv, embedding::DOUBLE[]) AS distance FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), chunk_id) AS rank FROM d {where})
SELECT qid, chunk_id, round(distance, 6) + 0.0 AS distance, rank::INT AS rank FROM r WHERE rank <= 10"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "chunk_id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@register("cosine_topk", COSINE_SQL.format(where=""))
def cosine_topk(spark, sf_dir):
    return _rounded(dense.top_k(vector_queries(spark, sf_dir), vector_store(spark, sf_dir), 10))


@register("cosine_topk_faceted", COSINE_SQL.format(where="WHERE label = (qid // 20) % 10"))
def cosine_topk_faceted(spark, sf_dir):
    asked = vector_queries(spark, sf_dir).withColumn("facet", (F.floor(F.col("qid") / 20) % 10).cast("string"))
    return _rounded(dense.top_k(asked, vector_store(spark, sf_dir), 10, facet="facet"))


def cell_index(spark: SparkSession, sf_dir: str) -> CellIndex:
    """An index of half of the vectors, to which the other half is added."""
    index, store = CellIndex(spark, new_folder(spark, "cells"), "long"), vector_store(spark, sf_dir)
    index.create(store.filter("chunk_id % 2 = 0"))
    index.add(store)
    return index


@register("vector_cells_topk", COSINE_SQL.format(where=""))
def vector_cells_topk(spark, sf_dir):
    return _rounded(cell_index(spark, sf_dir).search(vector_queries(spark, sf_dir), 10, exact=True))


@register("vector_cells_faceted", COSINE_SQL.format(where="WHERE label = (qid // 20) % 10"))
def vector_cells_faceted(spark, sf_dir):
    asked = vector_queries(spark, sf_dir).withColumn("facet", (F.floor(F.col("qid") / 20) % 10).cast("string"))
    return _rounded(cell_index(spark, sf_dir).search(asked, 10, facet="facet", exact=True))


@register(
    "safe_l2_normalise",
    """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN vec_id % 5 = 0 AND i = 1 THEN 0.0 WHEN vec_id % 7 = 0 THEN 0.0 ELSE x END) AS v FROM embeddings),
    n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v)
    SELECT vec_id, round(v[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0 AS first, round(v[2] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0 AS second, round(CASE WHEN n = 0 THEN 0 ELSE 1 END, 6)::DOUBLE AS length FROM n""",
)
def safe_l2_normalise(spark, sf_dir):
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.when((F.col("vec_id") % 7 == 0), 0.0).when((F.col("vec_id") % 5 == 0) & (i == 0), float("nan")).otherwise(v))
    unit = read(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalise(x).alias("u"))
    return unit.select("vec_id", (F.round(F.col("u")[0], 6) + 0.0).alias("first"), (F.round(F.col("u")[1], 6) + 0.0).alias("second"), F.round(V.norm(F.col("u")), 6).alias("length"))


HASH_SQL = """b AS (SELECT id, ('0x' || right(sha1(tok), 2))::INT AS bucket, count(*) AS c FROM (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM benchmark) GROUP BY ALL),
nn AS (SELECT id, sqrt(sum(c * c)) AS n FROM b GROUP BY id)"""


@register("hashing_embed", "WITH " + HASH_SQL + " SELECT id AS item_id, bucket, round(c / n, 6) AS value FROM b JOIN nn USING (id)")
def hashing_embed(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(V.hash_embedding(F.col("text"))).alias("bucket", "value"))
    return rows.filter("value <> 0").select("item_id", F.col("bucket").cast("int").alias("bucket"), F.round("value", 6).alias("value"))


@register(
    "hashing_cosine",
    "WITH " + HASH_SQL + """, p AS (SELECT a.id AS qid, c.id AS chunk_id, 1 - sum(a.c * c.c) / (any_value(x.n) * any_value(y.n)) AS distance FROM b a JOIN b c USING (bucket) JOIN nn x ON x.id = a.id JOIN nn y ON y.id = c.id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), chunk_id) AS rank FROM p) SELECT qid, chunk_id, round(distance, 6) + 0.0 AS distance, rank::INT AS rank FROM r WHERE rank <= 5""",
)
def hashing_cosine(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), V.hash_embedding(F.col("text")).alias("embedding"))
    return _rounded(dense.top_k(rows.withColumnRenamed("chunk_id", "qid"), rows, 5))


# -------------------------------------------------------------------------------------------- fusion


def two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists per vector query: nearest by cosine, and smallest ids of the query's label."""
    near = dense.top_k(vector_queries(spark, sf_dir), vector_store(spark, sf_dir), 10).select("qid", F.lit(0).alias("list_id"), "rank", "chunk_id")
    asked = vector_queries(spark, sf_dir).select("qid", F.col("facet").cast("int").alias("label"))
    # A label's list is cut before its questions get it, so no pair of question and row beyond the ten is made.
    first = vector_store(spark, sf_dir).filter("label IS NOT NULL").select("label", "chunk_id").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("chunk_id"))).filter("rank <= 10")
    same = asked.join(first, "label")
    return near.unionByName(same.select("qid", F.lit(1).alias("list_id"), "rank", "chunk_id"))


LISTS_SQL = """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT qid, vec_id AS chunk_id, label, ql, list_cosine_distance(qv, embedding::DOUBLE[]) AS distance FROM q, embeddings),
l AS (SELECT qid, 0 AS list_id, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), chunk_id) AS rank, chunk_id FROM d
      UNION ALL SELECT qid, 1, row_number() OVER (PARTITION BY qid ORDER BY chunk_id), chunk_id FROM d WHERE label = ql),
k AS (SELECT * FROM l WHERE rank <= 10)"""


@register("rrf_fuse", LISTS_SQL + ", s AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list_id, rank)) AS seen FROM k GROUP BY ALL) SELECT qid, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen)::INT AS rank FROM s")
def rrf_fuse(spark, sf_dir):
    return fusion.rrf(two_lists(spark, sf_dir)).select("qid", "chunk_id", F.round("score", 9).alias("score"), "rank")


BEST_SQL = """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT qid, vec_id AS chunk_id, label, list_cosine_distance(qv, embedding::DOUBLE[]) AS distance FROM q, embeddings WHERE vec_id <> qid),
b AS (SELECT qid, min(distance) FILTER (label = (qid // 20 + 1) % 10 AND (qid // 20) % 4 <> 3) AS bf, min(distance) AS bu FROM d GROUP BY qid),
s AS (SELECT qid, bf, bu, CASE WHEN bf IS NULL THEN bu IS NOT NULL WHEN bu IS NULL THEN false ELSE bf - bu >= 0.10 END AS starved FROM b)"""


def both_passes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = vector_queries(spark, sf_dir).withColumn("facet", F.when(F.floor(F.col("qid") / 20) % 4 == 3, "none").otherwise(((F.floor(F.col("qid") / 20) + 1) % 10).cast("string")))
    store = vector_store(spark, sf_dir)
    run = lambda facet: dense.top_k(asked, store, 11, facet=facet).filter("chunk_id <> qid").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter("rank <= 10")
    return run("facet"), run(None)


@register("starved_filter", BEST_SQL + " SELECT qid, round(bf, 6) AS bf, round(bu, 6) AS bu, starved FROM s")
def starved_filter(spark, sf_dir):
    inside, every = both_passes(spark, sf_dir)
    best = lambda df, name: df.groupBy("qid").agg(F.min("distance").alias(name))
    both = best(every, "bu").join(best(inside, "bf"), "qid", "left")
    return both.select("qid", F.round("bf", 6).alias("bf"), F.round("bu", 6).alias("bu"), fusion.starved(F.col("bf"), F.col("bu")).alias("starved"))


@register(
    "relaxed_retrieve",
    BEST_SQL + """, r AS (SELECT d.qid, chunk_id, distance, starved AS relaxed, row_number() OVER (PARTITION BY d.qid ORDER BY round(distance, 9), chunk_id) AS rank
    FROM d JOIN s USING (qid) WHERE starved OR (label = (qid // 20 + 1) % 10)) SELECT qid, chunk_id, round(distance, 6) AS distance, rank::INT AS rank, relaxed FROM r WHERE rank <= 10""",
)
def relaxed_retrieve(spark, sf_dir):
    inside, every = both_passes(spark, sf_dir)
    return fusion.relax(inside, every).select("qid", "chunk_id", F.round("distance", 6).alias("distance"), "rank", "relaxed")


def lexical_hits(spark: SparkSession, sf_dir: str, n: int = 30) -> DataFrame:
    """Chunk hits of the benchmark questions: chunks of the documents that BM25 finds, by document rank and ordinal."""
    found = lexical.search(documents_index(spark, sf_dir), benchmark_questions(spark, sf_dir), 5).select("qid", F.col("chunk_id").alias("pageid"), F.col("rank").alias("page_rank"))
    found = materialise(found, "found-pages")  # a table of known, small size: it is broadcast before texts are read
    rows = chunk_rows(spark, sf_dir, found).join(found, "pageid")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("page_rank", "ordinal"))).filter(F.col("rank") <= n)


HITS_SQL = (
    BM25_SQL
    + f", r AS (SELECT qid, chunk_id, {TOP} AS rank FROM sc), pg AS (SELECT qid, chunk_id AS pageid, rank AS page_rank FROM r WHERE rank <= 5)"
    + CHUNKS_SQL.replace("WITH ", ", ", 1).replace("w AS", "cw AS").replace("FROM w,", "FROM cw,").replace("FROM w WHERE", "FROM cw WHERE")
    + ", hh AS (SELECT c.*, qid, row_number() OVER (PARTITION BY qid ORDER BY page_rank, ordinal) AS rank FROM chunks c JOIN pg USING (pageid)), hits AS (SELECT * FROM hh WHERE rank <= 30)"
)


@register(
    "overlap_rerank",
    HITS_SQL
    + rf""", ov AS (SELECT h.qid, h.chunk_id, h.rank, len(list_filter({WORDS.format('lower(h.text)')}, lambda x: list_contains({WORDS.format('lower(b.text)')}, x)))::DOUBLE AS score FROM hits h JOIN benchmark b ON b.item_id = h.qid WHERE h.rank <= 20)
    SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank)::INT AS rank FROM ov""",
)
def overlap_rerank(spark, sf_dir):
    hits = lexical_hits(spark, sf_dir).join(benchmark_questions(spark, sf_dir), "qid")
    ranked = fusion.rerank(hits, V.overlap_score(F.col("question"), F.col("text")), 20)
    return ranked.select("qid", "chunk_id", F.col("_score").alias("score"), "rank")


CAP_SQL = """, bx AS (SELECT *, coalesce(lower(trim(heading)) = 'infobox' OR contains(text, '> infobox:'), false) AS box FROM hits),
fi AS (SELECT *, box AND row_number() OVER (PARTITION BY qid, pageid, box ORDER BY rank) = 1 AS fbox FROM bx),
sl AS (SELECT *, row_number() OVER (PARTITION BY qid, pageid ORDER BY fbox DESC, rank) AS slot FROM fi),
cp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nr FROM sl WHERE slot <= 3)"""


@register("cap_per_page", HITS_SQL + CAP_SQL + " SELECT qid, chunk_id, nr::INT AS rank FROM cp WHERE nr <= 8")
def cap_per_page(spark, sf_dir):
    return fusion.cap_per_page(lexical_hits(spark, sf_dir), 8, 3).select("qid", "chunk_id", "rank")


MERGE_SQL = f""", sm AS (SELECT pageid FROM chunks GROUP BY pageid HAVING count(*) FILTER (length(text) < 900) >= 3),
ln AS (SELECT pageid, chunk_id, {BARE} AS line FROM chunks WHERE pageid IN (SELECT pageid FROM sm)),
ru AS (SELECT *, row_number() OVER w AS n, sum(length(line) + 1) OVER w AS total FROM ln WINDOW w AS (PARTITION BY pageid ORDER BY chunk_id ROWS UNBOUNDED PRECEDING)),
bl AS (SELECT pageid, string_agg(line, chr(10) ORDER BY chunk_id) AS body FROM ru WHERE n = 1 OR total <= 4000 GROUP BY pageid),
jo AS (SELECT h.*, body, row_number() OVER (PARTITION BY qid, h.pageid ORDER BY rank) AS n FROM hits h LEFT JOIN bl USING (pageid))"""


@register(
    "merge_fragmented",
    HITS_SQL + MERGE_SQL + """ SELECT qid, CASE WHEN body IS NULL THEN chunk_id ELSE pageid || '-merged' END AS chunk_id, md5(CASE WHEN body IS NULL THEN text ELSE '[' || game || '] ' || title || ' > combined: ' || body END) AS text_md5,
    row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM jo WHERE body IS NULL OR n = 1""",
)
def merge_fragmented(spark, sf_dir):
    hits = lexical_hits(spark, sf_dir).drop("page_rank", "ordinal")
    merged = fusion.merge_fragmented(hits, chunk_rows(spark, sf_dir, hits), small_chars=900)
    return merged.select("qid", "chunk_id", F.md5("text").alias("text_md5"), "rank")


# -------------------------------------------------------------------------- sources, prompts, history


@register("source_numbers", HITS_SQL + ", f AS (SELECT qid, url, min(rank) AS first FROM hits GROUP BY ALL) SELECT qid, url, row_number() OVER (PARTITION BY qid ORDER BY first)::INT AS n FROM f")
def source_numbers(spark, sf_dir):
    return prompts.source_numbers(lexical_hits(spark, sf_dir))


@register(
    "source_cards",
    HITS_SQL
    + rf""", f AS (SELECT *, row_number() OVER (PARTITION BY qid, url ORDER BY rank) AS k FROM hits), g AS (SELECT qid, url, title, game, {COLLAPSE.format(chr(114) + 'egexp_replace(text, ' + chr(39) + r'^\[[^\]]*\][^:]*:\s*' + chr(39) + ', ' + chr(39) * 2 + ')')} AS t,
    row_number() OVER (PARTITION BY qid ORDER BY rank) AS n, count(*) OVER (PARTITION BY qid) AS total FROM f WHERE k = 1),
    v AS (SELECT *, CASE WHEN total <= 1 THEN 1.0 ELSE (total - n) / (total - 1)::DOUBLE END AS rel FROM g)
    SELECT qid, n::INT AS n, url, title, game, {CUT.format(n=200)} AS snippet, round(rel, 4) AS relevance, CASE WHEN rel >= 0.66 THEN 'high' WHEN rel >= 0.33 THEN 'med' ELSE 'low' END AS tier FROM v""",
)
def source_cards(spark, sf_dir):
    return prompts.source_cards(lexical_hits(spark, sf_dir))


@register("history_last6", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def history_last6(spark, sf_dir):
    return prompts.last_turns(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@register("previous_question", rf"SELECT conv_id, turn, md5(CASE WHEN coalesce({STRIP.format('p')}, '') = '' THEN text ELSE {STRIP.format('p')} || ' ' || text END) AS query_md5, p IS NOT NULL AS follow_up FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'user')")
def previous_question(spark, sf_dir):
    found = prompts.previous_questions(read(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", F.md5("retrieval_query").alias("query_md5"), F.col("previous").isNotNull().alias("follow_up"))


@register(
    "history_block",
    rf"""WITH t AS (SELECT conv_id, turn, text AS q, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS a, role FROM conversations),
    u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t WHERE role = 'user'),
    l AS (SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN {STRIP.format("coalesce(q, '')")} <> '' THEN 'Q: ' || {STRIP.format('q')} END, CASE WHEN {STRIP.format("coalesce(a, '')")} <> '' THEN 'A: ' || {STRIP.format('a')} END], lambda x: x IS NOT NULL), chr(10)) AS line FROM u WHERE n <= 6)
    SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY turn)) AS history_md5 FROM l WHERE line <> '' GROUP BY conv_id""",
)
def history_block(spark, sf_dir):
    after = F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = read(spark, sf_dir, "conversations").withColumn("answer", after).filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "answer")
    return prompts.history_blocks(turns).select("conv_id", F.md5("history").alias("history_md5"))


@register(
    "prompt_blocks",
    HITS_SQL
    + """, f AS (SELECT qid, url, min(rank) AS first FROM hits GROUP BY ALL), nu AS (SELECT qid, url, row_number() OVER (PARTITION BY qid ORDER BY first) AS n FROM f),
    bl AS (SELECT qid, rank, n, '[' || n || '] [' || title || ' (' || game || ')] ' || text || chr(10) || 'Source: ' || url AS block FROM hits JOIN nu USING (qid, url)),
    cx AS (SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, max(n) AS top FROM bl GROUP BY qid)
    SELECT item_id AS qid, md5('This question is about English (en), and all of the context below belongs to it.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '(nothing was found)') || chr(10) || chr(10)
      || CASE WHEN top IS NULL THEN '' ELSE 'After each statement give the number of the context it rests on, from [1] to [' || top || '], and no other number.' || chr(10) || chr(10) END
      || 'Format: answer with a short Markdown bullet list.' || chr(10) || chr(10) || 'Question: ' || text) AS prompt_md5 FROM benchmark LEFT JOIN cx ON cx.qid = item_id""",
)
def prompt_blocks(spark, sf_dir):
    asked = benchmark_questions(spark, sf_dir).withColumns({"game": F.lit("en"), "answer_format": F.lit("list")})
    return prompts.build_prompts(asked, lexical_hits(spark, sf_dir), {"en": "English"}).select("qid", F.md5("prompt").alias("prompt_md5"))


@register(
    "answer_events",
    """WITH a AS (SELECT event_id AS qid, event_type || ' says ' || user_id || ' and goes on' AS t, CASE WHEN event_id % 3 = 0 THEN 'fast' END AS tier, event_id % 5 = 0 AS declined, event_id % 7 = 0 AS err FROM events),
    e AS (SELECT qid, -1 AS o, 'tier' AS kind, '"fast"' AS payload FROM a WHERE tier IS NOT NULL AND NOT err
    UNION ALL SELECT qid, i::INT, 'text', '"' || substr(t, i * 16 + 1, 16) || '"' FROM a, unnest(range(0, ceil(length(t) / 16.0)::BIGINT)) AS r(i) WHERE NOT err
    UNION ALL SELECT qid, 998, 'declined', 'true' FROM a WHERE declined AND NOT err UNION ALL SELECT qid, 999, 'sources', '[]' FROM a WHERE NOT err
    UNION ALL SELECT qid, 0, 'error', '"broken"' FROM a WHERE err)
    SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY o) - 1)::INT AS seq, kind, payload FROM e""",
)
def answer_events(spark, sf_dir):
    answers = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("qid"),
        F.concat("event_type", F.lit(" says "), "user_id", F.lit(" and goes on")).alias("answer"),
        F.when(F.col("event_id") % 3 == 0, "fast").alias("tier"),
        (F.col("event_id") % 5 == 0).alias("declined"),
        F.lit("[]").alias("sources"),
        F.when(F.col("event_id") % 7 == 0, "broken").alias("error"),
    )
    return prompts.answer_events(answers).select("qid", F.col("seq").cast("int").alias("seq"), "kind", "payload")


# ----------------------------------------------------------------------------------- decisions, gates

CHOICES = ("fast", "thinking", "scholar", "bogus")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision replies with choices and confidences made from the events; every 13th is missing."""
    e = F.col("event_id")
    c = F.format_string("%d.%d", F.lit(0), e % 10)
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    shown = F.when(e % 17 == 0, F.lit('"high"')).otherwise(c)
    part = lambda name, value: F.concat(F.lit(f'"{name}":{{"choice":"'), value, F.lit('","confidence":'), shown, F.lit("}"))
    reply = F.concat(F.lit("{"), part("tier", pick(CHOICES, e % 4)), F.lit(","), part("topic", pick(("on_topic", "off_topic"), e % 2)), F.lit(","), part("format", pick(("table", "list", "prose", "verse"), e % 4)), F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", F.when(e % 13 != 0, reply).alias("reply"), "value", "user_id", "event_type")


REPLY_SQL = """WITH a AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'NaN'::DOUBLE ELSE (event_id % 10) / 10.0::DOUBLE END AS c, event_id % 13 <> 0 AS said,
['fast', 'thinking', 'scholar', NULL][(event_id % 4 + 1)::INT] AS tier, ['on_topic', 'off_topic'][(event_id % 2 + 1)::INT] AS topic, ['table', 'list', 'prose', NULL][(event_id % 4 + 1)::INT] AS fmt FROM events),
g AS (SELECT *, NOT isnan(c) AND c >= 0.5 AS c5, NOT isnan(c) AND c >= 0.8 AS c8 FROM a)"""


@register("choice_parse", REPLY_SQL + " SELECT event_id, CASE WHEN said THEN tier END AS choice, CASE WHEN said AND tier IS NOT NULL THEN CASE WHEN isnan(c) THEN -1.0 ELSE c END END AS confidence FROM g")
def choice_parse(spark, sf_dir):
    found = replies(spark, sf_dir).withColumn("c", D.choice(F.col("reply"), "tier", D.TIERS))
    return found.select("event_id", F.col("c.choice").alias("choice"), F.when(F.isnan("c.confidence"), -1.0).otherwise(F.col("c.confidence")).alias("confidence"))


@register("topic_gate", REPLY_SQL + " SELECT event_id, CASE WHEN NOT said THEN NULL WHEN topic = 'on_topic' THEN topic WHEN c8 THEN topic END AS topic FROM g")
def topic_gate(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", D.topic(D.choice(F.col("reply"), "topic", D.TOPICS)).alias("topic"))


@register("format_hint", REPLY_SQL + " SELECT event_id, CASE WHEN said AND c5 THEN fmt END AS format FROM g")
def format_hint(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", D.answer_format(D.choice(F.col("reply"), "format", D.FORMATS)).alias("format"))


@register(
    "route",
    REPLY_SQL
    + """ SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'scholar' WHEN said AND tier IS NOT NULL AND c5 THEN tier ELSE 'thinking' END AS tier,
    CASE WHEN event_id % 19 = 0 THEN 'override' WHEN said AND tier IS NOT NULL AND c5 THEN 'service' ELSE 'fallback' END AS source,
    CASE WHEN NOT said THEN NULL WHEN topic = 'on_topic' THEN topic WHEN c8 THEN topic END AS topic, CASE WHEN said AND c5 THEN fmt END AS format FROM g""",
)
def route(spark, sf_dir):
    forced = F.when(F.col("event_id") % 19 == 0, "scholar").when(F.col("event_id") % 23 == 0, "deepest")
    routed = replies(spark, sf_dir).withColumn("r", D.route(F.col("reply"), forced, F.lit(True)))
    return routed.select("event_id", "r.tier", "r.source", "r.topic", "r.format")


@register(
    "tier_overlay",
    """WITH a AS (SELECT conv_id, turn, coalesce(nullif(regexp_extract(event_type || text, 'fast|thinking|scholar|error|view'), ''), 'none') AS tier FROM (
        SELECT c.conv_id, c.turn, c.text, ['fast', 'thinking', 'scholar', 'view', 'error', ''][(length(c.text) % 6 + 1)::INT] AS event_type FROM conversations c)),
    t(tier, top_k, cand) AS (VALUES ('fast', 20, 60), ('thinking', 48, 60), ('scholar', 96, 224))
    SELECT conv_id, turn, a.tier, coalesce(t.top_k, f.top_k)::INT AS top_k, coalesce(t.cand, f.cand)::INT AS candidates FROM a LEFT JOIN t ON a.tier = t.tier, (SELECT * FROM t WHERE tier = 'thinking') f""",
)
def tier_overlay(spark, sf_dir):
    from .config import DEFAULTS, TIER_NAMES, apply_tier

    laid = lambda t: (t, apply_tier(DEFAULTS, t)["top_k"], apply_tier(DEFAULTS, t)["hybrid_candidates"])
    tiers = spark.createDataFrame([laid(t) for t in (*TIER_NAMES, "any other")], "_tier string, top_k int, candidates int")
    kinds = F.array(*map(F.lit, ("fast", "thinking", "scholar", "view", "error", "")))
    named = F.regexp_extract(F.concat(F.element_at(kinds, F.length("text") % 6 + 1), "text"), "fast|thinking|scholar|error|view", 0)
    asked = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(named == "", "none").otherwise(named).alias("tier"))
    key = F.when(F.col("tier").isin(list(TIER_NAMES)), F.col("tier")).otherwise("any other")
    return asked.join(F.broadcast(tiers), key == F.col("_tier")).select("conv_id", "turn", "tier", "top_k", "candidates")  # four rows


@register(
    "not_covered",
    """WITH v AS (SELECT event_id, ['answered', 'partial', 'not_covered', 'unknown', NULL][(user_id % 5 + 1)::INT] AS verdict, CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE WHEN event_type = 'signup' THEN 'Infinity'::DOUBLE ELSE value / 500.0::DOUBLE END AS confidence FROM events)
    SELECT event_id, coalesce(verdict = 'not_covered', false) AND NOT isnan(confidence) AND NOT isinf(confidence) AND confidence >= 0.2 AS declined FROM v""",
)
def not_covered(spark, sf_dir):
    verdict = F.element_at(F.array(*map(F.lit, (*D.COVERAGE, "unknown", None))), (F.col("user_id") % 5 + 1).cast("int"))
    confidence = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "signup", float("inf")).otherwise(F.col("value") / 500.0)
    return read(spark, sf_dir, "events").select("event_id", D.not_covered(verdict, confidence, 0.2).alias("declined"))


@register("check_eligible", REPLY_SQL + " SELECT event_id, event_id % 19 <> 0 AND said AND event_id % 29 <> 0 AND (tier IS NOT NULL) AS eligible FROM g")
def check_eligible(spark, sf_dir):
    forced = F.when(F.col("event_id") % 19 == 0, "scholar")
    routed = replies(spark, sf_dir).withColumn("r", D.route(F.col("reply"), forced, F.lit(True)))
    return routed.select("event_id", D.check_eligible(F.lit(True), F.col("r.source"), F.col("r.confidence"), F.col("event_id") % 29 != 0).alias("eligible"))


def gate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate records from labels and events: kinds by id, verdicts and confidences by their digits."""
    e = F.col("event_id")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    verdict = lambda by: F.struct(pick(D.COVERAGE, by % 3).alias("verdict"), ((e % 11) / 10.0).alias("confidence"))
    return read(spark, sf_dir, "events").select(
        "event_id",
        pick(("gold", "off_topic", "not_covered", "follow_up"), e % 4).alias("kind"),
        pick(D.TIERS, F.floor(e / 4) % 3).alias("tier"),
        F.struct(pick(("off_topic", "on_topic"), F.floor(e / 8) % 2).alias("choice"), ((e % 10) / 10.0).alias("confidence")).alias("topic"),
        F.struct(pick((*D.FORMATS, "verse"), F.floor(e / 16) % 4).alias("choice"), F.lit(1.0).alias("confidence")).alias("format"),
        F.when(e % 9 != 0, verdict(F.floor(e / 2))).alias("check1"),
        verdict(F.floor(e / 6)).alias("check2"),
    )


GATE_SQL = """WITH a AS (SELECT event_id AS e, ['gold', 'off_topic', 'not_covered', 'follow_up'][(event_id % 4 + 1)::INT] AS kind, ['fast', 'thinking', 'scholar'][((event_id // 4) % 3 + 1)::INT] AS tier,
(event_id // 8) % 2 = 0 AS off, (event_id % 10) / 10.0::DOUBLE AS tc, (event_id % 11) / 10.0::DOUBLE AS cc, event_id % 9 <> 0 AND (event_id // 2) % 3 = 2 AS n1, (event_id // 6) % 3 = 2 AS n2, (event_id // 16) % 4 AS f FROM events),
t AS (SELECT unnest([0.7::DOUBLE, 0.8, 0.9]) AS threshold),
s AS (SELECT e, kind, tier, threshold, off AND tc >= threshold AS blocked, n1 AND cc >= threshold AND tier <> 'scholar' AS escalated,
  CASE WHEN n1 AND cc >= threshold THEN tier = 'scholar' OR (n2 AND cc >= threshold) ELSE false END AS declined FROM a, t)"""


@register("replay_sweep", GATE_SQL + " SELECT e AS event_id, threshold, blocked, escalated, declined FROM s")
def replay_sweep(spark, sf_dir):
    return evaluate.sweep(gate_records(spark, sf_dir)).select("event_id", "threshold", "blocked", "escalated", "declined")


@register("escalate_decline", GATE_SQL + " SELECT e AS event_id, escalated, declined FROM s WHERE threshold = 0.8")
def escalate_decline(spark, sf_dir):
    found = gate_records(spark, sf_dir).withColumn("a", D.replay(F.col("check1"), F.col("check2"), F.col("tier"), 0.8))
    return found.select("event_id", "a.escalated", "a.declined")


@register(
    "gate_summary",
    GATE_SQL
    + " SELECT threshold, "
    + ", ".join(f"round(coalesce(avg({f}::INT) FILTER (kind = '{k}'), 0), 9) AS {n}" for k, f, n in (("gold", "blocked", "gold_blocked"), ("off_topic", "blocked", "off_topic_caught"), ("gold", "declined", "gold_declined"), ("not_covered", "declined", "not_covered_declined"), ("follow_up", "blocked", "follow_up_blocked"), ("follow_up", "declined", "follow_up_declined"), ("gold", "escalated", "gold_escalated")))
    + " FROM s GROUP BY threshold",
)
def gate_summary(spark, sf_dir):
    grid = evaluate.gate_summary(evaluate.sweep(gate_records(spark, sf_dir)))
    return grid.select("threshold", *[F.round(c, 9).alias(c) for c in grid.columns if c != "threshold"])


@register("ship_threshold", GATE_SQL + ", p AS (SELECT threshold, avg(declined::INT) AS r FROM s WHERE kind = 'gold' GROUP BY threshold) SELECT coalesce(min(threshold) FILTER (r <= 0.01)::VARCHAR, 'disable') AS threshold FROM p")
def ship_threshold(spark, sf_dir):
    return evaluate.ship_threshold(evaluate.sweep(gate_records(spark, sf_dir)), "declined")


@register("format_distribution", GATE_SQL + ' SELECT count(*) FILTER (f = 0) AS "table", count(*) FILTER (f = 1) AS list, count(*) FILTER (f = 2) AS prose, count(*) FILTER (f = 3) AS "none" FROM a')
def format_distribution(spark, sf_dir):
    return evaluate.format_distribution(gate_records(spark, sf_dir))


@register("call_budget", "SELECT event_id, running::BIGINT AS running FROM (SELECT event_id, sum(1 + event_id % 3) OVER (ORDER BY event_id) AS running FROM events) WHERE running <= 570")
def call_budget(spark, sf_dir):
    cases = read(spark, sf_dir, "events").select("event_id", (1 + F.col("event_id") % 3).alias("calls"))
    return evaluate.within_budget(cases, 570, "event_id").select("event_id", F.col("running").cast("long").alias("running"))


@register(
    "gold_hit_rate",
    BM25_SQL
    + f""", r AS (SELECT qid, chunk_id, {TOP} AS rank FROM sc), top AS (SELECT * FROM r WHERE rank <= 10),
    holds AS (SELECT item_id AS qid, min(doc_id) AS gold, any_value(item_id % 4) AS cat FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id),
    k AS (SELECT h.qid, d.lang AS game, 'c' || cat AS category, min(rank) AS rank FROM holds h JOIN documents d ON d.doc_id = h.gold LEFT JOIN top ON top.qid = h.qid AND top.chunk_id = h.gold GROUP BY ALL)
    SELECT game, category, count(*) AS n, count(rank)::BIGINT AS hits, round(avg((rank IS NOT NULL)::INT), 9) AS hit_rate, round(avg(rank), 9) AS mean_rank FROM k GROUP BY GROUPING SETS ((), (game), (category))""",
)
def gold_hit_rate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("game"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    where = containment.holds(spread(docs), items, "doc_id", "text", "qid", "passage").groupBy("qid").agg(F.min("doc_id").alias("gold"))
    gold = where.join(docs.select(F.col("doc_id").alias("gold"), "game"), "gold").select("qid", "game", F.concat(F.lit("c"), F.col("qid") % 4).alias("category"), F.concat(F.lit(BASE_URL), F.col("gold"), F.lit("/ ")).alias("source_url"), F.lit(None).cast("string").alias("source_title"))
    hits = lexical.search(documents_index(spark, sf_dir), benchmark_questions(spark, sf_dir), 10).select("qid", "rank", F.concat(F.lit(BASE_URL), F.col("chunk_id")).alias("url"), F.lit("").alias("title"))
    rates = evaluate.hit_rates(evaluate.gold_hits(gold, hits))
    return rates.select("game", "category", "n", F.col("hits").cast("long").alias("hits"), F.round("hit_rate", 9).alias("hit_rate"), F.round("mean_rank", 9).alias("mean_rank"))


PIECES_SQL = r"""p AS (SELECT item_id * 3 AS piece, text AS passage FROM benchmark
  UNION ALL SELECT item_id * 3 + 1, regexp_extract(text, '[^\x20\x09-\x0D]+') FROM benchmark UNION ALL SELECT item_id * 3 + 2, substr(text, 3 + (item_id % 5)::INT, 4 + (item_id % 90)::INT) FROM benchmark)"""


@register("containment_join", f"WITH {PIECES_SQL} SELECT doc_id, piece FROM documents JOIN p ON contains(text, passage)")
def containment_join(spark, sf_dir):
    """Whole passages, their first words, and pieces that begin and end within words, against whole texts."""
    items = read(spark, sf_dir, "benchmark")
    piece = lambda n, c: items.select((F.col("item_id") * 3 + n).alias("piece"), c.alias("passage"))
    cut = F.substring("text", (3 + F.col("item_id") % 5).cast("int"), (4 + F.col("item_id") % 90).cast("int"))
    pieces = piece(0, F.col("text")).unionByName(piece(1, F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0))).unionByName(piece(2, cut))
    return containment.holds(spread(read(spark, sf_dir, "documents")), pieces, "doc_id", "text", "piece", "passage")


@register("tag_histogram", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def tag_histogram(spark, sf_dir):
    found = evaluate.tag_histogram(read(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.col("lang").alias("game")))
    return found.select(F.col("qid").alias("source"), F.explode("tags").alias("lang", "n"))


# -------------------------------------------------------------------------------------------- streams


@register(
    "rate_limiter",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT event_id, user_id, n, true AS allowed, [t] AS hits FROM o WHERE n = 1
      UNION ALL SELECT o.event_id, o.user_id, o.n, len(list_filter(w.hits, lambda h: h > o.t - 86400000000)) < 2,
        CASE WHEN len(list_filter(w.hits, lambda h: h > o.t - 86400000000)) < 2 THEN list_append(list_filter(w.hits, lambda h: h > o.t - 86400000000), o.t) ELSE list_filter(w.hits, lambda h: h > o.t - 86400000000) END
      FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
    SELECT event_id, allowed FROM w""",
)
def rate_limiter(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return stateful.limit(events, "user_id", "ts", 2, 86_400.0, "event_id").select("event_id", "allowed")


@register("rate_window_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_window_count(spark, sf_dir):
    window = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return read(spark, sf_dir, "events").select("event_id", F.count("*").over(window).alias("n"))


@register("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.windowed_counts(events, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("body_guard", "SELECT conv_id, min(turn) AS refused_at FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r > 500 GROUP BY conv_id")
def body_guard(spark, sf_dir):
    parts = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return stateful.body_guard(parts, "conv_id", "turn", "size", 500)


# ------------------------------------------------------------------------------------------- flagship


@register(
    "hybrid_retrieve",
    BM25_SQL
    + ", "
    + HASH_SQL.replace("b AS (", "qb AS (", 1).replace("nn AS (SELECT id, sqrt(sum(c * c)) AS n FROM b", "qn AS (SELECT id, sqrt(sum(c * c)) AS n FROM qb")
    + """, db AS (SELECT id, ('0x' || right(sha1(tok), 2))::INT AS bucket, count(*) AS c FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents) GROUP BY ALL),
    dn AS (SELECT id, sqrt(sum(c * c)) AS n FROM db GROUP BY id),
    di AS (SELECT q.id AS qid, d.id AS chunk_id, 1 - sum(q.c * d.c) / (any_value(x.n) * any_value(y.n)) AS distance FROM qb q JOIN db d USING (bucket) JOIN qn x ON x.id = q.id JOIN dn y ON y.id = d.id GROUP BY ALL),
    de AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), chunk_id) AS rank FROM di),
    le AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc),
    un AS (SELECT qid, 0 AS list_id, rank, chunk_id FROM de WHERE rank <= 40 UNION ALL SELECT qid, 1, rank, chunk_id FROM le WHERE rank <= 40),
    fu AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min((list_id, rank)) AS seen FROM un GROUP BY ALL),
    fr AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, seen) AS rank FROM fu)"""
    + rf""", ov AS (SELECT f.qid, f.chunk_id, f.rank, len(list_filter({WORDS.format('lower(d.text)')}, lambda x: list_contains({WORDS.format('lower(b.text)')}, x)))::DOUBLE AS score FROM fr f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.qid WHERE f.rank <= 30),
    re AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rank FROM ov)
    SELECT qid, chunk_id, score, rank::INT AS rank FROM re WHERE rank <= 8""",
)
def hybrid_retrieve(spark, sf_dir):
    """Dense and lexical candidates of every benchmark question over the documents, fused, reranked and capped."""
    from .plans import hybrid

    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    store = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pageid"), F.lit("text").alias("heading"), "text", F.array("lang").alias("games"), V.hash_embedding(F.col("text")).alias("embedding"))
    asked = benchmark_questions(spark, sf_dir).withColumn("game", F.lit(None).cast("string"))
    cfg = {"hybrid_candidates": 40, "rerank_candidates": 30, "rrf_k": 60, "starved_gap": 0.1, "top_k": 8, "max_chunks_per_page": 2}
    store = materialise(store, "store")  # vectors are made once
    hits = hybrid.retrieve(asked, store, documents_index(spark, sf_dir), cfg)
    return hits.select("qid", "chunk_id", F.col("_score").alias("score"), "rank")


@register("answer_all")
def answer_all(spark, sf_dir):
    """The whole question path over the conversations' user turns with the offline services: route, retrieve by depth, check,
    escalate once, prompt, answer. Services have no SQL form; tests hold the path against literal cases."""
    from .config import load_config
    from .plans import answer

    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    store = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("pageid"), F.concat(F.lit("doc "), "doc_id").alias("title"), F.col("lang").alias("game"), F.array("lang").alias("games"), F.lit("text").alias("heading"), F.concat(F.lit(BASE_URL), "doc_id").alias("url"), "text", V.hash_embedding(F.col("text")).alias("embedding"))
    store = materialise(store, "answer-store")
    turns = prompts.previous_questions(read(spark, sf_dir, "conversations"))
    # Questions that are too long are refused, with the reason in their row; their words are in the questions after them.
    refused = turns.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.when(F.length("text") > 2000, D.valid_request(F.col("text"), F.lit(None).cast("string"), F.lit(0), F.lit(0), LANGS.bases)).alias("error")).filter("error IS NOT NULL")
    turns = turns.filter(~F.coalesce(F.length("text") > 2000, F.lit(False)))
    asked = turns.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("question"), F.lit(None).cast("string").alias("game"), F.col("previous").alias("previous_question"))
    index = lexical.build_index(store, asked=lexical.query_terms(asked.select("qid", F.concat_ws(" ", "previous_question", "question").alias("question")), "qid", "question"))
    told = answer.answer_all(asked, store, index, load_config()).select("qid", "tier", "escalated", "declined", F.md5("answer").alias("answer_md5"), F.col("error"))
    none = F.lit(None).cast("string")
    return told.unionByName(refused.select("qid", none.alias("tier"), F.lit(False).alias("escalated"), F.lit(False).alias("declined"), none.alias("answer_md5"), "error"))
