"""Text functions on columns. Blanks are the six ASCII ones unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+"

# Function words that a query drops while a content word remains.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "does", "for", "from", "had", "has", "have", "he",
    "her", "his", "how", "i", "in", "is", "it", "its", "of", "on", "or", "she", "that", "the", "their", "there",
    "they", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you",
]

# Readable labels of terse field keys; other keys are capitalised.
LABELS = {
    "lv": "Level", "lvl": "Level", "hp": "HP", "str": "STR", "agi": "AGI", "eth": "Ether", "dex": "DEX", "luck": "Luck",
    "exp": "EXP", "ap": "AP", "sp": "SP", "atk": "Attack", "def": "Defense", "recharge": "Recharge", "power": "Power",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, for use inside lambdas, where expressions are not shared."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens without stop words; all of them if nothing else is left."""
    found = tokens(text)
    rest = F.filter(found, lambda t: ~t.isin(STOP_WORDS))
    return F.when(F.size(rest) > 0, rest).otherwise(found)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))  # a pattern would look at every blank of the text


def collapse(text: Column) -> Column:
    """Words joined by single spaces."""
    return strip(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping word windows. A text that fits one window is returned stripped but otherwise as it is; longer ones
    are cut every ``size - overlap`` words and re-joined by single spaces, up to the window that reaches the end."""
    step, none = max(1, size - overlap), F.array().cast("array<string>")

    def cut(found: Column) -> Column:
        n = F.size(found)
        last = F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(found, i * step + 1, F.lit(size)), " "))
        return F.when(n == 0, none).when(n <= size, F.array(strip(text))).otherwise(pieces)

    return F.when(text.isNull(), none).otherwise(let(words(text), cut))


def breadcrumb(game: Column, title: Column, heading: Column) -> Column:
    return F.concat(F.lit("["), game, F.lit("] "), title, F.lit(" > "), heading, F.lit(": "))


def strip_breadcrumb(text: Column) -> Column:
    """What follows the first ' > ', wherever it stands; else the text, stripped."""
    at = F.instr(text, " > ")
    return F.when(at > 0, strip(F.substr(text, at + 3))).otherwise(strip(text))


def cut_words(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space within them (or hard, if there is none), with an ellipsis."""
    head = F.left(text, F.lit(limit))
    cut = F.rtrim(F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit("…")))


def opening(text: Column, limit: int) -> Column:
    """``cut_words`` of the collapsed text. Of a long text the beginning is collapsed first, which is enough where that
    leaves more than the limit."""
    begin = lambda t: let(collapse(F.left(t, F.lit(4 * limit))), lambda b: F.when(F.length(b) > limit, cut_words(b, limit)).otherwise(let(collapse(t), lambda c: cut_words(c, limit))))
    return let(text, begin)


def snippet(text: Column, limit: int = 200) -> Column:
    """A short preview without the breadcrumb in front."""
    bare = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"^\[[^\]]*\][^:]*:\s*", "")
    return opening(bare, limit)


def passage_body(text: Column, limit: int = 1500) -> Column:
    return opening(strip_breadcrumb(F.coalesce(text, F.lit(""))), limit)


def passage(title: Column, game: Column, text: Column, limit: int = 1500, body: Column | None = None) -> Column:
    """Title, facet and the beginning of the text, or a ``body`` that was made of it before."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" ("), F.coalesce(game, F.lit("")), F.lit("): "), passage_body(text, limit) if body is None else body)


def clip(line: Column, limit: int = 320) -> Column:
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(F.left(line, F.lit(limit)), r"[\x20\x09-\x0D]+$", ""), F.lit("…")))


def title_url(title: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


def normalise(text: Column) -> Column:
    """One space between words of any script's blanks, none before , . ; : ! ? ) ] or 's, none after ( or [; zero-width
    spaces go."""
    one = F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("​"), F.lit("")), r"(?U)\s+", " "))
    return F.regexp_replace(F.regexp_replace(one, r" +([,.;:!?)\]]|'s\b)", "$1"), r"([(\[]) +", "$1")


def label(key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    name = F.coalesce(key, F.lit(""))
    return F.coalesce(F.element_at(known, F.lower(strip(name))), F.concat(F.upper(F.left(name, F.lit(1))), F.lower(F.substr(name, F.lit(2)))))


def render_fields(game: Column, title: Column, template: Column, fields: Column) -> Column:
    """An infobox as a sentence: breadcrumb, template, then 'Label: value.' for each field that is not blank."""
    full = F.filter(fields, lambda f: strip(F.coalesce(f["v"], F.lit(""))) != "")
    parts = F.transform(full, lambda f: F.concat(label(f["k"]), F.lit(": "), f["v"], F.lit(".")))
    return F.concat(breadcrumb(game, title, F.lit("infobox")), F.array_join(F.concat(F.array(F.concat(template, F.lit("."))), parts), " "))


def scrub_paths(text: Column) -> Column:
    """Absolute Windows paths and POSIX paths of two or more segments become <path>."""
    windows_path = F.regexp_replace(text, r"(?<![A-Za-z0-9])[A-Za-z]:[\\/][^\s'\"<>|:*?]+", "<path>")
    return F.regexp_replace(windows_path, r"(?<![\w/.:])/(?:[\w.@+-]+/)+[\w.@+-]+", "<path>")


def host_name(host: Column) -> Column:
    """A Host header without its port, lower-cased; brackets of IPv6 stay."""
    low = F.lower(F.trim(host))
    return F.when(low.startswith("["), F.regexp_extract(low, r"^(\[[^\]]*\])", 1)).otherwise(F.regexp_extract(low, r"^([^:]*)", 1))


def client_key(forwarded: Column, peer: Column, trusted: Column) -> Column:
    """The first hop of a trusted X-Forwarded-For header, else the peer."""
    first = F.trim(F.get(F.split(forwarded, ","), 0))
    return F.coalesce(F.when(trusted, F.nullif(first, F.lit(""))), peer)


def retry_wait(header: Column, backoff: Column, most: int = 120) -> Column:
    """Seconds to wait: the Retry-After header where it is an integer, else the backoff; never above ``most``."""
    return F.least(F.coalesce(F.expr("cast(null as int)") if header is None else F.when(F.trim(header).rlike(r"^[+-]?\d{1,9}$"), F.trim(header).cast("int")), backoff), F.lit(most))


def sse_encode(kind: Column, payload: Column) -> Column:
    """One server-sent event; ``payload`` is JSON text."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))


def sse_parse(block: Column) -> Column:
    """STRUCT<kind, payload> of an event block; kind 'message' where none is named, data lines joined."""
    lines = F.split(block, "\n")
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, r"^data: ?", ""))
    kind = F.regexp_extract(block, r"(?m)^event: ?(.*)$", 1)
    return F.struct(F.when(kind == "", "message").otherwise(F.trim(kind)).alias("kind"), F.array_join(data, "\n").alias("payload"))


def citations(answer: Column, n_sources: Column) -> Column:
    """Numbers cited as [n] that name a source, in order of first use."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= n_sources)))


def safe_href(url: Column) -> Column:
    """The URL if it is http(s), else '#'."""
    return F.when(F.trim(url).rlike(r"(?i)^https?://"), F.trim(url)).otherwise(F.lit("#"))


def source_name(url: Column) -> Column:
    """A page's name from its URL: the last path segment, underscores as spaces, %-escapes undone."""
    tail = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1)
    spaced = F.replace(tail, F.lit("_"), F.lit(" "))
    return F.coalesce(F.try_url_decode(F.replace(spaced, F.lit("+"), F.lit("%2B"))), spaced)
