"""Personal data by patterns, and terms that reveal it by corpus co-occurrence.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. Each distinct value is a protected
entity. A term t in the documents of an entity e discloses pointwise information PMI(t; e) = log2(n_te N / (n_t n_e)) of the
IC(e) = log2(N / n_e) bits that identify it (Sanchez and Batet's information-theoretic sanitisation), all four counts
being documents of the whole corpus and their whole texts. Every occurrence of a term above a share of IC(e) is
reported as a further span, with or without the entity beside it, and generalised to its kind in ``sanitise``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, materialise, release_worker_cache

KINDS = ("email", "ip", "card", "phone")
#: Document frequencies that a task holds before it sends them on.
FLUSH = 400_000
#: Bits of the filter of flagged terms (1 MB), and terms that a task remembers of it.
FILTER_BITS, KNOWN = 1 << 23, 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@domain, found from each @ outward: a start inside a run of local characters can only match
    at the @ that ends the run, so the leftmost match is the whole run since the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start; matches that fail their kind's test are dropped."""
    out = [("email", s, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _signed(data: str) -> int:
    value = xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """The distinct protected values of the spans, hashed."""
    values = {(kind, text[s:e].lower() if kind in ("email", "ip") else "".join(_DIGITS.findall(text[s:e]))) for kind, s, e in spans}
    return sorted({_signed(f"{kind}:{value}") for kind, value in values})


def term_of(word: str) -> str:
    """A word in lower case, the same wherever it stands (the lower form of a whole text depends on neighbours)."""
    return word.lower()


def _terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) over the whole text; terms that touch base spans are not terms."""
    inside = sorted((s, e) for _, s, e in spans)
    at = high = 0
    for m in _TERM.finditer(text):
        while at < len(inside) and inside[at][0] < m.end():
            high = max(high, inside[at][1])
            at += 1
        if m.start() >= high:
            yield term_of(m[0]), m.start(), m.end()


_SCAN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("term", pa.int64()), ("df", pa.int64())])
_SCAN_DDL = "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, terms array<long>, term long, df long"


def _texts(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string"))


def _scan(docs: DataFrame) -> DataFrame:
    """One pass over every text: a row per document, with its terms if it holds an entity, and rows (term, df) of each
    task's document frequencies."""

    def flush(df: Counter) -> Iterator[pa.RecordBatch]:
        terms, counts = [_signed(t) for t in df], list(df.values())
        empty = {f.name: pa.nulls(len(terms), f.type) for f in _SCAN}
        yield pa.RecordBatch.from_pydict(empty | {"term": pa.array(terms, pa.int64()), "df": pa.array(counts, pa.int64())}, schema=_SCAN)
        df.clear()

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        df: Counter = Counter()
        for frame in frames:
            rows = []
            for doc_id, key, text in zip(column(frame, "doc_id"), column(frame, "key"), column(frame, "text"), strict=True):
                text = text or ""
                spans = base_spans(text)
                terms = {t for t, _, _ in _terms(text, spans)} if spans else set(map(term_of, _TERM.findall(text)))
                n = Counter(k for k, _, _ in spans)
                rows.append({"doc_id": doc_id, "key": key, **{f"n_{k}": n[k] for k in KINDS}, "base": joined(spans), "entities": _entities(text, spans), "terms": sorted(map(_signed, terms)) if spans else [], "term": None, "df": None})
                df.update(terms)
            yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)
            if len(df) > FLUSH:
                yield from flush(df)
        if df:
            yield from flush(df)

    return _texts(docs).mapInArrow(run, _SCAN_DDL)


def _filter_of(flagged: DataFrame) -> bytes:
    """FILTER_BITS bits, of fixed size whatever the input: those of the flagged terms' hashes are set."""
    place = F.pmod("t", F.lit(FILTER_BITS))
    words = flagged.groupBy(F.shiftright(place, 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(t, 32)))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out.astype("<u4").tobytes()


def _told(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """doc_id, key, terms: all spans of flagged terms, in every document. The filter lets few other terms through, and
    the join drops those."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(flagged))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("t", pa.int64()), ("at", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        bits, known = shared.value, {}
        for frame in frames:
            rows = []
            for doc_id, key, text in zip(column(frame, "doc_id"), column(frame, "key"), column(frame, "text"), strict=True):
                found: dict[int, list[dict]] = {}
                maybe = {}
                for term in set(map(term_of, _TERM.findall(text or ""))):
                    if (t := known.get(term)) is None:
                        h = _signed(term)
                        place = h % FILTER_BITS
                        t = known[term] = (h,) if bits[place >> 3] >> (place & 7) & 1 else ()
                    if t:
                        maybe[term] = t[0]
                if maybe:
                    for term, start, end in _terms(text, base_spans(text)):
                        if term in maybe:
                            found.setdefault(maybe[term], []).append({"s": start, "e": end})
                rows += [{"doc_id": doc_id, "key": key, "t": t, "at": at} for t, at in found.items()]
                if len(known) > KNOWN:
                    known.clear()
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    held = _texts(docs).mapInArrow(run, "doc_id long, key long, t long, at array<struct<s: long, e: long>>").dropDuplicates(["doc_id", "key", "t"])
    told = held.join(flagged, "t").groupBy("doc_id", "key").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    return told.select(F.col("doc_id").alias("_cs_id"), F.col("key").alias("_cs_key"), F.array_join(F.transform("at", lambda x: F.concat(F.lit("term:"), x["s"], F.lit(":"), x["e"])), ",").alias("terms"))


def find_personal_data(docs: DataFrame, share: float = 0.9) -> DataFrame:
    """doc_id, key (hash of the text), n_email .. n_phone, base and spans (kind:start:end, comma-joined; terms last).

    A term is reported wherever it stands, in any document, if PMI(t; e) >= ``share`` * IC(e) for some entity e; one
    document that holds both is enough. Null texts are empty. Rows that repeat are counted and returned as often as
    they occur. Hashes of 64 bits stand for terms and entities in the counts.
    """
    scan = materialise(_scan(docs), "pii-scan")
    rows = scan.filter("term IS NULL").drop("term", "df")
    total = rows.count()
    entities = rows.select(F.explode("entities").alias("e"), F.col("terms").alias("ts"))
    n_e = entities.groupBy("e").agg(F.count("*").alias("n_e"))
    n_t = scan.filter("term IS NOT NULL").groupBy(F.col("term").alias("t")).agg(F.sum("df").alias("n_t"))
    # Dealt by the term once, which serves the count of pairs and the join with n_t. As n_e is at least 1, a pair can only
    # disclose if n_t <= n_te * N ** (1 - share); the few that are left meet n_e and the rule itself.
    pairs = entities.select("e", F.explode("ts").alias("t")).repartition("t").groupBy("t", "e").agg(F.count("*").alias("n_te"))
    pairs = pairs.join(n_t, "t").filter(F.col("n_t") <= F.col("n_te") * F.lit(1.001 * float(max(1, total)) ** max(0.0, 1 - share))).join(n_e, "e")
    pmi = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    flagged = pairs.filter(pmi >= F.lit(share) * F.log2(F.lit(float(total)) / F.col("n_e"))).filter(F.col("n_e") < total).select("t").distinct()
    told = _told(docs, materialise(flagged, "pii-flagged"))
    out = rows.drop("terms").join(told, (F.col("key") == F.col("_cs_key")) & F.col("doc_id").eqNullSafe(F.col("_cs_id")), "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "terms")
    return out.select("doc_id", "key", *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"))


def redact(text: str, spans: str) -> str:
    """Replace each span by its kind in brackets; of overlapping spans the one that starts first, then the longer."""
    cuts = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",")))
    out, at = [], 0
    for start, end, kind in cuts:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = -end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """The documents with every span generalised to its kind; n_chars follows the text. Documents without a span are
    returned as they are."""
    found = find_personal_data(docs, **params).filter("spans <> ''").select(F.col("doc_id").alias("_cs_id"), F.col("key").alias("_cs_key"), F.col("spans").alias("_cs_spans")).distinct()
    marked = docs.join(found, (F.xxhash64("text") == F.col("_cs_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_cs_id")), "left")
    change = F.udf(lambda text, spans: redact(text, spans) if spans else text, "string", useArrow=True)
    changed = marked.withColumn("text", change("text", "_cs_spans"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("_cs_spans").isNull(), F.col("n_chars")).otherwise(length))
    return changed.select(docs.columns)


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
