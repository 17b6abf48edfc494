"""Wikitext to articles: a brace scanner for templates, sections, links, and drop rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions import facets
from ..functions.text import strip, title_url

_REF_SELF = re.compile(r"<ref[^>]*?/>", re.I)
_REF_PAIR = re.compile(r"<ref[^>]*?>.*?</ref>", re.I | re.S)
_HEADING = re.compile(r"^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", re.M)
_INNERMOST = re.compile(r"\{\{((?:(?!\{\{|\}\}).)*)\}\}", re.S)
_ASIDE = re.compile("\0([0-9]+)\1")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_FILE = re.compile(r"\s*(?:category|file|image)\s*:", re.I)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BRACES = re.compile(r"\{\{|\}\}")
_BRACKETS = re.compile(r"\{\{|\[\[|\}\}|\]\]|\|")
_EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\]]+(?:\s+([^\]]*))?\]")


def strip_refs(text: Column) -> Column:
    """Self-closing references, then paired ones with what they hold, are taken out."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)<ref[^>]*?/>", ""), r"(?is)<ref[^>]*?>.*?</ref>", "")


@dataclass
class Template:
    start: int
    end: int
    name: str
    params: list[tuple[str | None, str]]  # key or None, value


def _split_top(text: str) -> list[str]:
    """Split at bars outside nested braces and brackets."""
    out, depth, last = [], 0, 0
    for m in _BRACKETS.finditer(text):
        if m[0] in ("{{", "[["):
            depth += 1
        elif m[0] != "|":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(text[last : m.start()])
            last = m.end()
    return [*out, text[last:]]


def templates(text: str) -> list[Template]:
    """All templates, outer ones before those inside them, in order of their opening braces."""
    opened, found = [], []
    for m in _BRACES.finditer(text):
        i = m.start()
        if m[0] == "{{":
            opened.append(i)
        elif opened:
            start = opened.pop()
            head, *rest = _split_top(text[start + 2 : i])
            params = []
            for part in rest:
                key, eq, value = part.partition("=")
                named = eq and "{{" not in key and "[[" not in key
                params.append((key.strip(), value) if named else (None, part))
            found.append(Template(start, i + 2, head.strip(), params))
    return sorted(found, key=lambda t: t.start)


def _restored(text: str, aside: list[str]) -> str:
    """The text with what was put aside in its places; an entry may hold earlier ones."""
    whole: list[str] = []
    for part in aside:
        whole.append(_ASIDE.sub(lambda m: whole[int(m[1])], part))  # noqa: B023
    return _ASIDE.sub(lambda m: whole[int(m[1])], text)


def render_links(text: str, codes: Iterable[str]) -> str:
    """Link shortcuts {{CODE|target|shown}} become what they show, inner ones first: every round settles all templates
    that hold no other, those that are no shortcuts being put aside until the end."""
    codes, aside = set(codes), []

    def settle(m: re.Match) -> str:
        head, *rest = _split_top(m[1])
        if head.strip() not in codes:
            aside.append(m[0])
            return f"\0{len(aside) - 1}\1"
        shown = [part for part in rest if "=" not in part or "[[" in part.partition("=")[0]]
        return plain(shown[1] if len(shown) >= 2 else shown[0] if shown else "").strip()

    n = 1
    text = text.replace("\0", "").replace("\1", "")
    while n:
        text, n = _INNERMOST.subn(settle, text)
    return _restored(text, aside)


def _outer(text: str) -> list[tuple[int, int]]:
    """Where the outermost templates begin and end."""
    opened, found = [], []
    for m in _BRACES.finditer(text):
        if m[0] == "{{":
            opened.append(m.start())
        elif opened:
            start = opened.pop()
            while found and found[-1][0] > start:  # those inside it
                found.pop()
            found.append((start, m.end()))
    return found


def _drop_tables(text: str) -> str:
    out, depth, last = [], 0, 0
    for m in re.finditer(r"^[ \t:]*\{\||^[ \t]*\|\}", text, re.M):
        if m[0].strip(" \t:").startswith("{|"):
            if not depth:
                out.append(text[last : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            last = m.end()
    return "".join([*out, text[last:]]) if not depth else "".join(out)


def plain(text: str) -> str:
    """Wikitext without markup: templates, tables, comments, files and categories go; links keep what they show."""
    if "<!--" in text:
        text = _COMMENT.sub("", text)
    if "{{" in text:
        out, end = [], 0
        for start, after in _outer(text):
            out.append(text[end:start])
            end = after
        text = "".join([*out, text[end:]])
    if "{|" in text:
        text = _drop_tables(text)
    n = "[[" in text
    while n:  # a round for each level of links inside links
        text, n = _LINK.subn(lambda m: "" if _FILE.match(m[1]) else m[1].rpartition("|")[2], text)
    if "[" in text:
        text = _EXTERNAL.sub(lambda m: m[1] or "", text)
    if "''" in text:
        text = re.sub(r"'{2,5}", "", text)
    if "<" in text:
        text = _TAG.sub("", text)
    return _HEADING.sub(lambda m: m[2], text) if "==" in text else text


def infoboxes(text: str) -> list[dict]:
    """Templates that carry fields, with their fields in order; positional ones are named 1, 2, ..."""
    out = []
    for t in templates(text):
        low = t.name.lower()
        if "infobox" in low or low.endswith(" data"):
            fields: dict[str, str] = {}
            n = 0
            for key, value in t.params:
                if key is None:
                    n += 1
                    key = str(n)
                key = plain(key).strip()
                if key:
                    fields[key] = plain(value).strip()
            out.append({"template": t.name, "fields": [{"k": k, "v": v} for k, v in fields.items()]})
    return out


def sections(text: str) -> list[dict]:
    """The lead as Introduction and every level-2 section with its subsections inside; blank ones are dropped."""
    cuts = [m for m in _HEADING.finditer(text) if len(m[1]) == 2]
    parts = [("Introduction", text[: cuts[0].start()] if cuts else text)]
    parts += [(plain(m[2]).strip(), text[m.end() : nxt.start() if nxt else len(text)]) for m, nxt in zip_longest(cuts, cuts[1:])]
    out = []
    for heading, body in parts:
        body = re.sub(r"\n{3,}", "\n\n", plain(body).strip()).strip()
        if body:
            out.append({"heading": heading, "text": body})
    return out


def dropped(text: Column, least: int = 50) -> Column:
    """Pages that are no articles: none or empty, redirects, stubs under ``least`` characters, disambiguations."""
    bare = strip(text)
    names = facets.template_names(F.coalesce(text, F.lit("")))
    return F.coalesce(text, F.lit("")).eqNullSafe("") | F.lower(bare).startswith("#redirect") | (F.length(bare) < least) | F.exists(names, lambda n: F.lower(n).contains("disambig"))


def parse_pages(pages: DataFrame, base_url: str, cat: facets.Catalogue = facets.DEFAULT, least: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """title, pageid, wikitext to articles (schemas.ARTICLES), beside the columns of ``keep``. Tags are column expressions on the raw text; only the
    brace scanner runs in Python, on the pages that are kept."""
    codes = [*cat.bases, *cat.aliases]
    clean = strip_refs(F.col("wikitext"))
    kept = pages.filter(~dropped(F.col("wikitext"), least)).select("title", "pageid", facets.derive_label(F.col("title"), F.col("wikitext"), cat).alias("game"), facets.derive_memberships(F.col("title"), F.col("wikitext"), cat).alias("games"), title_url(F.col("title"), base_url).alias("url"), clean.alias("wikitext"), *keep)
    more = "".join(f", {c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    found = {"infoboxes": "ARRAY<STRUCT<template: STRING, fields: ARRAY<STRUCT<k: STRING, v: STRING>>>>", "factblocks": "ARRAY<STRUCT<heading: STRING, lines: ARRAY<STRING>>>", "sections": "ARRAY<STRUCT<heading: STRING, text: STRING>>"}
    kinds = {name: to_arrow_type(_parse_datatype_string(kind)) for name, kind in found.items()}
    first = ["title", "pageid", "game", "games", "url"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = [render_links(t, codes) for t in frame.column("wikitext").to_pylist()]
            made = {"infoboxes": [infoboxes(t) for t in texts], "factblocks": [None] * len(texts), "sections": [sections(t) for t in texts]}
            columns = {c: frame.column(c) for c in first} | {c: pa.array(rows, kinds[c]) for c, rows in made.items()} | {c: frame.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(columns)

    return kept.withColumn("pageid", F.col("pageid").cast("long")).mapInArrow(run, "title STRING, pageid BIGINT, game STRING, games ARRAY<STRING>, url STRING, " + ", ".join(f"{c} {k}" for c, k in found.items()) + more)
