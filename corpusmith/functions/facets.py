"""Facets: one display label and a set of memberships per page, from a catalogue of codes.

The catalogue is a parameter; the default one holds codes only. Phrases (category wordings per code) name the titles
of a particular wiki and are given by its user.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base codes, variant codes with the base they fold into, and the episodes under the umbrella label.
BASES = ("XC1", "XC2", "XC3", "XCX", "XG", "XS1", "XS2", "XS3")
ALIASES = {"XC1DE": "XC1", "XC2T": "XC2", "XC3FR": "XC3", "XCDE": "XC1"}
UMBRELLA, EPISODES = "XS", ("XS1", "XS2", "XS3")
EVERY = "series"


@dataclass(frozen=True)
class Catalogue:
    bases: Sequence[str] = BASES
    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))
    umbrella: str = UMBRELLA
    episodes: Sequence[str] = EPISODES
    every: str = EVERY
    #: (Java pattern, code), the most specific first; patterns ignore case.
    phrases: Sequence[tuple[str, str]] = ()


DEFAULT = Catalogue()


def _array(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def canonical(token: Column, cat: Catalogue = DEFAULT) -> Column:
    """The base code of a raw token (variants folded), or null."""
    code = F.upper(F.trim(token))
    folded = reduce(lambda c, pair: c.when(code == pair[0], pair[1]), cat.aliases.items(), F.when(F.lit(False), "")).otherwise(code)
    return F.when(folded.isin(list(cat.bases)), folded)


def _first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), 0)


def name_code(name: Column, cat: Catalogue = DEFAULT) -> Column:
    """The code that one of a template name's words is, the first such."""
    return _first(F.transform(F.split(F.trim(name), r"\s+"), lambda t: canonical(t, cat)))


def phrase_code(text: Column, cat: Catalogue = DEFAULT) -> Column:
    if not cat.phrases:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(text.rlike(f"(?i){pattern}"), code) for pattern, code in cat.phrases])


def structured_name(name: Column) -> Column:
    """Template names that tag a page: infoboxes and '... data' or '... stats'."""
    low = F.lower(name)
    return low.contains("infobox") | low.endswith(" data") | low.endswith(" stats")


def structured_template(name: Column) -> Column:
    """Template names whose fields are extracted: infoboxes and '... data'."""
    low = F.lower(name)
    return low.contains("infobox") | low.endswith(" data")


def umbrella_token(token: Column, cat: Catalogue = DEFAULT) -> Column:
    """The umbrella code itself, or a combination of its episodes such as XS1&2."""
    return F.upper(F.replace(F.trim(token), F.lit(" "), F.lit(""))).rlike(rf"^{cat.umbrella}([1-3](&[1-3])+)?$")


def generic_marker(name: Column, cat: Catalogue = DEFAULT) -> Column:
    """A template that names the umbrella and no single episode."""
    up, u = F.upper(F.trim(name)), cat.umbrella
    return (up == u) | up.startswith(f"{u}1&") | up.startswith(f"{u}2&") | (up == f"{u}&") | F.lower(F.trim(name)).startswith(f"articleicon/{u.lower()}")


def _parenthesised(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))


def template_names(wikitext: Column) -> Column:
    return F.transform(F.regexp_extract_all(wikitext, F.lit(r"\{\{\s*([^|{}\n]+)"), F.lit(1)), F.trim)


def categories(wikitext: Column) -> Column:
    return F.regexp_extract_all(wikitext, F.lit(r"(?i)\[\[\s*Category\s*:\s*([^\]|\n]+)"), F.lit(1))


def _category_codes(wikitext: Column, cat: Catalogue) -> Column:
    """The code of each category that has one, in document order: its last parenthesised code, else its phrase."""

    def one(text: Column) -> Column:
        codes = F.filter(F.transform(_parenthesised(text), lambda t: canonical(t, cat)), lambda c: c.isNotNull())
        return F.coalesce(F.try_element_at(codes, F.lit(-1)), phrase_code(text, cat))

    return F.filter(F.transform(categories(wikitext), one), lambda c: c.isNotNull())


def _codes(names: Column, cat: Catalogue) -> Column:
    return F.array_distinct(F.filter(F.transform(names, lambda n: name_code(n, cat)), lambda c: c.isNotNull()))


def suffix_memberships(title: Column, cat: Catalogue = DEFAULT) -> Column:
    """Codes that the title's parentheses name; the umbrella names all its episodes, a combination those it lists."""

    def one(token: Column) -> Column:
        up = F.upper(F.replace(F.trim(token), F.lit(" "), F.lit("")))
        digits = F.transform(F.regexp_extract_all(up, F.lit("[1-3]"), F.lit(0)), lambda d: F.concat(F.lit(cat.umbrella), d))
        code = canonical(token, cat)
        return F.when(code.isNotNull(), F.array(code)).when(up == cat.umbrella, _array(cat.episodes)).when(umbrella_token(token, cat), digits).otherwise(_array([]))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(_parenthesised(title), one))))


def _lone_template(wikitext: Column, cat: Catalogue) -> Column:
    names = template_names(wikitext)
    codes = _codes(names, cat)
    return F.when((F.size(codes) == 1) & ~F.exists(names, lambda n: generic_marker(n, cat)), F.get(codes, 0))


def derive_label(title: Column, wikitext: Column, cat: Catalogue = DEFAULT) -> Column:
    """The one display label: a title suffix; else the only code of the structured templates; else the categories (of
    a page with an infobox the first, unless two episodes make it the umbrella's); else a lone template; else all."""
    tokens = _parenthesised(title)
    suffix = _first(F.transform(tokens, lambda t: canonical(t, cat)))
    wide = F.exists(tokens, lambda t: umbrella_token(t, cat))
    names = template_names(wikitext)
    structured = _codes(F.filter(names, structured_name), cat)
    cats = _category_codes(wikitext, cat)
    kinds = F.array_distinct(cats)
    only_episodes = F.size(F.array_except(kinds, _array(cat.episodes))) == 0
    several = F.when(only_episodes, cat.umbrella).otherwise(cat.every)
    infobox = F.exists(names, lambda n: F.lower(n).contains("infobox"))
    return (
        F.when(suffix.isNotNull(), suffix)
        .when(wide, cat.umbrella)
        .when(wikitext.isNull() | (wikitext == ""), cat.every)
        .when(F.size(structured) == 1, F.get(structured, 0))
        .when(infobox & (F.size(F.array_intersect(kinds, _array(cat.episodes))) >= 2), several)
        .when(infobox & (F.size(cats) > 0), F.get(cats, 0))
        .when(F.size(kinds) == 1, F.get(kinds, 0))
        .when(F.size(kinds) >= 2, several)
        .otherwise(F.coalesce(_lone_template(wikitext, cat), F.lit(cat.every)))
    )


def derive_memberships(title: Column, wikitext: Column, cat: Catalogue = DEFAULT) -> Column:
    """All codes a page belongs to, sorted; empty means every one."""
    suffix = suffix_memberships(title, cat)
    text = F.coalesce(wikitext, F.lit(""))
    found = F.array_distinct(F.concat(_codes(F.filter(template_names(text), structured_name), cat), _category_codes(text, cat)))
    lone = _lone_template(text, cat)
    other = F.when(F.size(found) > 0, F.array_sort(found)).when(lone.isNotNull(), F.array(lone)).otherwise(_array([]))
    return F.when(F.size(suffix) > 0, suffix).otherwise(other)


def fallback_memberships(label: Column, cat: Catalogue = DEFAULT) -> Column:
    """Memberships of a page that carries only a label."""
    return F.when(label == cat.umbrella, _array(sorted(cat.episodes))).when(label.isin(list(cat.bases)), F.array(label)).otherwise(_array(sorted(cat.bases)))


def memberships(games: Column, label: Column, cat: Catalogue = DEFAULT) -> Column:
    """The memberships to filter by: the set, or where it is empty or null the label's."""
    return F.when(F.coalesce(F.size(games), F.lit(0)) > 0, F.array_sort(games)).otherwise(fallback_memberships(label, cat))


def flags(games: Column, cat: Catalogue = DEFAULT) -> dict[str, Column]:
    """One boolean column per base code; an empty set is a member of all."""
    empty = F.coalesce(F.size(games), F.lit(0)) <= 0
    return {f"g_{code}": empty | F.array_contains(games, code) for code in cat.bases}


def filter_code(game: str | None, cat: Catalogue = DEFAULT) -> str | None:
    """The code that a filter restricts to: only base codes restrict."""
    return game if game in cat.bases else None


def facet_condition(games: Column, game: str | None, cat: Catalogue = DEFAULT) -> Column:
    code = filter_code(game, cat)
    return F.lit(True) if code is None else F.array_contains(games, code)


def foreign(tags: Column, game: Column, bases: Sequence[str]) -> Column:
    """Base codes among ``tags`` other than the filter's own."""
    return F.array_sort(F.array_except(F.array_intersect(tags, _array(bases)), F.array(game)))


def title_hint(title: Column, cat: Catalogue = DEFAULT) -> Column:
    """The code in a title's parentheses, if any."""
    return _first(F.transform(_parenthesised(title), lambda t: canonical(t, cat)))


def main_hit(terms: Column, titles: Column) -> Column:
    """Whether one of the titles holds every term; a question without terms has no main hit."""
    return (F.size(terms) > 0) & F.exists(titles, lambda t: F.forall(terms, lambda w: F.lower(t).contains(w)))


def subject_terms(question: Column) -> Column:
    """Words over two letters of what a who or what question asks about."""
    found = F.regexp_extract(F.lower(question), r"^\s*(?:who|what)(?:\s+(?:is|are|was|were)|'s)\s+(?:the\s+|a\s+|an\s+)?([^?]*)", 1)
    return F.filter(F.regexp_extract_all(found, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) > 2)
