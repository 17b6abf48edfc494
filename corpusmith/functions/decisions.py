"""Routing and gating decisions over parsed replies. NaN never meets a threshold, unlike in Spark's own ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("fast", "thinking", "scholar")
TOPICS = ("on_topic", "off_topic")
FORMATS = ("table", "list", "prose")
COVERAGE = ("answered", "partial", "not_covered")
MAX_STATE_CHARS = 2000


def safe_double(text: Column, default: Column) -> Column:
    """A finite number, or the default."""
    value = text.try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), default).otherwise(value)


def at_least(value: Column, threshold: Column | float) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")) & (value >= threshold), F.lit(False))


def choice(reply: Column, question: str, allowed: Sequence[str]) -> Column:
    """STRUCT<choice, confidence> of one question in a reply's JSON ``answers``. A missing or unknown choice gives nulls;
    a missing confidence is 0, an unreadable one NaN."""
    picked = F.get_json_object(reply, f"$.{question}.choice")
    raw = F.get_json_object(reply, f"$.{question}.confidence")
    ok = picked.isin(list(allowed))
    confidence = F.when(raw.isNull(), F.lit(0.0)).otherwise(safe_double(raw, F.lit(float("nan"))))
    return F.struct(F.when(ok, picked).alias("choice"), F.when(ok, confidence).alias("confidence"))


def topic(answer: Column, off_topic: float = 0.8) -> Column:
    return F.when((answer["choice"] == "off_topic") & at_least(answer["confidence"], off_topic), "off_topic").when(answer["choice"] == TOPICS[0], TOPICS[0])


def answer_format(answer: Column, least: float = 0.5) -> Column:
    return F.when(answer["choice"].isNotNull() & at_least(answer["confidence"], least), answer["choice"])


def route(reply: Column, forced: Column, available: Column, fallback: str = "thinking", least: float = 0.5, off_topic: float = 0.8) -> Column:
    """STRUCT<tier, source, confidence, topic, format>: a forced tier is an override; a usable reply decides; else the
    fallback, which keeps the reply's confidence where it had one."""
    tier, said = choice(reply, "tier", TIERS), available & reply.isNotNull()
    own = F.when(forced.isin(list(TIERS)), forced)
    usable = said & tier["choice"].isNotNull() & at_least(tier["confidence"], least)
    source = F.when(own.isNotNull(), "override").when(usable, "service").otherwise("fallback")
    return F.struct(
        F.coalesce(own, F.when(usable, tier["choice"]), F.lit(fallback)).alias("tier"),
        source.alias("source"),
        F.when(own.isNull() & said, tier["confidence"]).alias("confidence"),
        F.when(said, topic(choice(reply, "topic", TOPICS), off_topic)).alias("topic"),
        F.when(said, answer_format(choice(reply, "format", FORMATS), least)).alias("format"),
    )


def not_covered(verdict: Column, confidence: Column, threshold: Column | float = 0.8) -> Column:
    return F.coalesce(verdict == "not_covered", F.lit(False)) & at_least(confidence, threshold)


def check_eligible(enabled: Column, source: Column, confidence: Column, key: Column) -> Column:
    """Whether the coverage check runs: enabled, with a key, not for overrides, nor after a reply that never came."""
    return F.coalesce(enabled & key & (source != "override") & ~((source == "fallback") & confidence.isNull()), F.lit(False))


def replay(check1: Column, check2: Column, tier: Column, threshold: Column | float) -> Column:
    """STRUCT<escalated, declined> at a threshold: a first not-covered verdict escalates unless the tier is deepest;
    what is still not covered is declined."""
    first = not_covered(check1["verdict"], check1["confidence"], threshold)
    deepest = tier == TIERS[-1]
    escalated = first & ~deepest
    second = not_covered(check2["verdict"], check2["confidence"], threshold)
    return F.struct(escalated.alias("escalated"), F.when(escalated, second).otherwise(first & deepest).alias("declined"))


def request_state(question: Column, previous: Column, game: Column) -> Column:
    """The JSON sent to a decision service: both questions trimmed."""
    return F.to_json(F.struct(F.left(question, F.lit(MAX_STATE_CHARS)).alias("question"), F.left(F.trim(previous), F.lit(MAX_STATE_CHARS)).alias("previous_question"), game.alias("game")))


def allowed_url(url: Column, host: str) -> Column:
    """https, and the named host or one under it."""
    name = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & ((name == host) | name.endswith(f".{host}")), F.lit(False))


def valid_request(question: Column, game: Column, turns: Column, longest_answer: Column, bases: Sequence[str]) -> Column:
    """The first reason why a request is refused, or null."""
    return (
        F.when(question.isNull() | (F.trim(question) == ""), "empty question")
        .when(F.length(question) > 2000, "question too long")
        .when(game.isNotNull() & (game != "") & ~game.isin(list(bases)), "unknown facet")
        .when(turns > 6, "too many turns")
        .when(longest_answer > 20000, "answer too long")
    )
