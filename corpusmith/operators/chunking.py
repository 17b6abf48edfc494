"""Articles to chunks: infobox sentences, fact blocks and sections, cut into overlapping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def chunk_articles(articles: DataFrame, size: int = 600, overlap: int = 80) -> DataFrame:
    """One row per chunk of articles (schemas.ARTICLES), ids pageid-NNNN in the order infoboxes, fact blocks, sections.

    Every window carries its breadcrumb; an infobox sentence has its own, which only the windows after the first get
    again. Blank chunks are dropped and take no number. All of a page's chunks come from its one row, so nothing is
    shuffled."""
    game, title = F.coalesce("game", F.lit("")), F.coalesce("title", F.lit(""))
    none = F.array().cast("array<struct<heading: string, text: string>>")

    def cut(block, heading, crumb, own_crumb=False):
        pieces = T.windows(block, size, overlap)
        return F.transform(pieces, lambda piece, i: F.struct(heading.alias("heading"), (F.when(i == 0, piece).otherwise(F.concat(crumb, piece)) if own_crumb else F.concat(crumb, piece)).alias("text")))

    box = F.flatten(F.transform("infoboxes", lambda b: cut(T.render_fields(game, title, b["template"], b["fields"]), F.lit("infobox"), T.breadcrumb(game, title, F.lit("infobox")), True)))
    name = lambda b: F.coalesce(b["heading"], F.lit("infobox"))
    facts = F.flatten(F.transform("factblocks", lambda b: cut(F.array_join(b["lines"], " "), name(b), T.breadcrumb(game, title, name(b)))))
    parts = F.flatten(F.transform("sections", lambda s: cut(s["text"], s["heading"], T.breadcrumb(game, title, s["heading"]))))
    every = F.concat(*[F.coalesce(x, none) for x in (box, facts, parts)])
    rows = articles.select("pageid", "title", "game", "games", "url", F.posexplode(F.filter(every, lambda c: T.strip(c["text"]) != "")).alias("ordinal", "chunk"))
    return rows.select(F.format_string("%s-%04d", F.col("pageid").cast("string"), F.col("ordinal")).alias("chunk_id"), "pageid", "title", "game", "games", F.col("chunk.heading").alias("heading"), "url", F.col("chunk.text").alias("text"))


def chunk_texts(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Windows of plain texts: the other columns, ordinal (from 0) and text."""
    others = [c for c in docs.columns if c != text_col]
    return docs.select(*others, F.posexplode(T.windows(F.col(text_col), size, overlap)).alias("ordinal", "text"))


def is_infobox(heading, text):
    """By heading, or by the words '> infobox:' anywhere in the text."""
    return F.coalesce((F.lower(T.strip(heading)) == "infobox") | text.contains("> infobox:"), F.lit(False))
