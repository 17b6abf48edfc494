"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame operations only).

The words of a source, its documents in a shuffled but fixed order, form one stream cut into equal-token blocks.
Slot k of the schedule has the golden-ratio point frac(k * phi), and the sources' targets cut the unit interval: a slot
goes to the source in whose part its point falls, so in every run of slots each source is within a logarithm of its
share. The slots of a source are ranked, and rank r takes block r of that source's stream, going around the stream
again when it ends. There are as many points as blocks needed; a source that the points leave short by its discrepancy
(or whose part is too small for any) has its last blocks in slots after them, one of each source in turn, and slots
beyond a source's need are void. The last slot of a source is trimmed so that its words meet its target.

Nothing is sorted or ranked in one task per source, nor over all sources: running sums and ranks are taken in buckets
or ranges, and their totals are summed in turn, so one source may hold any share of all rows, and sources may be as
many as rows. Rows that are equal are one entry of the stream with a number of copies.
"""

from __future__ import annotations

from decimal import getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Sources fewer than this are broadcast (a row is under 200 bytes); more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Golden ratio less one, and the fractional part of 2**20 times it: two-step products keep 2**60 points exact to 1e-9.
_PHI = (getcontext().create_decimal(5).sqrt() - 1) / 2
PHI, PHI_STEP = float(_PHI), float(_PHI * 2**20 % 1)
#: Rows of a source that share a bucket, about: no window holds more, whatever the source's share.
BUCKET_ROWS = 1_000
SLOT_BUCKET = 1 << 16
#: Copies of a row that one step lays out.
COPIES = 1_000
#: Hex digits of a document's hash that choose its bucket.
HASH_DIGITS = 8


def running(df: DataFrame, order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with the sums of ``sums`` over the rows before each, in ``order`` (which must tell all rows apart): sums in
    ranges of the rows, and the sums of the ranges before, of which there are as many as shuffle partitions."""
    keep = [c for c in df.columns]
    parts = materialise(df.repartitionByRange(*order).withColumn("_cs_range", F.spark_partition_id()), name)
    totals = parts.groupBy("_cs_range").agg(*[F.sum(v).alias(f"_cs_{k}") for k, v in sums.items()])
    before = Window.orderBy("_cs_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_cs_range", *[F.coalesce(F.sum(f"_cs_{k}").over(before), F.lit(0)).alias(f"_cs_{k}") for k in sums])
    inside = Window.partitionBy("_cs_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumns({f"_cs_in_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    return found.join(F.broadcast(totals), "_cs_range").select(*keep, *[(F.col(f"_cs_{k}") + F.col(f"_cs_in_{k}")).alias(k) for k in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """One row per source with its size and target words.

    ``sized`` has source and size. Sources by code point, null last, weigh ``weights`` in turn. Targets sum to
    ``share`` of all sizes and stop at ``repeat`` times their source's size; the excess is reshared by weight
    until none is above. In order of size per weight, capped sources come first, so the final level is the largest
    of (total - caps before) / (weight not before), and a target is the smaller of cap and level times weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    per = running(per, [F.col("source").isNull(), F.col("source")], {"sid": F.lit(1).cast("long")}, "mix-names")
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int")).cast("long"))
    per = running(per, [F.col("source_size") * repeat / F.col("w"), F.col("sid")], {"caps": F.col("source_size") * repeat, "weights": F.col("w")}, "mix-levels")
    size, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    rest, rest_w = F.lit(float(size) * float(share)) - F.col("caps"), F.lit(weight) - F.col("weights")
    level = per.agg(F.max_by(F.struct(rest.alias("rest"), rest_w.cast("long").alias("rest_w")), rest / rest_w)).first()[0] or (0.0, 1)
    target = F.least((F.col("source_size") * repeat).cast("double"), F.lit(float(level[0])) * F.col("w") / F.lit(int(level[1])))
    return per.select("source", "sid", "source_size", "n_rows", F.greatest(target, F.lit(0.0)).alias("target"))


def _attach(left: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Source columns by sid or by source; the side is broadcast only when it was counted to be small."""
    right = F.broadcast(sources) if few else sources
    if "sid" in left.columns:
        return left.join(right, "sid")
    right = right.withColumnRenamed("source", "source_key")
    return left.join(right, F.col("source").eqNullSafe(F.col("source_key"))).drop("source_key")


def _size_and_key(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, source, size and ``digest``, which orders the stream; ``whole``: rows are told apart by all their columns."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    if whole:
        digest = F.concat(digest, F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])), 16, "0"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), digest.alias("digest"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeat: int = 2, block: int = 8192, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The placed documents, their block pieces, and the schedule of slots.

    placed: doc_id, size, digest, source, sid, source_size, target and first (stream position), a row for each copy.
    pieces: sid, block, digest, doc_id, first, size, and the stream range [from_word, to_word) of the document in it.
    slots:  slot, sid, rank, pass, block, limit (stream position in this pass where the source's target is met).
    Nulls: a null text has no words; a null source is a source; a null doc_id hashes as the empty text. Rows that
    repeat are placed one by one. An empty table gives empty frames.
    """
    spark = docs.sparkSession
    sized = materialise(_size_and_key(docs, whole), "mix-sized")
    sources = materialise(source_targets(sized, weights, share, repeat), "mix-sources")
    n_sources = sources.count()
    few = n_sources <= BROADCAST_SOURCES

    # The shuffled stream of each source: running sums inside hash buckets, plus the sums of the buckets before.
    entries = sized.groupBy("source", "digest", "doc_id", "size").agg(F.count("*").alias("copies"))
    place = F.conv(F.substring("digest", 1, HASH_DIGITS), 16, 10).cast("long")
    n_buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS)
    bucketed = _attach(entries, sources, few).withColumn("bucket", F.floor(place * n_buckets / 16**HASH_DIGITS).cast("long"))
    words = F.col("size") * F.col("copies")
    totals = bucketed.groupBy("sid", "bucket").agg(F.sum(words).alias("bucket_size"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_first"))
    inside = Window.partitionBy("sid", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = bucketed.withColumn("last", F.sum(words).over(inside)).join(totals, ["sid", "bucket"])
    laid = laid.select("doc_id", "size", "digest", "copies", "source", "sid", "source_size", "target", (F.col("bucket_first") + F.col("last") - words).alias("begin"))
    # Copies lie one after another; many of them are laid out by several tasks.
    lots = laid.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("sid", "begin", "digest", "lot")
    nth = F.explode(F.sequence(F.col("lot") * COPIES, F.least(F.col("lot") * COPIES + (COPIES - 1), F.col("copies") - 1)))
    placed = lots.withColumn("nth", nth).withColumn("first", F.col("begin") + F.col("nth") * F.col("size")).drop("lot", "nth", "copies", "begin")
    placed = materialise(placed, "mix-placed")

    first, end = F.col("first"), F.col("first") + F.col("size")
    pieces = (
        placed.filter("size > 0")
        .withColumn("block", F.explode(F.sequence((first / block).cast("long"), ((end - 1) / block).cast("long"))))
        .select("sid", "block", "digest", "doc_id", "first", "size", F.greatest(first, F.col("block") * block).alias("from_word"), F.least(end, (F.col("block") + 1) * block).alias("to_word"))
    )

    # Slots that each source needs, and the points that deal them.
    goal, size = F.floor("target").cast("long"), F.col("source_size")
    need = sources.filter("source_size > 0").select("sid", "source_size", goal.alias("goal"), F.ceil(size / block).cast("long").alias("n_blocks"))
    need = need.withColumn("passes", F.floor(F.col("goal") / F.col("source_size")).cast("long"))
    need = need.withColumn("need", F.col("passes") * F.col("n_blocks") + F.ceil((F.col("goal") - F.col("passes") * F.col("source_size")) / block).cast("long"))
    need = running(need.drop("passes"), [F.col("sid")], {"goals": F.col("goal")}, "mix-need")
    n_slots, all_goals = need.agg(F.coalesce(F.sum("need"), F.lit(0)), F.coalesce(F.sum("goal"), F.lit(0))).first()
    per_goal = F.lit(float(max(1, all_goals)))
    share_of = need.withColumn("lower", F.col("goals") / per_goal).withColumn("upper", (F.col("goals") + F.col("goal")) / per_goal)
    cells = 4 * max(1, n_sources)
    share_of = share_of.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") * cells), F.least(F.floor(F.col("upper") * cells), F.lit(cells - 1)))))
    k = F.col("slot")
    point = F.shiftright(k, 20) * F.lit(PHI_STEP) + F.pmod(k, F.lit(1 << 20)) * F.lit(PHI)
    points = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * cells))
    dealt = points.join(F.broadcast(share_of) if few else share_of, "cell").filter("u >= lower AND u < upper")
    dealt = dealt.select("slot", "sid", "source_size", "goal", "n_blocks", "need", F.floor(k / SLOT_BUCKET).alias("part"))
    per_part = dealt.groupBy("sid", "part").agg(F.count("*").alias("n_part"))
    earlier = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    had = per_part.groupBy("sid").agg(F.sum("n_part").alias("had"))
    per_part = per_part.select("sid", "part", F.coalesce(F.sum("n_part").over(earlier), F.lit(0)).alias("before"))
    ranked = dealt.join(per_part, ["sid", "part"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1)
    shared = ["slot", "sid", "source_size", "goal", "n_blocks", "rank"]
    late = need.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < need")
    late = late.withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("need") - 1))).withColumn("slot", n_slots + (F.col("rank") - F.col("had")) * n_sources + F.col("sid"))
    slots = ranked.filter("rank < need").select(*shared).unionByName(late.select(*shared))
    turn = F.floor(F.col("rank") / F.col("n_blocks")).cast("long")
    slots = slots.select("slot", "sid", "rank", turn.alias("pass"), F.pmod("rank", "n_blocks").alias("block"), (F.col("goal") - turn * F.col("source_size")).cast("long").alias("limit"))
    return placed, pieces, slots


def _taken(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """Pieces with the slot that takes them and the words [from_word, upto) that it takes."""
    upto = F.least("to_word", "limit")
    return pieces.join(slots, ["sid", "block"]).withColumn("upto", upto).filter("upto > from_word")


def mixed_pieces(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: slot, sid, pass, block, doc_id and the words [word_from, word_to) of the document, in slot order
    when sorted by (slot, word position)."""
    _, pieces, slots = plan_mix(docs, **params)
    return _taken(pieces, slots).select("slot", "sid", "pass", "block", "doc_id", (F.col("from_word") - F.col("first")).alias("word_from"), (F.col("upto") - F.col("first")).alias("word_to"))


def mix_sources(docs: DataFrame, **params) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words that the schedule takes, repeats counted), source,
    first_slot (the earliest slot that takes any of its words, -1 for none) and n_slots (how many do). Documents without
    words are returned with taken 0. See ``plan_mix`` for the parameters and edge cases."""
    placed, pieces, slots = plan_mix(docs, **params)
    taken = _taken(pieces, slots).groupBy("sid", "first", "size").agg(F.sum(F.col("upto") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    # A position in a stream belongs to one document with words; its sid and first are a key.
    of = lambda c, none: F.coalesce(c, F.lit(none)).cast("long").alias(c)
    return placed.join(taken, ["sid", "first", "size"], "left").select("doc_id", "size", "source_size", "target", of("taken", 0), "source", of("first_slot", -1), of("n_slots", 0))


#: DuckDB: the water level by the same formula, the stream, the schedule slot by slot, and what its slots take.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s),
w AS (SELECT *, [3, 1, 2][(sid % 3 + 1)::INT]::BIGINT AS w FROM n),
c AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0)::DOUBLE AS rest,
             (sum(w) OVER ())::DOUBLE - coalesce(sum(w) OVER b, 0)::DOUBLE AS rest_w FROM w
      WINDOW b AS (ORDER BY (source_size * 2)::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest AS r, rest_w AS rw FROM c ORDER BY rest / rest_w DESC, sid LIMIT 1),
t AS (SELECT source, sid, source_size, greatest(least((source_size * 2)::DOUBLE, r * w / rw), 0) AS target FROM c, l),
p AS (SELECT row_number() OVER () AS row, d.*, t.sid, t.source_size, t.target,
             (sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id NULLS FIRST, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS first
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT sid, source_size, floor(target)::BIGINT AS goal, ceil(source_size / {block}::DOUBLE)::BIGINT AS n_blocks FROM t WHERE source_size > 0),
q AS (SELECT *, (goal // source_size) * n_blocks + ceil((goal % source_size) / {block}::DOUBLE)::BIGINT AS need,
             coalesce(sum(goal) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS goals,
             (sum(goal) OVER ())::DOUBLE AS all_goals FROM b),
g AS (SELECT sum(need)::BIGINT AS n_slots, (SELECT count(*) FROM t) AS n_sources FROM q),
x AS (SELECT slot, (slot // 1048576) * {phi_step}::DOUBLE + (slot % 1048576) * {phi}::DOUBLE AS v FROM (SELECT unnest(range((SELECT n_slots FROM g))) AS slot)),
y AS (SELECT slot, q.*, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
      FROM x JOIN q ON v - floor(v) >= goals / all_goals AND v - floor(v) < (goals + goal) / all_goals),
h AS (SELECT q.*, (SELECT count(*) FROM y WHERE y.sid = q.sid) AS had FROM q),
z AS (SELECT slot, sid, source_size, goal, n_blocks, rank FROM y WHERE rank < need
      UNION ALL SELECT n_slots + (rank - had) * n_sources + sid, sid, source_size, goal, n_blocks, rank
      FROM (SELECT *, unnest(range(had, need)) AS rank FROM h), g),
k AS (SELECT row, slot, least(first + size, (rank % n_blocks + 1) * {block}, goal - (rank // n_blocks) * z.source_size)
                        - greatest(first, (rank % n_blocks) * {block}) AS words
      FROM p JOIN z ON p.sid = z.sid AND first < (rank % n_blocks + 1) * {block} AND first + size > (rank % n_blocks) * {block}),
m AS (SELECT row, sum(words)::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(*)::BIGINT AS n_slots FROM k WHERE words > 0 GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, source, coalesce(first_slot, -1) AS first_slot, coalesce(m.n_slots, 0) AS n_slots
FROM p LEFT JOIN m ON p.row = m.row
"""


def mix_sql(docs: str = "documents", block: int = 8192) -> str:
    return MIX_SQL.format(docs=docs, block=block, phi=repr(PHI), phi_step=repr(PHI_STEP))


def repeat_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents as the schedule takes them: once for each pass of their source's stream that takes any of their
    words, in the order of the slots that take the first of them. Documents without words are in no stream and go."""
    _, pieces, slots = plan_mix(docs, whole=True, **params)
    turns = _taken(pieces, slots).groupBy("digest", "first", "pass").agg(F.min("slot").alias("_cs_slot"))
    turns = turns.select(F.col("digest").alias("_cs_digest"), F.col("first").alias("_cs_first"), "_cs_slot")
    key = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])), 16, "0")
    digest = F.concat(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary")), key)
    # Equal rows are interchangeable: one of them stands for all, and the copies' turns are in the schedule.
    one = docs.withColumn("_cs_of", digest).dropDuplicates(["_cs_of"])
    taken = one.join(turns, F.col("_cs_of") == F.col("_cs_digest"))
    return taken.orderBy("_cs_slot", "_cs_first", "_cs_digest").select(docs.columns)
