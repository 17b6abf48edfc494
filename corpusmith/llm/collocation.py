"""Collocated phrases: merged count-min sketches, one exact count of what survives them, scores and subsumption.

First pass: every task sketches the phrases of one to five words in its texts. A sketch has two rows of cells for each
length, as many as the text needs for a cell to hold few rare phrases; a cell holds at most the least count that is asked
for, one byte. Tasks send their sketches in compressed blocks
of cells, which are added up block by block, two levels deep. A cell never holds less than any of its phrases' counts, so
the one bit a cell that is left of it (whether the least count is reached) loses no frequent phrase.

Second pass: the bits go to all tasks, of bounded size. A phrase survives at a place if its own cells and those of both
phrases one word shorter in it are set, as no phrase is more frequent than a part of it. Survivors alone are counted,
exactly, by their words. Counts stay columns all the way: a task adds up its batches' tables and sends them as compressed
column blocks, one for each range of the phrases' hashes, and the blocks of a range are added up again; there are as many
ranges as the text needs for one to be small. What the sketch let through by chance falls to the exact count, so the result
is the same at any width of the sketch; a narrow one only lets more through.

Scores, subsumption and ranks are joins and aggregates of the few phrases that are left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise, release_worker_cache

#: Cells of one row of phrases of two words and more: the fewest and the most that a text is given (a task holds a byte, and
#: the driver and the second pass a bit, for each of 8.5 times as many), and the fewest of any row.
WIDTH, MOST_WIDTH, LEAST_WIDTH = 1 << 22, 1 << 26, 1 << 12
#: Bytes of text behind a cell, for each occurrence of the least count: its phrases then add up to less than half of that.
BYTES_A_CELL = 3.2
#: Bytes of text whose words a task holds at once, as numbers, hashes and places.
BATCH = 4 << 20
#: Cells of a block, and tasks whose blocks are added up first.
BLOCK, FAN_IN = 1 << 18, 256

#: 0 in a word, 1 blank, 2 between pieces; and A-Z in lower case.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"\x20\x09")] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Layout:
    """Where the cells of a sketch lie: for each length two rows, single words being fewer."""

    width: int
    longest: int

    def rows(self, size: int) -> Iterator[tuple[int, int]]:
        """(first cell, cells) of the rows of phrases of ``size`` words."""
        at = 0
        for n in range(1, size + 1):
            cells = max(min(self.width, LEAST_WIDTH), self.width >> 2 if n == 1 else self.width)
            for _ in range(2):
                if n == size:
                    yield at, cells
                at += cells

    @property
    def cells(self) -> int:
        at, cells = list(self.rows(self.longest))[-1]
        return at + cells

    def places(self, size: int, h: np.ndarray) -> list[np.ndarray]:
        out = []
        for (at, cells), mix in zip(self.rows(size), _MIX, strict=False):
            out.append(((((h ^ (h >> np.uint64(29))) * mix) >> np.uint64(36)) & np.uint64(cells - 1)).astype(np.int64) + at)
        return out


def sketch_width(size: int, least: int) -> int:
    """Cells of a row for ``size`` bytes of text. A fixed width would fill up: from some size on every cell reaches the
    least count, and every phrase of the corpus goes to the exact count."""
    return min(MOST_WIDTH, max(WIDTH, 1 << max(0, int(size / (BYTES_A_CELL * least)) - 1).bit_length()))


@dataclass
class Words:
    """The words of a batch of texts: numbers into ``names``, a hash that tells languages apart, piece and language."""

    names: pa.Array
    number: np.ndarray
    hash: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    langs: pa.Array

    def whole(self, size: int) -> np.ndarray:
        """Whether a phrase of ``size`` words begins at each word, within its piece."""
        n = len(self.piece) - size + 1
        return self.piece[:n] == self.piece[size - 1 :] if n > 0 else np.zeros(0, bool)

    def longer(self, h: np.ndarray, size: int) -> np.ndarray:
        """Hashes of phrases of ``size`` words from those of one word less."""
        n = max(0, len(self.piece) - size + 1)
        return (h[:n] ^ (h[:n] >> np.uint64(31))) * _MIX[0] + self.hash[size - 1 : size - 1 + n]


def split_words(text: pa.Array, lang: pa.Array) -> Words:
    text = pc.fill_null(text, "").cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _KIND[data]
    word = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=offsets[1:])
    names = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[word]])]).dictionary_encode()
    piece = np.cumsum((kind == 2) | edge[:-1], dtype=np.int64)[starts]
    langs = pc.fill_null(lang, "und").cast(pa.large_string()).dictionary_encode()
    of = langs.indices.to_numpy()[np.searchsorted(ends, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names.dictionary.to_pylist()), np.uint64, len(names.dictionary))
    seeds = np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in langs.dictionary.to_pylist()), np.uint64, len(langs.dictionary))
    number = names.indices.to_numpy().astype(np.int64)
    return Words(names.dictionary, number, hashes[number] ^ seeds[of], piece, of.astype(np.int64), langs.dictionary)


def _texts(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession, size=BATCH)
    return docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))


def _sketches(docs: DataFrame, layout: Layout, least: int) -> DataFrame:
    """block, task, cells: the blocks of each task's sketch that are not empty."""
    kind = np.min_scalar_type(2 * least)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        flat = np.zeros(0, kind)
        for frame in frames:
            if not len(flat):
                flat = np.zeros(layout.cells, kind)
            words = split_words(frame.column(0), frame.column(1))
            h = words.hash
            for size in range(1, layout.longest + 1):
                if size > 1:
                    h = words.longer(h, size)
                for places in layout.places(size, h[words.whole(size)]):
                    places = np.sort(places.astype(np.int32))  # a batch has far fewer phrases than a row has cells
                    start = np.flatnonzero(np.r_[True, places[1:] != places[:-1]][: len(places)])
                    n, cell = np.minimum(np.diff(np.r_[start, len(places)]), least).astype(kind), places[start]
                    flat[cell] = np.minimum(flat[cell] + n, least)
        task = TaskContext.get().partitionId()
        for block in range(0, len(flat), BLOCK):
            if (part := flat[block : block + BLOCK]).any():
                yield pa.RecordBatch.from_pylist([{"block": block // BLOCK, "task": task, "cells": pa.compress(part.tobytes(), "zstd", asbytes=True)}], schema=_BLOCKS)

    return _texts(docs).mapInArrow(run, _BLOCKS_DDL)


_BLOCKS = pa.schema([("block", pa.int64()), ("task", pa.int64()), ("cells", pa.binary())])
_BLOCKS_DDL = "block long, task long, cells binary"


def _added(blocks: DataFrame, group: Column, cells: int, least: int, bits: bool) -> DataFrame:
    """Blocks of one number and group added up; as the bits of cells that reach ``least``, or as cells again."""
    kind = np.min_scalar_type(2 * least)

    def done(block: int, group: int, total: np.ndarray) -> pa.RecordBatch:
        out = np.packbits(total >= least, bitorder="little").tobytes() if bits else pa.compress(total.tobytes(), "zstd", asbytes=True)
        return pa.RecordBatch.from_pylist([{"block": block, "task": group, "cells": out}], schema=_BLOCKS)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for frame in frames:
            for block, task, data in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                n = min(BLOCK, cells - block * BLOCK)
                part = np.frombuffer(pa.decompress(data, n * kind.itemsize, "zstd"), kind)
                if now == (block, task):
                    np.minimum(total + part, least, out=total)
                    continue
                if now:
                    yield done(*now, total)
                now, total = (block, task), part.copy()
        if now:
            yield done(*now, total)

    dealt = blocks.withColumn("task", group).repartition("block", "task").sortWithinPartitions("block", "task")
    return dealt.mapInArrow(run, _BLOCKS_DDL)


def frequent_cells(docs: DataFrame, layout: Layout, least: int) -> np.ndarray:
    """The bits of the whole table's sketch."""
    some = _added(_sketches(docs, layout, least), F.expr(f"task div {FAN_IN}"), layout.cells, least, bits=False)
    found = _added(some, F.lit(0).cast("long"), layout.cells, least, bits=True).toArrow()
    out = np.zeros(-(-layout.cells // BLOCK) * BLOCK // 8, np.uint8)
    for block, cells in zip(found["block"].to_pylist(), found["cells"].to_pylist(), strict=True):
        out[block * BLOCK // 8 : block * BLOCK // 8 + len(cells)] = np.frombuffer(cells, np.uint8)
    return out


#: Rows of counts that a task gathers before it sends or adds them up, and bytes of text behind one range of phrases.
GATHERED, RANGE_BYTES = 1_000_000, 64 << 20

_KEYS = ["range", "lang", "size", "phrase"]
_PACKED = pa.schema([("range", pa.int64()), ("counts", pa.binary())])


def _sum(tables: list[pa.Table]) -> pa.Table:
    """Tables of counts (range, lang, size, phrase, a) as one, each phrase once."""
    total = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate([("a", "sum")])
    return total.select([*_KEYS, "a_sum"]).rename_columns([*_KEYS, "a"])


def _pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row for each range: its counts as a compressed stream of columns."""
    table = table.sort_by("range")
    ranges = table["range"].to_numpy()
    for at in np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]).tolist() if len(ranges) else []:
        part, out = table.slice(at, int(np.searchsorted(ranges, ranges[at], "right")) - at), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(part.combine_chunks())
        yield pa.RecordBatch.from_pylist([{"range": int(ranges[at]), "counts": out.getvalue().to_pybytes()}], schema=_PACKED)


def _merged(packed: DataFrame, least: int) -> DataFrame:
    """lang, size, phrase, a of the counts that reach ``least``, and of the rows of size 0."""

    def done(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        total = _sum(tables)
        total = total.filter(pc.or_(pc.greater_equal(total["a"], least), pc.equal(total["size"], 0)))
        yield from pa.table({"lang": total["lang"].cast(pa.string()), "size": total["size"], "phrase": total["phrase"].cast(pa.large_string()).cast(pa.string()), "a": total["a"]}).to_batches(max_chunksize=65_536)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, n = None, [], 0
        for frame in frames:
            for at, data in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if at != now and tables:
                    yield from done(tables)
                    tables, n = [], 0
                now = at
                tables.append(pa.ipc.open_stream(data).read_all())
                n += len(tables[-1])
                if n > GATHERED:
                    tables = [_sum(tables)]
                    n = len(tables[0]) // 2  # so that a large sum is not made anew for every block
        if tables:
            yield from done(tables)

    return packed.repartition("range").sortWithinPartitions("range").mapInArrow(run, "lang string, size long, phrase string, a long")


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, width: int | None = None) -> DataFrame:
    """lang, size, phrase, a: all phrases of 1 to ``longest`` words that occur ``least`` times or more in a language, with
    their exact counts; and a row of size 0 per language with the number of its words. ``width`` cells a row of the sketch;
    None: as the text needs."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    layout = Layout(1 << max(0, int(width or sketch_width(size, least)) - 1).bit_length(), longest)
    ranges = max(64, size // RANGE_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, layout, least))

    def counted(frame: pa.RecordBatch, bits: np.ndarray) -> Iterator[pa.Table]:
        words = split_words(frame.column(0), frame.column(1))

        def table(h: np.ndarray, lang: np.ndarray, size: int, phrase: pa.Array, n: np.ndarray) -> pa.Table:
            at = ((h * _MIX[1]) >> np.uint64(33)) % np.uint64(ranges)
            return pa.table([pa.array(at.astype(np.int64)), words.langs.take(pa.array(lang)), pa.array(np.full(len(n), size)), phrase, pa.array(n)], names=[*_KEYS, "a"])

        per = np.bincount(words.lang, minlength=len(words.langs))
        yield table(np.zeros(len(per), np.uint64), np.arange(len(per)), 0, pa.nulls(len(per), pa.large_binary()), per)
        h, alive, gram = words.hash, np.ones(len(words.hash) + 1, bool), np.zeros(0, np.int64)
        for size in range(1, longest + 1):
            if size > 1:
                h = words.longer(h, size)
            alive = words.whole(size) & alive[: len(h)] & alive[1 : len(h) + 1]
            at = np.flatnonzero(alive)
            for row in range(2):
                places = layout.places(size, h[at])[row]
                at = at[np.flatnonzero(bits[places >> 3] >> (places & 7).astype(np.uint8) & 1)]
            alive = np.zeros(len(h), bool)
            alive[at] = True
            if not len(at):
                break
            before = words.lang[at] if size == 1 else gram[at]
            _, one, number, n = np.unique(before * len(words.names) + words.number[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
            gram = np.zeros(len(h), np.int64)
            gram[at] = number
            found = at[one]
            parts = [words.names.take(pa.array(words.number[found + k])) for k in range(size)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if size > 1 else parts[0]
            yield table(h[found], words.lang[found], size, phrase, n)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        tables, n = [], 0
        for frame in frames:
            new = list(counted(frame, shared.value))
            tables += new
            n += sum(map(len, new))
            if n > GATHERED:
                tables = [_sum(tables)]
                n = len(tables[0])
                if 2 * n > GATHERED:
                    yield from _pack(tables[0])
                    tables, n = [], 0
        if tables:
            yield from _pack(_sum(tables))

    return _merged(_texts(docs).mapInArrow(run, "range long, counts binary"), least)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, width: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    ``docs`` has text (null: empty) and lang (null: `und`). A phrase's count is a; cutting it after its first k words
    gives l = f(first part), r = f(rest) and floor(1000 a n / (l r)); the lowest-scoring cut counts, the first of equals.
    Phrases within a longer one that has ``share`` per cent of their count or more are dropped. All arithmetic is of
    decimals without a fraction. Rows that repeat count as often as they occur; no words give no rows."""
    counts = materialise(phrase_counts(docs, least, longest, width), "phrases")
    phrases = counts.filter("size > 0").select("lang", "size", "phrase", "a")
    words = counts.filter("size = 0").select(F.col("lang").alias("_wl"), F.col("a").alias("n"))
    candidates = phrases.filter("size > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int"))))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left = phrases.select(F.col("lang").alias("_ll"), F.col("phrase").alias("_lp"), F.col("a").alias("l"))
    right = phrases.select(F.col("lang").alias("_rl"), F.col("phrase").alias("_rp"), F.col("a").alias("r"))
    cuts = cuts.join(left, (F.col("lang") == F.col("_ll")) & (F.col("first") == F.col("_lp"))).join(right, (F.col("lang") == F.col("_rl")) & (F.col("rest") == F.col("_rp")))
    cuts = cuts.join(words, F.col("lang") == F.col("_wl"))
    score = F.expr("(cast(1000 * cast(a as decimal(15,0)) as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, int(size) - 1), m -> transform(sequence(1, int(size) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = candidates.filter("size > 2").withColumn("w", F.split("phrase", " ")).select(F.col("lang").alias("_il"), F.explode(inner).alias("_ip"), "a")
    inside = inside.groupBy("_il", "_ip").agg(F.max("a").alias("_longer"))
    kept = best.join(inside, (F.col("lang") == F.col("_il")) & (F.col("phrase") == F.col("_ip")), "left").filter(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * share))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """The same rows by DuckDB, which counts every phrase."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    split AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
    grams AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, {longest + 1}) AS t(k) WHERE i + k - 1 <= len(w)),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
    words AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
    cuts AS (SELECT c.lang, c.phrase, c.size, c.a, k, string_split(c.phrase, ' ') AS w FROM f c, range(1, {longest}) AS t(k) WHERE k < c.size),
    scored AS (SELECT c.lang, c.phrase, c.size, c.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
      FROM cuts c JOIN words USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, size, a, string_split(phrase, ' ') AS w FROM f WHERE size > 2), range(2, {longest}) AS t(m), range(1, {longest}) AS s(i)
      WHERE m < size AND i + m - 1 <= size GROUP BY ALL)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
      SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
      FROM best b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * b.a) WHERE rank <= {top}"""
