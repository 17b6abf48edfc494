"""Top-n BM25 by dynamic pruning over blocks of postings.

Chunks are dealt to parts of bounded size, and a part numbers its chunks by facet and length, so that neighbours are
alike. A term's postings in a part are cut into blocks of 128: chunk numbers as differences from the block's first, term
frequencies, a bit for every facet in the block, and the largest frequency in every run of 16 chunks that it touches. With
the run's shortest chunk that bounds the term's impact in the run under any average length, so blocks stay right when the
corpus grows.

A search gives every part the blocks of the asked terms. A question takes its terms by their largest impact; what the
terms from one on can add to a chunk is known for every run. Where that cannot lift an unseen chunk into the n best, nor a
chunk in the running, the run's postings are not scored, and a block all of whose runs are so is not opened. The edge to
reach is set early, by scoring the first leaders to the end. Results are exact: bounds are never below scores, and ties
with the n-th best are sent on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import K1, B

#: Postings of a block, chunks of a run, and tokens of a part's chunks that make it about full.
BLOCK, RUN, PART_TOKENS = 128, 16, 4_000_000
#: Few tokens are cut into parts of this size, as long as there are cores without one.
LEAST_TOKENS = 250_000
#: Terms after which the leaders so far are scored to the end, to raise the edge.
LEADS = (2, 4, 7, 11, 16)
#: Questions that a part answers at once.
PACK = 1024
#: A bound must lie so far below the n-th best score, which is compared at nine decimals.
SLACK = 1e-8

#: Rows that are not postings, under names that no token has: lengths of a part's chunks, chunks of a facet, chunks dropped.
MARK = "#"
LENGTHS, FACET, DEAD = MARK + "len", MARK + "facet:", MARK + "dead"

BLOCKS_DDL = "part int, term string, block int, n int, first int, last int, ords binary, tfs binary, runs binary, tops binary, facets long"
_BLOCKS = pa.schema(
    [("part", pa.int32()), ("term", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]
    + [("ords", pa.binary()), ("tfs", pa.binary()), ("runs", pa.binary()), ("tops", pa.binary()), ("facets", pa.int64())]
)


def facet_bit(facet: str) -> int:
    return 1 << xxhash.xxh64_intdigest(facet) % 63


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold the largest."""
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _packed_all(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """``_packed`` of every stretch of the values, which begin at ``begin``."""
    n = np.diff(np.r_[begin, len(values)])
    top = np.maximum.reduceat(values, begin)
    width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))
    ends = np.cumsum(n * width)
    wide = np.repeat(width, n)
    at = np.cumsum(wide) - wide
    data = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(width.max())):
        own = slice(None) if k == 0 else np.flatnonzero(wide > k)
        data[at[own] + k] = values[own] >> 8 * k & 255
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)])


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1").astype(np.int64)


def _unpacked_all(data: pa.Array, n: np.ndarray) -> np.ndarray:
    """``_unpacked`` of every value, of ``n`` numbers each, one after another."""
    ends = np.frombuffer(data.buffers()[1], np.int32 if pa.types.is_binary(data.type) else np.int64)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    held = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    width = np.diff(ends) // np.maximum(n, 1)
    wide = np.repeat(width, n)
    at = np.repeat(ends[:-1] - (np.cumsum(n * width) - n * width), n) + np.cumsum(wide) - wide
    out = held[at].astype(np.int64)
    for k in range(1, int(width.max(initial=0))):
        own = np.flatnonzero(wide > k)
        out[own] |= held[at[own] + k].astype(np.int64) << 8 * k
    return out


def impact(tf: np.ndarray, dl: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def part_blocks(part: int, terms: list[str], code: np.ndarray, ords: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, games: list) -> pa.Table:
    """The block rows of one part: postings (code into ``terms``, ord, tf) sorted by code and ord, lengths by ord, and
    the facets of each chunk."""
    bits, of = np.zeros(len(lengths), np.int64), {}
    for i, row in enumerate(games):
        for game in dict.fromkeys(x for x in (row if row is not None else ()) if x is not None):
            of.setdefault(game, []).append(i)
            bits[i] |= facet_bit(game)
    rows = [(LENGTHS, 0, len(lengths), 0, max(0, len(lengths) - 1), b"", _packed(lengths), b"", b"", 0)]
    rows += [(FACET + game, 0, len(at), at[0], at[-1], _packed(np.array(at) - at[0]), b"", b"", b"", facet_bit(game)) for game, at in sorted(of.items())]
    columns = list(zip(*rows, strict=True))
    marks = pa.Table.from_arrays([pa.array([part] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, _BLOCKS.types[1:], strict=True))], schema=_BLOCKS)
    if not len(code):
        return marks
    # All blocks at once: most terms have one posting, and a loop over terms would be most of the work.
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    inside = np.arange(len(code)) - np.repeat(start, np.diff(np.r_[start, len(code)]))
    begin = np.flatnonzero(inside % BLOCK == 0)
    n = np.diff(np.r_[begin, len(code)])
    first, last = ords[begin], ords[begin + n - 1]
    run = ords // RUN - np.repeat(first // RUN, n)
    fresh = np.r_[True, run[1:] != run[:-1]]
    fresh[begin] = True
    at = np.flatnonzero(fresh)
    runs_begin = np.searchsorted(at, begin)
    columns = [
        pa.array(np.full(len(begin), part, np.int32)),
        pa.array(terms, pa.string()).take(pa.array(code[begin])),
        *(pa.array(x.astype(np.int32)) for x in (inside[begin] // BLOCK, n, first, last)),
        _packed_all(ords - np.repeat(first, n), begin),
        _packed_all(tfs, begin),
        _packed_all(run[at], runs_begin),
        _packed_all(np.maximum.reduceat(tfs, at), runs_begin),
        pa.array(np.bitwise_or.reduceat(bits[ords], begin)),
    ]
    return pa.concat_tables([marks, pa.Table.from_arrays(columns, schema=_BLOCKS)]).combine_chunks()


def encode(table: pa.Table) -> pa.Table:
    """The block rows of one part's chunks (part, ord, terms, games)."""
    table = table.sort_by("ord").combine_chunks()
    terms = table["terms"].combine_chunks()
    sizes = np.diff(terms.offsets.to_numpy())
    words = terms.flatten().dictionary_encode()
    n = len(table)
    key, tfs = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
    return part_blocks(table["part"][0].as_py(), words.dictionary.to_pylist(), key // max(1, n), key % max(1, n), tfs, sizes.astype(np.int64), table["games"].to_pylist())


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (chunk_id, terms, games) with part, dl and ord: parts by the id's hash, numbers by facet and length."""
    rows = rows.withColumn("dl", F.size("terms").cast("int")).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("part").orderBy("games", "dl", "chunk_id")) - 1)


def parts_for(tokens: int, part_tokens: int = PART_TOKENS, cores: int = 1) -> int:
    return max(1, -(-tokens // part_tokens), min(cores, -(-tokens // min(part_tokens, LEAST_TOKENS))))


def build_blocks(rows: DataFrame) -> DataFrame:
    """Block rows of numbered chunks; a task holds the tokens of one part."""
    return rows.select("part", "ord", "terms", "games").groupBy("part").applyInArrow(encode, BLOCKS_DDL)


# -- search --------------------------------------------------------------------------------------------------------


@dataclass
class _List:
    """A term's blocks in a part."""

    first: np.ndarray
    last: np.ndarray
    n: np.ndarray
    facets: np.ndarray
    ords: list[bytes]
    tfs: list[bytes]
    run: np.ndarray  # the runs that the blocks touch, one block after another
    block: np.ndarray  # and the block of each
    high: np.ndarray  # by run: the largest impact, without the question's weight


class _Part:
    """The asked blocks of a part. ``opened`` counts the postings of blocks that were unpacked, ``scored`` those whose
    impact went into a question's score."""

    def __init__(self, table: pd.DataFrame, average: float):
        self.average, self.opened, self.scored = average, 0, 0
        # Columns are taken apart once for all terms, which are thousands with few blocks each.
        code, names = pd.factorize(table["term"])
        order = np.lexsort((table["block"].to_numpy(), code))
        firsts, lasts, ns, facets = (table[c].to_numpy().astype(np.int64)[order] for c in ("first", "last", "n", "facets"))
        ords, tfs, runs, tops = ([values[i] for i in order.tolist()] for values in (table[c].tolist() for c in ("ords", "tfs", "runs", "tops")))
        at = np.searchsorted(code[order], np.arange(len(names) + 1))
        place = {term: slice(a, b) for term, a, b in zip(names.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)}
        own = place.pop(LENGTHS).start
        self.lengths = _unpacked(tfs[own], int(ns[own])).astype(np.float64)
        self.run = np.arange(len(self.lengths)) // RUN
        self.short = np.minimum.reduceat(self.lengths, np.arange(0, len(self.lengths), RUN))
        self.alive = np.ones(len(self.lengths), bool)
        for dead in ords[place.pop(DEAD)] if DEAD in place else ():
            self.alive[np.frombuffer(dead, "<u4")] = False
        self.lists: dict[str, _List] = {}
        self.allowed: dict[str, np.ndarray] = {}
        self.kept: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        # Runs are stored as steps from a block's first, so the last of them tells in how many bytes each is.
        steps = lasts // RUN - firsts // RUN
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // np.where(steps < 1 << 8, 1, np.where(steps < 1 << 16, 2, 4))
        begin = np.r_[0, np.cumsum(sizes)]
        run = _unpacked_all(pa.array(runs, pa.large_binary()), sizes) + np.repeat(firsts // RUN, sizes)
        value = impact(_unpacked_all(pa.array(tops, pa.large_binary()), sizes).astype(np.float64), self.short[run], average)
        for term, rows in place.items():
            if term.startswith(FACET):
                self.allowed[term[len(FACET) :]] = _unpacked(ords[rows.start], int(ns[rows.start])) + int(firsts[rows.start])
                continue
            inside = slice(begin[rows.start], begin[rows.stop])
            high = np.zeros(len(self.short))
            np.maximum.at(high, run[inside], value[inside])
            self.lists[term] = _List(firsts[rows], lasts[rows], ns[rows], facets[rows], ords[rows], tfs[rows], run[inside], np.repeat(np.arange(rows.stop - rows.start), sizes[rows]), high)

    def open(self, term: str, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers and impacts of a block."""
        if (found := self.kept.get((term, block))) is None:
            a, n = self.lists[term], int(self.lists[term].n[block])
            ords = _unpacked(a.ords[block], n) + a.first[block]
            found = self.kept[term, block] = ords, impact(_unpacked(a.tfs[block], n).astype(np.float64), self.lengths[ords], self.average)
            self.opened += n
        return found

    def postings(self, term: str, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.open(term, b) for b in blocks.tolist()]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0))

    def whole(self, chunks: np.ndarray, score: np.ndarray, lists: list[tuple[str, float, _List]]) -> np.ndarray:
        """The scores of a few chunks with what the lists add to them."""
        out, near = score[chunks], np.zeros(len(self.short), bool)
        near[self.run[chunks]] = True
        for term, weight, a in lists:
            if not (touched := near[a.run]).any():
                continue
            reached, runs = np.zeros(len(a.last) + 1, bool), np.zeros(len(a.last) + 1, bool)
            reached[np.searchsorted(a.last, chunks)] = True
            runs[a.block[touched]] = True
            ords, value = self.postings(term, np.flatnonzero((reached & runs)[:-1]))
            if len(ords):
                place = np.minimum(np.searchsorted(ords, chunks), len(ords) - 1)
                hit = ords[place] == chunks
                out[hit] += weight * value[place[hit]]
                self.scored += int(hit.sum())
        return out

    def best(self, asked: list[tuple[str, float]], n: int, facet: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers and scores of the part's n best, with ties."""
        lists = [(t, w, self.lists[t]) for t, w in asked if t in self.lists]
        mask, bit = self.alive, -1
        if facet is not None:
            mask = np.zeros(len(self.alive), bool)
            mask[self.allowed.get(facet, np.zeros(0, np.int64))] = True
            mask, bit = mask & self.alive, facet_bit(facet)
        lists.sort(key=lambda x: -x[1] * x[2].high.max())
        rest = np.zeros((len(lists) + 1, len(self.short)))  # by run: what the terms from here on can add together
        for k in range(len(lists) - 1, -1, -1):
            rest[k] = rest[k + 1] + lists[k][1] * lists[k][2].high
        score, seen, out = np.zeros(len(mask)), np.zeros(len(mask), bool), ~mask
        found, edge = np.zeros(0, np.int64), -np.inf
        for k, (term, weight, a) in enumerate(lists):
            low = edge - SLACK
            running = score[found] + rest[k][self.run[found]] >= low
            out[found[~running]] = True
            found = found[running]
            need = rest[k] >= low
            need[self.run[found]] = True
            blocks = np.unique(a.block[need[a.run]])
            if facet is not None:
                blocks = blocks[(a.facets[blocks] & bit) != 0]
            ords, value = self.postings(term, blocks)
            fits = ~out[ords] & (score[ords] + rest[k][self.run[ords]] >= low)
            out[ords[~fits]] = True
            ords = ords[fits]
            self.scored += len(ords)
            score[ords] += weight * value[fits]
            found = np.concatenate([found, ords[~seen[ords]]])
            seen[ords] = True
            if len(found) >= n:
                edge = max(edge, np.partition(score[found], len(found) - n)[len(found) - n])
                if k + 1 in LEADS and k + 1 < len(lists):
                    leaders = found[np.argpartition(score[found], len(found) - n)[len(found) - n :]]
                    edge = max(edge, self.whole(np.sort(leaders), score, lists[k + 1 :]).min())
        found = found[np.round(score[found], 9) >= np.round(edge, 9)] if len(found) > n else found
        return found, score[found]


FOUND_DDL = "qid {qid}, segment string, part int, ord int, score double, opened long, scored long"


def answer_parts(blocks: DataFrame, packs: DataFrame, n: int, average: float) -> DataFrame:
    """qid, segment, part, ord, score of each part's n best of each question, with ties; and per part and pack one row
    without a question that counts postings opened and scored.

    ``blocks``: segment, pack and the block rows; ``packs``: segment, part, pack, questions array<struct<qid, facet,
    terms array<struct<term, weight>>>>."""
    columns = ["qid", "segment", "part", "ord", "score", "opened", "scored"]
    kind = packs.schema["questions"].dataType.elementType["qid"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        segment, part, _ = key
        if not len(rows):  # no chunk was dealt to this part
            return pd.DataFrame({c: [] for c in columns})
        place = _Part(rows, average)
        out = {"qid": [], "ord": [], "score": []}
        for questions in asked["questions"]:
            for q in questions:
                found, score = place.best([(t["term"], t["weight"]) for t in q["terms"]], n, q["facet"])
                out["qid"] += [q["qid"]] * len(found)
                out["ord"] += found.tolist()
                out["score"] += score.tolist()
        counted = pd.DataFrame({"qid": [None], "ord": [-1], "score": [0.0], "opened": [place.opened], "scored": [place.scored]})
        frame = pd.concat([pd.DataFrame(out).assign(opened=0, scored=0), counted]) if out["qid"] else counted
        return frame.assign(segment=segment, part=part)[columns]

    keys = ("segment", "part", "pack")
    return blocks.groupBy(*keys).cogroup(packs.groupBy(*keys)).applyInPandas(run, FOUND_DDL.format(qid=kind))
