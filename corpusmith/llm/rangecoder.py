"""Token-id files packed by a context-mixing range coder.

Blocks of ids are coded apart and carry a CRC-32 of their ids, so each can be read alone with its file's directory, and
damage stays in its block. Three predictions of an id are mixed into one probability: the id that the two ids before
foretell (order 2), the id that the one before foretells (order 1), both learned in the block, and the shares of all ids
in the file (order 0), which stand in its directory. The weights are learned in the block for each pair of confidences
that the first two have earned. They are whole numbers, so every machine finds the same, and the chances add up to a power
of two: an id is coded in one step.

The coder works on many blocks at once: step t codes id t of every block, with one numpy operation for all of them,
so the interpreter's cost is shared. Streams are independent of which blocks were coded together.

File layout (little-endian): magic "CMR4", documents u32, blocks u32, bytes of order 0 u32, ids u64, CRC-32 of the
directory u32; the directory: doc_id i64 and has-id u8 and ids u32 for each document, ids u32 and bytes u32 and CRC-32 u32
for each block, order 0 (deflated: ids u16, then their shares less one u16); then the blocks' bytes.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import bound_batches, materialise, release_worker_cache, without_gc, worker_cache

BLOCK, LANES = 16_384, 1024
#: Small files have shorter blocks, down to the least, so that a step still codes this many.
LEAST_BLOCK, LEAST_LANES = 2048, 512
#: Ids of a file; documents are never split between files.
FILE_IDS = BLOCK * LANES
MAGIC, HEAD = b"CMR4", struct.Struct("<4sIIIQI")
#: A range below the bottom gives a digit out; what lies under that digit is kept.
BOTTOM, KEPT, DIGIT = np.uint64(1 << 32), np.uint64(32), np.uint64(24)
ONE = np.uint64(1)
#: Ids are below this, and order 0's shares add up to it.
IDS_BITS = 16
IDS = 1 << IDS_BITS
#: Weights are in 1/256, so an id's chances are in 1/2^24.
WEIGHT_BITS = 8
TOTAL_BITS = np.uint64(IDS_BITS + WEIGHT_BITS)
MOST = np.uint64((1 << IDS_BITS + WEIGHT_BITS) - 1)
#: Spreads an id over the bits that places are taken from.
SPREAD = 0x9E3779B1
#: Steps that are prepared at once when coding.
SPAN = 32
#: Steps whose ids are turned from blocks to steps, or back, at once.
HELD = 512
#: Places of a block's tables of orders 2 and 1, and confidences of a prediction (0: none yet).
PLACES = np.array([[1 << 14], [1 << 12]])
SURE_BITS = 3
SURE = (1 << SURE_BITS) - 1
#: What a hit (second half) or a miss does to a prediction that stays: a hit makes it surer, a miss a sure one less so. Others give way at a miss.
CHANGE = (np.array([-2] * (SURE + 1) + [1] * SURE + [0]) << IDS_BITS).astype(np.uint32)
STAYS = np.array([False] * 3 + [True] * (2 * SURE - 1))
FRESH = np.uint32(1 << IDS_BITS)
#: A weight, in 1/65536, loses 1/32 of itself at each step, and gains this with a hit: order 0's never falls under 1/256.
RATE, GAIN = 5, 2040
#: Both weights lie in one number, order 2's above order 1's; this keeps what one loses out of the other.
LOSS = ((1 << 16 - RATE) - 1) * ((1 << 16) + 1)
#: What they gain, by whether order 2 (2) and order 1 (1) foretold the id: one of them, order 2 first.
GAINS = np.array([0, GAIN, GAIN << 16, GAIN << 16])


def _first_weights(most: int) -> np.ndarray:
    """The weights before a block has taught better, by confidence of order 2 and of order 1."""
    sure2, sure1 = np.arange(SURE + 1)[:, None], np.arange(SURE + 1)[None, :]
    second = most * (2 * sure2 + 1) // (2 * sure2 + 8) * (sure2 > 0)
    return (second << 16 | (most - second) * (2 * sure1 + 1) // (2 * sure1 + 16) * (sure1 > 0)).reshape(-1)


FIRST = _first_weights(GAIN << RATE)


class Shares:
    """Order 0: the shares of ids, in 1/65536; every id that is coded has one at least."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids = ids
        self.size = np.zeros(IDS, np.int64)
        self.size[ids] = size
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.at = np.repeat(np.arange(IDS, dtype=np.uint32), self.size)

    @classmethod
    def of(cls, ids: np.ndarray) -> Shares:
        count = np.bincount(ids, minlength=IDS)
        there = np.flatnonzero(count)
        if not len(there):
            return cls.even()
        size = 1 + count[there] * (IDS - len(there)) // len(ids)
        size[np.argmax(size)] += IDS - size.sum()
        return cls(there, size)

    @classmethod
    def even(cls) -> Shares:
        return cls(np.arange(IDS), np.ones(IDS, np.int64))

    def pack(self) -> bytes:
        return zlib.compress(np.concatenate((self.ids, self.size[self.ids] - 1)).astype("<u2").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Shares:
        ids, size = np.frombuffer(zlib.decompress(data), "<u2").astype(np.int64).reshape(2, -1)
        return cls(ids, size + 1)


class _Lanes:
    """Models and coder of ``n`` blocks. A range holds 32 to 56 bits, and every digit of a stream has 24."""

    def __init__(self, n: int, shares: Shares):
        self.n, self.shares = n, shares
        self.range = np.full(n, 1 << 56, np.uint64)
        self.weights = np.tile(FIRST, n)
        # What follows a context, and above it how sure that is: a lane's places of order 2, then those of order 1.
        self.next = np.zeros(n * int(PLACES.sum()), np.uint32)
        self.base = np.arange(n) * int(PLACES.sum()) + [[0], [int(PLACES[0, 0])]]
        self.last = np.zeros((2, n), np.int64)  # the last two ids, spread over 48 bits
        self.state = np.arange(n, dtype=np.uint32) << 2 * SURE_BITS

    def places(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where the tables of orders 2 and 1 hold what follows these ids."""
        at = np.empty((*last.shape[:-1], 2, last.shape[-1]), np.int64)
        np.bitwise_xor(last, before >> 7, out=at[..., 0, :])
        at[..., 1, :] = last
        at >>= 11
        at &= PLACES - 1
        at += self.base[:, : last.shape[-1]]
        return at

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the tables hold there, how sure that is, and the places and values of the weights in use."""
        now = self.next.take(at)
        sure = now >> IDS_BITS
        state = sure[0] << SURE_BITS
        state += sure[1]
        state += self.state[: len(state)]
        return now, sure, state, self.weights.take(state)

    def learn(self, at: np.ndarray, now: np.ndarray, sure: np.ndarray, state: np.ndarray, own: np.ndarray, found: np.ndarray, hit: np.ndarray) -> None:
        """Take in the id that came (``found``, and whether it is the one foretold); ``now`` and ``sure`` are used up."""
        hits = hit.view(np.uint8)
        gain = GAINS.take((hits[0] << 1) | hits[1])
        gain -= (own >> RATE) & LOSS
        gain += own
        self.weights[state] = gain
        sure += hits << SURE_BITS
        now += CHANGE.take(sure)
        self.next[at] = np.where(STAYS.take(sure), now, found + FRESH)


def _mix(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of orders 2 and 1, in 1/2^24, and order 0's, in 1/256."""
    weights = np.empty((2, *own.shape), np.int64)
    np.right_shift(own, 16 + WEIGHT_BITS, out=weights[0])
    np.right_shift(own, WEIGHT_BITS, out=weights[1])
    weights[1] &= (1 << WEIGHT_BITS) - 1
    rest = (1 << WEIGHT_BITS) - weights[0]
    rest -= weights[1]
    weights <<= IDS_BITS
    return weights, rest


def _chances(shares: Shares, found: np.ndarray, foretold: np.ndarray, weights: np.ndarray, rest: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixture's chance of all ids below the one found, and of that one."""
    found_at = found.astype(np.intp)
    start, size = shares.start.take(found_at), shares.size.take(found_at)
    start *= rest
    size *= rest
    below, within = weights * (foretold < found), weights * hit
    start += below[0]
    start += below[1]
    size += within[0]
    size += within[1]
    return start.view(np.uint64), size.view(np.uint64)


class _Encoder(_Lanes):
    """A digit may hold a carry into the one before it, which is settled at the end."""

    def __init__(self, lengths: np.ndarray, shares: Shares):
        super().__init__(len(lengths), shares)
        self.lengths = lengths
        self.low = np.zeros(self.n, np.uint64)
        self.out = np.zeros((self.n, SPAN + 64 + int(lengths.max(initial=0)) // 3), np.uint32)
        self.at = np.zeros(self.n, np.int64)

    def code(self, ids: np.ndarray) -> None:
        """Code the next ids of the first lanes, a row a step. What does not lead from step to step is done for all rows at once."""
        steps, active = ids.shape
        found = ids.astype(np.uint32)
        last = np.concatenate((self.last[:, :active], found * np.int64(SPREAD)))
        places = self.places(last[:-2], last[1:-1])
        self.last[:, :active] = last[-2:]
        foretold, owns = np.empty((2, steps, active), np.uint32), np.empty((steps, active), np.int64)
        hits = np.empty((2, steps, active), bool)
        for t in range(steps):
            at = places[t]
            now, sure, state, own = self.predict(at)
            owns[t] = own
            seen = np.bitwise_and(now, IDS - 1, out=foretold[:, t])
            self.learn(at, now, sure, state, own, found[t], np.equal(seen, found[t], out=hits[:, t]))
        weights, rest = _mix(owns)
        start, size = _chances(self.shares, found, foretold, weights, rest, hits)
        low, span = self.low[:active], self.range[:active]
        digits, due = np.empty((steps, active), np.uint64), np.empty((steps, active), bool)
        for t in range(steps):
            span >>= TOTAL_BITS
            low += span * start[t]
            span *= size[t]
            small = np.less(span, BOTTOM, out=due[t])
            shift = small * DIGIT
            np.right_shift(low, KEPT, out=digits[t])
            low -= (digits[t] << KEPT) * small
            low <<= shift
            span <<= shift
        self.put(digits, due)

    def put(self, digits: np.ndarray, due: np.ndarray) -> None:
        """Write those digits that are due to the ends of their lanes."""
        active = due.shape[1]
        ends = self.at[:active] + np.cumsum(due, axis=0)
        if int(ends[-1].max()) + SPAN >= self.out.shape[1]:
            self.out = np.concatenate((self.out, np.zeros_like(self.out)), axis=1)
        step, lane = np.nonzero(due)
        self.out[lane, ends[step, lane] - 1] = digits[step, lane]
        self.at[:active] = ends[-1]

    def finish(self) -> list[bytes]:
        # One digit more tells a number within what is left of the range, as that has 32 bits; zeros follow it.
        self.put((self.low + (BOTTOM - ONE) >> KEPT)[None, :], np.ones((1, self.n), bool))
        found = []
        for row, size in zip(self.out, self.at.tolist(), strict=True):
            digits = row[:size]
            while (carry := digits[1:] >> np.uint32(24)).any():
                digits &= 0xFF_FFFF
                digits[:-1] += carry
            found.append(digits.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes())
        return found


class _Decoder(_Lanes):
    def __init__(self, blocks: list[bytes], shares: Shares):
        super().__init__(len(blocks), shares)
        # Four bytes and a digit come first, then a digit at a time; zeros follow the end.
        self.width = 3 + -(-max(map(len, blocks), default=0) // 3)
        self.digits = np.zeros((self.n, self.width), np.uint32)
        self.code = np.zeros(self.n, np.uint64)
        for i, block in enumerate(blocks):
            block = block.ljust(7, b"\0") + bytes((1 - max(len(block), 7)) % 3)
            raw = np.frombuffer(block, np.uint8, offset=4).reshape(-1, 3).astype(np.uint32)
            self.digits[i, : len(raw)] = raw[:, 0] << np.uint32(16) | raw[:, 1] << np.uint32(8) | raw[:, 2]
            self.code[i] = int.from_bytes(block[:4], "big") << 24 | int(self.digits[i, 0])
        self.at = np.arange(self.n) * self.width + 1

    def step(self, active: int) -> np.ndarray:
        """The next id of the first ``active`` lanes."""
        shares, last = self.shares, self.last[:, :active]
        at = self.places(last[0], last[1])
        now, sure, state, own = self.predict(at)
        foretold = now & np.uint32(IDS - 1)
        weights, rest = _mix(own)
        code, span = self.code[:active], self.range[:active]
        span >>= TOTAL_BITS
        # What the predictions add above their ids' own shares is taken out; order 0's share is left.
        value = np.minimum(code // span, MOST).view(np.int64)
        end = shares.end.take(foretold)
        end *= rest
        above = np.empty((2, active), bool)
        np.less_equal(foretold[1], foretold[0], out=above[0])
        np.logical_not(above[0], out=above[1])
        end += weights[::-1] * above
        extra = value + 1 - end
        np.maximum(extra, 0, out=extra)
        np.minimum(extra, weights, out=extra)
        value -= extra[0]
        value -= extra[1]
        found = shares.at.take(value // rest)
        hit = foretold == found
        start, size = _chances(shares, found, foretold, weights, rest, hit)
        code -= span * start
        span *= size
        self.learn(at, now, sure, state, own, found, hit)
        small = span < BOTTOM
        shift = small * DIGIT
        code <<= shift
        code |= self.digits.take(self.at[:active], mode="clip") * small
        span <<= shift
        self.at[:active] += small
        last[0] = last[1]
        np.multiply(found, SPREAD, out=last[1])
        return found


def _active(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(first step, step after the last, lanes still at work) of at most so many steps: lengths descend, so these are the
    first lanes."""
    at = 0
    for end in np.unique(lengths).tolist():
        active = int(np.searchsorted(-lengths, -end, "right"))
        for low in range(at, end, most):
            yield low, min(low + most, end), active
        at = end


def encode_blocks(blocks: list[np.ndarray], shares: Shares | None = None) -> list[bytes]:
    """The coded bytes of each block of ids (0 to 65535); without ``shares`` order 0 holds all ids alike."""
    shares = shares or Shares.even()
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for low in range(0, len(order), LANES):
        own = order[low : low + LANES]
        coder = _Encoder(np.array([len(blocks[i]) for i in own]), shares)
        for first, end, active in _active(coder.lengths, HELD):
            ids = np.stack([blocks[i][first:end] for i in own[:active]]).T
            for t in range(0, end - first, SPAN):
                coder.code(ids[t : t + SPAN])
        for i, data in zip(own, coder.finish(), strict=True):
            out[i] = data
    return out


def _decode(blocks: list[bytes], sizes: list[int], shares: Shares) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ids of all blocks, one block after the other, and each block's own among them."""
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    whole = np.zeros(ends[-1] if ends else 0, np.uint16)
    out = [whole[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    order = sorted(range(len(blocks)), key=lambda i: -sizes[i])
    for low in range(0, len(order), LANES):
        own = order[low : low + LANES]
        coder = _Decoder([blocks[i] for i in own], shares)
        for first, end, active in _active(np.array([sizes[i] for i in own]), HELD):
            ids = np.empty((end - first, active), np.uint16)
            for row in ids:
                row[:] = coder.step(active)
            for i, found in zip(own, ids.T, strict=False):
                out[i][first:end] = found
    return whole, out


def decode_blocks(blocks: list[bytes], sizes: list[int], shares: Shares | None = None) -> list[np.ndarray]:
    return _decode(blocks, sizes, shares or Shares.even())[1]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_file(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One file of whole documents, in the order given."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint16)
    size = min(BLOCK, max(LEAST_BLOCK, -(-len(ids) // LEAST_LANES)))
    blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
    shares = Shares.of(ids)
    coded, table = encode_blocks(blocks, shares), shares.pack()
    directory = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([d is not None for d, _ in docs], "u1").tobytes() + np.array([len(x) for _, x in docs], "<u4").tobytes()
    directory += np.array([(len(b), len(c), _crc(b)) for b, c in zip(blocks, coded, strict=True)], "<u4").tobytes() + table
    return HEAD.pack(MAGIC, len(docs), len(blocks), len(table), len(ids), zlib.crc32(directory)) + directory + b"".join(coded)


def read_file(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a file; ValueError names the first block or directory that fails its checksum."""
    magic, n, n_blocks, n_table, n_ids, crc = HEAD.unpack_from(data)
    end = HEAD.size + 13 * n + 12 * n_blocks + n_table
    directory = data[HEAD.size : end]
    if magic != MAGIC or zlib.crc32(directory) != crc:
        raise ValueError("not a token file, or its directory is damaged")
    doc_ids, named = np.frombuffer(directory, "<i8", n), np.frombuffer(directory, "u1", n, 8 * n)
    sizes, table = np.frombuffer(directory, "<u4", n, 9 * n), np.frombuffer(directory, "<u4", 3 * n_blocks, 13 * n).reshape(-1, 3)
    ends = end + np.cumsum(table[:, 1], dtype=np.int64)
    ids, blocks = _decode([data[e - s : e] for e, s in zip(ends.tolist(), table[:, 1].tolist(), strict=True)], table[:, 0].tolist(), Shares.unpack(directory[13 * n + 12 * n_blocks :]))
    for k, (block, want) in enumerate(zip(blocks, table[:, 2].tolist(), strict=True)):
        if _crc(block) != want:
            raise ValueError(f"block {k} fails its checksum")
    if len(ids) != n_ids:
        raise ValueError("ids are missing")
    cuts = np.cumsum(sizes, dtype=np.int64)
    return [(d if ok else None, ids[e - s : e]) for d, ok, s, e in zip(doc_ids.tolist(), named.tolist(), sizes.tolist(), cuts.tolist(), strict=True)]


def _spread(known: list[bytes], index: np.ndarray, closes: np.ndarray, end: int) -> list[np.ndarray]:
    """The ids of texts from those of their words: ``index`` numbers the words of all texts, which close at ``closes``."""
    raw = [*known, struct.pack("<H", end)]
    flat, sizes = np.frombuffer(b"".join(raw), "<u2"), np.fromiter(map(len, raw), np.int64, len(raw)) >> 1
    index = np.insert(index, closes, len(known))
    count = sizes.take(index)
    ends = np.cumsum(count)
    ids = flat.take(np.repeat((np.cumsum(sizes) - sizes).take(index) - ends + count, count) + np.arange(ends[-1]) if len(ends) else index)
    cuts = [0, *ends.take(closes + np.arange(len(closes))).tolist()]
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _byte_table(value: Callable[[int], int], dtype: type = np.uint8) -> np.ndarray:
    return np.array([value(b) for b in range(256)], dtype)


def _byte_letters() -> np.ndarray:
    """The letters that byte-level vocabularies write for bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return _byte_table(lambda b: b if b in own else next(others), np.uint16)


class _Pieces:
    """Ids of texts of ASCII and the Latin letters up to U+00FF, in which characters are lower-cased and told apart one by
    one: the texts of a frame are cut at once into the pieces of the pattern, pieces are told apart by Arrow, and the
    library merges each one it has not met. For tokenizers of this normaliser and pattern alone."""

    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    BLANK, LETTER, DIGIT, MARK = range(4)
    QUOTE = ord("'")
    #: Pieces of a call: the library holds some hundred bytes for each token until it returns.
    AT_ONCE = 16_384
    # In UTF-8: C3 and a byte after it are a Latin letter, save the signs of times (97) and division (B7).
    ODD = _byte_table(lambda b: not (32 <= b < 127 or b in b"\t\n\r" or b == 0xC3 or 0x80 <= b < 0xC0 and b not in (0x97, 0xB7)), bool)
    LOWER = _byte_table(lambda b: b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b).tobytes()
    KIND = _byte_table(lambda b: 0 if b in b" \t\n\r" else 1 if b >= 0x80 or chr(b).isalpha() else 2 if 48 <= b <= 57 else 3).tobytes()
    LETTERS = _byte_letters()

    @classmethod
    def fits(cls, tokenizer: Tokenizer) -> bool:
        normalizer, splitter = (json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
        steps = splitter.get("pretokenizers") or [{}]
        return (
            normalizer.get("normalizers") == cls.NORMALIZERS
            and steps[0] == {"type": "Split", "pattern": {"Regex": cls.PATTERN}, "behavior": "Removed", "invert": True}
            and [step["type"] for step in steps[1:]] == ["ByteLevel"]
            and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
            and bool(getattr(tokenizer.model, "end_of_word_suffix", None)) and tokenizer.model.dropout is None
            and not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values())
        )

    def __init__(self, tokenizer: Tokenizer, ends: np.ndarray):
        self.merger = Tokenizer(tokenizer.model)  # shares the vocabulary
        self.merger.pre_tokenizer = WhitespaceSplit()
        self.ends = ends
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of the texts, and where each text begins and the last one ends."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return whole[offsets[0] : offsets[-1]], offsets - offsets[0]

    def odd(self, texts: pa.Array, special: list[str]) -> np.ndarray:
        """Which texts hold other characters or what may be a special token's string."""
        if not len(texts):
            return np.zeros(0, bool)
        data, at = self._bytes(texts)
        found = np.zeros(len(texts), bool)
        found[np.searchsorted(at, np.flatnonzero(self.ODD.take(data)), "right") - 1] = True
        for token in special:
            found |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return found

    def _starts(self, data: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which bytes begin a piece."""
        first = np.ones(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == self.DIGIT
        first[at[at < len(first)]] = True
        first &= kind != self.BLANK
        quotes = np.flatnonzero(data == self.QUOTE)
        if len(quotes):
            # A mark of its own and the letters of a short form are one piece; more letters are the next.
            padded, new, letter = np.append(data, [0, 0]), np.append(first, [True, True]), np.append(kind, [0, 0]) == self.LETTER
            quotes = quotes[first[quotes] & new[quotes + 1] & letter[quotes + 1]]
            quotes = quotes[~np.isin(quotes + 1, at)]
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, list(b"stmd"))
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            long &= ~new[quotes + 2]
            for those, size in ((quotes[short], 1), (quotes[long], 2)):
                first[those + 1] = False
                after = those + 1 + size
                first[after[letter[after]]] = True
        return first

    def _learn(self, words: list[bytes]) -> None:
        """Pieces not known yet: those used before the last clearance are taken over, the others merged by the library."""
        known, older = self.known, self.older
        if older:
            known.update((w, ids) for w in words if (ids := older.get(w)) is not None)
            words = [w for w in words if w not in known]
        letters = self.LETTERS.copy()
        letters[32] = 32
        for low in range(0, len(words), self.AT_ONCE):
            part = words[low : low + self.AT_ONCE]
            text = letters.take(np.frombuffer(b" ".join(part), np.uint8)).astype("<u2").tobytes().decode("utf-16-le")
            ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
            ends = (np.flatnonzero(self.ends.take(ids)) + 1).tolist()
            if len(ends) != len(part) or ends[-1] != len(ids):
                raise ValueError("a piece does not end with an end-of-word token")
            raw = ids.tobytes()
            known.update((word, raw[2 * a : 2 * b]) for word, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))

    def encode(self, texts: pa.Array, end: int, most: int) -> list[np.ndarray]:
        data, at = self._bytes(texts)
        low = data.tobytes().translate(self.LOWER)
        data, kind = np.frombuffer(low, np.uint8), np.frombuffer(low.translate(self.KIND), np.uint8)
        first, kept = self._starts(data, kind, at), kind != self.BLANK
        closes = np.searchsorted(np.flatnonzero(first), at[1:])
        body, starts = data[kept], np.flatnonzero(first[kept])
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(body)).astype(np.int32)), pa.py_buffer(body)])
        coded = pieces.dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), b" ")[0].as_py()
        words = joined.split(b" ") if joined else []
        if len(self.known) > most:
            self.older, self.known = self.known, {}
        known = self.known
        if missing := [w for w in words if w not in known]:
            self._learn(missing)
        return _spread([known[w] for w in words], coded.indices.to_numpy(), closes, end)


class _Words:
    """Ids of texts by the tokenizer, which drops blanks: what stands between plain spaces or line ends is encoded once
    and kept, letters and the marks after them apart. Neither the tokenizer's normaliser nor its pattern looks across
    these. A text that holds what may be a special token's string is encoded as a whole."""

    MOST = 300_000
    MARKS = ".,;:!?"
    #: Letters below this have no decomposed form, so a word of them is one piece of the pattern, which ends with an end-of-word token.
    PLAIN = "\u0100"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.between = self.special[-1]
        self.mark = self.tokenizer.token_to_id(self.between)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(IDS, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.lower = all((self.tokenizer.normalizer.normalize_str(x) if self.tokenizer.normalizer else x) == x.lower() for x in map(chr, range(256)) if x.isalpha())
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.pieces = _Pieces(self.tokenizer, self.ends) if _Pieces.fits(self.tokenizer) else None

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, "<u2") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words not known yet: those used before the last clearance are taken over, the others encoded in one call, told
        apart by a special token between them."""
        known, older = self.known, self.older
        new: dict[str, tuple[str, str]] = {}
        parts: set[str] = set()
        letters: set[str] = set()
        for word in words:
            if (ids := older.get(word)) is not None:
                known[word] = ids
                continue
            bare = word.rstrip(self.MARKS)
            if bare.isalpha() and max(bare) < self.PLAIN:
                cut = (bare.lower(), word[len(bare) :]) if self.lower else (bare, word[len(bare) :])
                if cut[0] not in known:
                    letters.add(cut[0])
            else:
                cut = (word, "")
            new[word] = cut
            parts.update(part for part in cut if part and part not in known)
        parts -= letters
        if letters:
            order = list(letters)
            ids = self._library([" ".join(order)])[0]
            ends = (np.flatnonzero(self.ends.take(ids)) + 1).tolist()
            if len(ends) == len(order) and ends[-1] == len(ids):
                raw = ids.tobytes()
                for part, a, b in zip(order, [0, *ends[:-1]], ends, strict=True):
                    known[part] = raw[2 * a : 2 * b]
            else:  # another vocabulary, whose words have no mark of their own at the end
                parts |= letters
        if parts:
            order = list(parts)
            ids = self._library([self.between.join(order)])[0]
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            for part, a, b in zip(order, cuts[:-1], cuts[1:], strict=True):
                known[part] = ids[a + 1 : b].tobytes()
        for word, (bare, marks) in new.items():
            known[word] = known[bare] + known[marks]

    def encode_all(self, texts: pa.Array | list[str], end: int) -> list[np.ndarray]:
        """The ids of each text (null: empty) and ``end``."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        texts = texts.fill_null("")
        odd = self.pieces.odd(texts, self.special) if self.pieces else np.ones(len(texts), bool)
        others = iter(self._encode_others(texts.filter(pa.array(odd)).to_pylist(), end) if odd.any() else [])
        if odd.all():
            return list(others)
        plain = self.pieces.encode(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, end, self.MOST)
        return [next(others) if o else ids for o, ids in zip(odd.tolist(), plain, strict=True)]

    def _encode_others(self, texts: list[str], end: int) -> list[np.ndarray]:
        odd = {i: x for i, x in enumerate(texts) if any(t in x for t in self.special)}
        plain = pa.array(["" if i in odd else x for i, x in enumerate(texts)] if odd else texts, pa.string())
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = parts.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > self.MOST:
            self.older, self.known = self.known, {"": b""}
        known = self.known
        if missing := [w for w in words if w not in known]:
            self._learn(missing)
        closes = parts.offsets.to_numpy()[1:].astype(np.int64)
        out = _spread([known[w] for w in words], coded.indices.to_numpy(), closes, end)
        for i, ids in zip(odd, self._library(list(odd.values())) if odd else [], strict=True):
            out[i] = np.append(ids, np.uint16(end)).astype("<u2")
        return out

    def encode(self, text: str, end: int) -> np.ndarray:
        return self.encode_all([text], end)[0]


def _words(path: str) -> _Words:
    return worker_cache(("words", path), lambda: _Words(path))


#: Bytes of text of a bucket, about: what one file's lanes hold. A task makes one bucket. Small tables are cut into buckets
#: of the least size, as long as there are cores without one.
BUCKET_BYTES, LEAST_BYTES = 40 << 20, 4 << 20


def write_tokens(docs: DataFrame, path: str, end: int = 2, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Encode every whole text, append ``end``, and write the files: bucket, part, n_docs, n_ids and data, one row per
    file, in the shared folder. Buckets are ranges of doc_id (nulls first), each one task's, and files within them follow
    doc_id, so (bucket, part) is the order of all ids. Rows that share an id are put in order by their texts and may
    fill several buckets. The vocabulary must have ids below 65536.

    Null texts are empty (the end alone); rows that repeat are written each; other columns are not read; an empty table
    gives no file."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    rows = docs.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "h", "row"]
    buckets = max(1, -(-size // bucket_bytes), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))
    dealt = rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def pack(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bucket = _words(path), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        part, size = 0, 0

        def flush() -> pa.RecordBatch:
            pa.default_memory_pool().release_unused()  # the coder's tables are numpy's
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "part": part, "n_docs": len(held), "n_ids": size, "data": write_file(held)}], schema=schema)

        for frame in without_gc(frames):
            for doc_id, ids in zip(frame.column(0).to_pylist(), own.encode_all(frame.column("text"), end), strict=True):
                if size >= FILE_IDS:
                    yield flush()
                    held, part, size = [], part + 1, 0
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield flush()

    return materialise(dealt.mapInArrow(pack, "bucket int, part int, n_docs long, n_ids long, data binary"), "token-files")


def read_tokens(files: DataFrame, digest: bool = False) -> DataFrame:
    """The documents of the files in order: doc_id, start (ids of all documents before), n_tokens, and the ids (binary,
    little-endian u32) or, with ``digest``, their CRC-32. A file that fails a checksum fails the job."""
    bound_batches(files.sparkSession)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        pa.default_memory_pool().release_unused()
        for frame in frames:
            for bucket, part, data in zip(*(frame.column(i).to_pylist() for i in range(3)), strict=True):
                docs = read_file(data)
                sizes = np.array([len(x) for _, x in docs], np.int64)
                raw = (x.astype("<u4").tobytes() for _, x in docs)
                last = pa.array([zlib.crc32(r) for r in raw], pa.int64()) if digest else pa.array(list(raw), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(docs), pa.int32()), pa.array([part] * len(docs), pa.int32()), pa.array([d for d, _ in docs], pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), last], names=["bucket", "part", "doc_id", "inside", "n_tokens", "last"])

    # A file to a task: all have about the same size.
    dealt = files.select("bucket", "part", "data").repartitionByRange(max(1, min(10_000, files.count())), "bucket", "part")
    found = dealt.mapInArrow(run, f"bucket int, part int, doc_id long, inside long, n_tokens long, last {'long' if digest else 'binary'}")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_start"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.select("bucket", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))
    starts = parts.join(buckets, "bucket").select("bucket", "part", (F.col("bucket_start") + F.col("part_start")).alias("base"))
    return found.join(starts, ["bucket", "part"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))
