"""Byte-level BPE as a finite-state transducer that is determinised while it runs.

``Transducer`` reads one pre-token byte by byte. A state is (last token emitted, bytes still undecided). After each
byte, every cut of the undecided bytes that some token may still span is a live hypothesis; the tokens that all
hypotheses begin with are emitted, so lookahead is bounded by the longest token. States and arcs are made the first
time a text needs them and reused afterwards.

The last token of each prefix is unique: a token may follow another only where merging their joined bytes gives just
these two back, and a chain of such pairs is the one merged form of the prefix.

``Utf8Stream`` is the decoder's state machine: it takes the bytes of any number of ids and gives the text that is
complete so far.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, without_gc, worker_cache

#: What a worker keeps before it starts anew: states, joint checks, and the outputs of short pre-tokens.
MAX_STATES, MAX_PAIRS, MAX_WORDS, WORD_BYTES = 120_000, 200_000, 300_000, 48
LEARN = 8
#: The pattern under which single blanks may be cut at (see Codec); texts are split as a whole by any other.
BLANK_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.ends: list[int] = [-1]  # the token that ends at a node
        self.inner: list[bool] = [True]  # whether a token goes on from a node
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                if (child := self.trie.get(key)) is None:
                    child = self.trie[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = child
            self.ends[node] = rank
        self.misses = 0
        self._pairs: dict[int, bool] = {}
        self._splits: dict[bytes, tuple[bytes, bytes]] = {}
        self._reset()

    def _reset(self) -> None:
        start = (-1, b"")
        self.states: dict[tuple[int, bytes], int] = {start: 0}
        self.keys: list[tuple[int, bytes]] = [start]
        #: Of each state the hypotheses (trie node since the cut, tokens before it), the earliest cut first.
        self.live: list[list[tuple[int, tuple[int, ...]]]] = [[(0, ())]]
        #: Where the first five bytes of a longer pre-token lead, and what they emit.
        self.jumps: dict[bytes, tuple[tuple[int, ...], int]] = {}
        self.arcs: dict[int, tuple[tuple[int, ...], int]] = {}  # state * 256 + byte -> tokens emitted, state

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges applied to ``piece`` in order of rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of ``token`` joins."""
        if (known := self._splits.get(token)) is None:
            parts, own = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
            while len(parts) > 2:
                _, i = min((self.ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self._splits[token] = parts[0], parts[1]
        return known

    def follows(self, before: int, token: int) -> bool:
        """Whether merging ``before`` + ``token`` gives these two back: no merge across the joint may come before the
        merges that make either side, as the two are taken apart again from the later-made side. ``before`` -1: whether
        the token's own bytes merge to it."""
        if (known := self._pairs.get(before << 32 | token)) is not None:
            return known
        if len(self._pairs) > MAX_PAIRS:
            self._pairs.clear()
        if before < 0:
            known = len(self.merged(self.bytes_of[token])) == 1
        else:
            left, right, get, limit, known = self.bytes_of[before], self.bytes_of[token], self.ranks.get, 1 << 60, True
            while True:
                if get(left + right, 1 << 60) < limit:
                    known = False
                    break
                a, b = get(left), get(right)
                if a > b and len(left) > 1 or len(right) == 1:
                    if len(left) == 1:
                        break
                    limit, left = a, self._split(left)[1]
                else:
                    limit, right = b + 1, self._split(right)[0]
        self._pairs[before << 32 | token] = known
        return known

    def _arc(self, at: int, byte: int) -> tuple[tuple[int, ...], int]:
        last, pending = self.keys[at]
        trie, ends, inner, pairs = self.trie, self.ends, self.inner, self._pairs
        full, live = None, []
        for node, chain in self.live[at]:
            if (child := trie.get(node << 8 | byte)) is None:
                continue
            if full is None and (token := ends[child]) >= 0:
                before = chain[-1] if chain else last
                known = pairs.get(before << 32 | token)
                if self.follows(before, token) if known is None else known:
                    full = (*chain, token)
            if inner[child]:
                live.append((child, chain))
        if full is not None:
            live.append((0, full))
        pending += bytes((byte,))
        common, first = 0, live[0][1]
        for i, token in enumerate(first):
            if any(len(chain) <= i or chain[i] != token for _, chain in live):
                break
            common = i + 1
        out = first[:common]
        if common:
            gone = sum([len(self.bytes_of[t]) for t in out])
            last, pending, live = out[-1], pending[gone:], [(node, chain[common:]) for node, chain in live]
        key = (last, pending)
        if (to := self.states.get(key)) is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.live.append(live)
        arc = self.arcs[at << 8 | byte] = out, to
        return arc

    def _rest(self, at: int, tail: bytes) -> list[int]:
        """What a pre-token that ends with ``tail`` still emits. Ends are mostly a word's own, so they make no states:
        the hypotheses are carried along and the one that a token completes at the last byte is the answer."""
        last, pending = self.keys[at]
        if last < 0 and (whole := self.ranks.get(pending + tail)) is not None:
            return [whole]  # a pre-token that is itself a token stays whole
        trie, ends, pairs, live, full = self.trie, self.ends, self._pairs, self.live[at], None
        for byte in tail:
            ahead, full = [], None
            for node, chain in live:
                if (child := trie.get(node << 8 | byte)) is None:
                    continue
                if full is None and (token := ends[child]) >= 0:
                    before = chain[-1] if chain else last
                    known = pairs.get(before << 32 | token)
                    if self.follows(before, token) if known is None else known:
                        full = (*chain, token)
                ahead.append((child, chain))
            if full is not None:
                ahead.append((0, full))
            live = ahead
        return list(full or ())

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token. Where an arc is missing near the end of a word, the rest is mostly the word's own:
        it is followed without arcs, and only one such miss in LEARN makes some."""
        if not piece:
            return []
        if len(self.keys) > MAX_STATES:
            self._reset()
        at, ids, arcs, begin = 0, [], self.arcs, 0
        if len(piece) > 5 and (jump := self.jumps.get(piece[:5])) is not None:
            (ids, at), begin = jump, 5
            ids = [*ids]
        n = len(piece) - 1
        for i in range(begin, n):
            arc = arcs.get(at << 8 | piece[i])
            if arc is None:
                if i >= 5 and n - i <= 12:
                    self.misses += 1
                    if self.misses % LEARN:
                        return ids + self._rest(at, piece[i:])
                arc = self._arc(at, piece[i])
            out, at = arc
            if out:
                ids += out
            if i == 4:
                self.jumps[piece[:5]] = (tuple(ids), at)
        return ids + self._rest(at, piece[n:])


class Utf8Stream:
    """Incremental UTF-8: ``feed`` gives the text that is complete, ``close`` what is left (U+FFFD for a cut end).

    The state is the tail of an unfinished character, at most three bytes; a lead byte says how many must follow."""

    def __init__(self):
        self.tail = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 4 if byte & 0xF8 == 0xF0 else 3 if byte & 0xF0 == 0xE0 else 2 if byte & 0xE0 == 0xC0 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        keep = self.open_tail(data)
        self.tail = data[len(data) - keep :] if keep else b""
        return (data[: len(data) - keep] if keep else data).decode("utf-8", "replace")

    def close(self) -> str:
        text, self.tail = self.tail.decode("utf-8", "replace"), b""
        return text


class _OtherBlanks(Exception):
    """A text has blanks that are not single spaces or line ends between words."""


class Codec:
    """Text to ids and back, with the outputs of what stands between single blanks kept.

    Under the pattern BLANK_CUT, a text whose blanks are single spaces and line ends between other characters is cut there: the pattern never joins
    characters across such a blank, a space goes with what follows it and a line end stands alone. Any other text,
    and every text under another pattern, is split by the pattern as a whole."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.machine, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.bytes_of, self.cut_blanks = self.machine.bytes_of, pattern == BLANK_CUT
        self.known: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        out = array("I", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= WORD_BYTES:
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            self.known[piece] = out
        return out

    def _whole(self, text: str) -> bytes:
        known, make = self.known, self._piece
        return b"".join([known.get(piece) or make(piece) for piece in self.pattern.findall(text)])

    def _word(self, kept: dict[str, bytes], word: str, space: str) -> bytes:
        if not word or word != word.strip():
            raise _OtherBlanks
        if word[-1] in ".,;:!?" and word[-2:-1].isalpha():  # such a mark is a pre-token of its own
            bare = word[:-1]
            return (kept.get(bare) or self._word(kept, bare, space)) + (self.known.get(word[-1]) or self._piece(word[-1]))
        if word.isalpha():
            out = array("I", self.machine.encode((space + word).encode())).tobytes()
        else:
            out = self._whole(space + word)
        if len(word) <= WORD_BYTES:
            if len(kept) >= MAX_WORDS:
                kept.clear()
            kept[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """All ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cut_blanks:
            return self._whole(text)
        plain, spaced, make, parts = self.plain, self.spaced, self._word, []
        try:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                parts.append(plain.get(first) or make(plain, first, ""))
                parts += [spaced.get(word) or make(spaced, word, " ") for word in rest]
                parts.append(self.newline)
        except _OtherBlanks:
            return self._whole(text)
        parts.pop()
        return b"".join(parts)

    @property
    def newline(self) -> bytes:
        return self.known.get("\n") or self._piece("\n")

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4

    def decode(self, ids: bytes, step: int = 65536) -> Iterator[str]:
        """The text of ids, a bounded number of ids at a time."""
        stream, numbers, bytes_of = Utf8Stream(), np.frombuffer(ids, "<u4"), self.bytes_of
        for at in range(0, len(numbers), step):
            yield stream.feed(b"".join([bytes_of[i] for i in numbers[at : at + step].tolist()]))
        yield stream.close()


def codec(path: str, pattern: str) -> Codec:
    return worker_cache(("bpe", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """Encode every whole text, then decode the ids.

    Returns doc_id and n_tokens with either ids (binary, little-endian u32) and the decoded text, or their SHA-256
    digests. Null texts are empty: no ids, the digest of nothing. Repeated rows give repeated results; other columns
    are not read. One text is in memory at a time beside its Arrow batch.
    """
    bound_batches(docs.sparkSession)
    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    kinds = ["string", "string"] if digest else ["binary", "string"]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((n, pa.binary() if k == "binary" else pa.string()) for n, k in zip(names, kinds, strict=True))])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for frame in without_gc(frames):  # the machine's many small tuples hold no cycles; scanning them would double the time
            counts, first, second = [], [], []
            for text in column(frame, "text"):
                ids = own.encode(text or "")
                counts.append(len(ids) // 4)
                if digest:
                    back = hashlib.sha256()
                    for part in own.decode(ids):
                        back.update(part.encode())
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(back.hexdigest())
                else:
                    first.append(ids)
                    second.append("".join(own.decode(ids)))
            yield pa.RecordBatch.from_pydict({"doc_id": frame.column(0), "n_tokens": counts, names[0]: first, names[1]: second}, schema=schema)

    ddl = f"doc_id long, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)
