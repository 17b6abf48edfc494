"""Token counts that follow edits without counting a whole text again.

``build_trees`` counts every text once and keeps its tree as a row of a table; ``apply_edits`` takes a later batch of
edits to those rows and gives the edited trees, again rows of such a table, without looking at the text of an untouched
leaf. A document is a row of leaves, each holding some consecutive pre-tokens with their characters and tokens, under a
segment tree of subtree sums. An edit is located by descending the character sums, the touched leaves and the context
around them are split and encoded anew, and the sums on the paths to the root are updated.

Pre-tokens depend on at most the pre-token before them and on one character after them (the pattern looks one character
ahead, and only within blanks), so a region is settled once its new pre-tokens meet an old boundary beyond the edit
from the same starting point. Leaves that an edit leaves empty stay in the tree with sum zero; a leaf that has grown
past four times its size causes the tree to be laid out anew, which amortises to a constant per inserted character.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import MAX_WORDS, WORD_BYTES, load_ranks
from .common import bound_batches, column, materialise, worker_cache

#: Pre-tokens in a fresh leaf.
LEAF = 64


class PieceCounts:
    """Numbers of tokens of pre-tokens, those of short ones kept."""

    def __init__(self, path: str, pattern: str):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def _make(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= WORD_BYTES:
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            self.known[piece] = n
        return n

    def __call__(self, pieces: list[str]) -> list[int]:
        known, make = self.known, self._make
        return [known.get(piece) or make(piece) for piece in pieces]


class _Leaves:
    """A stored tree's leaves: a list of lists of pre-tokens, of which only the touched are made."""

    def __init__(self, texts: list[str], cuts: list[bytes]):
        self.texts, self.cuts, self.made = texts, cuts, {}

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, i: int) -> list[str]:
        if i not in self.made:
            out, at, text = [], 0, self.texts[i]
            for n in array("I", self.cuts[i]):
                out.append(text[at : at + n])
                at += n
            self.made[i] = out
        return self.made[i]

    def __setitem__(self, i: int, pieces: list[str]) -> None:
        self.made[i] = pieces

    def __iter__(self) -> Iterator[list[str]]:
        return (self[i] for i in range(len(self)))

    def rows(self) -> tuple[list[str], list[bytes]]:
        texts, cuts = list(self.texts), list(self.cuts)
        for i, leaf in self.made.items():
            texts[i], cuts[i] = "".join(leaf), array("I", map(len, leaf)).tobytes()
        return texts, cuts


class CountTree:
    """Token counts of one text under edits. ``count`` gives the numbers of tokens of pre-tokens."""

    def __init__(self, text: str | None, pattern: regex.Pattern, count: Callable[[list[str]], list[int]]):
        self.pattern, self.count = pattern, count
        self.recounted = 0  # characters encoded after an edit
        if text is not None:
            self._lay(pattern.findall(text))

    @classmethod
    def stored(cls, texts: list[str], cuts: list[bytes], tokens: list[int], pattern: regex.Pattern, count: Callable[[list[str]], list[int]]) -> CountTree:
        """The tree that ``rows`` described; leaves are split into pre-tokens when an edit touches them."""
        tree = cls(None, pattern, count)
        tree.leaves = _Leaves(texts, cuts)
        tree._sum(list(map(len, texts)), tokens)
        return tree

    def rows(self) -> tuple[list[str], list[bytes], list[int]]:
        """The leaves' texts, their pre-tokens' lengths (u32) and their numbers of tokens."""
        n = len(self.leaves)
        if isinstance(self.leaves, _Leaves):
            texts, cuts = self.leaves.rows()
        else:
            texts, cuts = ["".join(leaf) for leaf in self.leaves], [array("I", map(len, leaf)).tobytes() for leaf in self.leaves]
        return texts, cuts, self.tokens[self.size : self.size + n]

    def _lay(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        counts = self.count(pieces)
        self._sum([len("".join(leaf)) for leaf in self.leaves], [sum(counts[i : i + LEAF]) for i in range(0, max(1, len(pieces)), LEAF)])

    def _sum(self, chars: list[int], tokens: list[int]) -> None:
        size = 1
        while size < len(chars):
            size *= 2
        self.size = size
        none = [0] * (size - len(chars))
        self.chars, self.tokens = [0] * size + chars + none, [0] * size + tokens + none
        for i in range(size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def __len__(self) -> int:
        return self.chars[1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(piece for leaf in self.leaves for piece in leaf)

    def tokens_before(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before character ``at``."""
        leaf, start = self._find(at)
        out, node = 0, self.size + leaf
        while node > 1:
            if node & 1:
                out += self.tokens[node - 1]
            node >>= 1
        for piece in self.leaves[leaf]:
            start += len(piece)
            if start > at:
                break
            out += self.count([piece])[0]
        return out

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf for the end) and its first character."""
        node, start = 1, 0
        if at >= self.chars[1]:
            return len(self.leaves) - 1, self.chars[1] - self.chars[self.size + len(self.leaves) - 1]
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, pieces: list[str]) -> None:
        self.leaves[leaf] = pieces
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), sum(self.count(pieces))
        node >>= 1
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node >>= 1

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters at ``at`` by ``inserted``; places beyond the text count as its end."""
        at = max(0, min(at, len(self)))
        removed = max(0, min(removed, len(self) - at))
        if not removed and not inserted:
            return
        first, start = self._find(at)
        pieces, k = self.leaves[first], 0
        while k < len(pieces) and start + len(pieces[k]) < at:
            start += len(pieces[k])
            k += 1
        # Context: the pre-token before, wherever its leaf is; a run of blanks may be split off the one before that.
        for _ in range(2):
            while k == 0 and first > 0:
                first -= 1
                pieces = self.leaves[first]
                k = len(pieces)
            if k:
                k -= 1
                start -= len(pieces[k])
        head = self.leaves[first][:k]
        old: list[str] = []
        last, rest = first, self.leaves[first][k:]
        reach, taken, want = at + removed, start, 2
        while True:
            while rest and (taken < reach or want):
                piece = rest.pop(0)
                old.append(piece)
                want -= taken >= reach
                taken += len(piece)
            if taken >= reach and not want:
                made = self._split(old, start, at, removed, inserted, "".join(rest[:1]) or self._peek(last))
                if made is not None:
                    break
                want = 4
            elif last + 1 < len(self.leaves):
                last += 1
                rest = list(self.leaves[last])
            else:
                whole = "".join(old)
                made = self.pattern.findall(whole[: at - start] + inserted + whole[at - start + removed :])
                self.recounted += sum(map(len, made))
                break
        if first == last:
            self._set(first, [*head, *made, *rest])
        else:
            self._set(first, [*head, *made])
            for leaf in range(first + 1, last):
                self._set(leaf, [])
            self._set(last, rest)
        if len(self.leaves[first]) > 4 * LEAF:
            self._lay([piece for leaf in self.leaves for piece in leaf])

    def _peek(self, leaf: int) -> str:
        for at in range(leaf + 1, len(self.leaves)):
            if self.leaves[at]:
                return self.leaves[at][0]
        return ""

    def _split(self, old: list[str], start: int, at: int, removed: int, inserted: str, after: str) -> list[str] | None:
        """New pre-tokens for the region, or None if they do not yet end at its end with the same last pre-token."""
        whole = "".join(old)
        new = whole[: at - start] + inserted + whole[at - start + removed :]
        made, end = [], 0
        for match in self.pattern.finditer(new + after):
            if match.end() > len(new):
                break
            made.append(match[0])
            end = match.end()
        self.recounted += end
        if end != len(new):
            return None
        # In step with the old text: the last pre-token is an old one and lies beyond the edit.
        tail = len(whole) - (at - start + removed)
        settled = (not old and not after) or (bool(made) and bool(old) and made[-1] == old[-1] and len(old[-1]) < tail)
        return made if settled or not after else None


_TREE_DDL = "doc_id long, n_tokens long, n_chars long, leaf_texts array<string>, leaf_cuts array<binary>, leaf_tokens array<long>"
_TREE = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_chars", pa.int64()), ("leaf_texts", pa.list_(pa.string())), ("leaf_cuts", pa.list_(pa.binary())), ("leaf_tokens", pa.list_(pa.int64()))])
_EDITED_DDL = _TREE_DDL + ", n_tokens_before long, n_edits long, recounted_chars long"
_EDITED = pa.schema([*_TREE, ("n_tokens_before", pa.int64()), ("n_edits", pa.int64()), ("recounted_chars", pa.int64())])
_EDITS = "array<struct<at: long, removed: long, inserted: string>>"


def _counts(path: str, pattern: str) -> PieceCounts:
    return worker_cache(("edits", path, pattern), lambda: PieceCounts(path, pattern))


def build_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One stored tree per document: doc_id, n_tokens, n_chars and the leaves' texts, cuts and tokens. Null texts are
    empty; rows that repeat have a tree each; other columns are not read; an empty table gives no rows."""
    bound_batches(docs.sparkSession)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counts(path, pattern)
        for frame in frames:
            trees = [CountTree(text or "", own.pattern, own) for text in column(frame, "text")]
            texts, cuts, tokens = ([r[k] for r in map(CountTree.rows, trees)] for k in range(3))
            made = [[t.total for t in trees], [len(t) for t in trees], texts, cuts, tokens]
            yield pa.RecordBatch.from_arrays([frame.column(0), *(pa.array(c, f.type) for c, f in zip(made, list(_TREE)[1:], strict=True))], schema=_TREE)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TREE_DDL)


def apply_edits(trees: DataFrame, path: str, pattern: str, edits: str | DataFrame = "edits") -> DataFrame:
    """The stored trees after their edits, with n_tokens_before, n_edits and recounted_chars (characters encoded anew).

    ``edits`` names a column of ``trees`` (array of struct<at, removed, inserted>, in order), or is a table of doc_id,
    seq, at, removed and inserted, one row per edit: those of a document apply to each of its trees in order of seq, and
    documents without any keep theirs. Each edit applies to the text the last one left; places beyond it count as its
    end; null edits are none and null parts are 0 or empty. The edits of one document are one task's work."""
    bound_batches(trees.sparkSession)
    if not isinstance(edits, str):
        parts = F.struct("seq", F.struct(F.col("at").cast("long").alias("at"), F.col("removed").cast("long").alias("removed"), F.col("inserted").cast("string").alias("inserted")).alias("edit"))
        batch = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["edit"]).alias("edits"))
        trees, edits = trees.join(batch, "doc_id", "left"), "edits"

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counts(path, pattern)
        for frame in frames:
            out: list[list] = [[] for _ in range(8)]
            for texts, cuts, tokens, given in zip(*(column(frame, c) for c in ("leaf_texts", "leaf_cuts", "leaf_tokens", "edits")), strict=True):
                tree = CountTree.stored(texts, cuts, tokens, own.pattern, own)
                before, todo = tree.total, [e for e in given or [] if e]
                for e in todo:
                    tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                for held, value in zip(out, (tree.total, len(tree), *tree.rows(), before, len(todo), tree.recounted), strict=True):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([frame.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(_EDITED)[1:], strict=True))], schema=_EDITED)

    return trees.select("doc_id", "leaf_texts", "leaf_cuts", "leaf_tokens", F.col(edits).cast(_EDITS).alias("edits")).mapInArrow(run, _EDITED_DDL)


def texts_of(trees: DataFrame) -> DataFrame:
    """doc_id and text of stored trees."""
    return trees.select("doc_id", F.array_join("leaf_texts", "").alias("text"))


def standard_edits(n_chars: str = "n_chars") -> Column:
    """The edits of the registered query, applied one after another: a phrase goes in at a third of the text, five
    characters go out at the half, and seven are replaced at two thirds."""
    n = F.col(n_chars)
    edit = lambda at, removed, inserted: F.struct(F.floor(at).cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    return F.array(edit(n / 3, 0, " as amended,"), edit(n / 2, 5, ""), edit(2 * n / 3, 7, "x 2nd ed."))


def count_with_edits(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_edits, n_chars_after, recounted_chars for every whole text: its tree is built
    and written, and the stored tree is edited by ``standard_edits``. Edge cases are those of the two steps."""
    trees = materialise(build_trees(docs, path, pattern), "edit-trees")
    edited = apply_edits(trees.withColumn("edits", standard_edits()), path, pattern)
    return edited.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), "n_edits", F.col("n_chars").alias("n_chars_after"), "recounted_chars")
