"""Language of words and documents by a linear-chain conditional random field.

States are languages. A word's potentials are sums of learned weights of its features: hashed prefixes and suffixes of
one to four letters, letter n-grams of two and three and the word itself, and its membership in each language's lexicon
(words that several sampled texts of the language hold). Transitions between the languages of neighbouring words are
learned too, from whole texts and from sequences in which stretches of several languages are put together. Words are
labelled by forward-backward over the whole text; a document's language is the one with most expected words.

Fitting takes a bounded sample of labelled rows (``SAMPLE_DOCS`` of a language, about ``SAMPLE_ROWS`` in all), with their
whole texts; every labelled language is in it. Prediction covers every word of every text.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, column, crc_mod, without_gc, worker_cache

#: The bounds of the fitting sample: rows of a language, and rows in all (each language keeps at least LEAST_DOCS).
SAMPLE_DOCS, SAMPLE_ROWS, LEAST_DOCS = 100, 600, 8
#: Mean posterior below which ``keep_identified`` rejects a document.
LEAST_SCORE = 0.4
#: Words of a piece. A chain runs on from piece to piece: messages are carried over the cuts exactly.
SPAN = 48
BITS = 16
#: Words whose potentials a worker keeps; numbers that one step of the recursions works on, about.
MAX_WORDS, STEP_SIZE = 500_000, 1 << 18

def letters_of(words: list[str]) -> list[str]:
    """The words' letters in lower case."""
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in (word.lower() for word in words)]


def features(words: list[str], lexicon: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the words' letters, and the place of the word that each belongs to; none for a token without letters.
    Hashed affixes, n-grams and whole words come first; a word in the lexicon of language j also has feature 2**BITS + j.
    All words are worked on together: one array of code points, hashed at every start."""
    letters = letters_of(words)
    sizes = np.array([len(x) for x in letters], np.int64)
    points = np.frombuffer("".join(letters).encode("utf-32-le", "surrogatepass"), np.uint32)
    some = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[some]
    size, word = sizes[some], np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(first + size, size) - np.arange(len(points))  # letters from here to the word's end
    found: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def grams(kind: int, at: np.ndarray, n: int) -> None:
        h = np.full(len(at), kind, np.uint32)
        for k in range(n):
            h = (h ^ points[at + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        found.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
        owner.append(word[at])

    for k in range(1, 5):  # prefixes and suffixes
        long = size >= k
        grams(k, first[long], k)
        grams(4 + k, (first + size)[long] - k, k)
    for k in (2, 3):
        grams(8 + k, np.flatnonzero(left >= k), k)
    if len(some):  # the word itself, as a polynomial in its code points
        place = np.arange(len(points)) - np.repeat(first, size)
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
        whole = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * power[place], first)
        found.append((whole >> np.uint64(64 - BITS)).astype(np.uint32))
        owner.append(some)
    if lexicon:
        listed = [(i, j) for i, w in enumerate(letters) if w for j in lexicon.get(w, ())]
        found.append(np.array([(1 << BITS) + j for _, j in listed], np.uint32))
        owner.append(np.array([i for i, _ in listed], np.int64))
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # languages x languages, log potentials
    lexicon: dict[str, list[int]]  # letters of a word: the languages that list it

    def emit(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The potentials of words (words x languages), and whether they have letters."""
        found, owner = features(words, self.lexicon)
        n = np.bincount(owner, minlength=len(words))
        sums = [np.bincount(owner, self.weights[found, j], len(words)) for j in range(len(self.languages))]
        return (np.stack(sums, axis=1) / np.sqrt(np.maximum(n, 1))[:, None]).astype(np.float32), n > 0


def marginals(scores: np.ndarray, moves: np.ndarray, valid: np.ndarray, ahead: np.ndarray | None = None, back: np.ndarray | None = None, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward. scores: steps x sequences x states (log potentials); valid: steps x sequences, false after a
    sequence's end. Returns the posterior of each state, zero where not valid.

    ``ahead`` are forward messages from words before the sequences (a row of NaN: there are none) and ``back`` backward
    messages from words after them. The expected moves, over the cut before a sequence too, are added to ``pairs``."""
    steps, n, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(moves - moves.max()).astype(e.dtype)
    one = np.ones((k, 1), e.dtype)  # sums of rows by a product, faster than over a short axis
    fresh = np.ones(n, bool) if ahead is None else np.isnan(ahead[:, 0])
    start = np.full((n, k), 1.0 / k, e.dtype) if ahead is None else np.where(fresh[:, None], 1.0 / k, ahead).astype(e.dtype)
    now, forward = start, np.empty_like(e)
    for i in range(steps):
        new = now @ t
        if i == 0:
            new = np.where(fresh[:, None], now, new)
        new *= e[i]
        new /= new @ one
        now = forward[i] = np.where(valid[i][:, None], new, now)
    back = np.full((n, k), 1.0 / k, e.dtype) if back is None else back.astype(e.dtype)
    out = np.zeros_like(e)
    for i in range(steps - 1, -1, -1):
        post = forward[i] * back
        post /= post @ one
        out[i] = np.where(valid[i][:, None], post, 0)
        seen = back * e[i]
        if pairs is not None:
            use = valid[i] if i else valid[i] & ~fresh
            left, right = (forward[i - 1] if i else start)[use], seen[use]
            pairs += (left / (((left @ t) * right) @ one)).T @ right * t
        if i:
            new = seen @ t.T
            new /= new @ one
            back = np.where(valid[i][:, None], new, back)
    return out


def _transfers(scores: np.ndarray, moves: np.ndarray, valid: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each sequence does to a message: a matrix of states before and after it (rows sum to one) and the log of the
    sums of its rows. A ``fresh`` sequence begins with its own first word, without a move into it."""
    steps, n, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(moves - moves.max()).astype(e.dtype)
    one = np.ones((k, 1), e.dtype)
    all_, logs = np.broadcast_to(np.eye(k, dtype=e.dtype), (n, k, k)), np.zeros((n, k), np.float64)
    for i in range(steps):
        new = (all_.reshape(-1, k) @ t).reshape(n, k, k)
        if i == 0:
            new = np.where(fresh[:, None, None], all_, new)
        new = new * e[i][:, None, :]
        size = (new.reshape(-1, k) @ one).reshape(n, k)
        size = np.where(valid[i][:, None], size, 1)
        logs += np.log(size)
        all_ = np.where(valid[i][:, None, None], new / size[:, :, None], all_)
    return all_, logs


def chains(table: np.ndarray, flat: np.ndarray, counts: np.ndarray, moves: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """The posteriors of all words of whole texts. ``flat``: the words' rows in ``table`` (potentials), text after text;
    ``counts``: words of each text. A text is cut into pieces of SPAN words; the pieces' transfer matrices give the
    messages that enter each piece from both sides, so the posteriors are those of one uncut chain."""
    k = table.shape[1]
    n_seq = -(-counts // SPAN)
    starts, base = np.cumsum(counts) - counts, np.cumsum(n_seq) - n_seq
    place = np.arange(n_seq.sum()) - np.repeat(base, n_seq)
    first = np.repeat(starts, n_seq) + place * SPAN
    ends = np.repeat(starts + counts, n_seq)
    owners, size = np.repeat(n_seq, n_seq), len(first)
    post = np.zeros((len(flat), k), table.dtype)

    def piece(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps = int(min(SPAN, (ends - first)[which].max()))
        at = first[which][None, :] + np.arange(steps)[:, None]
        ok = at < ends[which][None, :]
        return at, ok, table[np.where(ok, flat[np.minimum(at, len(flat) - 1)], 0)]

    ahead, back = np.full((size, k), np.nan), np.full((size, k), 1.0 / k)
    linked = np.flatnonzero(owners > 1)
    if len(linked):
        through, logs = np.empty((len(linked), k, k), table.dtype), np.empty((len(linked), k))
        step = max(64, STEP_SIZE // (k * k))
        for low in range(0, len(linked), step):
            own = linked[low : low + step]
            _, ok, scores = piece(own)
            through[low : low + step], logs[low : low + step] = _transfers(scores, moves, ok, place[own] == 0)
        scale = np.exp(logs - logs.max(axis=1, keepdims=True))
        at = np.full(size, -1)
        at[linked] = np.arange(len(linked))
        by_place = np.argsort(place[linked], kind="stable")
        cuts = np.searchsorted(place[linked][by_place], np.arange(int(place.max()) + 2))
        levels = [linked[by_place[a:b]] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i, own in enumerate(levels[:-1]):  # from the first pieces on
            now = np.full((len(own), k), 1.0 / k) if i == 0 else ahead[own]
            new = np.einsum("ni,nij->nj", now * scale[at[own]], through[at[own]])
            on = place[own] + 1 < owners[own]
            ahead[own[on] + 1] = (new / new.sum(axis=1, keepdims=True))[on]
        for own in levels[:0:-1]:  # from the last pieces back
            new = scale[at[own]] * np.einsum("nij,nj->ni", through[at[own]], back[own])
            back[own - 1] = new / new.sum(axis=1, keepdims=True)
    step = max(64, STEP_SIZE // k)
    order = np.argsort(first - ends, kind="stable")  # short pieces together
    for low in range(0, size, step):
        own = order[low : low + step]
        at, ok, scores = piece(own)
        post[at[ok]] = marginals(scores, moves, ok, ahead[own], back[own], pairs)[ok]
    return post


def _sequences(words: dict[str, list[list[str]]], rng: np.random.Generator, parts: int) -> tuple[list[list[str]], list[np.ndarray]]:
    """Words and labels of the fitting sequences: the sampled texts, and as many as ``parts`` that are put together from
    stretches of several languages."""
    langs = [lang for lang in sorted(words) if any(words[lang])]
    label = {lang: i for i, lang in enumerate(sorted(words))}
    texts = [doc for lang in langs for doc in words[lang] if doc]
    labels = [np.full(len(doc), label[lang]) for lang in langs for doc in words[lang] if doc]
    pools = {lang: [w for doc in words[lang] for w in doc] for lang in langs}
    for _ in range(parts if len(langs) > 1 else 0):
        text: list[str] = []
        own: list[int] = []
        while len(text) < SPAN:
            lang = langs[int(rng.integers(len(langs)))]
            n = int(rng.integers(4, 16))
            at = int(rng.integers(max(1, len(pools[lang]) - n)))
            part = pools[lang][at : at + n]
            text += part
            own += [label[lang]] * len(part)
        texts.append(text)
        labels.append(np.array(own))
    return texts, labels


def make_lexicon(words: dict[str, list[list[str]]]) -> dict[str, list[int]]:
    """The words that at least two sampled texts of a language hold, with the languages' numbers."""
    out: dict[str, list[int]] = {}
    for j, lang in enumerate(sorted(words)):
        seen: Counter = Counter()
        for doc in words[lang]:
            seen.update({w for w in letters_of(list(set(doc))) if w})
        for w, n in seen.items():
            if n > 1:
                out.setdefault(w, []).append(j)
    return out


def fit(words: dict[str, list[list[str]]], rounds: int = 15, rate: float = 0.25, decay: float = 1e-3, seed: int = 7) -> Crf:
    """Maximise the conditional likelihood of the labels by Adam over all sequences at once, with exact expectations."""
    langs = sorted(words)
    k, lexicon = len(langs), make_lexicon(words)
    texts, labels = _sequences(words, np.random.default_rng(seed), 2 * sum(map(len, words.values())))
    if not texts:
        return Crf(langs, np.zeros(((1 << BITS) + k, k), np.float32), np.zeros((k, k), np.float32), {})
    index: dict[str, int] = {}
    seqs = np.array([index.setdefault(w, len(index)) for text in texts for w in text])
    vocab, counts, gold = list(index), np.array([len(text) for text in texts]), np.concatenate(labels)
    flat, owner = features(vocab, lexicon)
    used, flat = np.unique(flat, return_inverse=True)
    scale = (1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(vocab)), 1)))[:, None]
    has = np.stack([np.bincount(seqs, gold == j, len(vocab)) for j in range(k)], axis=1)
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(counts) - counts] = False
    moved = np.bincount((np.roll(gold, 1) * k + gold)[inner], minlength=k * k).reshape(k, k)
    w, t = np.zeros((len(used), k)), np.zeros((k, k))
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        emit = np.stack([np.bincount(owner, w[flat, j], len(vocab)) for j in range(k)], axis=1) * scale
        pairs = np.zeros((k, k))
        post = chains(emit.astype(np.float32), seqs, counts, t, pairs)
        off = (np.stack([np.bincount(seqs, post[:, j], len(vocab)) for j in range(k)], axis=1) - has) * scale
        gw = np.stack([np.bincount(flat, off[owner, j], len(used)) for j in range(k)], axis=1) / len(seqs) + decay * w / len(used)
        gt = (pairs - moved) / len(seqs) + decay * t
        for x, g, a, b in zip((w, t), (gw, gt), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    full = np.zeros(((1 << BITS) + k, k), np.float32)
    full[used] = w
    return Crf(langs, full, t.astype(np.float32), lexicon)


def sample_words(docs: DataFrame, docs_each: int = SAMPLE_DOCS, rows: int = SAMPLE_ROWS) -> dict[str, list[list[str]]]:
    """The bounded fitting sample: of each language ``docs_each`` rows by hash of the id (fewer where languages are many,
    so that all have about ``rows``, but LEAST_DOCS at least), each with its whole text. Equal rows count once."""
    named = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n_langs = named.select("lang").distinct().count()
    each = min(docs_each, max(LEAST_DOCS, rows // max(1, n_langs)))
    keyed = named.withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "h")
    picked = keyed.select("doc_id", "lang", "h").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), F.col("h").alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of")) & (F.col("h") == F.col("key"))
    chosen = keyed.join(F.broadcast(picked.distinct()), same, "left_semi").dropDuplicates(["doc_id", "lang", "h"])  # picked: the bounded sample
    out: dict[str, list[list[str]]] = {}
    for lang, text in sorted(tuple(r) for r in chosen.select("lang", "text").collect()):
        out.setdefault(lang, []).append(text.split())
    return out


class _Potentials:
    """Word to row of potentials; row 0 is a token without letters."""

    def __init__(self, model: Crf):
        self.model, self.k = model, len(model.languages)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, self.k), np.float32)
        self.n = 1

    def add(self, words: list[str]) -> None:
        scores, lettered = self.model.emit(words)
        more = int(lettered.sum())
        while self.n + more > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[self.n : self.n + more] = scores[lettered]
        at = np.zeros(len(words), np.int64)
        at[lettered] = np.arange(self.n, self.n + more)
        self.rows.update(zip(words, at.tolist(), strict=True))
        self.n += more


def predict_words(model: Crf, known: _Potentials, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of every word (words x languages), whether it has letters, and the words of each text."""
    split = [text.split() for text in texts]
    if len(known.rows) > MAX_WORDS:
        known.clear()
    rows = known.rows
    if missing := list({word for words in split for word in words if word not in rows}):
        known.add(missing)
    counts = np.array([len(words) for words in split], np.int64)
    flat = np.fromiter((rows[word] for words in split for word in words), np.int32, int(counts.sum()))
    return chains(known.table, flat, counts, model.moves), flat > 0, counts


def predict(docs: DataFrame, model: Crf, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` and two columns called ``names``: the language with the largest mean posterior over the words with letters, and that
    mean (ties to the smaller language). ``und`` and 0 where the text is null or has no letter, or nothing was learned.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    token = uuid.uuid4().hex  # names this model's tables in the workers
    shared = spark.sparkContext.broadcast(model)  # 2**BITS x languages floats, and the lexicon of the sample
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_cs_text"))
    fields = [f for f in source.schema.fields if f.name != "_cs_text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{names[0]}` string, `{names[1]}` double"

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = worker_cache(("langid", token), lambda: _Potentials(own))
        for frame in without_gc(frames):
            texts = [t or "" for t in column(frame, "_cs_text")]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if own.languages:
                post, lettered, counts = predict_words(own, known, texts)
                owner = np.repeat(np.arange(len(texts)), counts)[lettered]
                sums = np.stack([np.bincount(owner, post[lettered, j], len(texts)) for j in range(len(own.languages))], axis=1)
                n = np.bincount(owner, minlength=len(texts))
                best = sums.argmax(axis=1)
                scores = np.clip(sums[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
                langs = [own.languages[b] if c else "und" for b, c in zip(best.tolist(), n.tolist(), strict=True)]
            arrays = [frame.column(i) for i in range(frame.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*frame.schema.names[:-1], *names])

    return source.mapInArrow(run, ddl)


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id and ``words``, an array of struct<word, lang, p> in order: every word of the text, its most probable language
    and that language's posterior; lang is ``und`` and p 0 for a token without letters. Null texts have no words; rows
    that repeat are labelled each."""
    bound_batches(docs.sparkSession)
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = worker_cache(("langid", token), lambda: _Potentials(own))
        for frame in frames:
            texts = [t or "" for t in column(frame, "text")]
            split = [t.split() for t in texts]
            if own.languages:
                post, lettered, _ = predict_words(own, known, texts)
                best = post.argmax(axis=1)
                langs = [own.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                p = np.where(lettered, post.max(axis=1), 0.0).astype(float).tolist()
            else:
                langs, p = ["und"] * sum(map(len, split)), [0.0] * sum(map(len, split))
            labels, out = iter(zip(langs, p, strict=True)), []
            for words in split:
                out.append([{"word": w, "lang": lang, "p": q} for w, (lang, q) in zip(words, labels, strict=False)])
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(out, kind)], names=["doc_id", "words"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, words array<struct<word: string, lang: string, p: double>>")


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.filter(crc_mod(F.col("doc_id"), 4) != 2)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from ``training_rows``, text and lang alone. Rows
    that repeat are predicted each; an empty table gives no rows; null ids count as the empty text in held_out."""
    model = fit(sample_words(training_rows(docs)))
    return predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that have a language: those without any letter, or null, go, and so do those in which no language
    takes a mean posterior of ``least``. With no label to learn from, all are without a language."""
    model = fit(sample_words(training_rows(docs)))
    found = predict(docs, model, tuple(docs.columns), ("_cs_lang", "_cs_score"))
    return found.filter(F.col("_cs_lang").eqNullSafe("und") == F.lit(False)).filter(F.col("_cs_score") >= least).select(docs.columns)
