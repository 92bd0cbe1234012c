"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a public one, fixed: all pieces of a SentencePiece model that
can stand in a word, as bytes, with all single bytes. Every language has a
probability for each piece. A word's likelihood is the sum over all its
segmentations into pieces, computed by the forward algorithm over the whole
word, whatever its length (values are rescaled as they run); a text's is the
product over its words, and the languages' posterior under their shares among
the permitted documents decides. The probabilities come from expectation
maximisation over the same segmentations (forward and backward) on a bounded
sample.

Words are scored once a table: a worker keeps the log-likelihoods of the words
it has seen under their 64-bit hashes.

Scale: one narrow pass, no shuffle; tasks receive the piece table (a few MB for
the vocabulary and its languages, whatever the corpus). Words are scored in
groups of like length; a long one is gone through in stretches, so memory does
not grow with its pieces. The fit uses at most ROWS documents of each language,
the least by hash of their id, found by a cut in the hash that follows from the
language's count of ids: no language is lost beside a larger one.

Defined cases: null text, empty text and text without a letter are ``und`` with
score 0; without any language to learn from every text is ``und`` with score 0;
ties go to the first language by code points; null ids are scored, held_out is
null for them, and are not learned from; rows that repeat an id teach once (the
least language and text) and score as any other; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.learning import fold
from docweft.llm.op02_sentencepiece import BYTE, MARK, NORMAL, USER_DEFINED, read_model
from docweft.llm.units import HashTable
from docweft.llm.words import U64, Texts, mix, slices, split, views, word_hashes

#: Documents of each language that the fit may use.
ROWS = 1000
ROUNDS = 3
#: Smoothing: the count that every piece has in every language before any is seen.
FLOOR = 0.02
#: Per byte, against products that vanish; every RESCALE bytes they are made one again.
LIFT, RESCALE = 64.0, 16
#: Bytes of words that are gone through together.
_GROUP = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")
_BASE = U64(0x9E3779B97F4A7C15)


def pieces_of(file: str | bytes) -> list[bytes]:
    """The vocabulary's pieces, a space for the marker, and all single bytes; those with a marker inside match no word."""
    found = {bytes([i]) for i in range(256)}
    for text, _, kind in read_model(file if isinstance(file, bytes) else Path(file).read_bytes()).pieces:
        if kind in (NORMAL, USER_DEFINED) and text and not text[1:].count(MARK):
            found.add(text.replace(MARK, " ").encode())
    return sorted(found)


class Lexicon:
    """Pieces by hash."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.sizes = np.array([len(x) for x in pieces])
        self.longest = int(self.sizes.max())
        self.table = HashTable(max(10, (4 * self.n).bit_length()))
        keys = np.zeros(self.n, U64)
        for i, piece in enumerate(pieces):
            value = 0
            for byte in piece:
                value = (value * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            keys[i] = value
        self.table.add(mix(keys + self.sizes.astype(U64)))  # rows in the order of the pieces

    def spans(self, words: np.ndarray) -> np.ndarray:
        """[l - 1, word, b - 1]: the piece of l bytes that ends before byte b, or ``n`` for none; words are rows of bytes."""
        rows, length = words.shape
        out = np.full((min(self.longest, length), rows, length), self.n, np.int32)
        value = np.zeros((rows, length + 1), U64)
        for l in range(1, len(out) + 1):  # noqa: E741
            value = value[:, : length - l + 1] * _BASE + words[:, l - 1 :] + U64(1)
            found = self.table.find(mix(value + U64(l)).ravel()).reshape(value.shape)
            out[l - 1][:, l - 1 :] = np.where(found < 0, self.n, found)
        return out

    def stretches(self, words: np.ndarray, back: bool = False):
        """(low, spans of the ends after low) over whole words, some _GROUP bytes at a time, from the left or from the right."""
        step = max(1, _GROUP // len(words))
        lows = range(0, words.shape[1], step)
        for low in reversed(lows) if back else lows:
            lead = min(low, self.longest - 1)
            yield low, self.spans(words[:, low - lead : low + step])[:, :, lead:]


def forward(words: np.ndarray, lexicon: Lexicon, lifted: np.ndarray, size: np.ndarray | None = None, keep: bool = False) -> tuple[np.ndarray, ...]:
    """Log-likelihood (words x languages) of the first ``size`` bytes of each row, lifted; with ``keep`` also alpha and its logs by position.

    ``lifted`` (pieces x languages) has a last row of zeros for no piece. What
    alpha holds times exp(log) is the sum over all segmentations up to there.
    """
    rows, length = words.shape
    size = np.full(rows, length) if size is None else size
    back = lexicon.longest
    alpha = np.zeros(((length if keep else back + RESCALE) + 1, rows, lifted.shape[1]))
    log = np.zeros(alpha.shape if keep else (1, *alpha.shape[1:]))
    now, shift, out = np.zeros(alpha.shape[1:]), 0, np.zeros(alpha.shape[1:])
    alpha[0] = 1
    for low, spans in lexicon.stretches(words):
        for b in range(low + 1, low + spans.shape[2] + 1):
            if not keep and b - shift >= len(alpha):  # only what a piece can reach is held
                alpha[:back] = alpha[len(alpha) - back :].copy()
                shift = b - back
            n = min(b, len(spans), back)
            at = b - shift
            alpha[at] = np.einsum("lnk,lnk->nk", alpha[at - n : at][::-1], lifted[spans[:n, :, b - low - 1]])
            if b % RESCALE == 0:
                by = np.where(alpha[at] > 0, alpha[at], 1.0)
                alpha[max(0, at - back + 1) : at + 1] /= by
                now = now + np.log(by)
                if keep:
                    log[max(0, at - back + 1) : at] = now
            if keep:
                log[at] = now
            done = size == b
            if done.any():
                out[done] = np.log(alpha[at][done]) + now[done]
    return (out, alpha, log) if keep else (out,)


def expected(words: np.ndarray, size: np.ndarray, counts: np.ndarray, lexicon: Lexicon, lifted: np.ndarray) -> np.ndarray:
    """Expected number of each piece in each language, for words (rows, padded to one length) with counts a language."""
    rows, length = words.shape
    out = np.zeros((lexicon.n + 1, lifted.shape[1]))
    total, alpha, log = forward(words, lexicon, lifted, size, True)
    beta, past, now = np.zeros_like(alpha), np.zeros_like(log), np.zeros(alpha.shape[1:])
    beta[size, np.arange(rows)] = 1
    for low, spans in lexicon.stretches(words, True):
        for b in range(low + spans.shape[2], low, -1):
            n = min(b, len(spans))
            # A word that ends here starts at 1; what its pending places hold is nothing yet.
            now = np.where((size == b)[:, None], 0.0, now)
            past[b] = now
            piece = spans[:n, :, b - low - 1]
            move = lifted[piece] * beta[b]
            own = alpha[b - n : b][::-1] * move * np.exp(log[b - n : b][::-1] + now - total) * counts
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(piece.ravel(), own[:, :, k].ravel(), lexicon.n + 1)
            beta[b - n : b] += move[::-1]
            if b % RESCALE == 0:
                by = np.where(beta[b - 1] > 0, beta[b - 1], 1.0)
                beta[b - n : b] /= by
                now = now + np.log(by)
    return out[:-1]


def like(size: np.ndarray):
    """Places of words of like length, with the length to pad to; at most _GROUP bytes together, or one longer word."""
    order = np.argsort(size, kind="stable")
    ranked, low = size[order], 0
    while low < len(order):
        most = int(ranked[low]) if ranked[low] <= 32 else int(ranked[low]) * 5 // 4
        high = min(int(np.searchsorted(ranked, most, "right")), low + max(1, _GROUP // most))
        yield order[low:high], int(ranked[high - 1])
        low = high


def _matrix(texts: Texts, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Rows: a space, then the word's bytes, then nothing up to ``length``."""
    at = np.arange(length)
    rows = np.where(at < size[:, None], texts.data[np.minimum(start[:, None] + at, len(texts.data) - 1)], 0)
    return np.concatenate([np.full((len(rows), 1), 0x20, np.uint8), rows.astype(np.uint8)], axis=1).astype(U64)


@dataclass
class Languages:
    names: list[str]
    shares: np.ndarray  # log
    chance: np.ndarray  # pieces x languages
    pieces: list[bytes]


def train(texts: list[bytes], langs: list[str], pieces: list[bytes], documents: dict[str, int] | None = None) -> Languages:
    """``documents``: how many of each language there are in all, for the shares."""
    names = sorted(set(langs), key=lambda x: x.encode())
    if not names:
        return Languages([], np.zeros(0), np.zeros((len(pieces), 0)), pieces)
    lexicon = Lexicon(pieces)
    data = b"\n".join(texts)
    joined = Texts(np.frombuffer(data, np.uint8), np.array([0, *np.cumsum([len(x) + 1 for x in texts])[:-1], len(data)], np.int64))
    words = split(joined)
    of = np.repeat([names.index(x) for x in langs], np.diff(words.of))
    keys, place, inverse = np.unique(word_hashes(joined, words), return_index=True, return_inverse=True)
    counts = np.stack([np.bincount(inverse[of == k], minlength=len(keys)) for k in range(len(names))], axis=1).astype(float)
    start, size = words.start[place], (words.end - words.start)[place]
    lift = LIFT ** lexicon.sizes[:, None]
    chance = np.full((lexicon.n, len(names)), 1.0 / lexicon.n)
    for _ in range(ROUNDS):
        lifted = np.concatenate([chance * lift, np.zeros((1, len(names)))])
        total = np.full_like(chance, FLOOR)
        for own, length in like(size):
            total += expected(_matrix(joined, start[own], size[own], length), size[own] + 1, counts[own], lexicon, lifted)
        chance = total / total.sum(axis=0)
    docs = np.array([(documents or {}).get(x) or langs.count(x) for x in names], float)
    return Languages(names, np.log(docs / docs.sum()), chance, pieces)


class Scorer:
    """Log-likelihoods of words, remembered."""

    def __init__(self, model: Languages, table_bytes: int = 1 << 25):
        self.model = model
        self.bits = max(10, (table_bytes // (8 * max(1, len(model.names)))).bit_length())
        self.lexicon = Lexicon(model.pieces)
        self.lifted = np.concatenate([model.chance * LIFT ** self.lexicon.sizes[:, None], np.zeros((1, len(model.names)))])
        self.clear()

    def clear(self) -> None:
        self.table = HashTable(self.bits)
        self.values = np.zeros((1 << self.bits - 1, len(self.model.names)))

    def _score(self, texts: Texts, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), len(self.model.names)))
        for own, length in like(size):
            found = forward(_matrix(texts, start[own], size[own], length), self.lexicon, self.lifted, size[own] + 1)[0]
            out[own] = found - (size[own] + 1)[:, None] * np.log(LIFT)
        return out

    def posterior(self, texts: Texts) -> np.ndarray:
        """Probability of each language for each text."""
        words = split(texts)
        keys = word_hashes(texts, words)
        rows = self.table.find(keys)
        new, place = np.unique(keys[rows < 0], return_index=True)
        if len(new):
            place = np.flatnonzero(rows < 0)[place]
            if len(new) > self.table.room:
                self.clear()
                new, place = np.unique(keys, return_index=True)
            own = self._score(texts, words.start[place], (words.end - words.start)[place])
            if len(new) > self.table.room:  # one text of more distinct words than the table takes
                values = own[np.searchsorted(new, keys)]
            else:
                self.values[self.table.add(new)] = own
                values = self.values[self.table.find(keys)]
        else:
            values = self.values[rows]
        sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
        like = sums[words.of[1:]] - sums[words.of[:-1]] + self.model.shares
        like -= like.max(axis=1, keepdims=True)
        p = np.exp(like)
        return p / p.sum(axis=1, keepdims=True)


_SCORERS: dict[int, Scorer] = {}


def fit(docs: DataFrame, vocabulary: str, learn: Column, rows: int = ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """``learn`` reads the column _id."""
    own = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    found = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_id", 0.02).alias("ids")).collect()  # a row a language
    if not found:
        return train([], [], pieces_of(vocabulary))
    counts = {r.lang: r.n for r in found}
    # A cut that leaves about twice as many ids as wanted (all, if there are no more), then the least by hash.
    cuts = [(r.lang, (2 * rows + 100) / r.ids) for r in found]
    spark = docs.sparkSession
    place = (F.xxhash64("_id").cast("double") / 2.0**64 + 0.5).alias("place")
    near = own.select("_id", "lang", place).join(F.broadcast(spark.createDataFrame(cuts, "lang string, cut double")), "lang").where("place < cut")
    held: dict = {}
    for r in sorted(near.select("_id", "lang", "place").distinct().toLocalIterator(), key=lambda r: (r["place"], str(r["_id"]))):
        mine = held.setdefault(r.lang, [])
        if len(mine) < rows:
            mine.append(r["_id"])
    kind = docs.schema[key].dataType.simpleString()
    few = spark.createDataFrame([(i,) for ids in held.values() for i in ids], f"_id {kind}").distinct()
    table = own.join(F.broadcast(few), "_id").groupBy("_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("_id", "x.lang", "x.text").toArrow().sort_by("_id")
    return train([x.encode("utf-8", "replace") for x in table.column("text").to_pylist()], table.column("lang").to_pylist(), pieces_of(vocabulary), counts)


def languages(docs: DataFrame, vocabulary: str, folds: int = 4, held: int = 2, rows: int = ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score of each row; learned from text and language outside the held-out fold."""
    model = fit(docs, vocabulary, fold(F.col("_id"), folds) != held, rows, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if known.names and id(known) not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[id(known)] = Scorer(known)
        scorer = _SCORERS[id(known)] if known.names else None
        for batch in slices(batches, "_text"):
            texts = views(batch.column("_text"))
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if known.names:
                p = scorer.posterior(texts)
                best = p.argmax(axis=1)
                for i, raw in enumerate(batch.column("_text").to_pylist()):
                    if raw and _LETTER.search(raw):
                        names[i], scores[i] = known.names[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(names), pa.array(scores)], names=["_key", "lang_pred", "score"])

    rows_ = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    out = rows_.mapInArrow(run, f"_key {kind}, lang_pred string, score double")
    return out.select(F.col("_key").alias(key), (fold(F.col("_key"), folds) == held).alias("held_out"), "lang_pred", "score")
