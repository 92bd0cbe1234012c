"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words, its pairs of words and
the character n-grams of its words (both ends marked), hashed to a fixed number
of buckets; a linear layer and a softmax give the probability of each class. Training is plain stochastic
gradient descent in numpy, one document a step, on the driver.

The output layer is linear in the mean, so scoring needs one number a bucket
(vector times the difference of the output columns): each text is a sum over a
small table, exact and whole, in one narrow pass without shuffle. The model that
tasks receive is that table, 1.5 MB whatever the corpus.

The fit uses at most ROWS labelled documents of each class, whole texts, and
corrects the output for the classes' shares among all permitted labels.

Defined cases: null and empty text score what the bias alone gives; null ids are
scored, held_out is null for them; repeated rows score equally; without labels
of both classes every score is 0.5; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.learning import fold, labelled
from docweft.llm.words import SPACE, U64, Texts, mix, slices, split, views, word_hashes

#: Labelled documents of each class that the fit may use.
ROWS = 1500
DIMS, EPOCHS, RATE, SEED = 8, 6, 0.6, 11
#: Buckets of words and word pairs, and of character n-grams.
WORD_BITS, GRAM_BITS = 17, 16
GRAMS = (2, 3, 4)
BUCKETS = (1 << WORD_BITS) + len(GRAMS) * (1 << GRAM_BITS)


def features(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, bounds of each text's features), a kind at a time."""
    words = split(texts)
    hashes = word_hashes(texts, words)
    yield (hashes >> U64(64 - WORD_BITS)).astype(np.int64), words.of
    # A pair is hashed by its words, or as a repeat if they are the same.
    if len(hashes) > 1:
        again = hashes[1:] == hashes[:-1]
        pair = np.where(again, U64(0xABCDEF), mix(hashes[1:] * U64(3) + hashes[:-1]))
        doc = np.repeat(np.arange(len(texts)), np.diff(words.of))
        inside = doc[1:] == doc[:-1]
        yield (pair[inside] >> U64(64 - WORD_BITS)).astype(np.int64), np.searchsorted(doc[1:][inside], np.arange(len(texts) + 1))
    chars, at = characters(texts)
    blank = np.concatenate([[0], np.cumsum(chars == 1)])
    for k, n in enumerate(GRAMS):
        if len(chars) < n:
            continue
        value = chars[: len(chars) - n + 1].copy()
        for i in range(1, n):
            value = value * np.uint32(0x01000193) + chars[i : len(chars) - n + 1 + i]
        value = (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
        # An n-gram lies in one word with its ends: only its first and last character may be a blank, and not all are.
        inner = blank[n - 1 : len(chars)] - blank[1 : len(chars) - n + 2]
        own = np.flatnonzero((inner == 0) & (blank[n:] - blank[: len(chars) - n + 1] < n))
        yield value[own].astype(np.int64) + (1 << WORD_BITS) + (k << GRAM_BITS), np.searchsorted(own, at)


def characters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a blank (1) for every separator and around each text, and where each text starts."""
    data = texts.data
    lead = (data & 0xC0) != 0x80
    many = np.concatenate([[0], np.cumsum(lead)])[texts.at]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(points) != many[-1]:  # not UTF-8: bytes stand for characters
        points, many = data.astype(np.uint32), texts.at
    blank = (points < 256) & SPACE[np.minimum(points, 255)]
    points = np.where(blank, np.uint32(1), points + np.uint32(2))
    return np.concatenate([np.insert(points, many[:-1], np.uint32(1)), np.ones(1, np.uint32)]), many + np.arange(len(many))


def train(texts: list[bytes], y: np.ndarray, prior: float | None = None) -> tuple[np.ndarray, float]:
    """(logit of class 1 a bucket, bias): a text's logit is the mean over its features plus the bias."""
    if len(np.unique(y)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(SEED)
    bags = []
    for raw in texts:
        t = Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
        every = [x for x, _ in features(t)]
        buckets, counts = np.unique(np.concatenate(every), return_counts=True)
        bags.append((buckets.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            buckets, share = bags[i]
            own = vectors[buckets]
            mean = share @ own
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= np.float32(0.05) * rate * p
            # A mean spreads one step over many vectors: each moves in proportion to its share of the largest.
            vectors[buckets] = own - rate * np.outer(share / share.max() if len(share) else share, back)
    share = y.mean()
    shift = 0.0 if prior is None else np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift)


def logits(texts: Texts, table: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for buckets, at in features(texts):
        sums = np.concatenate([[0.0], np.cumsum(table[buckets], dtype=np.float64)])
        total += sums[at[1:]] - sums[at[:-1]]
        count += np.diff(at)
    return total / np.maximum(count, 1) + bias


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = ROWS, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    sample, share = labelled(docs, labels, label, learn, rows, key, text)
    texts = [(x or "").encode("utf-8", "replace") for x in sample.column("text").to_pylist()]
    return train(texts, np.array(sample.column("y").to_pylist(), np.int64), share)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with score double, the probability of class 1 (a column of that name is replaced)."""
    kept = [f for f in docs.schema.fields if f.name != "score"]
    # Columns travel under their places, so no name of theirs can clash.
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)), T.StructField("score", T.DoubleType())])
    source = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in slices(batches, "text"):
            p = 1 / (1 + np.exp(-np.clip(logits(views(batch.column("text")), table, bias), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(p)], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], "score")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """key, held_out, score, predicted of each row; learned from rows outside the held-out fold."""
    model = fit(docs, labels, fold(F.col("_id"), folds) != held, rows=rows, key=key, text=text)
    scored = score(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), model, text)
    return scored.select(F.col(key), (fold(F.col(key), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """``docs`` without the rows that score under the threshold; learned from all labels of ``docs``."""
    columns = docs.columns
    bare = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    model = fit(docs, labels, F.lit(True), rows=rows, key=key, text=text)
    scored = score(bare, model, f"c{columns.index(text)}").where(F.col("score") >= threshold)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
