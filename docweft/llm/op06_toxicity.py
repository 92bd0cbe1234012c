"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A token is a word, A-Z folded; a word of over LONGEST bytes is several tokens,
stretches that overlap so that each of its n-grams is in one. A token's input is a learned vector of the word, if the
sample has it often enough, beside the mean of learned vectors of its hashed
character n-grams (3 to 5 bytes, with both ends marked). Two gated recurrent
layers read a window of tokens in either direction, attention pools their states,
and a logistic unit scores the window. A text's score is the greatest over all
its windows of WINDOW tokens, each STRIDE after the one before.

Training is written out in numpy (back-propagation through time, Adam). Labels
are of documents, so after a first pass over all windows a toxic document
teaches with the windows that score highest, a clean one with those that do too.

Scale: one narrow pass without shuffle; tasks receive the weights, about 2 MB
whatever the corpus. A worker computes a word's input once a table and runs
windows in batches of a fixed number, so memory does not grow with a text. The fit
uses at most ROWS labelled documents of each class, whole texts.

Defined cases: null, empty and wordless text is one window of no tokens and
scores 0; null ids are scored, held_out is null for them; repeated rows score
equally; without labels of both classes every score is 0; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.learning import fold, labelled
from docweft.llm.units import HashTable
from docweft.llm.words import U64, Texts, Words, slices, split, views, word_hashes

#: Labelled documents of each class that the fit may use.
ROWS = 1500
WINDOW, STRIDE = 48, 32
HIDDEN, WORD_DIMS, CHAR_DIMS = 8, 8, 8
CHAR_BITS, GRAMS, LONGEST = 14, (3, 4, 5), 40
OFTEN = 12
SEED = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are not part of a word's inside when they stand at its ends.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _cut(words: Words) -> Words:
    """Those of over LONGEST bytes as stretches of LONGEST, evenly spaced, each n-gram whole in one of them."""
    size = words.end - words.start
    if not len(size) or size.max() <= LONGEST:
        return words
    lap = max(GRAMS) - 1
    parts = np.where(size > LONGEST, -(-(size - lap) // (LONGEST - lap)), 1)
    own = np.repeat(np.arange(len(size)), parts)
    bounds = np.concatenate([[0], np.cumsum(parts)])
    start = words.start[own] + (np.arange(len(own)) - bounds[own]) * (size[own] - LONGEST) // np.maximum(parts[own] - 1, 1)
    return Words(start, np.minimum(start + LONGEST, words.end[own]), bounds[words.of])


def tokens(texts: Texts) -> Words:
    """Words without the signs at their ends, long ones cut; words of signs only stay as they are."""
    words = split(texts)
    if not len(words):
        return words
    plain = _PLAIN[texts.data]
    place = np.arange(len(plain))
    nxt = np.minimum.accumulate(np.where(plain, place, len(plain))[::-1])[::-1]
    prv = np.maximum.accumulate(np.where(plain, place, -1))
    start, end = nxt[words.start], prv[words.end - 1] + 1
    none = start >= words.end
    return _cut(Words(np.where(none, words.start, start), np.where(none, words.end, end), words.of))


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of some words."""
    out, of = [], []
    size = end - start
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        spot = start[rows][:, None] + np.arange(int(length))
        chars = np.full((len(rows), int(length) + 2), 1, np.uint32)
        chars[:, 1:-1] = _LOWER[data[spot]]
        chars[:, -1] = 2
        for n in GRAMS:
            if chars.shape[1] < n:
                continue
            value = np.zeros((len(rows), chars.shape[1] - n + 1), np.uint32)
            for i in range(n):
                value = value * np.uint32(0x01000193) + chars[:, i : chars.shape[1] - n + 1 + i] + np.uint32(n)
            value = (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)
            out.append(value.ravel())
            of.append(np.repeat(rows, value.shape[1]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out).astype(np.int64), np.concatenate(of)


@dataclass
class Net:
    vocabulary: np.ndarray  # sorted hashes of the words with a vector
    p: dict[str, np.ndarray]

    @property
    def trained(self) -> bool:
        return bool(self.p)


def _start(rng: np.random.Generator, words: int) -> dict[str, np.ndarray]:
    d, h = WORD_DIMS + CHAR_DIMS, HIDDEN
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    p = {"word": draw(words + 1, WORD_DIMS, s=0.1), "char": draw(1 << CHAR_BITS, CHAR_DIMS, s=0.5)}
    p["word"][-1] = 0
    for side in "fb":
        p |= {f"W{side}": draw(d, 3 * h, s=d**-0.5), f"U{side}": draw(h, 3 * h, s=h**-0.5), f"b{side}": np.zeros(3 * h, np.float32)}
    p |= {"A": draw(2 * h, h, s=(2 * h) ** -0.5), "a": draw(h, s=h**-0.5), "o": draw(2 * h, s=(2 * h) ** -0.5), "c": np.full(1, -1.0, np.float32)}
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _scan(p: dict, side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, rows, HIDDEN) of one direction over x (time, rows, inputs); padding holds the state."""
    h = HIDDEN
    pre = x @ p[f"W{side}"] + p[f"b{side}"]
    state, states, trace = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape[:2], h), np.float32), []
    recurrent = np.ascontiguousarray(p[f"U{side}"][:, : 2 * h]), np.ascontiguousarray(p[f"U{side}"][:, 2 * h :])
    for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
        gates = _sigmoid(pre[t, :, : 2 * h] + state @ recurrent[0])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(pre[t, :, 2 * h :] + (r * state) @ recurrent[1])
        live = mask[t][:, None] * z
        before, state = state, state + live * (new - state)
        states[t] = state
        if keep:
            trace.append((t, before, z, r, new))
    return states, trace


def _pool(p: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    inner = np.tanh(states @ p["A"])
    e = np.where(mask, inner @ p["a"], np.float32(-30))
    e -= e.max(axis=0)
    w = np.exp(e) * mask
    w /= np.maximum(w.sum(axis=0), 1e-9)
    return inner, w, np.einsum("tn,tnh->nh", w, states)


def forward(p: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logit of each window; x (time, rows, inputs), mask (time, rows)."""
    states = np.concatenate([_scan(p, side, x, mask, False)[0] for side in "fb"], axis=2)
    return _pool(p, states, mask)[2] @ p["o"] + p["c"]


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """(d loss / d parameter, d loss / d x, loss) of the mean cross-entropy."""
    h = HIDDEN
    scans = {side: _scan(p, side, x, mask, True) for side in "fb"}
    states = np.concatenate([scans[side][0] for side in "fb"], axis=2)
    inner, w, pooled = _pool(p, states, mask)
    prob = _sigmoid(pooled @ p["o"] + p["c"])
    back = ((prob - y) / len(y)).astype(np.float32)
    g = {"o": pooled.T @ back, "c": back.sum(keepdims=True)}
    d_pool = back[:, None] * p["o"]
    d_states = w[:, :, None] * d_pool
    d_w = np.einsum("nh,tnh->tn", d_pool, states)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    g["a"] = np.einsum("tn,tnh->h", d_e, inner)
    d_inner = d_e[:, :, None] * p["a"] * (1 - inner * inner)
    g["A"] = np.einsum("tnk,tnh->kh", states, d_inner)
    d_states = d_states + d_inner @ p["A"].T
    d_x = np.zeros_like(x)
    for k, side in enumerate("fb"):
        U = p[f"U{side}"]
        d_pre, dU, carry = np.zeros((*x.shape[:2], 3 * h), np.float32), np.zeros_like(U), np.zeros((x.shape[1], h), np.float32)
        for t, before, z, r, new in reversed(scans[side][1]):
            carry = carry + d_states[t, :, k * h : (k + 1) * h]
            live = mask[t][:, None]
            d_new = carry * live * z * (1 - new * new)
            d_z = carry * live * (new - before) * z * (1 - z)
            through = d_new @ U[:, 2 * h :].T
            d_r = through * before * r * (1 - r)
            gates = np.concatenate([d_z, d_r], axis=1)
            d_pre[t, :, : 2 * h], d_pre[t, :, 2 * h :] = gates, d_new
            dU[:, : 2 * h] += before.T @ gates
            dU[:, 2 * h :] += (r * before).T @ d_new
            carry = carry * (1 - live * z) + through * r + gates @ U[:, : 2 * h].T
        g[f"U{side}"] = dU
        g[f"W{side}"] = np.einsum("tnd,tng->dg", x, d_pre)
        g[f"b{side}"] = d_pre.sum(axis=(0, 1))
        d_x += d_pre @ p[f"W{side}"].T
    loss = float(-np.log(np.maximum(np.where(y > 0, prob, 1 - prob), 1e-7)).mean())
    return g, d_x, loss


def windows(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, text) of all windows; the last of a text ends with it. Texts without tokens have none."""
    n = np.diff(of)
    many = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = of[:-1][text] + nth * STRIDE
    return first, np.minimum(WINDOW, of[1:][text] - first), text


def _grid(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token of each (time, window), and which are real."""
    time = np.arange(int(size.max()))[:, None]
    mask = time < size
    return np.where(mask, first + time, 0), mask


def _gathered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values of each of n rows."""
    return np.stack([np.bincount(rows, v, n) for v in values.T], axis=1).astype(np.float32)


def train(texts: list[bytes], y: np.ndarray, epochs: int = 7, batch: int = 128, steps: int = 250) -> Net:
    """The network fitted to documents and their labels; small samples are gone over until ``steps`` steps are made."""
    if len(np.unique(y)) < 2:
        return Net(np.zeros(0, U64), {})
    rng = np.random.default_rng(SEED)
    data = b"\n".join(texts)
    joined = Texts(np.frombuffer(data, np.uint8), np.array([0, *(np.cumsum([len(x) + 1 for x in texts])[:-1]), len(data)], np.int64))
    words = tokens(joined)
    keys, place, token, seen = np.unique(word_hashes(joined, words, lower=True), return_index=True, return_inverse=True, return_counts=True)
    often = np.flatnonzero(seen >= OFTEN)
    row = np.full(len(keys), len(often))
    row[often] = np.arange(len(often))
    bucket, of = grams(joined.data, words.start[place], words.end[place])
    order = np.argsort(of, kind="stable")
    bucket, at = bucket[order], np.searchsorted(of[order], np.arange(len(keys) + 1))
    number = np.maximum(np.diff(at), 1).astype(np.float32)
    p = _start(rng, len(often))
    first, size, text = windows(words.of)
    if not len(text):
        return Net(np.zeros(0, U64), {})
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0

    def inputs(grid: np.ndarray) -> tuple[np.ndarray, ...]:
        own, inverse = np.unique(token[grid], return_inverse=True)
        lengths = at[own + 1] - at[own]
        ends = np.cumsum(lengths)
        flat = bucket[np.repeat(at[own] - ends + lengths, lengths) + np.arange(ends[-1])]
        to = np.repeat(np.arange(len(own)), lengths)
        char = np.add.reduceat(p["char"][flat], ends - lengths, axis=0)  # every token has an n-gram
        vec = np.concatenate([p["word"][row[own]], char / number[own][:, None]], axis=1)
        return vec[inverse.reshape(grid.shape)], own, inverse.reshape(grid.shape), flat, to

    def descend(pick: np.ndarray, rate: float) -> float:
        nonlocal step
        step += 1
        grid, mask = _grid(first[pick], size[pick])
        x, own, inverse, flat, to = inputs(grid)
        g, d_x, loss = gradients(p, x, mask, y[text[pick]].astype(np.float32))
        d_vec = _gathered(inverse[mask], d_x[mask], len(own))
        g["word"] = _gathered(row[own], d_vec[:, :WORD_DIMS], len(p["word"]))
        g["word"][-1] = 0  # unknown words have no vector of their own
        g["char"] = _gathered(flat, (d_vec[:, WORD_DIMS:] / number[own][:, None])[to], len(p["char"]))
        for k, d in g.items():
            m, v = moment[k]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def score_all() -> np.ndarray:
        out = np.empty(len(text), np.float32)
        for low in range(0, len(text), 1024):
            grid, mask = _grid(first[low : low + 1024], size[low : low + 1024])
            out[low : low + 1024] = forward(p, inputs(grid)[0], mask)
        return out

    about = np.sum(y == 1) + np.minimum(np.bincount(text, minlength=len(y)), 3)[y == 0].sum()
    epochs = max(epochs, min(80, int(-(-steps * batch // max(about, batch)))))
    for epoch in range(epochs):
        if epoch == 0:
            pick = rng.permutation(len(text))
        else:
            order = np.lexsort((-score_all(), text))
            rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            toxic = y[text[order]] == 1
            pick = rng.permutation(order[toxic & (rank < 1) | ~toxic & (rank < 3)])
        for low in range(0, len(pick), batch):
            descend(pick[low : low + batch], 0.012 * (1 - 0.8 * epoch / epochs))
    return Net(keys[often], p)


class Scorer:
    """Scores of whole texts; inputs of words are remembered in a table."""

    def __init__(self, net: Net, bits: int = 20):
        self.net, self.bits = net, bits
        self.clear()

    def clear(self) -> None:
        self.table = HashTable(self.bits)
        self.values = np.zeros((1 << self.bits - 1, WORD_DIMS + CHAR_DIMS), np.float32)

    def _inputs(self, texts: Texts, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        p, known = self.net.p, self.net.vocabulary
        row = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        row = np.where(known[row] == keys, row, len(known)) if len(known) else np.zeros(len(keys), np.int64)
        char = np.zeros((len(keys), CHAR_DIMS), np.float32)
        for low in range(0, len(keys), 20_000):
            bucket, of = grams(texts.data, start[low : low + 20_000], end[low : low + 20_000])
            n = len(start[low : low + 20_000])
            number = np.maximum(np.bincount(of, minlength=n), 1)
            for k in range(CHAR_DIMS):
                char[low : low + n, k] = np.bincount(of, p["char"][bucket, k], n) / number
        return np.concatenate([p["word"][row], char], axis=1)

    def score(self, texts: Texts) -> np.ndarray:
        out = np.zeros(len(texts))
        words = tokens(texts)
        if not len(words) or not self.net.trained:
            return out
        keys = word_hashes(texts, words, lower=True)
        rows = self.table.find(keys)
        new, place = np.unique(keys[rows < 0], return_index=True)
        values = self.values
        if len(new):
            place = np.flatnonzero(rows < 0)[place]
            if len(new) > self.table.room:
                self.clear()
                new, place = np.unique(keys, return_index=True)
            own = self._inputs(texts, words.start[place], words.end[place], new)
            if len(new) > self.table.room:  # one text of more distinct words than the table takes
                values, rows = own, np.searchsorted(new, keys)
            else:
                self.values[self.table.add(new)] = own
                values, rows = self.values, self.table.find(keys)
        first, size, text = windows(words.of)
        logit = np.empty(len(text), np.float32)
        order = np.argsort(size, kind="stable")
        for low in range(0, len(order), 2048):
            own = order[low : low + 2048]
            grid, mask = _grid(first[own], size[own])
            logit[own] = forward(self.net.p, values[rows[grid]], mask)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logit)
        live = best > -np.inf
        out[live] = 1 / (1 + np.exp(-np.clip(best[live], -700, 700)))
        return out


_SCORERS: dict[int, Scorer] = {}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = ROWS, key: str = "doc_id", text: str = "text") -> Net:
    sample, _ = labelled(docs, labels, label, learn, rows, key, text)
    return train([(x or "").encode("utf-8", "replace") for x in sample.column("text").to_pylist()], np.array(sample.column("y").to_pylist(), np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """key, held_out, score, predicted of each row; learned from rows outside the held-out fold."""
    net = fit(docs, labels, fold(F.col("_id"), folds) != held, rows=rows, key=key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if id(known) not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[id(known)] = Scorer(known)
        for batch in slices(batches, "_text", 1 << 18):
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(_SCORERS[id(known)].score(views(batch.column("_text"))))], names=["_key", "score"])

    out = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, f"_key {kind}, score double")
    return out.select(F.col("_key").alias(key), (fold(F.col("_key"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
