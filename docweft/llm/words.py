"""Vectorised word kernels over Arrow text buffers.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; in UTF-8 that is
the pattern ``[^\\x20\\x09-\\x0D]+`` over characters. Hashes are 64-bit and
chained: every eight bytes of a word, and every pair of halves of a run of words,
go through a non-linear mix, so no algebra makes different words meet. Where a
result depends on equality, operators compare bytes or 128-bit digests of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that one numpy pass holds; longer texts are passed alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Words of over this many bytes are hashed by the xxhash library, one call each.
_LONG = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)  # the first n bytes of a block
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Texts:
    """Some texts as one byte array; ``at`` has a bound more than there are texts."""

    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


@dataclass
class Words:
    """Words of Texts in order: byte bounds, and the bounds of each text's words."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray  # len(texts) + 1

    def __len__(self) -> int:
        return len(self.start)


def views(column: pa.Array) -> Texts:
    """The buffers of a string column, nulls as empty texts, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = views(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(texts.at, texts.at[low] + limit, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def split(texts: Texts) -> Words:
    """All words of all texts; a text's end ends a word."""
    n = len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts) + 1, np.int64))
    solid = ~SPACE[texts.data]
    edge = np.zeros(n + 1, bool)
    edge[texts.at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, texts.at))


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer, zeros after the end; 16 places more than there are bytes."""
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    return np.ndarray((len(data) + 16,), "<u8", padded, strides=(1,))


def word_hashes(texts: Texts, words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z only."""
    if not len(words):
        return np.zeros(0, U64)
    data = _LOWER[texts.data] if lower else texts.data
    wide, size = blocks(data), words.end - words.start
    value = size.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(0x27D4EB2F165667C5)
    left, at = np.arange(len(size)), 0
    while len(left):
        block = wide[words.start[left] + at] & _KEEP[np.minimum(size[left] - at, 8)]
        value[left] = mix(value[left] * U64(0x9E3779B97F4A7C15) + mix(block + U64(0xD6E8FEB86659FD93)))
        at += 8
        left = left[(size[left] > at) & (size[left] <= _LONG)]
    for i in np.flatnonzero(size > _LONG).tolist():
        value[i] = xxhash.xxh3_64_intdigest(data[words.start[i] : words.end[i]].tobytes())
    return value


def run_hashes(hashes: np.ndarray, first: np.ndarray, length) -> np.ndarray:
    """A hash of the runs of words [first, first + length).

    Runs of 1, 2, 4, ... words are hashed from two halves each; any run is two
    such, the second ending with it, and its length.
    """
    first = np.asarray(first)
    length = np.broadcast_to(np.asarray(length, np.int64), first.shape)
    out, own, half = np.zeros(len(first), U64), hashes, 1
    most = int(length.max()) if len(first) else 0
    while half <= most:
        here = slice(None) if half <= int(length.min()) and most < 2 * half else np.flatnonzero((length >= half) & (length < 2 * half))
        a, n = first[here], length[here]
        out[here] = mix(own[a] * U64(0xA0761D6478BD642F) + own[a + n - half] + n.astype(U64) * U64(0x165667B19E3779F9))
        if 2 * half <= most:
            own = mix(own[:-half] * U64(0xE7037ED1A0B428DB) + own[half:])
        half *= 2
    return out


def run_starts(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``length`` words that stay in one text, and each text's bounds among them."""
    count = np.diff(words.of)
    runs = np.maximum(count - length + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(runs)])
    return np.arange(bounds[-1]) + np.repeat(words.of[:-1] - bounds[:-1], runs), bounds
