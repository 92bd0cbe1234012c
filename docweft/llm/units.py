"""Encoding whole texts with the tokenizers library, one library call per distinct unit.

A unit is a run of separators with the bytes up to the next run. When no token
and no pre-token can reach over a unit's end, a text's ids are its units' ids
in order; natural text repeats its units, so each distinct one goes through the
library once a table and its ids are kept under its 64-bit hash, beside the
unit's bytes. A hit counts only if the bytes are the same; a text with a unit
whose hash another one has goes through the library whole.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np

from docweft.llm.words import _KEEP, Texts, Words, blocks, word_hashes

U64 = np.uint64
#: Simple units that are joined to one string; the library's threads share the strings of a call.
JOINED = 250


class HashTable:
    """64-bit keys to row numbers, open addressing, all operations on arrays."""

    def __init__(self, bits: int):
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.rows, self.n = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32), 0

    @property
    def room(self) -> int:
        return (self.mask + 1) // 2 - self.n

    @staticmethod
    def _solid(keys: np.ndarray) -> np.ndarray:
        return np.where(keys == 0, U64(1), keys)  # 0 marks an empty slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it has none."""
        keys = self._solid(keys)
        slot = (keys >> self.shift).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.rows[slot], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.rows[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Give each of some distinct keys that have no row the next one."""
        keys = self._solid(keys)
        rows = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        slot, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            took = free[self.keys[slot[free]] == keys[free]]
            self.rows[slot[took]] = rows[took]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        return rows


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the place of one occurrence of each."""
    return np.unique(keys, return_index=True)


class UnitEncoder:
    """ids of whole texts.

    encode(strings) -> list of id sequences: the library, for any strings.
    joined(string) -> ids, with ``opens`` telling from an id whether it opens a
    unit: the library on many simple units (one space, then no separator) in a
    row; None to do without.
    spell(unit, first): the string that stands for a unit's bytes.
    odd(texts) -> bool per text: those that must go through ``whole`` undivided.
    """

    def __init__(self, encode: Callable, whole: Callable, separators: bytes, odd: Callable, spell: Callable | None = None, opens: np.ndarray | None = None, bits: int = 22):
        self.encode_strings, self.whole, self.odd, self.opens, self.bits = encode, whole, odd, opens, bits
        self.spell = spell or (lambda unit, first: unit.decode("utf-8", "replace"))
        self.marks_first = spell is not None
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        self.clear()

    def clear(self) -> None:
        rows = 1 << self.bits - 1
        self.table = HashTable(self.bits)
        self.at = np.zeros(rows + 1, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        # The units themselves: twice the size and whether it is a text's first, the first 16 bytes, and the bytes of longer ones.
        self.shape, self.heads, self.long = np.zeros(rows, np.int64), np.zeros((rows, 2), U64), {}

    def _look(self, texts: Texts, units: Words, first: np.ndarray, places) -> tuple[np.ndarray, np.ndarray]:
        """(shape, heads) of some units."""
        start, size = units.start[places], (units.end - units.start)[places]
        wide = blocks(texts.data)
        heads = np.stack([wide[start] & _KEEP[np.minimum(size, 8)], wide[start + 8] & _KEEP[np.clip(size - 8, 0, 8)]], axis=1)
        return 2 * size + first[places] if self.marks_first else 2 * size, heads

    def _same(self, texts: Texts, units: Words, first: np.ndarray, rows: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Which units are, byte for byte, those of the rows found for them."""
        shape, heads = self._look(texts, units, first, slice(None))
        same = (rows >= 0) & (self.shape[rows] == shape) & (self.heads[rows] == heads).all(axis=1)
        for i in np.flatnonzero(same & live & (shape > 33)).tolist():
            same[i] = self.long[int(rows[i])] == texts.data[units.start[i] : units.end[i]].tobytes()
        return same

    def _ids(self, spelled: list[str], simple: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(spelled)
        easy = np.flatnonzero(simple)
        groups = [easy[low : low + JOINED].tolist() for low in range(0, len(easy), JOINED)]
        for own, found in zip(groups, self.encode_strings(["".join([spelled[i] for i in g]) for g in groups]) if groups else [], strict=True):
            ids = np.array(found, np.uint32)
            heads = np.flatnonzero(self.opens[ids])
            if len(heads) == len(own) and heads[0] == 0:
                for i, part in zip(own, np.split(ids, heads[1:]), strict=True):
                    out[i] = part
        rest = [i for i, x in enumerate(out) if x is None]
        for i, found in zip(rest, self.encode_strings([spelled[i] for i in rest]) if rest else [], strict=True):
            out[i] = np.array(found, np.uint32)
        return out

    def _learn(self, texts: Texts, units: Words, first: np.ndarray, keys: np.ndarray, places: np.ndarray) -> None:
        start, end = units.start[places], units.end[places]
        after = texts.data[np.minimum(start + 1, len(texts.data) - 1)]
        simple = (texts.data[start] == 0x20) & (end - start > 1) & ~self.separator[after] & ~first[places]
        if self.opens is None:
            simple[:] = False
        raw = [texts.data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        found = self._ids([self.spell(x, f) for x, f in zip(raw, first[places].tolist(), strict=True)], simple)
        ids, lengths = np.concatenate(found), np.array([len(x) for x in found])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        rows = self.table.add(keys)
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[rows + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.shape[rows], self.heads[rows] = self._look(texts, units, first, places)
        self.long |= {int(r): x for r, x in zip(rows, raw, strict=True) if len(x) > 16}

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) and the bounds of each text's among them."""
        n, data = len(texts), texts.data
        sizes = np.diff(texts.at)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        sep = self.separator[data]
        cut = sep.copy()
        cut[1:] &= ~sep[:-1]
        opening = texts.at[:-1][sizes > 0]
        cut[opening] = True
        start = np.flatnonzero(cut)
        of = np.searchsorted(start, texts.at)
        units = Words(start, np.append(start[1:], len(data)), of)
        first = np.zeros(len(start), bool)
        first[of[:-1][sizes > 0]] = True
        odd = self.odd(texts)
        keys = word_hashes(texts, units)
        if self.marks_first:
            keys = np.where(first, keys ^ U64(0x5851F42D4C957F2D), keys)
        live = np.ones(len(start), bool)
        for i in np.flatnonzero(odd):
            live[of[i] : of[i + 1]] = False
        rows = self.table.find(keys)
        new, places = distinct(keys[live & (rows < 0)])
        if len(new):
            places = np.flatnonzero(live & (rows < 0))[places]
            if len(new) > self.table.room:
                self.clear()
                new, places = distinct(keys[live])
                places = np.flatnonzero(live)[places]
                if len(new) > self.table.room:
                    return self._undivided(texts)
            self._learn(texts, units, first, new, places)
            rows = self.table.find(keys)
        met = live & ~self._same(texts, units, first, rows, live)
        if met.any():  # two units of one hash
            odd[np.searchsorted(of, np.flatnonzero(met), "right") - 1] = True
            live &= ~met
        rows = np.where(live, rows, 0)
        lengths = np.where(live, self.at[rows + 1] - self.at[rows], 0)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.at[rows] - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[of]
        if odd.any():
            each = [np.array(self.whole(texts.text(i)), np.uint32) if odd[i] else ids[bounds[i] : bounds[i + 1]] for i in range(n)]
            return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, bounds

    def _undivided(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(self.whole(texts.text(i)), np.uint32) for i in range(len(texts))]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def has_wide_blanks(texts: Texts) -> np.ndarray:
    """Texts with white space beyond ASCII (fixed UTF-8 forms), which may join a run of separators."""
    d = texts.data
    out = np.zeros(len(texts), bool)
    if len(d) < 2 or not (d >= 0xC2).any():
        return out
    a, b = d[:-1], d[1:]
    c = np.append(d[2:], np.uint8(0))
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    out[np.searchsorted(texts.at, np.flatnonzero(hit), "right") - 1] = True
    return out


def byte_level(file: str | bytes) -> UnitEncoder:
    """A byte-level BPE from a file in the library's JSON form, by path or as bytes; special tokens' strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str((file if isinstance(file, bytes) else Path(file).read_bytes()).decode())
    tokenizer.encode_special_tokens = True
    size = tokenizer.get_vocab_size()
    opens = np.zeros(size, bool)
    for token, i in tokenizer.get_vocab().items():
        opens[i] = token.startswith("Ġ")
    encode = lambda strings: [x.ids for x in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
    whole = lambda raw: tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
    return UnitEncoder(encode, whole, bytes([0x20, *range(0x09, 0x0E)]), has_wide_blanks, opens=opens)
