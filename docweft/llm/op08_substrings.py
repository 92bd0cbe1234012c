"""Substring dedup on a log-structured fingerprint index.

A window is LENGTH consecutive words. Its fingerprint is the least hash of the
runs of ANCHOR words in it (the leftmost, if equal), so equal windows have equal
fingerprints at equal places, and neighbouring windows mostly share one: about
one fingerprint for 14 windows. The index keeps sorted immutable runs of
(fingerprint, count). Each batch of documents is merge-joined with the runs of
the batches before it: fingerprints seen before, or twice in the batch, are
hits. Then it becomes a run itself; runs of one level are compacted into one of
the next when FANOUT of them have gathered. An index of an earlier run can be
opened again by its folder.

Hits are verified on whole windows. A stretch is the words of all consecutive
windows with one fingerprint: if its words recur, all its windows do. Stretches
that differ under one fingerprint (where copies begin, end or were edited) send
one representative each, and their windows are compared one by one, with the
number of places each stands for. Words are the same where BLAKE2 digests (128
bits) of their bytes, joined by single spaces, are; 64-bit hashes only propose.

Scale: a row a stretch in the index passes, and only hits after them. The group
of a passage that a third of the documents share is pre-aggregated to its
distinct stretches before the shuffle. Whole texts are shuffled once,
compressed; a task holds about 1 MB of text and one document's windows.

Defined cases: null and empty text has no words; texts shorter than a window
lose nothing; overlapping occurrences within a document count; a row is known by
its id and 128 bits of its text's SHA-256, so repeated rows repeat each other's
windows and lose them; null ids are ids; an empty table gives no rows; other
columns are kept only by ``cleaned``, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.scratch import Scratch
from docweft.llm.words import Texts, Words, run_hashes, slices, split, views, word_hashes

LENGTH, ANCHOR, FANOUT = 50, 8, 2
NO_ID = -(1 << 63)


def stretches(texts: Texts, words: Words, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, fingerprint) of every stretch."""
    anchor = min(ANCHOR, length)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(words) < length:
        return none
    hashes = word_hashes(texts, words)
    grams = run_hashes(hashes, np.arange(len(hashes) - anchor + 1), anchor)
    spots = np.lib.stride_tricks.sliding_window_view(grams, length - anchor + 1)
    least = np.arange(len(spots)) + np.concatenate([spots[low : low + 65536].argmin(axis=1) for low in range(0, len(spots), 65536)])
    doc = np.repeat(np.arange(len(texts)), np.diff(words.of))
    inside = np.flatnonzero(doc[: len(least)] == doc[length - 1 :])
    if not len(inside):
        return none
    at, text = least[inside], doc[inside]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    first, count = inside[cut], np.diff(np.append(cut, len(inside)))
    return text[cut], first - words.of[text[cut]], count, grams[at[cut]]


def digests(texts: Texts, words: Words, first: np.ndarray, count) -> list[bytes]:
    """128 bits of the words [first, first + count), joined by single spaces."""
    if not len(first):
        return []
    data, last = texts.data, first + count - 1
    plain = np.ones(len(words), bool)
    plain[:-1] = (words.start[1:] - words.end[:-1] == 1) & (data[np.minimum(words.end[:-1], len(data) - 1)] == 0x20)
    odd = np.concatenate([[0], np.cumsum(~plain)])
    raw = data.tobytes()
    return [
        hashlib.blake2b(x if own else b" ".join(x.split()), digest_size=16).digest()
        for x, own in zip((raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)), (odd[last] == odd[first]).tolist(), strict=True)
    ]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("_text"))


def _keys(batch: pa.RecordBatch, texts: Texts) -> tuple[pa.Array, pa.Array]:
    """k1, k2 of each row: its id, and half of its text's SHA-256 (as ``_key_columns``)."""
    return batch.column("id").fill_null(NO_ID), pa.array([hashlib.sha256(texts.text(i)).digest()[:16] for i in range(len(texts))], pa.binary())


def _key_columns(key: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(key.cast("long"), F.lit(NO_ID)), F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)), 1, 16)


def fingerprints(rows: DataFrame, length: int, full: bool) -> DataFrame:
    """A row a stretch: fp, and if ``full`` also span, k1, k2 (the document's row), at and windows."""
    schema = "fp long" + ", span binary, k1 long, k2 binary, at int, windows int" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = views(batch.column("_text"))
            words = split(texts)
            text, at, count, fp = stretches(texts, words, length)
            out = [pa.array(fp.view(np.int64))]
            if full:
                k1, k2 = _keys(batch, texts)
                span = digests(texts, words, at + words.of[text], count + (length - 1))
                out += [pa.array(span, pa.binary()), k1.take(pa.array(text)), k2.take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["fp", "span", "k1", "k2", "at", "windows"][: len(out)])

    return rows.mapInArrow(run, schema)


class FingerprintIndex:
    """Sorted immutable runs of (fp, n) by level; in a scratch folder, or in ``folder``, whose finished runs are taken up again."""

    def __init__(self, scratch: Scratch, length: int = LENGTH, fanout: int = FANOUT, folder: str | None = None):
        self.scratch, self.length, self.fanout, self.folder = scratch, length, fanout, folder
        self.levels: list[list[DataFrame]] = []
        self.hits: list[DataFrame] = []
        for at in scratch.finished(f"{folder}/*/*") if folder else []:
            level = int(at.rsplit("/", 2)[-2])
            self.levels += [[] for _ in range(level + 1 - len(self.levels))]
            self.levels[level].append(scratch.open(at, "fp long, n long"))

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _put(self, counts: DataFrame, level: int) -> DataFrame:
        at = f"{self.folder}/{level}/{uuid.uuid4().hex}" if self.folder else None
        run = self.scratch.keep(counts.sortWithinPartitions("fp"), f"run-{level}", at)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(run)
        return run

    def add(self, rows: DataFrame) -> DataFrame:
        """Take in a batch (id, _text); returns its fingerprints that recur in it or occur in history."""
        fresh = fingerprints(rows, self.length, False).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
        history = self.runs
        run = self._put(fresh, 0)
        hits = run.where("n > 1").select("fp")
        for old in history:
            hits = hits.unionByName(run.where("n = 1").join(old.select("fp").hint("merge"), "fp").select("fp"))
        self.hits.append(self.scratch.keep(hits.distinct() if len(history) > 1 else hits, "hits"))
        for level, held in enumerate(self.levels):
            if len(held) >= self.fanout:
                self.compact(level)
        return self.hits[-1]

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one of the next."""
        old, self.levels[level] = self.levels[level], []
        merged = old[0]
        for run in old[1:]:
            merged = merged.unionByName(run)
        self._put(merged.groupBy("fp").agg(F.sum("n").alias("n")), level + 1)
        for run in old:
            self.scratch.drop(run)

    def repeated(self) -> DataFrame:
        """All fingerprints that occur more than once so far."""
        every = self.hits[0]
        for hits in self.hits[1:]:
            every = every.unionByName(hits)
        return every.distinct()


def _one(raw: bytes) -> tuple[Texts, Words]:
    texts = Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
    return texts, split(texts)


def _cover(n: int, spans: list[tuple[int, int]], length: int) -> np.ndarray:
    """Which of n words lie in a window of some (first window, windows)."""
    edge = np.zeros(n + 1, np.int64)
    for at, count in spans:
        edge[at] += 1
        edge[at + count - 1 + length] -= 1
    return np.cumsum(edge[:n]) > 0


def _clean(raw: bytes, gone: np.ndarray | None) -> tuple[int, bytes]:
    """(words removed, the rest joined by single spaces)."""
    own = raw.split()
    if gone is None or not gone.any():
        return 0, b" ".join(own)
    return int(gone.sum()), b" ".join([own[i] for i in np.flatnonzero(~gone).tolist()])


def scrub(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", batches: int = 2, digest: bool = False) -> DataFrame:
    """A row for each row of ``docs``: id, k2, n_words long, n_removed long, and kept (string).

    kept: the words no repeated window covers, joined by single spaces, null where
    none is removed; with ``digest`` the SHA-256 of the words kept instead, as kept_sha256. ``batches``: into how many
    parts of the rows, dealt by hash of the id, the index is fed.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = _rows(docs, key, text)
    index = FingerprintIndex(scratch, length)
    for i in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i) if batches > 1 else rows)
    hot = scratch.keep(index.repeated(), "repeated")

    found = scratch.keep(fingerprints(rows, length, True).join(hot, "fp"), "found")
    classes = scratch.keep(found.groupBy("fp", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at", "windows")).alias("x")), "stretches")
    kinds = scratch.keep(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    # n: 0 for every stretch found, -1 again for those that occur once as a whole, and how many a representative stands for.
    alone = classes.where("n = 1").select("x.k1", "x.k2", "x.at", "x.windows", F.lit(-1).cast("long").alias("n"))
    open_ = classes.join(kinds.select("fp"), "fp").select("x.k1", "x.k2", "x.at", "x.windows", "n")
    marks = found.select("k1", "k2", "at", "windows", F.lit(0).cast("long").alias("n")).unionByName(alone).unionByName(open_)
    marks = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "windows", "n")).alias("marks"))
    name = "kept_sha256" if digest else "kept"

    def zip_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "_text"):
            texts = views(batch.column("_text"))
            k1, k2 = _keys(batch, texts)
            yield pa.RecordBatch.from_arrays([k1, k2, batch.column("id"), pa.array([press.compress(texts.text(i)) for i in range(len(texts))], pa.binary())], names=["k1", "k2", "id", "z"])

    packed = rows.mapInArrow(zip_up, "k1 long, k2 binary, id long, z binary")

    def finish(raw: bytes, n: int, spans: list[tuple[int, int]]) -> tuple[int, str]:
        removed, rest = _clean(raw, _cover(n, spans, length) if spans else None)
        if not digest:
            return removed, rest.decode("utf-8", "replace") if removed else None
        return removed, hashlib.sha256(rest).hexdigest()

    def draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                z, marks = part.column("z").to_pylist(), part.column("marks").to_pylist()
                cols: dict[str, list] = {c: [] for c in ("n_words", "n_removed", name, "z", "spans", "open")}
                for i in range(part.num_rows):
                    raw = unpress.decompress(z[i])
                    own = marks[i] or []
                    alone = {m["at"] for m in own if m["n"] < 0}
                    spans = [(m["at"], m["windows"]) for m in own if m["n"] == 0 and m["at"] not in alone]
                    asked = [m for m in own if m["n"] > 0]
                    n = len(raw.split())
                    lonely = any(m["n"] == 1 for m in asked)
                    hashes = None
                    if asked:
                        texts, words = _one(raw)
                        places = np.concatenate([np.arange(m["at"], m["at"] + m["windows"]) for m in asked])
                        weight = np.concatenate([np.full(m["windows"], m["n"]) for m in asked])
                        hashes = [{"h": a, "at": c, "n": d} for a, c, d in zip(digests(texts, words, places, length), places.tolist(), weight.tolist(), strict=True)]
                    removed, rest = (None, None) if lonely else finish(raw, n, spans)
                    for c, v in (("n_words", n), ("n_removed", removed), (name, rest), ("z", z[i] if lonely else None), ("spans", [{"at": a, "windows": w} for a, w in spans] if lonely else None), ("open", hashes)):
                        cols[c].append(v)
                kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), name: pa.string(), "z": pa.binary(), "spans": pa.list_(pa.struct([("at", pa.int32()), ("windows", pa.int32())])), "open": pa.list_(pa.struct([("h", pa.binary()), ("at", pa.int32()), ("n", pa.int64())]))}
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k1"), part.column("k2"), *[pa.array(cols[c], t) for c, t in kinds.items()]], names=["id", "k1", "k2", *kinds])

    drafts = scratch.keep(
        packed.join(marks, ["k1", "k2"], "left").select("k1", "k2", "id", "z", "marks").mapInArrow(
            draft, f"id long, k1 long, k2 binary, n_words long, n_removed long, {name} string, z binary, spans array<struct<at:int,windows:int>>, open array<struct<h:binary,at:int,n:long>>"
        ),
        "drafts",
    )
    for done in (found, classes, kinds, hot, *index.hits, *index.runs):
        scratch.drop(done)
    # Windows of stretches that differ, one by one: n is how many places a stretch stands for.
    asked = drafts.where("open is not null").select("k1", "k2", F.explode("open").alias("w")).select("k1", "k2", "w.*")
    twice = asked.groupBy("h").agg(F.sum("n").alias("places"), F.min("n").alias("least")).where("places > 1 and least = 1")
    extra = asked.where("n = 1").join(twice.select("h"), "h").groupBy("k1", "k2").agg(F.collect_set("at").alias("extra"))
    waiting = drafts.where("z is not null").select("k1", "k2", "id", "n_words", "z", "spans").join(extra, ["k1", "k2"], "left")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                removed, rest = [], []
                for n, z, spans, extra in zip(*(part.column(c).to_pylist() for c in ("n_words", "z", "spans", "extra")), strict=True):
                    a, b = finish(unpress.decompress(z), n, [(s["at"], s["windows"]) for s in spans] + [(at, 1) for at in extra or ()])
                    removed.append(a)
                    rest.append(b)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k2"), part.column("n_words"), pa.array(removed, pa.int64()), pa.array(rest, pa.string())], names=["id", "k2", "n_words", "n_removed", name])

    settled = waiting.mapInArrow(settle, f"id long, k2 binary, n_words long, n_removed long, {name} string")
    return drafts.where("z is null").select("id", "k2", "n_words", "n_removed", name).unionByName(settled)


def removals(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of each row."""
    return scrub(docs, length, key, text, digest=True).select(F.col("id").alias(key), "n_words", "n_removed", "kept_sha256")


def cleaned(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with texts cut to the kept words; texts that lose none keep their white space, those that lose all go."""
    done = scrub(docs, length, key, text).where("n_removed > 0").select(F.coalesce("id", F.lit(NO_ID)).alias("k1"), "k2", "kept").groupBy("k1", "k2").agg(F.min("kept").alias("kept"))
    # Columns travel under their places, so no name of theirs can clash.
    k1, k2 = _key_columns(F.col(f"`{key}`"), F.col(f"`{text}`"))
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], k1.alias("k1"), k2.alias("k2"))
    # Texts are dealt by key at any size: what was cut grows with the corpus.
    joined = keyed.join(done.hint("merge"), ["k1", "k2"], "left").where("kept is null or kept <> ''")
    return joined.select(*[(F.coalesce(F.col("kept"), F.col(f"c{i}")) if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
