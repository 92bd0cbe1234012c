"""MinHash near-dedup with b-bit signatures.

Every document's set of word shingles is reduced to HASHES minima. Bands of ROWS
minima name candidate buckets; of each minimum the lowest BITS bits, after a
mix, are packed into longs, and a pair's similarity is estimated from the bits
that agree, corrected for those that agree by chance: (agreeing - 2**-b) /
(1 - 2**-b). Candidates whose estimate is far below the threshold (over four
standard deviations) go; all others are confirmed on the full sets of the two
texts. At a similarity of 0.8 a pair shares no bucket once in 20,000, and the
estimate drops it once in a million.

Documents with the same words in the same order (BLAKE2 digests of them, 128
bits) are one class from the start; every other link is confirmed on the sets of
words themselves. Buckets are compared in two rounds, so that groups of near
copies never yield all their pairs: first every class with one pivot of its
buckets (a bucket's pivot is the member with most company over all its buckets;
the original of a group of edited copies has most); then, after components, the
strays, members that the pivot's component left out, with all members of other
components, in blocks that send back links only. No candidate pair is dropped: a
pair is either compared or already known to be connected.

Scale: one narrow pass over the texts makes rows of about 300 bytes; buckets,
counts, pivots and estimates are DataFrame operations on those (bit_count, no
Python); texts are shuffled only for documents with candidates left. What a
bucket is joined with is written first, so that both sides of such a join are
plain shuffles and adaptive execution may split a hot bucket.

Defined cases: null text, empty text and text without words have an empty set,
link with nothing and are kept; fewer words than a shingle are one shingle of
all words; null ids are left out; rows that repeat an id are one document that
has every row's links and the largest of their set sizes; an empty table gives
no rows; other columns are not read, and kept by ``deduplicated`` whatever their
names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.components import components
from docweft.llm.scratch import Scratch
from docweft.llm.words import Texts, mix, run_hashes, slices, split, views, word_hashes

HASHES, BANDS, ROWS, BITS, SEED = 128, 25, 5, 2, 7_919
WORDS, PERCENT = 5, 80
#: Members of a bucket that one unit of the second round holds of each side.
BLOCK = 512
#: How far below the threshold an estimate may be before the pair goes unconfirmed.
SLACK = 0.2

_LANES = 0x5555555555555555


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(hashes: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each of the family's functions over 32-bit hashes."""
    low = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 4096):
        values = (hashes[at : at + 4096][None, :] ^ flips[:, None]) * factors[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """BITS low bits of each mixed minimum, 64 / BITS to a long."""
    lanes = (mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two packed signatures of HASHES values of two bits each."""
    parts = []
    for i in range(HASHES * BITS // 64):
        z = x[i].bitwiseXOR(y[i])
        parts.append(F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(_LANES))))
    differ = sum(parts[1:], parts[0])
    chance = 2.0**-BITS
    return ((HASHES - differ) / float(HASHES) - chance) / (1 - chance)


def _sets(texts: Texts, words: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's set."""
    found = split(texts)
    hashes = word_hashes(texts, found, lower=True)
    count = np.diff(found.of)
    full = np.maximum(count - words + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(full)])
    shingles = run_hashes(hashes, np.arange(bounds[-1]) + np.repeat(found.of[:-1] - bounds[:-1], full), words) if bounds[-1] else np.zeros(0, np.uint64)
    for i in range(len(texts)):
        if count[i] >= words:
            yield np.unique(shingles[bounds[i] : bounds[i + 1]])
        elif count[i]:
            yield run_hashes(hashes[found.of[i] : found.of[i + 1]], np.array([0]), int(count[i]))
        else:
            yield np.zeros(0, np.uint64)


def _print(own: np.ndarray) -> bytes | None:
    """The fingerprint of a set, none of an empty one."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _folded(raw: bytes) -> list[bytes]:
    """The words, A-Z folded."""
    return raw.translate(_LOWER).split()


def signatures(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(id, n, fp binary, bands array<long>, sig array<long>): n is the size of the set, fp a digest of the words in order; null for an empty one, as the rest."""
    rows = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, factors = _family(HASHES)
        powers = np.cumprod(np.full(ROWS, 0x9E3779B97F4A7C15, np.uint64))
        order = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for batch in slices(batches, "_text"):
            texts = views(batch.column("_text"))
            sizes, fps, bands, sigs = [], [], [], []
            for i, own in enumerate(_sets(texts, words)):
                sizes.append(len(own))
                if not len(own):
                    fps.append(None)
                    bands.append(None)
                    sigs.append(None)
                    continue
                fps.append(hashlib.blake2b(b" ".join(_folded(texts.text(i))), digest_size=16).digest())
                low = minima((own >> np.uint64(32)).astype(np.uint32), flips, factors)
                wide = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                bands.append(mix(mix((wide * powers).sum(axis=1, dtype=np.uint64)) + order).view(np.int64))
                sigs.append(pack(low).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "n", "fp", "bands", "sig"])

    return rows.mapInArrow(run, "id long, n long, fp binary, bands array<long>, sig array<long>")


def shingle_set(raw: str | None, words: int) -> frozenset:
    """The set itself, as tuples of byte strings."""
    own = _folded((raw or "").encode("utf-8", "surrogatepass"))
    if len(own) <= words:
        return frozenset([tuple(own)] if own else [])
    return frozenset(zip(*(own[i:] for i in range(words)), strict=False))


#: A-Z to a-z; bytes.split() parts at 0x20 and 0x09-0x0D and nowhere else.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough: 100 * intersection >= percent * union."""
    texts = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("_text"))
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("_text").alias("_ta")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("_text").alias("_tb")), "b").select("a", "b", "_ta", "_tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, frozenset())
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                b = batch.column("b")[i].as_py()
                tb = batch.column("_tb")[i].as_py()
                if held[0] != (b, tb):
                    held = ((b, tb), shingle_set(tb, words))
                x, y = shingle_set(batch.column("_ta")[i].as_py(), words), held[1]
                if enough(x, y, percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "a long, b long").distinct()


class Cell:
    """Members of one pair of a bucket's blocks; finds the candidate pairs that belong to this bucket."""

    def __init__(self, rows: pa.Table, percent: int):
        self.ids = rows.column("id").to_numpy()
        self.parts = rows.column("part").to_numpy()
        self.sides = rows.column("side").to_numpy()
        flat = lambda c: np.stack([np.asarray(x) for x in rows.column(c).to_numpy()])
        self.sigs, self.bands = flat("sig").view(np.uint64), flat("bands")
        self.bucket = rows.column("bucket")[0].as_py()
        self.same = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        self.floor = percent / 100.0 - SLACK

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, candidates): places of both sides and which pairs of them must be compared.

        Not yet connected, likely enough by their signatures, and with no shared
        bucket before this one, so each pair is looked at in one bucket only.
        """
        n = np.arange(len(self.ids))
        left, right = (n, n) if self.same else (n[self.sides == 0], n[self.sides == 1])
        if not len(left) or not len(right):
            return left, right, np.zeros((len(left), len(right)), bool)
        live = self.parts[left][:, None] != self.parts[right][None, :]
        if self.same:
            live &= left[:, None] < right[None, :]
        differ = np.zeros(live.shape, np.int64)
        for w in range(self.sigs.shape[1]):
            z = self.sigs[left, w][:, None] ^ self.sigs[right, w][None, :]
            differ += np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(_LANES))
        chance = 2.0**-BITS
        live &= ((HASHES - differ) / HASHES - chance) / (1 - chance) >= self.floor
        band = int(np.argmax(self.bands[0] == self.bucket))
        for k in range(band):
            if not live.any():
                break
            live &= self.bands[left, k][:, None] != self.bands[right, k][None, :]
        return left, right, live


def enough(x: frozenset, y: frozenset, percent: int) -> bool:
    shared = len(x & y)
    return shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)


def _linked(a: np.ndarray, b: np.ndarray, n: int, same: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Of the links proposed among n places, those that hold and join something new."""
    root, kept = list(range(n)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y and same(i, j):
            root[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


def overlaps(raw: list[str], words: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text's set, intersections of left with right) by hashes of shingles, as products of incidence matrices."""
    texts = views(pa.array(raw, pa.large_string()))
    found = split(texts)
    hashes = word_hashes(texts, found, lower=True)
    sets = []
    for i in range(len(texts)):
        own = hashes[found.of[i] : found.of[i + 1]]
        size = min(words, len(own))
        sets.append(np.unique(run_hashes(own, np.arange(len(own) - size + 1), size)) if len(own) else own)
    sizes = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # what stands in one text only adds to no intersection
    names = np.cumsum(count > 1) - 1
    of, column = of[shared], names[column[shared]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int((count > 1).sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        have = np.zeros((len(sets), 4096), np.float32)
        have[of[a:b], column[a:b] - low] = 1
        total += have[left] @ have[right].T
    return sizes, total


_CELL = "bucket long, i int, j int, side int, id long, part long, sig array<long>, bands array<long>"


def _cells(rows: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work`` (a pa.Table to record batches) on the rows of each (bucket, i, j)."""
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in ("bucket", "i", "j")], axis=1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                key = tuple(keys[low])
                if key != last and held:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, high - low))
                last = key
        if held:
            yield from work(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def second_round(placed: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members of one bucket in different parts: a spanning forest of each unit of work.

    placed: bucket, fp, id, sig, part, main (the pivot's part). A bucket's strays
    and the rest are cut into blocks of BLOCK members; a unit is a block of strays
    with itself, a later one or a block of the rest. Signatures go first; texts
    follow only for members with a candidate left. A unit proposes links by
    matrices of hashes and confirms those it sends back on the sets themselves.
    """
    stray = F.col("part") != F.col("main")
    many = lambda c: F.ceil(F.sum(c.cast("int")) / BLOCK).cast("int")
    sizes = scratch.keep(placed.groupBy("bucket").agg(many(stray).alias("ns"), many(~stray).alias("nm")).where("ns > 0"), "sizes")
    rows = placed.join(sizes, "bucket").join(reps.select("fp", "bands"), "fp")
    rows = rows.withColumn("me", F.pmod(F.xxhash64("fp", F.lit(3)), F.when(stray, F.col("ns")).otherwise(F.col("nm"))).cast("int"))
    unit = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    ahead = F.transform(F.sequence(F.col("me"), F.col("ns") + F.col("nm") - 1), lambda j: unit(F.col("me"), j, 0))
    behind = F.transform(F.filter(F.sequence(F.lit(0), F.col("me")), lambda i: i < F.col("me")), lambda i: unit(i, F.col("me"), 1))
    against = F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda i: unit(i, F.col("ns") + F.col("me"), 1))
    rows = rows.withColumn("unit", F.explode(F.when(stray, F.concat(ahead, behind)).otherwise(against)))
    rows = rows.select("bucket", "unit.i", "unit.j", "unit.side", "id", "part", "sig", "bands")

    def screen(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right, live = Cell(rows, percent).pairs()
        keep = np.union1d(left[live.any(axis=1)], right[live.any(axis=0)])
        if len(keep):
            yield from rows.take(pa.array(keep)).combine_chunks().to_batches()

    likely = scratch.keep(_cells(rows, screen, _CELL), "likely")
    texts = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("_text"))
    asked = texts.join(likely.select("id").distinct(), "id", "left_semi")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = Cell(rows, percent)
        left, right, live = cell.pairs()
        if not live.any():
            return
        size, shared = overlaps(rows.column("_text").to_pylist(), words, left, right)
        # Two hashes that meet would shift a count by one; the sets decide.
        likely = 100 * (shared.astype(np.int64) + 2) >= percent * (size[left][:, None] + size[right][None, :] - shared.astype(np.int64) - 2)
        a, b = np.nonzero(live & (shared > 0) & likely)
        raw = rows.column("_text")

        @functools.lru_cache(64)
        def own(i: int) -> frozenset:
            return shingle_set(raw[i].as_py(), words)

        forest = _linked(left[a], right[b], len(cell.ids), lambda i, j: enough(own(i), own(j), percent))
        if forest:
            x, y = np.array(forest).T
            yield pa.RecordBatch.from_arrays([pa.array(cell.ids[x]), pa.array(cell.ids[y])], names=["a", "b"])

    return _cells(likely.join(asked, "id").select("bucket", "i", "j", "side", "id", "part", "sig", "bands", "_text"), compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", every: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """A row an id: n_shingles, component_id (least id reachable by links), kept (is its own component). ``every``: signatures made before."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    every = scratch.keep(signatures(docs, words, key, text), "signatures") if every is None else every
    live = every.where("fp is not null")
    # Rows of the same words, or of one id, are connected: a class (fp) is named by its least id.
    reps = scratch.keep(live.groupBy("fp").agg(F.min_by(F.struct("bands", "sig"), "id").alias("x"), F.min("id").alias("rep")).select("fp", "rep", "x.bands", "x.sig"), "classes")
    floor = percent / 100.0 - SLACK

    rows = reps.select("fp", F.col("rep").alias("id"), "sig", F.explode("bands").alias("bucket"))
    counts = scratch.keep(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "counts")
    shared = scratch.keep(rows.join(counts, "bucket"), "buckets")
    company = shared.groupBy("fp").agg(F.sum("m").alias("company"))
    member = scratch.keep(shared.drop("m").join(company, "fp"), "members")
    scratch.drop(shared)
    pivots = member.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("id"), "sig")).alias("p"))
    pivots = scratch.keep(pivots.select("bucket", (-F.col("p.id")).alias("pivot"), F.col("p.company").alias("pivot_company"), F.col("p.sig").alias("pivot_sig")), "pivots")
    # Each member meets one pivot here: a likely one with most company, so that groups hang on few.
    agree = estimate(F.col("sig"), F.col("pivot_sig"))
    met = member.join(pivots, "bucket").where(F.col("id") != F.col("pivot")).select("fp", "id", "pivot", "pivot_company", agree.alias("agree")).where(F.col("agree") >= floor)
    best = met.groupBy("fp", "id").agg(F.max(F.struct(F.col("agree") >= percent / 100.0, "pivot_company", (-F.col("pivot")).alias("pivot"))).alias("p"))
    first = scratch.keep(best.select(F.col("id").alias("a"), (-F.col("p.pivot")).alias("b")).distinct(), "first")
    links = scratch.keep(confirm(first, docs, words, percent, key, text), "links")
    part = scratch.keep(components(links, scratch), "parts")

    main = pivots.select("bucket", F.col("pivot").alias("id")).join(part.withColumnRenamed("node", "id"), "id", "left")
    main = scratch.keep(main.select("bucket", F.coalesce("component", "id").alias("main")), "main")
    placed = member.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component", "company")
    placed = scratch.keep(placed.join(main, "bucket"), "placed")
    if not placed.where("part <> main").isEmpty():
        more = second_round(placed, reps, docs, words, percent, key, text, scratch)
        links = links.unionByName(scratch.keep(more, "more"))
    # An id with rows of different sets ties their classes together.
    named = scratch.keep(live.select("fp", "id", "n").join(reps.select("fp", "rep"), "fp").groupBy("id").agg(F.collect_set("rep").alias("reps"), F.max("n").alias("n")), "named")
    ties = named.where(F.size("reps") > 1).select(F.col("id").alias("a"), F.explode("reps").alias("b"))
    of = components(links.unionByName(ties), scratch)
    for done in (reps, counts, member, pivots, first, main, placed):
        scratch.drop(done)
    empty = every.groupBy("id").agg(F.max("n").alias("n")).where("n = 0").select("id", F.lit(None).cast("long").alias("rep"), "n")
    final = named.select("id", F.array_min("reps").alias("rep"), "n").unionByName(empty).join(of.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
    return final.withColumn("kept", F.col(key) == F.col("component_id"))


def _single(rows: DataFrame, words: int) -> DataFrame:
    """The least row, as JSON, of each key and set of rows (row struct, key, text); rows without words are equal if their texts are."""
    schema = rows.withColumn("fp", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [_print(own) for own in _sets(views(batch.column("text")), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.binary())], names=[*batch.schema.names, "fp"])

    wordless = F.when(F.col("fp").isNull(), F.col("text"))
    return rows.mapInArrow(run, schema).groupBy("key", "fp", wordless.alias("text")).agg(F.min_by("row", F.to_json("row")).alias("row"))


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", nulls: bool = False) -> DataFrame:
    """``docs`` without the documents that are in the group of one with a smaller id, and one row of each id and set.

    Rows with a null id stay, one of each set; with ``nulls`` those of equal text
    are a document whose id is above 2**62, so that any other of its group stays.
    """
    scratch = Scratch(docs.sparkSession, "deduplicated")
    own, body = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")
    if nulls:
        own = F.coalesce(own, F.shiftrightunsigned(F.xxhash64(body), 2) + F.lit(1 << 62))
    # Columns travel under their places, so no name of theirs can clash.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], own.alias("key"), body.alias("text"))
    every = scratch.keep(signatures(rows, words, "key", "text"), "signatures")
    inner = Scratch(docs.sparkSession, "minhash")
    gone = scratch.keep(near_duplicates(rows, words, percent, "key", "text", every, inner).where("not kept").select(F.col("key").alias("gone")), "gone")
    again = scratch.keep(every.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("id").alias("gone")), "again")
    inner.delete(inner.path)
    scratch.drop(every)
    places = [f"c{i}" for i in range(len(docs.columns))]
    packed = F.struct(*places).alias("row")
    # Merges at any size: the documents that go grow with the corpus.
    out = rows.where("key is not null").join(gone.unionByName(again).hint("merge"), F.col("key") == F.col("gone"), "left_anti").select(*places)
    if not again.isEmpty():
        more = rows.join(again.join(gone, "gone", "left_anti").hint("merge"), F.col("key") == F.col("gone"), "left_semi")
        out = out.unionByName(_single(more.select(packed, "key", "text"), words).select("row.*"))
    if not nulls and not docs.where(F.col(f"`{key}`").isNull()).isEmpty():
        out = out.unionByName(_single(rows.where("key is null").select(packed, "key", "text"), words).select("row.*"))
    return out.select(*[F.col(c).alias(name) for c, name in zip(places, docs.columns, strict=True)])
