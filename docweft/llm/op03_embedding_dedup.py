"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosine, components.

Each table hashes a vector to the signs of its products with BITS random
hyperplanes; vectors that agree in any table are compared by cosine in double
precision. At cosine c a pair agrees in a table with (1 - acos(c) / pi) ** bits:
with 32 tables of 12 bits a pair at 0.95 is missed once in 34,000 (MISSED). With
more bits there are as many more tables as keep a pair at ``similar`` under that
(53 at 16 bits, 104 at 22); closer pairs are missed ever less.

Identical vectors are one class before hashing. Of buckets with the same members
in several tables only the first is compared, so a dense cluster is moved once
while it stays together. A bucket is cut into blocks of
BLOCK vectors by hash, and pairs of blocks are the unit of work, so a bucket
with a third of all rows is many tasks of at most 2 * BLOCK vectors. A pair that
agrees in several tables counts in the first of them. A unit of work sends back
a number of links a vector and a spanning forest, never its pairs.

Scale: the shuffle is a row a table and vector (float32 inputs stay 4 bytes a
component); bits grow by one as the number of vectors doubles from a million, so
that buckets stay small, and the tables with them (by an eighth or so a bit).

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and vectors of another length than a pair's other, link with
nothing and are kept; null ids are left out; rows that repeat an id are one
vector (the least by order of arrays; a null one gives way); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.components import components
from docweft.llm.scratch import Scratch

TABLES, BITS, BLOCK, SEED = 32, 12, 1024, 20240229
SIMILAR = 0.95
#: Largest share of the pairs at the threshold that may share no bucket.
MISSED = 1 / 34_000


def tables_for(bits: int, similar: float = SIMILAR) -> int:
    """Tables of ``bits`` bits, TABLES at least, that a pair at ``similar`` shares no bucket of with MISSED at most."""
    agree = (1 - np.arccos(np.clip(similar, -1.0, 1.0)) / np.pi) ** bits
    if not 0 < agree < 1:
        return TABLES
    return max(TABLES, int(np.ceil(np.log(MISSED) / np.log1p(-agree))))


def _planes(dims: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, tables * bits))


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _hashed(rows: DataFrame, tables: int, bits: int, width: int) -> DataFrame:
    """(id, size, raw binary, sig binary): sig holds an int32 a table."""
    kind = np.float32 if width == 4 else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                lists = part.column("v")
                lengths = np.asarray(lists.value_lengths(), np.int64)
                flat, ends = np.asarray(lists.flatten()).astype(kind), np.concatenate([[0], np.cumsum(lengths)])
                raws, sigs = [b""] * len(lengths), [b""] * len(lengths)
                for dims in np.unique(lengths):
                    at = np.flatnonzero(lengths == dims)
                    raw = flat[(ends[at][:, None] + np.arange(dims)).ravel()].reshape(len(at), dims)
                    signs = (_unit(raw) @ _planes(int(dims), tables, bits) > 0).reshape(len(at), tables, bits)
                    sig = (signs << np.arange(bits)).sum(axis=2).astype(np.int32)
                    for j, i in enumerate(at):
                        raws[i], sigs[i] = raw[j].tobytes(), sig[j].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("size"), pa.array(raws, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "size", "raw", "sig"])

    return rows.mapInArrow(run, "id long, size long, raw binary, sig binary")


def _links(x: np.ndarray, y: np.ndarray, at: float) -> np.ndarray:
    return x @ y.T >= at


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join something new among n places."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    kept = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


class Unit:
    """Vectors of one bucket's pair of blocks (i, j), i <= j; compares across blocks, or within one."""

    def __init__(self, width: int, similar: float):
        self.kind, self.similar = (np.float32 if width == 4 else np.float64), similar

    def work(self, table: int, same: bool, ids, sizes, raws, sigs, sides) -> tuple[list, list]:
        """[(id, links)], [(id, id)]."""
        counts, edges = [], []
        dims = np.array([len(r) for r in raws])
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            own, size, side = ids[at], sizes[at], sides[at]
            x = _unit(np.frombuffer(b"".join(raws[i] for i in at), self.kind).reshape(len(at), -1))
            sig = np.frombuffer(b"".join(sigs[i] for i in at), np.int32).reshape(len(at), -1)
            left, right = (np.arange(len(at)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if not len(left) or not len(right) or same and len(left) < 2:
                continue
            a, b = np.nonzero(_links(x[left], x[right], self.similar))
            a, b = left[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            # The first table in which the pair agrees counts it.
            for low in range(0, table):
                live = sig[a, low] != sig[b, low]
                a, b = a[live], b[live]
            if not len(a):
                continue
            links = np.bincount(a, size[b], len(at)) + np.bincount(b, size[a], len(at))
            counts += [(int(own[i]), int(links[i])) for i in np.flatnonzero(links)]
            edges += [(int(own[i]), int(own[j])) for i, j in _forest(a, b, len(at))]
        return counts, edges


def compare(hashed: DataFrame, tables: int, width: int, similar: float, block: int, scratch: Scratch) -> DataFrame:
    """(a, b, links): rows with b null carry links of a from one unit of work; the others are forest links."""
    spread = hashed.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring(F.col("sig"), t * 4 + 1, F.lit(4)))).alias("t", "s"))
    members = F.struct(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(1)))).alias("members")
    full = spread.groupBy("t", "s").agg(members).where("members.m > 1")
    # A pair counts in its first table, and a bucket with the same members in an earlier one is not that.
    full = scratch.keep(full.groupBy("members").agg(F.min(F.struct("t", "s")).alias("x")).select("x.t", "x.s", "members.m"), "buckets")
    shared = spread.join(full, ["t", "s"]).select("id", "t", "s", F.ceil(F.col("m") / block).cast("int").alias("nb"))
    # One row a bucket in which the vector has company, then one a pair of blocks.
    member = hashed.join(shared, "id").withColumn("me", F.pmod(F.xxhash64("id", F.lit(7)), F.col("nb")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    member = member.select("id", "size", "raw", "sig", "t", "s", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), (F.col("me") > F.col("other")).cast("int").alias("side"))
    cells = member.repartition("t", "s", "i", "j").sortWithinPartitions("t", "s", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = Unit(width, similar)
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> tuple[list, list]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            get = lambda c: whole.column(c).to_numpy()
            same = whole.column("i")[0] == whole.column("j")[0]
            return unit.work(whole.column("t")[0].as_py(), same, get("id"), get("size"), whole.column("raw").to_pylist(), whole.column("sig").to_pylist(), get("side"))

        def out(counts: list, edges: list) -> pa.RecordBatch:
            a = [x for x, _ in counts] + [x for x, _ in edges]
            b = [None] * len(counts) + [y for _, y in edges]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([n for _, n in counts] + [0] * len(edges), pa.int64())], names=["a", "b", "links"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.array([int.from_bytes(x, "little") for x in batch.column("s").to_pylist()], np.int64)
            keys = np.stack([np.asarray(batch.column("t"), np.int64), s, np.asarray(batch.column("i"), np.int64), np.asarray(batch.column("j"), np.int64)], axis=1)
            cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [batch.num_rows]])
            counts, edges = [], []
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                key = tuple(keys[low])
                if key != last and held:
                    c, e = done(held)
                    counts += c
                    edges += e
                    held = []
                held.append(batch.slice(low, high - low))
                last = key
            yield out(counts, edges)
        if held:
            yield out(*done(held))

    return cells.mapInArrow(run, "a long, b long, links long")


def near_duplicates(rows: DataFrame, similar: float = SIMILAR, key: str = "vec_id", vector: str = "embedding", tables: int | None = None, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """A row an id: n_links (other vectors linked directly), component_id (least id reachable), kept (is its own component)."""
    scratch = Scratch(rows.sparkSession, "embeddings")
    kind = rows.schema[vector].dataType.elementType.simpleString()
    width = 4 if kind == "float" else 8
    v = F.col(f"`{vector}`") if width == 4 else F.col(f"`{vector}`").cast("array<double>")
    once = rows.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    once = scratch.keep(once.withColumn("v", F.when((F.size("v") > 0) & sound, F.col("v"))), "once")
    if bits is None:
        bits = max(BITS, (max(once.count(), 1) - 1).bit_length() - 8)
        bits = min(bits, 30)
    tables = tables_for(bits, similar) if tables is None else tables
    # -0.0 and 0.0 are one value of a vector.
    classes = once.where("v is not null").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind if width == 4 else "double"))).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    hashed = scratch.keep(_hashed(classes.select("id", "size", "v"), tables, bits, width), "hashed")
    found = scratch.keep(compare(hashed, tables, width, similar, block, scratch), "found")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    of = components(found.where("b is not null").select("a", "b"), scratch)
    per_class = hashed.select("id", "size").join(links.withColumnRenamed("a", "id"), "id", "left").join(of.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    v_of = classes.select("v", F.col("id").alias("rep"))
    members = once.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind if width == 4 else "double"))).join(v_of, "v", "left").select("id", "rep")
    out = members.join(per_class, "rep", "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
