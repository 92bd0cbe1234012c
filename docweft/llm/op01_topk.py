"""Exact top-k search by exhaustive term-at-a-time accumulation.

A row is a sparse vector: term (position) -> integer weight. Candidates are
packed into blocks, each with its postings: for every term the candidates that
have it and their weights. A query adds, term by term, its weight times the
posting weights into a dense score array over the block; the k best of a block
are cut out by partition selection, and the bests of all blocks are merged.

Scale: blocks are packed where the rows are read. Each block goes to one of
``cells`` cells and blocks of queries to every cell, so all queries meet all rows
without a cross join, a broadcast or a row repeated more than once a cell; a task
holds one block of each. The shuffle of results is k rows a query and block,
pre-cut to k by query in each task.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; null ids take no part; weights beyond 64 bits are an
error, and so is a score beyond them that is among the k best (sums that could
leave them are taken in unbounded integers); a query's own id is no candidate;
rows that repeat an id, whatever their vectors, count as one candidate (the
greatest score); ties go to the smaller id; vectors of unequal lengths meet in the terms they share; fewer than k
candidates give fewer rows; an empty table gives none; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 4096  # rows of a block
QUERIES = 256


def usable(vector: Column) -> Column:
    """A vector, or null where it takes no part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(v) > 0) & fine, v)


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, as long; an error where that has none."""
    return F.transform(vector, lambda x: F.when(F.abs(x * float(scale)) < 2.0**63, F.floor(x * float(scale))).otherwise(F.raise_error(F.lit("a component's weight is beyond 64 bits")).cast("long")))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, at, terms, weights), all binary: up to ``size`` rows each, as sparse rows; block is a digest of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                ids = np.asarray(part.column("id"), np.int64)
                lists = part.column("weights")
                lengths = np.asarray(lists.value_lengths(), np.int64)
                weights = np.asarray(lists.flatten(), np.int64)
                terms = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                row = np.repeat(np.arange(len(ids)), lengths)
                live = weights != 0
                at = np.concatenate([[0], np.cumsum(np.bincount(row[live], minlength=len(ids)))])
                out = [ids.tobytes(), at.astype(np.int64).tobytes(), terms[live].astype(np.int32).tobytes(), weights[live].tobytes()]
                digest = hashlib.blake2b(b"".join(out), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (digest, *out)], names=["block", "ids", "at", "terms", "weights"])

    return rows.mapInArrow(run, "block binary, ids binary, at binary, terms binary, weights binary")


class Postings:
    """A block of candidates, term by term."""

    def __init__(self, ids: bytes, at: bytes, terms: bytes, weights: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        row = np.repeat(np.arange(len(self.ids), dtype=np.int64), np.diff(np.frombuffer(at, np.int64)))
        terms, weights = np.frombuffer(terms, np.int32), np.frombuffer(weights, np.int64)
        order = np.argsort(terms, kind="stable")
        names, first = np.unique(terms[order], return_index=True)
        ends = np.append(first[1:], len(order))
        self.of = {int(t): (row[order[a:b]], weights[order[a:b]]) for t, a, b in zip(names, first, ends, strict=True)}
        self.most = {t: float(np.abs(own.astype(np.float64)).max()) for t, (_, own) in self.of.items()}

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of all candidates: 64-bit where no sum can leave that, else unbounded integers."""
        bound = sum(abs(float(w)) * self.most.get(t, 0.0) for t, w in zip(terms.tolist(), weights.tolist(), strict=True))
        score = np.zeros(len(self.ids), np.int64 if bound < 2.0**62 else object)
        for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
            rows, own = self.of.get(term, (None, None))
            if rows is None:
                continue
            own = own.astype(score.dtype, copy=False)
            if len(rows) == len(score):
                score += weight * own  # every candidate has it, in order
            else:
                score[rows] += weight * own  # a candidate stands once in a posting list
        return score


def _ranked(ids: np.ndarray, score: np.ndarray, places: np.ndarray) -> np.ndarray:
    if score.dtype != object:
        return places[np.lexsort((ids[places], -score[places]))]
    return np.array(sorted(places.tolist(), key=lambda i: (-score[i], ids[i])), np.int64)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to smaller ids, one an id."""
    if len(score) > 4 * k and score.dtype != object:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        places = np.flatnonzero(score >= cut)
    else:
        places = np.arange(len(score))
    places = _ranked(ids, score, places)
    _, low = np.unique(ids[places], return_index=True)
    distinct = places[np.sort(low)]
    if len(distinct) < k and len(places) < len(score):
        # Repeated ids took places: all candidates are looked at.
        places = _ranked(ids, score, np.arange(len(score)))
        _, low = np.unique(ids[places], return_index=True)
        distinct = places[np.sort(low)]
    return distinct[:k]


def search(queries: DataFrame, candidates: DataFrame, k: int, cells: int | None = None, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """The k greatest inner products of each query with all candidates.

    Both sides: id long, weights array<long> (no nulls). Returns query_id, rank
    int from 1, id, score long.
    """
    spark = queries.sparkSession
    cells = cells or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = [x.where("id is not null and weights is not null").select(F.col("id").cast("long"), "weights") for x in (candidates, queries)]
    left = _blocks(sides[0], block).withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)))
    right = _blocks(sides[1], query_block).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "at", "terms", "weights")]).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    met = left.join(right, "cell").drop("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["block"] != held:
                    held, postings = row["block"], Postings(row["ids"], row["at"], row["terms"], row["weights"])
                ids, at = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_at"], np.int64)
                terms, weights = np.frombuffer(row["q_terms"], np.int32), np.frombuffer(row["q_weights"], np.int64)
                out: tuple[list, list, list] = ([], [], [])
                for q, query in enumerate(ids.tolist()):
                    score = postings.scores(terms[at[q] : at[q + 1]], weights[at[q] : at[q + 1]])
                    places = best(postings.ids, score, k + 1)
                    places = places[postings.ids[places] != query][:k]
                    out[0].append(np.full(len(places), query))
                    out[1].append(postings.ids[places])
                    out[2].append(score[places])
                wide = [pa.array([Decimal(int(x)) for x in one], pa.decimal128(38, 0)) if one.dtype == object else pa.array(one).cast(pa.decimal128(38, 0)) for one in out[2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()), pa.concat_arrays(wide)], names=["query_id", "id", "score"])

    found = met.mapInArrow(run, "query_id long, id long, score decimal(38, 0)")
    # Repeated query rows and repeated ids agree here; the rest is k rows a query and block.
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fits = F.abs("score") <= F.lit((1 << 63) - 1).cast("decimal(38, 0)")
    score = F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score among the best is beyond 64 bits")).cast("long"))
    return ranked.select("query_id", "rank", "id", score.alias("score"))


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: rows with id divisible by ``every`` against all rows but their own."""
    rows = embeddings.select(F.col(f"`{key}`").cast("long").alias("id"), usable(F.col(f"`{vector}`")).alias("v")).where("v is not null").select("id", quantised(F.col("v"), scale).alias("weights"))
    found = search(rows.where(F.col("id") % every == 0), rows, k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
