"""Bounded, repeatable samples of labelled documents for the classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, key: str = "doc_id", text: str = "text") -> tuple[pa.Table, float]:
    """((text, y) of at most ``rows`` documents of each class 0 and 1 whose id meets ``learn``, the least by hash of the id; share of class 1 among all).

    Only labels of documents that ``docs`` holds count. An id labelled both ways,
    or with null, is left out; of rows that repeat an id the least text is taken,
    whole. ``learn`` reads the column _id.
    """
    marks = labels.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn)
    marks = marks.groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    held = marks.join(docs.select(F.col(f"`{key}`").alias("_id")), "_id", "left_semi")
    order = F.struct(F.xxhash64("_id").alias("h"), F.col("_id"), F.col("y"))
    picked = [held.where(F.col("y") == y).select(order.alias("o")).orderBy("o").limit(rows) for y in (0, 1)]
    count = held.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    many = {r.y: r.n for r in count.collect()}
    few = picked[0].unionByName(picked[1]).select("o._id", "o.y")  # at most 2 * rows rows of 12 bytes
    own = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"))
    table = own.join(F.broadcast(few), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("_id", "text", "y").toArrow()
    share = many.get(1, 0) / max(1, sum(many.values()))
    return table.sort_by("_id").select(["text", "y"]), share
