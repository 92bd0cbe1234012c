"""Row numbers over a whole ordered table without gathering it in one task.

Rows fall into buckets by their first sort key: a fixed monotone function of it,
so any two passes agree and no sampling is needed. Buckets are counted (one
narrow pass, pre-aggregated), a running sum over the counts, a row a bucket,
tells how many rows stand before each, and rows are numbered within buckets. A
bucket is one of SLOTS parts of a doubling for numbers and moments, and the first
bytes for text; a key that a third of all rows share is one bucket, which is
sorted with spilling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.operators import nested as N

SLOTS = 1024
_LOWEST, _HIGHEST, _ZERO = -(1 << 60), 1 << 60, 1100


def _number(key: Column, kind: T.DataType) -> Column | None:
    """A double that never falls as the key rises; None for types without one."""
    if isinstance(kind, T.NumericType):
        return key.cast("double")
    if isinstance(kind, T.BooleanType):
        return key.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key).cast("double")
    if isinstance(kind, T.TimestampNTZType):  # by parts: a cast would go through a zone with gaps
        return F.unix_date(key.cast("date")).cast("double") * 86400 + F.hour(key) * 3600 + F.minute(key) * 60 + F.second(key)
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(key.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return None


def bucket(key: Column, kind: T.DataType) -> Column | None:
    """The bucket (long) of a sort key, nulls lowest and NaN highest; None for types that have none."""
    number = _number(key, kind)
    if number is None:
        return None
    size = F.abs(number)
    power = F.floor(F.log2(size))
    part = F.least(F.greatest(size / F.pow(F.lit(2.0), power) - 1, F.lit(0.0)), F.lit(1 - 2.0**-40))
    slot = (power + _ZERO) * SLOTS + F.floor(part * SLOTS)
    finite = F.when(number > 0, slot).when(number < 0, -slot).otherwise(F.lit(0).cast("long"))
    endless = F.when(number > 0, F.lit(_HIGHEST - 1)).otherwise(F.lit(_LOWEST + 1))
    return F.when(number.isNull(), F.lit(_LOWEST)).when(F.isnan(number), F.lit(_HIGHEST)).when(size == float("inf"), endless).otherwise(finite)


def numbered(df: DataFrame, ordering: tuple[tuple[str, bool], ...], keys: list[Column], name: str, back: bool = False) -> DataFrame:
    """``df`` with ``name``: the row's number from 1 in the order of ``keys``, which are ``ordering`` (reversed, if ``back``)."""
    first, up = ordering[0]
    own = bucket(N.column((first,)), df.schema[first].dataType) if first != f"{N.HIDDEN}_row" else None
    if own is None:  # no order that two passes could agree on
        return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long"))
    b, before = f"{N.HIDDEN}_b", f"{N.HIDDEN}_before"
    counts = df.select(own.alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy(F.col("b").asc() if up != back else F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("b").alias(f"{b}s"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias(before))
    placed = df.withColumn(b, own).join(starts, F.col(b) == F.col(f"{b}s"))
    return placed.withColumn(name, F.col(before) + F.row_number().over(Window.partitionBy(b).orderBy(*keys))).drop(b, f"{b}s", before)
