"""The five aggregates; nulls are always skipped, and the sum of nothing is 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: (builder, stage operator)
AGGREGATES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "sum": (lambda x: F.coalesce(F.sum(x), F.lit(0)), "$sum"),
    "mean": (F.avg, "$avg"),
    "min": (F.min, "$min"),
    "max": (F.max, "$max"),
}


def count() -> Column:
    return F.count(F.lit(1))
