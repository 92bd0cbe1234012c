"""A cursor over a query's rows: one running job, one partition at a time on the driver."""

from __future__ import annotations

import datetime as dt
import decimal
import itertools
import json

from pyspark.sql import DataFrame, Row

from docweft.errors import InvalidQueryError


def _plain(value: object) -> object:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


class Cursor:
    """page() frames, batch() lists, json() strings and one() rows, each from where the last left off."""

    def __init__(self, df: DataFrame):
        self._rows, self.columns = df.toLocalIterator(prefetchPartitions=True), df.columns

    def batch(self, size: int = 1000) -> list[dict]:
        if not isinstance(size, int) or isinstance(size, bool) or size < 1:
            raise InvalidQueryError("size must be a whole number from 1")
        return [{c: v for c, v in zip(self.columns, row, strict=True)} for row in itertools.islice(self._rows, size)]

    def page(self, size: int = 1000):
        import pandas as pd

        return pd.DataFrame(self.batch(size), columns=self.columns)

    def one(self) -> dict | None:
        return next(iter(self.batch(1)), None)

    def json(self, size: int = 1000) -> list[str]:
        return [json.dumps({c: _plain(v) for c, v in row.items()}, ensure_ascii=False) for row in self.batch(size)]
