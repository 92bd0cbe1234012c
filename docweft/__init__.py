"""Lazy document analytics on Spark."""

from docweft.errors import InvalidQueryError, QueryError, UnsupportedError
from docweft.operators.table import ROW_SEQ, LazyTable, desc
from docweft.sources.source import Source

__all__ = ["ROW_SEQ", "InvalidQueryError", "LazyTable", "QueryError", "Source", "UnsupportedError", "desc"]
