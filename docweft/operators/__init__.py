"""The verbs."""
from docweft.operators.table import ROW_SEQ, LazyTable

__all__ = ["ROW_SEQ", "LazyTable"]
