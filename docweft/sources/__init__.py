"""Where tables come from."""
from docweft.sources.source import Source

__all__ = ["Source"]
