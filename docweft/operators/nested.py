"""Paths into struct columns: walking, rebuilding, replacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = tuple[str, ...]
HIDDEN = "__ord"


def column(path: Path) -> Column:
    """The Column of a path; parts are names, dots in them included."""
    return F.col(".".join("`" + part.replace("`", "``") + "`" for part in path))


def shown(df: DataFrame) -> list[str]:
    """Columns that are no bookkeeping."""
    return [c for c in df.columns if not c.startswith(HIDDEN)]


def kind_of(schema: T.StructType, path: Path) -> T.DataType | None:
    """The type at a path, None if there is none."""
    kind: T.DataType = schema
    for part in path:
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def leaves(schema: T.StructType, under: Path = ()) -> list[Path]:
    """Paths of all leaves; arrays, maps and empty structs are leaves."""
    kind = kind_of(schema, under)
    if not isinstance(kind, T.StructType) or not kind.names:
        return [under]
    return [leaf for f in kind.fields if under or not f.name.startswith(HIDDEN) for leaf in leaves(schema, (*under, f.name))]


def find(schema: T.StructType, name: str) -> Path | None:
    """A column of that very name, or a struct path spelled with dots."""
    if name in schema.names:
        return (name,)
    path = tuple(name.split("."))
    return path if len(path) > 1 and kind_of(schema, path) is not None else None


def place(schema: T.StructType, name: str) -> Path:
    """Where a field of a new name goes: into the struct that its first parts name, else a column of that very name."""
    path = tuple(name.split("."))
    return path if len(path) > 1 and isinstance(kind_of(schema, path[:1]), T.StructType) else (name,)


def regrown(paths: list[Path]) -> list[Column]:
    """Structs with the selected paths only, roots and fields in order of first mention; a null parent stays null."""
    tree: dict = {}
    for path in paths:
        at = tree
        for i, part in enumerate(path):
            if at.get(part, {}) is None:
                break  # all of it is selected already
            if i == len(path) - 1:
                at[part] = None
            else:
                at = at.setdefault(part, {})

    def build(at: dict | None, path: Path) -> Column:
        if at is None:
            return column(path)
        inner = F.struct(*[build(sub, (*path, part)).alias(part) for part, sub in at.items()])
        return F.when(column(path).isNotNull(), inner)

    return [build(sub, (part,)).alias(part) for part, sub in tree.items()]


def replaced(df: DataFrame, path: Path, value: Column) -> DataFrame:
    """``df`` with the value at a path: a column in place, a new one at the end, or a field of a struct."""
    root, there = path[0], len(path)
    while there > 2 and not isinstance(kind_of(df.schema, path[: there - 1]), T.StructType):
        there -= 1
    for part in reversed(path[there:]):  # structs that the path names and nothing has yet
        value = F.struct(value.alias(part))
    path = path[:there]
    if len(path) > 1:
        value = F.when(column((root,)).isNotNull(), column((root,)).withField(".".join("`" + p.replace("`", "``") + "`" for p in path[1:]), value))
    if root in df.columns:
        return df.select(*[value.alias(c) if c == root else column((c,)) for c in df.columns])
    return df.select(*[column((c,)) for c in df.columns], value.alias(root))


def unwound(df: DataFrame, path: Path, keep_empty: bool, position: str | None = None) -> DataFrame:
    """A row for each element at a path; what is no array is one element, and null or empty gives a row only if kept."""
    kind = kind_of(df.schema, path)
    if not isinstance(kind, T.ArrayType):
        out = df if keep_empty else df.where(column(path).isNotNull())
        return out if position is None else out.select(*[column((c,)) for c in out.columns], F.lit(None).cast("long").alias(position))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    opened = df.select(*[column((c,)) for c in df.columns], explode(column(path)).alias(f"{HIDDEN}_at", f"{HIDDEN}_element"))
    out = replaced(opened, path, column((f"{HIDDEN}_element",)))
    keep = [column((c,)) for c in df.columns]
    return out.select(*keep, *([column((f"{HIDDEN}_at",)).cast("long").alias(position)] if position else []))
