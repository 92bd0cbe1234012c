"""The scalar functions that may stand in an expression.

Every function takes and returns Columns; Operand carries the literal a Column
was made from where semantics depend on it (digits, separators, lists).
SCALARS maps a name to (builder, least and most number of arguments, stage
operator for rendering).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.errors import InvalidQueryError, UnsupportedError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Operand:
    """A Column with its type, if known, and the value it was made from, if literal."""

    column: Column
    kind: T.DataType | None = None
    value: object = None
    literal: bool = False


def literal(value: object) -> Operand:
    """Scalars, None and moments; naive moments are UTC, and all keep milliseconds."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        value = value.replace(microsecond=value.microsecond // 1000 * 1000)
        return Operand(F.to_timestamp_ntz(F.lit(value.isoformat(sep=" ", timespec="milliseconds"))), T.TimestampNTZType(), value, True)
    if isinstance(value, dt.date):
        return literal(dt.datetime(value.year, value.month, value.day))
    if value is None or isinstance(value, (bool, int, float, str)):
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        return Operand(F.lit(value), kinds.get(type(value)), value, True)
    raise InvalidQueryError(f"a local value must be a scalar, a list of scalars, a moment or None, not {type(value).__name__}")


def _whole(x: Operand, rounded: Column) -> Column:
    """floor and ceiling of fractional input stay fractional."""
    return rounded.cast("double") if isinstance(x.kind, (T.DoubleType, T.FloatType)) or x.kind is None else rounded


def _digits(x: Operand | None, what: str) -> int:
    if x is None:
        return 0
    if not x.literal or isinstance(x.value, bool) or not isinstance(x.value, (int, float)):
        raise InvalidQueryError(f"the digits of {what} must be a literal number")
    return int(x.value)


def round_even(x: Operand, digits: Operand | None = None) -> Column:
    """Half to even, as the server's rounding."""
    return F.bround(x.column, _digits(digits, "round"))


def truncate(x: Operand, digits: Operand | None = None) -> Column:
    n = _digits(digits, "trunc")
    if n == 0:
        return x.column - x.column % F.lit(1)
    scaled = x.column * F.lit(10.0**n)
    return (scaled - scaled % F.lit(1)) / F.lit(10.0**n)


def logarithm(x: Operand, base: Operand | None = None) -> Column:
    return F.ln(x.column) if base is None else F.ln(x.column) / F.ln(base.column)


def as_text(x: Operand) -> Column:
    """Numbers without a fraction read as whole numbers in text."""
    if isinstance(x.kind, T.StringType):
        return x.column
    if isinstance(x.kind, (T.DoubleType, T.FloatType)) or x.kind is None:
        number = x.column.cast("double") if x.kind is not None else x.column.try_cast("double")
        if x.kind is None:
            return x.column.cast("string")
        whole = (number % F.lit(1) == 0) & (F.abs(number) < F.lit(1e15))
        return F.when(whole, number.cast("long").cast("string")).otherwise(x.column.cast("string"))
    return x.column.cast("string")


def paste(*parts: Operand, sep: object = " ") -> Column:
    if not isinstance(sep, str):
        raise InvalidQueryError("sep must be a literal string")
    out: list[Column] = []
    for i, part in enumerate(parts):
        if i and sep:
            out.append(F.lit(sep))
        out.append(as_text(part))
    return F.concat(*out)


def substring(x: Operand, first: Operand, last: Operand) -> Column:
    """Characters first to last, from 1; a start before 1 is 1."""
    start = F.greatest(first.column.cast("int"), F.lit(1))
    return F.substring(x.column, start, F.greatest(last.column.cast("int") - start + 1, F.lit(0)))


def least(*xs: Operand) -> Column:
    return xs[0].column if len(xs) == 1 else F.least(*[x.column for x in xs])


def greatest(*xs: Operand) -> Column:
    return xs[0].column if len(xs) == 1 else F.greatest(*[x.column for x in xs])


def member(x: Operand, among: Operand | list) -> Column:
    """Two-valued: null is in a list only if the list has null."""
    if isinstance(among, list):
        values = [literal(v) for v in among]
        rest = [v.column for v in values if v.value is not None]
        found = F.coalesce(x.column.isin(*rest), F.lit(False)) if rest else F.lit(False)
        return found | x.column.isNull() if len(rest) < len(values) else found
    if among.kind is not None and not isinstance(among.kind, T.ArrayType):
        raise UnsupportedError("the right side of `in` must be a list or an array field")
    return F.coalesce(F.array_contains(among.column, x.column), F.lit(False))


def _one(f: Callable[[Column], Column]) -> Callable[[Operand], Column]:
    return lambda x: f(x.column)


#: name: (builder, least arguments, most, stage operator)
SCALARS: dict[str, tuple[Callable, int, int, str]] = {
    "abs": (_one(F.abs), 1, 1, "$abs"),
    "sqrt": (_one(F.sqrt), 1, 1, "$sqrt"),
    "exp": (_one(F.exp), 1, 1, "$exp"),
    "floor": (lambda x: _whole(x, F.floor(x.column)), 1, 1, "$floor"),
    "ceiling": (lambda x: _whole(x, F.ceil(x.column)), 1, 1, "$ceil"),
    "trunc": (truncate, 1, 2, "$trunc"),
    "round": (round_even, 1, 2, "$round"),
    "log": (logarithm, 1, 2, "$log"),
    "log10": (_one(F.log10), 1, 1, "$log10"),
    "atan2": (lambda y, x: F.atan2(y.column, x.column), 2, 2, "$atan2"),
    "pmin": (least, 1, 99, "$min"),
    "pmax": (greatest, 1, 99, "$max"),
    "tolower": (_one(F.lower), 1, 1, "$toLower"),
    "toupper": (_one(F.upper), 1, 1, "$toUpper"),
    "nchar": (lambda x: F.char_length(x.column).cast("long"), 1, 1, "$strLenCP"),
    "substr": (substring, 3, 3, "$substrCP"),
    "substring": (substring, 3, 3, "$substrCP"),
    "is_na": (lambda x: x.column.isNull(), 1, 1, "$eq"),
    "if_else": (lambda c, a, b: F.when(c.column, a.column).otherwise(b.column), 3, 3, "$cond"),
}
for _name in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh"):
    SCALARS[_name] = (_one(getattr(F, _name)), 1, 1, f"${_name}")


def subtract(x: Operand, y: Operand) -> Column:
    moments(x, y)
    return x.column - y.column


def moments(*xs: Operand) -> None:
    if any(isinstance(x.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) for x in xs):
        raise UnsupportedError("arithmetic on moments")


def divide(x: Operand, y: Operand) -> Column:
    moments(x, y)
    return x.column.cast("double") / y.column


def arithmetic(f: Callable[[Column, Column], Column]) -> Callable[[Operand, Operand], Column]:
    def run(x: Operand, y: Operand) -> Column:
        moments(x, y)
        return f(x.column, y.column)

    return run


#: name: (builder, stage operator)
BINARY: dict[str, tuple[Callable, str]] = {
    "+": (arithmetic(lambda a, b: a + b), "$add"),
    "-": (subtract, "$subtract"),
    "*": (arithmetic(lambda a, b: a * b), "$multiply"),
    "/": (divide, "$divide"),
    "%": (arithmetic(lambda a, b: a % b), "$mod"),
    "**": (arithmetic(F.pow), "$pow"),
    "==": (lambda x, y: x.column == y.column, "$eq"),
    "!=": (lambda x, y: x.column != y.column, "$ne"),
    ">": (lambda x, y: x.column > y.column, "$gt"),
    ">=": (lambda x, y: x.column >= y.column, "$gte"),
    "<": (lambda x, y: x.column < y.column, "$lt"),
    "<=": (lambda x, y: x.column <= y.column, "$lte"),
    "&": (lambda x, y: x.column & y.column, "$and"),
    "|": (lambda x, y: x.column | y.column, "$or"),
}
