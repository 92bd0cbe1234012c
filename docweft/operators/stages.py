"""Raw JSON stages, interpreted as DataFrame operations.

$match $addFields $set $project $unset $group $sort $limit $skip $unwind
$replaceRoot $count; any other stage is refused. Strings that start with "$" are
fields, {"$literal": x} is x, {"$date": "..."} a moment.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.errors import InvalidQueryError, UnsupportedError
from docweft.functions import scalars as S
from docweft.operators import nested as N


def parse_stage(text: object) -> dict:
    """One JSON object with one key that starts with $."""
    if not isinstance(text, str):
        raise InvalidQueryError("a stage must be one JSON string")
    try:
        stage = json.loads(text)
    except ValueError:
        raise InvalidQueryError("a stage must be valid JSON") from None
    if not isinstance(stage, dict) or len(stage) != 1:
        raise InvalidQueryError("a stage must be a JSON object with a single key")
    if not next(iter(stage)).startswith("$"):
        raise InvalidQueryError("the key of a stage must start with $")
    return stage


def _moment(text: object) -> S.Operand:
    if not isinstance(text, str):
        raise InvalidQueryError("$date takes a string")
    return S.literal(dt.datetime.fromisoformat(text.replace("Z", "+00:00")))


def _field(df: DataFrame, name: str) -> S.Operand:
    path = N.find(df.schema, name)
    return S.Operand(F.lit(None)) if path is None else S.Operand(N.column(path), N.kind_of(df.schema, path))


_SIMPLE = {"$eq": "==", "$ne": "!=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<=", "$subtract": "-", "$divide": "/", "$mod": "%", "$pow": "**"}
_FOLDED = {"$and": "&", "$or": "|", "$add": "+", "$multiply": "*"}
_UNARY = {"$abs": "abs", "$sqrt": "sqrt", "$exp": "exp", "$floor": "floor", "$ceil": "ceiling", "$log10": "log10", "$toLower": "tolower", "$toUpper": "toupper", "$strLenCP": "nchar", "$ln": "log", **{f"${n}": n for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")}}


def expression(df: DataFrame, x: object) -> S.Operand:
    if isinstance(x, str):
        if x == "$$ROOT":
            return S.Operand(F.struct(*[N.column((c,)).alias(c) for c in N.shown(df)]), T.StructType([df.schema[c] for c in N.shown(df)]))
        return _field(df, x[1:]) if x.startswith("$") else S.literal(x)
    if not isinstance(x, (dict, list)):
        return S.literal(x)
    if isinstance(x, list):
        return S.Operand(F.array(*[expression(df, y).column for y in x]), T.ArrayType(T.NullType()))
    if len(x) != 1 or not next(iter(x)).startswith("$"):
        return S.Operand(F.struct(*[expression(df, v).column.alias(k) for k, v in x.items()]))
    (op, given), = x.items()
    if op == "$literal":
        return S.literal(given)
    if op == "$date":
        return _moment(given)
    if op == "$cond":
        if isinstance(given, dict):
            given = [given.get("if"), given.get("then"), given.get("else")]
        c, a, b = (expression(df, y) for y in given)
        return S.Operand(F.when(c.column, a.column).otherwise(b.column), a.kind)
    if op == "$switch":
        out = None
        for branch in given["branches"]:
            c, v = expression(df, branch["case"]).column, expression(df, branch["then"]).column
            out = F.when(c, v) if out is None else out.when(c, v)
        return S.Operand(out.otherwise(expression(df, given.get("default")).column))
    raw = given if isinstance(given, list) else [given]
    if op == "$in":
        if isinstance(raw[1], list):
            return S.Operand(S.member(expression(df, raw[0]), [y.get("$literal") if isinstance(y, dict) else y for y in raw[1]]), T.BooleanType())
        return S.Operand(S.member(expression(df, raw[0]), expression(df, raw[1])), T.BooleanType())
    args = [expression(df, y) for y in raw]
    if op == "$eq" and any(a.literal and a.value is None for a in args):
        other = args[0] if args[1].literal and args[1].value is None else args[1]
        return S.Operand(other.column.isNull(), T.BooleanType())
    if op == "$ne" and any(a.literal and a.value is None for a in args):
        other = args[0] if args[1].literal and args[1].value is None else args[1]
        return S.Operand(other.column.isNotNull(), T.BooleanType())
    if op == "$not":
        return S.Operand(~args[0].column, T.BooleanType())
    if op in _SIMPLE and len(args) == 2:
        return S.Operand(S.BINARY[_SIMPLE[op]][0](*args))
    if op in _FOLDED and args:
        out = args[0]
        for a in args[1:]:
            out = S.Operand(S.BINARY[_FOLDED[op]][0](out, a), out.kind)
        return out
    if op in _UNARY and len(args) == 1:
        return S.Operand(S.SCALARS[_UNARY[op]][0](args[0]))
    if op in ("$round", "$trunc"):
        return S.Operand((S.round_even if op == "$round" else S.truncate)(*args), args[0].kind)
    if op == "$log":
        return S.Operand(S.logarithm(*args))
    if op == "$atan2":
        return S.Operand(F.atan2(args[0].column, args[1].column))
    if op in ("$min", "$max"):
        return S.Operand((S.least if op == "$min" else S.greatest)(*args), args[0].kind)
    if op == "$concat":
        return S.Operand(F.concat(*[S.as_text(a) for a in args]), T.StringType())
    if op == "$substrCP":
        return S.Operand(F.substring(args[0].column, args[1].column.cast("int") + 1, args[2].column.cast("int")), T.StringType())
    if op == "$ifNull":
        return S.Operand(F.coalesce(*[a.column for a in args]), args[0].kind)
    raise UnsupportedError(f"stage operator {op}")


def _test(df: DataFrame, key: str, op: str, to: object) -> Column:
    """A field against a value in query form: never null, and an array field passes by any of its elements."""
    found = _field(df, key)
    if op in ("$ne", "$nin"):  # the rows that the positive form leaves, nulls among them
        return ~_test(df, key, {"$ne": "$eq", "$nin": "$in"}[op], to)

    def holds(x: S.Operand) -> Column:
        if op == "$in":
            return S.member(x, list(to))
        value = expression(df, to if isinstance(to, dict) else {"$literal": to})
        if op == "$eq" and value.literal and value.value is None:
            return x.column.isNull()
        return F.coalesce(S.BINARY[_SIMPLE[op]][0](x, value), F.lit(False))

    if isinstance(found.kind, T.ArrayType) and not isinstance(to, list) or isinstance(found.kind, T.ArrayType) and op == "$in":
        any_of = F.coalesce(F.exists(found.column, lambda e: holds(S.Operand(e, found.kind.elementType))), F.lit(False))
        null = op == "$eq" and to is None or op == "$in" and None in to
        return any_of | found.column.isNull() if null else any_of
    if isinstance(to, list) and op == "$eq":
        kind = found.kind.simpleString() if found.kind is not None else "array<string>"
        return F.coalesce(found.column == F.array(*[F.lit(x) for x in to]).cast(kind), F.lit(False)) if isinstance(found.kind, T.ArrayType) else F.lit(False)
    return holds(found)


def _condition(df: DataFrame, query: dict) -> Column:
    """Query form: {"field": value or {"$gt": ...}}, $and, $or, $expr."""
    out = F.lit(True)
    for key, value in query.items():
        if key == "$expr":
            test = expression(df, value).column
        elif key in ("$and", "$or"):
            parts = [_condition(df, q) for q in value]
            test = parts[0]
            for p in parts[1:]:
                test = test & p if key == "$and" else test | p
        elif key.startswith("$"):
            raise UnsupportedError(f"$match operator {key}")
        elif isinstance(value, dict) and value and all(k.startswith("$") and k != "$date" for k in value):
            test = F.lit(True)
            for op, to in value.items():
                if op == "$exists":
                    test = test & (_field(df, key).column.isNotNull() if to else _field(df, key).column.isNull())
                elif op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin"):
                    if op in ("$in", "$nin") and not isinstance(to, list):
                        raise InvalidQueryError(f"{op} takes an array")
                    test = test & _test(df, key, op, to)
                else:
                    raise UnsupportedError(f"$match operator {op}")
        else:
            test = _test(df, key, "$eq", value)
        out = out & test
    return out


def _project(df: DataFrame, spec: dict) -> DataFrame:
    spec = dict(spec)
    off = [k for k, v in spec.items() if v in (0, False) and not isinstance(v, (dict, str, list))]
    on = {k: v for k, v in spec.items() if k not in off}
    if not on:
        return _without(df, off)
    same, made, below = [], [], []
    if "_id" in df.columns and "_id" not in spec:
        same.append(("_id",))
    for name, value in on.items():
        if isinstance(value, (int, bool, float)) and not isinstance(value, str):
            path = N.find(df.schema, name)
            if path is not None:
                same.append(path)
        else:
            own = expression(df, value).column
            if len(path := N.place(df.schema, name)) > 1:
                below.append((path, own.alias(f"{N.HIDDEN}_p{len(below)}")))
            else:
                made.append(own.alias(name))
    out = df.select(*N.regrown(same), *made, *[c for _, c in below])
    for i, (path, _) in enumerate(below):
        own = N.column((f"{N.HIDDEN}_p{i}",))
        if path[0] in out.columns:
            out = N.replaced(out, path, own)
        else:
            for part in reversed(path[1:]):
                own = F.struct(own.alias(part))
            out = N.replaced(out, path[:1], own)
    return out.select(*[N.column((c,)) for c in N.shown(out)])


def _without(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        path = N.find(df.schema, name)
        if path is None:
            continue
        if len(path) == 1:
            df = df.select(*[N.column((c,)) for c in df.columns if c != name])
        else:
            df = N.replaced(df, path[:-1], N.column(path[:-1]).dropFields("`" + path[-1] + "`"))
    return df


def _accumulator(df: DataFrame, spec: object) -> Column:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise InvalidQueryError("an accumulator is an object with a single key")
    (op, given), = spec.items()
    x = expression(df, given).column
    if op == "$sum":
        return F.count(F.lit(1)) if given == 1 and not isinstance(given, bool) else F.coalesce(F.sum(x), F.lit(0))
    found = {"$avg": F.avg, "$min": F.min, "$max": F.max, "$push": F.collect_list}.get(op)
    if found is None:
        raise UnsupportedError(f"accumulator {op}")
    return found(x)


def _group(df: DataFrame, spec: dict) -> DataFrame:
    spec = dict(spec)
    if "_id" not in spec:
        raise InvalidQueryError("$group needs _id")
    key = spec.pop("_id")
    sums = [_accumulator(df, v).alias(k) for k, v in spec.items()]
    if key is None:
        out = df.agg(*sums) if sums else df.agg(F.count(F.lit(1)).alias("__ord_n"))
        return out.select(F.lit(None).cast("string").alias("_id"), *[N.column((k,)) for k in spec])
    own = expression(df, key).column.alias("_id")
    return df.groupBy(own).agg(*sums) if sums else df.select(own).distinct()


def apply_stage(df: DataFrame, stage: dict) -> DataFrame:
    (name, spec), = stage.items()
    if name == "$match":
        return df.where(_condition(df, spec))
    if name in ("$addFields", "$set"):
        given = {k: expression(df, v).column for k, v in spec.items()}
        for key, value in given.items():
            df = N.replaced(df, N.find(df.schema, key) or N.place(df.schema, key), value)
        return df
    if name == "$project":
        return _project(df, spec)
    if name == "$unset":
        return _without(df, [spec] if isinstance(spec, str) else list(spec))
    if name == "$group":
        return _group(df, spec)
    if name == "$sort":
        keys = []
        for key, way in spec.items():
            c = _field(df, key).column
            keys.append(c.asc() if way == 1 else c.desc())
        return df.orderBy(*keys) if keys else df
    if name in ("$limit", "$skip"):
        if isinstance(spec, bool) or not isinstance(spec, int) or spec < 0:
            raise InvalidQueryError(f"{name} takes a whole number from 0")
        return df.limit(spec) if name == "$limit" else df.offset(spec)
    if name == "$unwind":
        spec = {"path": spec} if isinstance(spec, str) else dict(spec)
        at = str(spec.get("path", ""))
        if not at.startswith("$"):
            raise InvalidQueryError("$unwind takes a path that starts with $")
        path = N.find(df.schema, at[1:])
        if path is None:
            return df if spec.get("preserveNullAndEmptyArrays") else df.limit(0)
        return N.unwound(df, path, bool(spec.get("preserveNullAndEmptyArrays")), spec.get("includeArrayIndex"))
    if name == "$replaceRoot":
        root = expression(df, spec["newRoot"]).column.alias("__ord_root")
        return df.select(root).select("__ord_root.*")
    if name == "$count":
        return df.agg(F.count(F.lit(1)).alias(spec))
    raise UnsupportedError(f"stage {name}")
