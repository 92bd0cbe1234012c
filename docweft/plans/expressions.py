"""Expressions: text parsed to a checked tree, then to a Column and to a stage document.

Text is Python expression syntax against a whitelist; nothing is evaluated as
Python. Names resolve to fields of the table first and to ``env`` second;
``data.x`` (or ``data["x"]``) is always a field, ``env.x`` always a local value.
A dotted name is a nested field. A ready-made Column passes through unchanged.
"""

from __future__ import annotations

import ast
import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.errors import InvalidQueryError, UnsupportedError
from docweft.functions import scalars as S
from docweft.functions.aggregates import AGGREGATES, count

_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Pow: "**", ast.BitAnd: "&", ast.BitOr: "|"}
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<="}


@dataclass(frozen=True)
class Node:
    """field(name), literal(value), list(values), or the call ``name`` of ``args``."""

    kind: str
    name: str = ""
    value: object = None
    args: tuple[Node, ...] = ()
    options: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Scope:
    """What names mean: ``find`` gives a field's (Column, type) or None."""

    find: Callable[[str], tuple[Column, T.DataType] | None]
    env: Mapping[str, object] = field(default_factory=dict)


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


def _local(name: str, scope: Scope) -> Node:
    if name not in scope.env:
        raise InvalidQueryError(f"cannot evaluate local expression `{name}`")
    value = scope.env[name]
    if isinstance(value, (list, tuple, set, frozenset)):
        for x in value:
            S.literal(x)
        return Node("list", value=list(value))
    S.literal(value)
    return Node("literal", value=value)


def parse(text: str, scope: Scope) -> Node:
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise InvalidQueryError(f"cannot read the expression {text!r}: {e.msg}") from None
    return _walk(tree, scope)


def _walk(node: ast.expr, scope: Scope) -> Node:
    if isinstance(node, ast.Constant):
        if node.value is not None and not isinstance(node.value, (bool, int, float, str)):
            raise UnsupportedError(f"literal {node.value!r}")
        return Node("literal", value=node.value)
    if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id in ("data", "env"):
        if not isinstance(node.slice, ast.Constant) or not isinstance(node.slice.value, str):
            raise UnsupportedError("data[...] and env[...] take a literal name")
        return Node("field", node.slice.value) if node.value.id == "data" else _local(node.slice.value, scope)
    if (name := _dotted(node)) is not None:
        head, _, rest = name.partition(".")
        if rest and head == "data":
            return Node("field", rest)
        if rest and head == "env":
            return _local(rest, scope)
        if scope.find(name) is not None:
            return Node("field", name)
        return _local(name, scope)
    if isinstance(node, (ast.List, ast.Tuple)):
        return _list(node.elts, scope)
    if isinstance(node, ast.BinOp):
        op = _BINARY.get(type(node.op))
        if op is None:
            raise UnsupportedError(f"operator {type(node.op).__name__}" + (" (powers are written **)" if isinstance(node.op, ast.BitXor) else ""))
        return Node("call", op, args=(_walk(node.left, scope), _walk(node.right, scope)))
    if isinstance(node, ast.BoolOp):
        op = "&" if isinstance(node.op, ast.And) else "|"
        out = _walk(node.values[0], scope)
        for x in node.values[1:]:
            out = Node("call", op, args=(out, _walk(x, scope)))
        return out
    if isinstance(node, ast.UnaryOp):
        inner = _walk(node.operand, scope)
        if isinstance(node.op, ast.UAdd):
            return inner
        if isinstance(node.op, ast.USub):
            if inner.kind == "literal" and isinstance(inner.value, (int, float)):
                return Node("literal", value=-inner.value)
            return Node("call", "*", args=(Node("literal", value=-1), inner))
        return Node("call", "!", args=(inner,))
    if isinstance(node, ast.Compare):
        if len(node.ops) > 1:
            raise UnsupportedError("chained comparisons; put parentheses around each")
        left, right = _walk(node.left, scope), _walk(node.comparators[0], scope)
        if isinstance(node.ops[0], (ast.In, ast.NotIn)):
            found = Node("call", "in", args=(left, right))
            return Node("call", "!", args=(found,)) if isinstance(node.ops[0], ast.NotIn) else found
        if type(node.ops[0]) not in _COMPARE:
            raise UnsupportedError(f"comparison {type(node.ops[0]).__name__}")
        return Node("call", _COMPARE[type(node.ops[0])], args=(left, right))
    if isinstance(node, ast.Call):
        return _call(node, scope)
    raise UnsupportedError(f"expression `{ast.unparse(node)}`")


def _list(elements: list[ast.expr], scope: Scope) -> Node:
    values = []
    for x in elements:
        own = _walk(x, scope)
        if own.kind != "literal":
            raise UnsupportedError("a list may hold literal scalars only")
        values.append(own.value)
    return Node("list", value=values)


def _call(node: ast.Call, scope: Scope) -> Node:
    name = _dotted(node.func)
    if name is None or any(isinstance(a, ast.Starred) for a in node.args) or any(k.arg is None for k in node.keywords):
        raise UnsupportedError(f"call `{ast.unparse(node)}`")
    if name == "c":
        return _list(node.args, scope)
    options = {}
    if name in ("paste", "paste0"):
        for k in node.keywords:
            if k.arg != "sep" or name == "paste0":
                raise UnsupportedError(f"argument {k.arg} of {name}")
            own = _walk(k.value, scope)
            if own.kind != "literal" or not isinstance(own.value, str):
                raise InvalidQueryError("sep must be a literal string")
            options["sep"] = own.value
        if not node.args:
            raise InvalidQueryError(f"{name} needs an argument")
        return Node("call", name, args=tuple(_walk(a, scope) for a in node.args), options={"sep": options.get("sep", " " if name == "paste" else "")})
    if name == "case_when":
        if node.keywords:
            raise UnsupportedError("named arguments of case_when")
        pairs = []
        for a in node.args:
            if not isinstance(a, ast.Tuple) or len(a.elts) != 2:
                raise UnsupportedError("case_when takes (condition, value) pairs")
            pairs += [_walk(a.elts[0], scope), _walk(a.elts[1], scope)]
        return Node("call", name, args=tuple(pairs))
    if name not in S.SCALARS:
        raise UnsupportedError(f"function {name}()")
    positional = [_walk(a, scope) for a in node.args] + [_walk(k.value, scope) for k in node.keywords if k.arg in ("digits", "base", "start", "stop", "first", "last")]
    if len(positional) < len(node.args) + len(node.keywords):
        raise UnsupportedError(f"named arguments of {name}")
    _, low, high, _ = S.SCALARS[name]
    if len(positional) < low:
        raise InvalidQueryError(f"{name} needs {low} argument" + "s" * (low > 1))
    if len(positional) > high:
        raise UnsupportedError(f"more than {high} arguments of {name}")
    return Node("call", name, args=tuple(positional))


def operand(node: Node, scope: Scope) -> S.Operand:
    """The Column of a tree."""
    if node.kind == "field":
        found = scope.find(node.name)
        if found is None:
            raise InvalidQueryError(f"unknown field `{node.name}`")
        return S.Operand(*found)
    if node.kind == "literal":
        return S.literal(node.value)
    if node.kind == "list":
        raise UnsupportedError("a list stands only on the right of `in`")
    if node.name == "in":
        right = node.args[1]
        if right.kind == "literal":
            raise UnsupportedError("the right side of `in` must be a list or an array field")
        return S.Operand(S.member(operand(node.args[0], scope), right.value if right.kind == "list" else operand(right, scope)), T.BooleanType())
    if node.name == "case_when":
        return _case(node, scope)
    args = [operand(a, scope) for a in node.args]
    if node.name == "!":
        return S.Operand(~args[0].column, T.BooleanType())
    if node.name in S.BINARY:
        column = S.BINARY[node.name][0](*args)
        if node.name in ("+", "-", "*", "/", "%", "**"):
            return S.Operand(column, _wider(node.name, args))
        return S.Operand(column, T.BooleanType())
    if node.name in ("paste", "paste0"):
        return S.Operand(S.paste(*args, sep=node.options["sep"]), T.StringType())
    return S.Operand(S.SCALARS[node.name][0](*args), _result(node.name, args))


def _wider(op: str, args: list[S.Operand]) -> T.DataType | None:
    kinds = [a.kind for a in args]
    if op in ("/", "**") or any(isinstance(k, (T.DoubleType, T.FloatType)) for k in kinds):
        return T.DoubleType()
    return kinds[0] if all(isinstance(k, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for k in kinds) else None


def _widest(args: list[S.Operand]) -> T.DataType | None:
    kinds = [a.kind for a in args]
    if any(isinstance(k, (T.DoubleType, T.FloatType)) for k in kinds):
        return T.DoubleType()
    whole = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if all(type(k) in whole for k in kinds):
        return max(kinds, key=lambda k: whole.index(type(k)))
    return kinds[0] if all(type(k) is type(kinds[0]) for k in kinds) else None


def _result(name: str, args: list[S.Operand]) -> T.DataType | None:
    if name in ("tolower", "toupper", "substr", "substring"):
        return T.StringType()
    if name == "nchar":
        return T.LongType()
    if name == "is_na":
        return T.BooleanType()
    if name in ("abs", "round", "trunc", "floor", "ceiling"):
        return args[0].kind
    if name in ("pmin", "pmax"):
        return _widest(args)
    if name == "if_else":
        return args[1].kind if type(args[1].kind) is type(args[2].kind) else None
    return T.DoubleType()


def _case(node: Node, scope: Scope) -> S.Operand:
    """A literal True condition is the default wherever it stands, the last one if several; without it, null."""
    default, chain, kinds = F.lit(None), None, []
    for condition, value in zip(node.args[::2], node.args[1::2], strict=True):
        own = operand(value, scope)
        kinds.append(own.kind)
        if condition.kind == "literal" and condition.value is True:
            default = own.column
            continue
        test = operand(condition, scope).column
        chain = F.when(test, own.column) if chain is None else chain.when(test, own.column)
    return S.Operand(default if chain is None else chain.otherwise(default), kinds[0] if kinds and all(type(k) is type(kinds[0]) for k in kinds) else None)


def document(node: Node | Column) -> object:
    """The stage form of a tree, for inspection."""
    if isinstance(node, Column):
        return {"$column": str(node)}
    if node.kind == "field":
        return f"${node.name}"
    if node.kind == "literal":
        if isinstance(node.value, (dt.datetime, dt.date)):
            return {"$date": moment_text(node.value)}
        return node.value
    if node.kind == "list":
        return [document(Node("literal", value=v)) for v in node.value]
    args = [document(a) for a in node.args]
    if node.name == "!":
        return {"$not": args}
    if node.name == "in":
        return {"$in": args}
    if node.name in S.BINARY:
        return {S.BINARY[node.name][1]: args}
    if node.name in ("paste", "paste0"):
        sep, out = node.options["sep"], []
        for i, a in enumerate(args):
            out += [sep, a] if i and sep else [a]
        return {"$concat": out}
    if node.name == "is_na":
        return {"$eq": [args[0], None]}
    if node.name == "case_when":
        rest = [(c, v) for c, v, n in zip(args[::2], args[1::2], node.args[::2], strict=True) if not (n.kind == "literal" and n.value is True)]
        default = [v for v, n in zip(args[1::2], node.args[::2], strict=True) if n.kind == "literal" and n.value is True]
        return {"$switch": {"branches": [{"case": c, "then": v} for c, v in rest], "default": default[-1] if default else None}} if rest else (default[-1] if default else None)
    if node.name in ("substr", "substring"):
        start = {"$subtract": [args[1], 1]}
        return {"$substrCP": [args[0], start, {"$add": [{"$subtract": [args[2], args[1]]}, 1]}]}
    if node.name == "log" and len(args) == 1:
        return {"$ln": args[0]}
    if node.name == "round":
        return {"$round": [args[0], args[1] if len(args) > 1 else 0]}
    return {S.SCALARS[node.name][3]: args[0] if len(args) == 1 else args}


def moment_text(value: dt.date) -> str:
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc)
    return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"


def scalar(given: object, scope: Scope) -> tuple[S.Operand, object]:
    """(operand, stage document) of what a verb was given: text, a Column or a plain value."""
    if isinstance(given, Column):
        return S.Operand(given), document(given)
    if isinstance(given, str):
        node = parse(given, scope)
        return operand(node, scope), document(node)
    own = S.literal(given)
    return own, document(Node("literal", value=given))


def aggregate(given: object, scope: Scope) -> tuple[Column, object, str]:
    """(Column, stage document, label) of a summary: n() or one of the aggregates over one scalar expression."""
    if isinstance(given, Column):
        return given, document(given), str(given)
    if not isinstance(given, str):
        raise UnsupportedError("a summary is an aggregate call")
    try:
        tree = ast.parse(given.strip(), mode="eval").body
    except SyntaxError as e:
        raise InvalidQueryError(f"cannot read the expression {given!r}: {e.msg}") from None
    label = ast.unparse(tree)
    if not isinstance(tree, ast.Call) or not isinstance(tree.func, ast.Name) or tree.func.id not in ("n", *AGGREGATES):
        raise UnsupportedError(f"aggregate `{label}`")
    if tree.func.id == "n":
        return count(), {"$sum": 1}, label
    for k in tree.keywords:
        if k.arg != "na_rm":
            raise UnsupportedError(f"argument {k.arg} of {tree.func.id}")
        if not isinstance(k.value, ast.Constant) or not isinstance(k.value.value, bool):
            raise InvalidQueryError("na_rm must be True or False")
    if not tree.args:
        raise InvalidQueryError(f"{tree.func.id} needs an argument")
    if len(tree.args) > 1:
        raise UnsupportedError(f"more than one argument of {tree.func.id}")
    node = _walk(tree.args[0], scope)
    build, name = AGGREGATES[tree.func.id]
    return build(operand(node, scope).column), {name: document(node)}, label
