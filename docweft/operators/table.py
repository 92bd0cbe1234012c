"""The lazy table: an immutable chain of verbs over a DataFrame.

Each verb returns a new table whose DataFrame Catalyst has analysed; no job runs
before a terminal (collect, cursor, and infer_schema's check for emptiness).
Order is kept as data: sort keys are copied to hidden columns, so later verbs
may overwrite them, and a row number of the input is made only when a verb needs
it, below which filters still reach the scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.errors import InvalidQueryError, UnsupportedError, UnsupportedVerb
from docweft.operators import nested as N
from docweft.operators.positions import numbered
from docweft.operators.stages import apply_stage, parse_stage
from docweft.plans import expressions as E
from docweft.plans.rendering import render
from docweft.sources.source import Source
from docweft.streaming.cursor import Cursor

#: In mutate() and transmute(): the row's number from 1 in the current order, within groups if there are any.
ROW_SEQ = "1:n()"


#: Verbs that users of data-frame grammars know and that this engine refuses by design.
REFUSED = frozenset(
    "inner_join left_join right_join full_join semi_join anti_join cross_join union union_all intersect setdiff distinct count tally pull relocate "
    "pivot_longer pivot_wider across rowwise rollup cube grouping_sets window watermark sql udf".split()
)


def desc(name: str) -> tuple[str, bool]:
    """A descending sort key."""
    return (name, False)


def _is_sequence(given: object) -> bool:
    return isinstance(given, str) and given.replace(" ", "") == ROW_SEQ


def _count(n: object, verb: str) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, float)) or n != n or n != int(n):
        raise InvalidQueryError(f"n of {verb} must be a single whole number")
    return int(n)


@dataclass(frozen=True, repr=False)
class LazyTable:
    df: DataFrame
    name: str = "table"
    fields: tuple[tuple[str, N.Path], ...] = ()
    flat: bool = False
    projected: bool = False
    groups: tuple[str, ...] = ()
    ordering: tuple[tuple[str, bool], ...] = ()
    ops: tuple[dict, ...] = ()
    stages: tuple[dict, ...] = ()
    env: Mapping[str, object] = field(default_factory=dict)

    def __getattr__(self, name: str) -> object:
        if name in REFUSED:
            raise UnsupportedVerb(f"{name}()")
        raise AttributeError(name)

    # -- construction ---------------------------------------------------------

    @staticmethod
    def from_df(df: DataFrame, name: str = "table", schema: list[str] | None = None, env: Mapping[str, object] | None = None) -> LazyTable:
        """``schema``: the names to know, dotted for nested fields; all leaves if None. ``env``: local values by name."""
        if not isinstance(df, DataFrame):
            raise InvalidQueryError("a table is made from a DataFrame")
        if schema is None:
            fields = tuple((".".join(p), p) for p in N.leaves(df.schema))
        else:
            fields = tuple((s, N.find(df.schema, s) or (s,)) for s in schema)
        return LazyTable(df, name, fields, env=dict(env or {}))

    @staticmethod
    def from_source(source: Source, **more: object) -> LazyTable:
        return LazyTable.from_df(source.df, source.name, list(source.schema) if source.schema else None, **more)

    def with_env(self, **values: object) -> LazyTable:
        """Local values that expressions may name."""
        return replace(self, env={**self.env, **values})

    # -- names -------------------------------------------------------------------

    def _path(self, name: str) -> N.Path | None:
        known = dict(self.fields)
        path = known.get(name) or N.find(self.df.schema, name)
        return path if path is not None and not path[0].startswith(N.HIDDEN) and N.kind_of(self.df.schema, path) is not None else None

    def _need(self, name: object, verb: str) -> N.Path:
        if not isinstance(name, str):
            raise UnsupportedError(f"{verb}() takes field names")
        path = self._path(name.removeprefix("data.") if self._path(name) is None else name)
        if path is None:
            raise InvalidQueryError(f"{verb}(): unknown field `{name}`")
        return path

    @property
    def _scope(self) -> E.Scope:
        def find(name: str) -> tuple[Column, T.DataType] | None:
            path = self._path(name)
            return None if path is None else (N.column(path), N.kind_of(self.df.schema, path))

        return E.Scope(find, self.env)

    @property
    def _hidden(self) -> list[Column]:
        return [N.column((c,)) for c in self.df.columns if c.startswith(N.HIDDEN)]

    def schema_fields(self) -> list[str]:
        """Visible names, dotted for nested leaves."""
        return [name for name, _ in self.fields]

    def infer_schema(self) -> LazyTable:
        """Know all leaves of the DataFrame's own schema; refused for a table without rows."""
        if self.df.limit(1).isEmpty():
            raise InvalidQueryError("cannot infer a schema from an empty collection")
        fields = tuple((".".join(p), p) for p in N.leaves(self.df.schema))
        if not fields:
            raise InvalidQueryError("cannot infer a schema: no named fields")
        return replace(self, fields=fields)

    # -- rows ----------------------------------------------------------------

    def filter(self, *predicates: object, by: object = None, preserve: object = None) -> LazyTable:
        """Rows for which all predicates are true (null is not)."""
        if by is not None:
            raise UnsupportedError("filter(by=)")
        test, documents = F.lit(True), []
        for given in predicates:
            if not isinstance(given, (str, Column, bool)):
                raise UnsupportedError("a predicate is a boolean expression")
            own, doc = E.scalar(given, self._scope)
            kind = self.df.select(own.column).schema[0].dataType
            if not isinstance(kind, T.BooleanType):
                raise UnsupportedError(f"a predicate must be boolean, not {kind.simpleString()}")
            test = test & own.column
            documents.append(doc)
        shown = documents[0] if len(documents) == 1 else {"$and": documents}
        return replace(self, df=self.df.where(test), ops=(*self.ops, {"$match": {"$expr": shown}}))

    def arrange(self, *keys: object, by_group: bool = False) -> LazyTable:
        """Sort by names and desc(name); nulls are least. Ties keep the order they had."""
        asked: dict[str, bool] = {g: True for g in self.groups} if by_group else {}
        for key in keys:
            name, up = key if isinstance(key, tuple) and len(key) == 2 else (key, True)
            if not isinstance(name, str) or not isinstance(up, bool):
                raise UnsupportedError("arrange() takes names and desc(name)")
            if self._path(name) is None and name.startswith("desc(") and name.endswith(")"):
                name, up = name[5:-1].strip(), False
            self._need(name, "arrange")
            asked[name] = up
        if not asked:
            return self
        made, order = [], []
        n = sum(c.startswith(N.HIDDEN) for c in self.df.columns)
        for i, (name, up) in enumerate(asked.items()):
            made.append(N.column(self._need(name, "arrange")).alias(f"{N.HIDDEN}{n + i}"))
            order.append((f"{N.HIDDEN}{n + i}", up))
        df = self.df.select("*", *made)
        return replace(self, df=df, ordering=(*order, *self.ordering), ops=(*self.ops, {"$sort": {k: 1 if up else -1 for k, up in asked.items()}}))

    def _numbered(self) -> LazyTable:
        """With the input's row number as the last sort key."""
        name = f"{N.HIDDEN}_row"
        if any(k == name for k, _ in self.ordering):
            return self
        df = self.df.select("*", F.monotonically_increasing_id().alias(name))
        return replace(self, df=df, ordering=(*self.ordering, (name, True)))

    def _keys(self, back: bool = False) -> list[Column]:
        return [N.column((k,)).asc() if up != back else N.column((k,)).desc() for k, up in self.ordering]

    def slice_head(self, n: object = 1, **other: object) -> LazyTable:
        """The first n rows; n < 0 leaves out the last -n. Groups play no part."""
        return self._slice(n, other, "slice_head")

    def slice_tail(self, n: object = 1, **other: object) -> LazyTable:
        """The last n rows; n < 0 leaves out the first -n."""
        return self._slice(n, other, "slice_tail")

    def head(self, n: object = 6) -> LazyTable:
        return self._slice(n, {}, "slice_head")

    def _slice(self, n: object, other: Mapping[str, object], verb: str) -> LazyTable:
        if other:
            raise UnsupportedError(f"{verb}({', '.join(other)}=)")
        n = _count(n, verb)
        own = self._numbered()
        back = (verb == "slice_tail") == (n >= 0)
        if n >= 0:
            df = own.df.orderBy(*own._keys(back)).limit(n)
        else:
            at = f"{N.HIDDEN}_at"
            df = numbered(own.df, own.ordering, own._keys(back), at, back).where(N.column((at,)) > -n).drop(at)
        op = {"$limit": n} if verb == "slice_head" and n >= 0 else {f"${verb}": n}
        return replace(own, df=df, ops=(*self.ops, op))

    # -- columns -----------------------------------------------------------------

    def select(self, *names: object, **renamed: str) -> LazyTable:
        """Fields in order, new=old to rename. Dotted fields stay nested unless a rename makes the selection flat."""
        if not names and not renamed:
            raise InvalidQueryError("select() needs a field")
        for name in names:
            if not isinstance(name, str) or name.startswith("-"):
                raise UnsupportedError("select() takes field names only")
        pairs = [(n, self._need(n, "select")) for n in names] + [(new, self._need(old, "select")) for new, old in renamed.items()]
        out = [n for n, _ in pairs]
        if len(set(out)) < len(out):
            raise InvalidQueryError("select() repeats an output name")
        moved = any(new != ".".join(path) and new != path[-1:][0] or len(path) == 1 and new != path[0] for new, path in pairs)
        if not self.flat and not renamed and not moved:
            df = self.df.select(*N.regrown([p for _, p in pairs]), *self._hidden)
            return replace(self, df=df, fields=tuple(pairs), ops=(*self.ops, {"$project": {n: 1 for n in out}}))
        df = self.df.select(*[N.column(p).alias(n) for n, p in pairs], *self._hidden)
        return self._flat(df, out, {n: ".".join(p) for n, p in pairs}, self.groups)

    def _flat(self, df: DataFrame, out: list[str], shown: Mapping[str, str], groups: tuple[str, ...]) -> LazyTable:
        doc = {n: 1 if n == p else f"${p}" for n, p in shown.items()}
        return replace(self, df=df, fields=tuple((n, (n,)) for n in out), flat=True, projected=True, groups=groups, ops=(*self.ops, {"$project": doc}))

    def rename(self, **renamed: str) -> LazyTable:
        """new=old; all other known fields keep their places."""
        if not self.fields:
            raise InvalidQueryError("rename() requires known fields")
        old_to_new = {}
        for new, old in renamed.items():
            if old not in dict(self.fields):
                raise InvalidQueryError(f"rename(): unknown field `{old}`")
            old_to_new[old] = new
        out = [old_to_new.get(n, n) for n, _ in self.fields]
        if len(set(out)) < len(out):
            raise InvalidQueryError("rename() repeats an output name")
        df = self.df.select(*[N.column(p).alias(o) for o, (_, p) in zip(out, self.fields, strict=True)], *self._hidden)
        return self._flat(df, out, {o: ".".join(p) for o, (_, p) in zip(out, self.fields, strict=True)}, tuple(old_to_new.get(g, g) for g in self.groups))

    def mutate(self, *unnamed: object, **assigned: object) -> LazyTable:
        """Set fields from left to right; later expressions see earlier fields."""
        if unnamed:
            raise InvalidQueryError("mutate() takes named expressions")
        own = self
        for name, given in assigned.items():
            if not name or name.startswith(N.HIDDEN):
                raise InvalidQueryError(f"a field cannot be called `{name}`")
            own = own._sequence(name) if _is_sequence(given) else own._assign(name, given)
        return own

    def _assign(self, name: str, given: object) -> LazyTable:
        value, doc = E.scalar(given, self._scope)
        return self._set(name, value.column, {"$addFields": {name: doc}})

    def _set(self, name: str, value: Column, op: dict) -> LazyTable:
        path = self._path(name) or N.place(self.df.schema, name)
        df = N.replaced(self.df, path, value)
        fields = self.fields if name in dict(self.fields) else (*self.fields, (name, path))
        return replace(self, df=df, fields=fields, ops=(*self.ops, op))

    def _sequence(self, name: str) -> LazyTable:
        own, op = self._numbered(), {"$rowSequence": {"field": name, "groups": list(self.groups)}}
        if own.groups:
            window = Window.partitionBy(*[N.column(own._need(g, "group_by")) for g in own.groups]).orderBy(*own._keys())
            return own._set(name, F.row_number().over(window).cast("long"), op)
        at = f"{N.HIDDEN}_at"
        done = replace(own, df=numbered(own.df, own.ordering, own._keys(), at))._set(name, N.column((at,)), op)
        return replace(done, df=done.df.drop(at))

    def transmute(self, *unnamed: object, **assigned: object) -> LazyTable:
        """mutate(), then only the named fields in their order."""
        own = self.mutate(*unnamed, **assigned)
        if not assigned:
            return self
        paths = [own._need(n, "transmute") for n in assigned]
        df = own.df.select(*[N.column(p).alias(n) for n, p in zip(assigned, paths, strict=True)], *own._hidden)
        return own._flat(df, list(assigned), {n: n for n in assigned}, own.groups)

    # -- groups ----------------------------------------------------------------

    def group_by(self, *names: object, add: bool = False, drop: object = None, **named: object) -> LazyTable:
        """Group by fields, instead of or (add) beside the groups there are; no names: none."""
        asked = [*names, *named.values()]
        for name in asked:
            self._need(name, "group_by")
        groups = tuple(dict.fromkeys([*(self.groups if add else ()), *asked]))
        return replace(self, groups=groups)

    def summarise(self, *unnamed: object, by: object = None, groups: object = None, **assigned: object) -> LazyTable:
        """A row a group: group fields, then n(), sum, mean, min or max of an expression over the rows. Groups stay."""
        if by is not None:
            raise UnsupportedError("summarise(by=)")
        made = [E.aggregate(g, self._scope) for g in unnamed]
        sums = [(label, c, doc) for c, doc, label in made]
        for name, given in assigned.items():
            c, doc, _ = E.aggregate(given, self._scope)
            sums.append((name, c, doc))
        if not sums:
            raise InvalidQueryError("summarise() needs a summary")
        out = [*self.groups, *(n for n, _, _ in sums)]
        if len(set(out)) < len(out):
            raise InvalidQueryError("summarise() repeats an output name")
        keys = [N.column(self._need(g, "group_by")).alias(g) for g in self.groups]
        aggregates = [c.alias(n) for n, c, _ in sums]
        df = self.df.groupBy(*keys).agg(*aggregates) if keys else self.df.agg(*aggregates)
        doc = {"$group": {"_id": {g: f"${'.'.join(self._need(g, 'group_by'))}" for g in self.groups} or None, **{n: d for n, _, d in sums}}}
        tidy = {"$project": {"_id": 0, **{g: f"$_id.{g}" for g in self.groups}, **{n: 1 for n, _, _ in sums}}}
        return replace(self, df=df, fields=tuple((n, (n,)) for n in out), ordering=(), projected=True, flat=True, ops=(*self.ops, doc, tidy))

    summarize = summarise

    # -- nested documents --------------------------------------------------------

    def flatten_fields(self, *targets: str, names_fn: Callable[[list[str]], list[str]] | None = None) -> LazyTable:
        """Nested leaves as columns of their own: all, or those under the targets; other fields come first."""
        nested = [(n, p) for n, p in self.fields if len(p) > 1 or isinstance(N.kind_of(self.df.schema, p), T.StructType)]
        if not nested:
            raise InvalidQueryError("flatten_fields() requires known nested dotted paths; use infer_schema() or schema=")
        chosen: dict[N.Path, str] = {}
        for target in targets or [n for n, _ in nested]:
            path = self._need(target, "flatten_fields")
            for leaf in N.leaves(self.df.schema, path):
                chosen.setdefault(leaf, ".".join([target.removeprefix("data."), *leaf[len(path) :]]))
        names = list(chosen.values())
        if names_fn is not None:
            new = names_fn(list(names))
            if not isinstance(new, (list, tuple)) or len(new) != len(names) or not all(isinstance(x, str) and x for x in new):
                raise InvalidQueryError("names_fn must return one non-empty string per field")
            names = list(new)
        kept = [(n, p) for n, p in self.fields if p not in chosen and not any(leaf[: len(p)] == p for leaf in chosen)]
        out = [n for n, _ in kept] + names
        if len(set(out)) < len(out):
            raise InvalidQueryError("names_fn must return unique names that no kept field has")
        pairs = kept + list(zip(names, chosen, strict=True))
        df = self.df.select(*[N.column(p).alias(n) for n, p in pairs], *self._hidden)
        return self._flat(df, out, {n: ".".join(p) for n, p in pairs}, self.groups)

    def unwind_array(self, name: str, preserve_empty: bool = False) -> LazyTable:
        """A row for each element of an array field, the element in its place."""
        if not isinstance(preserve_empty, bool):
            raise InvalidQueryError("preserve_empty must be True or False")
        path = self._need(name, "unwind_array")
        at = f"{N.HIDDEN}{sum(c.startswith(N.HIDDEN) for c in self.df.columns)}u" if self.ordering else None
        df = N.unwound(self.df, path, preserve_empty, at)
        fields = []
        for n, p in self.fields:
            # Elements that are documents bring their fields.
            fields += [(".".join([n, *leaf[len(p) :]]), leaf) for leaf in N.leaves(df.schema, p)] if p == path else [(n, p)]
        op = {"$unwind": {"path": f"${'.'.join(path)}", "preserveNullAndEmptyArrays": True} if preserve_empty else f"${'.'.join(path)}"}
        return replace(self, df=df, fields=tuple(fields), ordering=(*self.ordering, (at, True)) if at else (), ops=(*self.ops, op))

    # -- raw stages and terminals ------------------------------------------------

    def append_stage(self, text: str) -> LazyTable:
        """A raw JSON stage; runs after all verbs wherever it is called. Visible names stay."""
        return replace(self, stages=(*self.stages, parse_stage(text)))

    def to_df(self) -> DataFrame:
        """The result, lazily."""
        df = self.df.orderBy(*self._keys()) if self.ordering else self.df
        df = df.select(*[N.column((c,)) for c in N.shown(df)])
        wanted = df.columns
        for stage in self.stages:
            df = apply_stage(df, stage)
        if self.stages and self.projected and (there := [c for c in wanted if c in df.columns]):
            df = df.select(*[N.column((c,)) for c in there])
        return df

    def collect(self) -> list[Row]:
        return self.to_df().collect()

    def cursor(self) -> Cursor:
        return Cursor(self.to_df())

    def compile(self) -> list[dict]:
        """The pipeline as stage documents, for inspection."""
        return [*self.ops, *self.stages]

    def show_query(self, explain: bool = False) -> str:
        text = render(self.compile())
        print(text)
        if explain:
            self.to_df().explain("formatted")
        return text

    def __repr__(self) -> str:
        parts = [f"<LazyTable {self.name}", f"fields: {', '.join(self.schema_fields()) or 'unknown'}", f"operations: {len(self.ops)}"]
        if self.groups:
            parts.append(f"groups: {', '.join(self.groups)}")
        if self.stages:
            parts.append(f"raw stages: {json.dumps([next(iter(s)) for s in self.stages])}")
        return "; ".join(parts) + ">"
