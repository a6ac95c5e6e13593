"""Relations: a DataFrame whose columns have names of our own, and the scope that says what they are called.

A program addresses a column by the binding that owns it, case counts, and names
may hold dots, blanks or repeat. So Spark never resolves a program's name: each
column has a physical name that is used once, and the scope maps binding and
column to it.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmap import types
from weftmap.errors import Refusal
from weftmap.functions import expr as X
from weftmap.functions.catalogue import FUNCTIONS

_numbers = itertools.count()


def _fresh(n: int) -> list[str]:
    return [f"w{next(_numbers)}" for _ in range(n)]


@dataclass(frozen=True)
class Slot:
    physical: str
    type: object


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    scope: dict[str, dict[str, Slot]]
    sources: tuple[str, ...] = ()  # what it was derived from, sorted

    # Names

    def slot(self, binding: str, column: str, line: int = 0) -> Slot:
        if binding not in self.scope:
            raise Refusal("name/row-not-in-scope", f"`{binding}` is not in scope; there is {', '.join(sorted(self.scope)) or 'nothing'}", line)
        if column not in self.scope[binding]:
            raise Refusal("name/unknown-field", f"`{binding}` has no column `{column}`", line)
        return self.scope[binding][column]

    def type(self, binding: str, column: str, line: int = 0):
        return self.slot(binding, column, line).type

    def column(self, binding: str, column: str, line: int = 0) -> Column:
        return F.col(self.slot(binding, column, line).physical)

    def slots(self) -> list[tuple[str, str, Slot]]:
        return [(b, c, s) for b, columns in self.scope.items() for c, s in columns.items()]

    def named(self) -> DataFrame:
        """The rows under the names of their columns; ones that repeat are told apart by their binding."""
        names = [c for _, c, _ in self.slots()]
        return self.df.select([F.col(s.physical).alias(c if names.count(c) == 1 else f"{b}.{c}") for b, c, s in self.slots()])

    # Operators

    @staticmethod
    def source(df: DataFrame, binding: str, uri: str | None = None) -> Relation:
        """Bind a frame: every column as it is typed, what the primitives do not cover as text."""
        names = _fresh(len(df.columns))
        kinds = [types.of_spark(f.dataType) for f in df.schema]
        held = [F.col(n) if _held(f.dataType) else _as_text(F.col(n), f.dataType) for n, f in zip(names, df.schema, strict=True)]
        bound = df.toDF(*names)
        if any(not _held(f.dataType) for f in df.schema):
            bound = bound.select([h.alias(n) for h, n in zip(held, names, strict=True)])
        slots = {c: Slot(n, k) for c, n, k in zip(df.columns, names, kinds, strict=True)}
        return Relation(bound, {binding: slots}, (uri or binding,))

    @staticmethod
    def empty(like: Relation) -> Relation:
        """No rows, the columns of ``like``: what a union adds nothing to."""
        return Relation(like.df.limit(0), like.scope, ())

    def where(self, predicate: X.Expr) -> Relation:
        """The rows for which the predicate is true; null is not."""
        got = X.type_of(predicate, self)
        if got not in (types.BOOL, types.UNKNOWN):
            raise Refusal("type/expected-bool", f"where takes a Bool, and this is {types.spelled(got)}", predicate.line)
        return Relation(self.df.filter(X.render(predicate, self)), self.scope, self.sources)

    def select(self, columns: list[X.ColRef]) -> Relation:
        scope: dict[str, dict[str, Slot]] = {}
        for c in columns:
            if not isinstance(c, X.ColRef):
                raise Refusal("pipeline/invalid-stage-argument", "select takes columns", getattr(c, "line", 0))
            scope.setdefault(c.binding, {})[c.column] = self.slot(c.binding, c.column, c.line)
        return Relation(self.df.select([s.physical for cs in scope.values() for s in cs.values()]), scope, self.sources)

    def extend(self, binding: str, column: str, e: X.Expr) -> Relation:
        """One more column, under a binding."""
        ty, (name,) = X.type_of(e, self), _fresh(1)
        scope = {b: dict(cs) for b, cs in self.scope.items()}
        scope.setdefault(binding, {})[column] = Slot(name, ty)
        return Relation(self.df.withColumn(name, X.render(e, self)), scope, self.sources)

    def rename(self, binding: str, old: str, new: str) -> Relation:
        slot = self.slot(binding, old)
        if new in self.scope[binding]:
            raise Refusal("name/duplicate-field", f"`{binding}` already has `{new}`")
        columns = {new if c == old else c: slot if c == old else s for c, s in self.scope[binding].items()}
        return Relation(self.df, self.scope | {binding: columns}, self.sources)

    def alias(self, name: str) -> Relation:
        """The same rows under one binding, with physical names of their own."""
        if len(self.scope) != 1:
            raise Refusal("pipeline/invalid-stage-argument", "only a relation of one binding can be renamed")
        ((_, columns),) = self.scope.items()
        return Relation(self.df, {name: columns}, self.sources)._apart()

    def _apart(self) -> Relation:
        names = dict(zip([s.physical for _, _, s in self.slots()], _fresh(len(self.slots())), strict=True))
        df = self.df.select([F.col(a).alias(b) for a, b in names.items()])
        scope = {b: {c: Slot(names[s.physical], s.type) for c, s in cs.items()} for b, cs in self.scope.items()}
        return Relation(df, scope, self.sources)

    def join(self, other: Relation, on: X.Expr, kind: str = "inner") -> Relation:
        """Inner join on equalities between one column of each side; both rows are kept whole."""
        if kind != "inner":
            raise Refusal("unsupported/expression", f"a {kind} join is not part of the language", on.line)
        shared = sorted(set(self.scope) & set(other.scope))
        if shared:
            raise Refusal("pipeline/invalid-stage-argument", f"`{shared[0]}` is on both sides; give one a name with `as`", on.line)
        pairs = [self._pair(other, c) for c in _conjuncts(on)]
        apart = other._apart()
        condition = None
        for mine, theirs in pairs:
            a, b = self.slot(*mine), apart.slot(*theirs)
            if not types.comparable(a.type, b.type):
                raise Refusal("type/incomparable", f"{types.spelled(a.type)} and {types.spelled(b.type)} cannot be compared", on.line)
            equal = F.col(a.physical) == F.col(b.physical)
            condition = equal if condition is None else condition & equal
        return Relation(self.df.join(apart.df, condition, "inner"), self.scope | apart.scope, tuple(sorted({*self.sources, *other.sources})))

    def _pair(self, other: Relation, e: X.Expr) -> tuple[tuple[str, str], tuple[str, str]]:
        if not (isinstance(e, X.BinOp) and e.op == "=="):
            raise Refusal("pipeline/join-not-equality", "on takes equalities, joined by `and`", e.line)
        sides = []
        for x in (e.left, e.right):
            if not isinstance(x, X.ColRef):
                raise Refusal("pipeline/join-key-not-column", "each side of an equality in on is a column", e.line)
            here, there = x.binding in self.scope, x.binding in other.scope
            if not (here or there):
                raise Refusal("name/row-not-in-scope", f"`{x.binding}` is on neither side", e.line)
            (self if here else other).slot(x.binding, x.column, x.line)
            sides.append((here, (x.binding, x.column)))
        if sides[0][0] == sides[1][0]:
            raise Refusal("pipeline/join-one-side", "both columns are of one side", e.line)
        mine, theirs = sides if sides[0][0] else sides[::-1]
        return mine[1], theirs[1]

    def distinct(self) -> Relation:
        return Relation(self.df.distinct(), self.scope, self.sources)

    def union(self, other: Relation, name: str) -> Relation:
        """All rows of both, by position; names and types must be the same in order. One binding: ``name``."""
        mine, theirs = self.slots(), other.slots()
        if [c for _, c, _ in mine] != [c for _, c, _ in theirs] or [s.type for _, _, s in mine] != [s.type for _, _, s in theirs]:
            raise Refusal("pipeline/union-mismatch", "both sides of a union need the same columns in the same order and of the same types")
        if len({c for _, c, _ in mine}) < len(mine):
            raise Refusal("pipeline/union-mismatch", "a side of a union has two columns of one name")
        names = _fresh(len(mine))
        both = self.df.select([F.col(s.physical).alias(n) for (_, _, s), n in zip(mine, names, strict=True)])
        both = both.union(other.df.select([F.col(s.physical) for _, _, s in theirs]))
        scope = {name: {c: Slot(n, s.type) for (_, c, s), n in zip(mine, names, strict=True)}}
        return Relation(both, scope, tuple(sorted({*self.sources, *other.sources})))

    def group_by(self, keys: list[X.ColRef], aggregates: list[tuple[str, str, X.ColRef]], name: str) -> Relation:
        """One row per combination of keys; ``aggregates`` are (out, function, column) and belong to ``name``."""
        if not keys or not aggregates:
            raise Refusal("pipeline/stage-arity", "group_by takes a key and an aggregation at least")
        scope: dict[str, dict[str, Slot]] = {}
        for k in keys:
            scope.setdefault(k.binding, {})[k.column] = self.slot(k.binding, k.column, k.line)
        outs = []
        for out, function, c in aggregates:
            known = FUNCTIONS.get(function)
            if known is None or not known.aggregate:
                raise Refusal("pipeline/not-an-aggregate", f"`{function}` is not an aggregation", c.line)
            slot, (physical,) = self.slot(c.binding, c.column, c.line), _fresh(1)
            if not types.subtypes(slot.type, types.FLOAT):
                raise Refusal("type/argument-mismatch", f"`{function}` expects Float, and this is {types.spelled(slot.type)}", c.line)
            if out in scope.get(name, {}):
                raise Refusal("name/duplicate-field", f"`{out}` is given twice", c.line)
            outs.append(known.column(F.col(slot.physical)).alias(physical))
            scope.setdefault(name, {})[out] = Slot(physical, known.result)
        grouped = self.df.groupBy([F.col(self.slot(k.binding, k.column).physical) for k in keys]).agg(*outs)
        return Relation(grouped, scope, self.sources)

    def limit(self, n: int) -> Relation:
        return Relation(self.df.limit(n), self.scope, self.sources)


def _conjuncts(e: X.Expr) -> list[X.Expr]:
    return _conjuncts(e.left) + _conjuncts(e.right) if isinstance(e, X.BinOp) and e.op == "and" else [e]


def _held(kind) -> bool:
    from pyspark.sql import types as T

    return types.of_spark(kind) != types.STRING or isinstance(kind, T.StringType)


def _as_text(column: Column, kind) -> Column:
    from pyspark.sql import types as T

    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column)
    return F.hex(column) if isinstance(kind, T.BinaryType) else column.cast("string")
