"""The algebra as data: thirteen operators in the order in which they are needed.

A program is lowered to a list of these; :func:`evaluate` turns what a table or
edge needs into DataFrames, and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from weftmap.errors import Refusal
from weftmap.functions.expr import ColRef, Expr
from weftmap.operators.relation import Relation


@dataclass(frozen=True)
class Op:
    pass


@dataclass(frozen=True)
class Source(Op):
    uri: str
    format: str
    binding: str
    options: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Project(Op):
    input: int
    columns: tuple[ColRef, ...]


@dataclass(frozen=True)
class Extend(Op):
    input: int
    binding: str
    column: str
    expr: Expr


@dataclass(frozen=True)
class Rename(Op):
    input: int
    binding: str
    old: str
    new: str


@dataclass(frozen=True)
class Filter(Op):
    input: int
    predicate: Expr


@dataclass(frozen=True)
class Join(Op):
    left: int
    right: int
    on: Expr
    alias: str | None = None
    kind: str = "inner"


@dataclass(frozen=True)
class Union(Op):
    left: int
    right: int
    relation: str


@dataclass(frozen=True)
class GroupBy(Op):
    input: int
    keys: tuple[ColRef, ...]
    aggregates: tuple[tuple[str, str, ColRef], ...]
    relation: str


@dataclass(frozen=True)
class Distinct(Op):
    input: int


@dataclass(frozen=True)
class EmitVertex(Op):
    input: int
    mapping: str
    shape_iri: str
    identity: Expr
    properties: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class EmitEdge(Op):
    input: int
    label: str
    predicate: str
    source_iri: str  # class of the source
    target_iri: str  # class of the target
    source_id: Expr
    target_id: Expr
    single: bool


@dataclass(frozen=True)
class Sink(Op):
    inputs: tuple[int, ...]


@dataclass(frozen=True)
class Empty(Op):
    like: int


@dataclass
class Plan:
    ops: list[Op] = field(default_factory=list)

    def add(self, op: Op) -> int:
        self.ops.append(op)
        return len(self.ops) - 1

    def inputs(self, at: int) -> list[int]:
        op = self.ops[at]
        found = [getattr(op, name) for name in ("input", "left", "right", "like") if hasattr(op, name)]
        return found + list(getattr(op, "inputs", ()))

    def needed(self, at: int) -> list[int]:
        """The operators below one, itself last, each once, inputs first."""
        order: list[int] = []

        def visit(i: int):
            if i not in order:
                for j in self.inputs(i):
                    visit(j)
                order.append(i)

        visit(at)
        return order

    def sources(self, at: int) -> list[str]:
        """The tables that an operator is derived from, sorted."""
        return sorted({self.ops[i].uri for i in self.needed(at) if isinstance(self.ops[i], Source)})


def evaluate(plan: Plan, at: int, read, done: dict[int, Relation] | None = None) -> Relation:
    """The relation of one operator; ``read(source)`` opens a source, ``done`` keeps what was evaluated before."""
    done = {} if done is None else done
    for i in plan.needed(at):
        if i not in done:
            done[i] = _one(plan.ops[i], done, read)
    return done[at]


def _one(op: Op, done: dict[int, Relation], read) -> Relation:
    if isinstance(op, Source):
        return read(op)
    if isinstance(op, Project):
        return done[op.input].select(list(op.columns))
    if isinstance(op, Extend):
        return done[op.input].extend(op.binding, op.column, op.expr)
    if isinstance(op, Rename):
        return done[op.input].rename(op.binding, op.old, op.new)
    if isinstance(op, Filter):
        return done[op.input].where(op.predicate)
    if isinstance(op, Join):
        right = done[op.right]
        return done[op.left].join(right.alias(op.alias) if op.alias else right, op.on, op.kind)
    if isinstance(op, Union):
        return done[op.left].union(done[op.right], op.relation)
    if isinstance(op, GroupBy):
        return done[op.input].group_by(list(op.keys), list(op.aggregates), op.relation)
    if isinstance(op, Distinct):
        return done[op.input].distinct()
    if isinstance(op, Empty):
        return Relation.empty(done[op.like])
    raise Refusal("unsupported/expression", f"{type(op).__name__} is no relation")
