"""Expression nodes, their types, and the columns that they become."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftmap.errors import Refusal
from weftmap.functions.catalogue import FUNCTIONS
from weftmap.types import BOOL, DATETIME, FLOAT, INTEGER, LANG, NULL, STRING, UNKNOWN, comparable, spelled, subtypes


@dataclass(frozen=True)
class Expr:
    line: int = field(default=0, kw_only=True, compare=False)


@dataclass(frozen=True)
class Lit(Expr):
    value: str | bool | int | float | None


@dataclass(frozen=True)
class ColRef(Expr):
    binding: str
    column: str


@dataclass(frozen=True)
class Concat(Expr):
    """Interpolation: literal texts and expressions in turn; a null part makes the whole null."""

    parts: tuple[str | Expr, ...]


@dataclass(frozen=True)
class IsNull(Expr):
    operand: Expr
    negated: bool = False


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    named: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class BinOp(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class UnaryOp(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Ternary(Expr):
    condition: Expr
    then: Expr
    otherwise: Expr


@dataclass(frozen=True)
class LangLit(Expr):
    text: str
    tag: str


@dataclass(frozen=True)
class Edge(Expr):
    """``Type(args)``: the identity of that type with its holes filled."""

    type_name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Assert(Expr):
    """Stands for what it holds; the name is for messages."""

    name: str
    inner: Expr


ARITHMETIC = {"+", "-", "*", "/", "%"}
COMPARISON = {"==", "!=", "<", "<=", ">", ">="}
LOGIC = {"and", "or"}


def arguments(call: Call) -> list[Expr]:
    """The arguments in the order of the parameters."""
    known = FUNCTIONS.get(call.name)
    if known is None:
        raise Refusal("name/unknown-function", f"there is no function `{call.name}`", call.line)
    names = [n for n, _ in known.params]
    if len(call.args) > len(names):
        raise Refusal("argument/arity", f"`{call.name}` takes {len(names)} argument(s)", call.line)
    given: dict[str, Expr] = dict(zip(names, call.args, strict=False))
    for name, value in call.named:
        if name not in names:
            raise Refusal("name/unknown-parameter", f"`{call.name}` has no parameter `{name}`", call.line)
        if name in given:
            raise Refusal("argument/duplicate", f"`{name}` is given twice", call.line)
        given[name] = value
    missing = [n for n in names if n not in given]
    if missing:
        raise Refusal("argument/arity", f"`{call.name}` needs `{missing[0]}`", call.line)
    return [given[n] for n in names]


def type_of(e: Expr, scope) -> object:
    """The type of an expression over a scope (``scope.type(binding, column, line)``); wrong ones are refused."""
    if isinstance(e, Lit):
        if e.value is None:
            return NULL
        return {bool: BOOL, int: INTEGER, float: FLOAT, str: STRING}[type(e.value)]
    if isinstance(e, ColRef):
        return scope.type(e.binding, e.column, e.line)
    if isinstance(e, Concat):
        for part in e.parts:
            if isinstance(part, Expr) and not isinstance(type_of(part, scope), str):
                raise Refusal("type/argument-mismatch", "only a single value can be put into a text", e.line)
        return STRING
    if isinstance(e, IsNull):
        type_of(e.operand, scope)
        return BOOL
    if isinstance(e, LangLit):
        return LANG
    if isinstance(e, Assert):
        return type_of(e.inner, scope)
    if isinstance(e, Call):
        known = FUNCTIONS.get(e.name)
        args = arguments(e)
        if known.aggregate:
            raise Refusal("unsupported/expression", f"`{e.name}` stands only in group_by", e.line)
        for i, ((name, wanted), arg) in enumerate(zip(known.params, args, strict=True)):
            got = type_of(arg, scope)
            if not subtypes(got, wanted):
                raise Refusal("type/argument-mismatch", f"`{name}` of `{e.name}` expects {spelled(wanted)}, and this is {spelled(got)}", e.line)
            if i in known.constant and not (isinstance(arg, Lit) and isinstance(arg.value, str)):
                raise Refusal("unsupported/expression", f"`{name}` of `{e.name}` must be a string literal", e.line)
        if e.name == "math.abs":
            return type_of(args[0], scope)
        return known.result
    if isinstance(e, UnaryOp):
        got = type_of(e.operand, scope)
        if e.op == "not":
            _need_bool(got, e.line)
            return BOOL
        _need_number(got, e.line)
        return got
    if isinstance(e, Ternary):
        _need_bool(type_of(e.condition, scope), e.line)
        a, b = type_of(e.then, scope), type_of(e.otherwise, scope)
        if a == b or subtypes(a, b):
            return b
        if subtypes(b, a):
            return a
        raise Refusal("type/branch-mismatch", f"the branches are {spelled(a)} and {spelled(b)}", e.line)
    if isinstance(e, BinOp):
        a, b = type_of(e.left, scope), type_of(e.right, scope)
        if e.op in LOGIC:
            _need_bool(a, e.line)
            _need_bool(b, e.line)
            return BOOL
        if e.op in COMPARISON:
            if not comparable(a, b):
                raise Refusal("type/incomparable", f"{spelled(a)} and {spelled(b)} cannot be compared", e.line)
            return BOOL
        if e.op == "+" and STRING in (a, b):
            raise Refusal("type/expected-number", 'texts are joined by interpolation: "{a}{b}"', e.line)
        _need_number(a, e.line)
        _need_number(b, e.line)
        return FLOAT if e.op == "/" or FLOAT in (a, b) else INTEGER
    raise Refusal("unsupported/expression", f"{type(e).__name__} has no value here", e.line)


def _need_bool(ty, line):
    if ty not in (BOOL, UNKNOWN):
        raise Refusal("type/expected-bool", f"a condition must be Bool, and this is {spelled(ty)}", line)


def _need_number(ty, line):
    if ty not in (INTEGER, FLOAT, UNKNOWN):
        raise Refusal("type/expected-number", f"a number is expected, and this is {spelled(ty)}", line)


def _divide(left: Column, right: Column) -> Column:
    """Division of doubles, with infinities and NaN where IEEE 754 has them."""
    a, b = left.cast("double"), right.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(a / b)


def lexical(column: Column, ty) -> Column:
    """A value as the text that an interpolation writes."""
    if ty == DATETIME:
        whole = F.date_format(column.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
        part = F.date_format(column.cast("timestamp_ntz"), "SSSSSS")
        part = F.regexp_replace(part, "0+$", "")
        return F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return column.cast("string")


def render(e: Expr, scope) -> Column:
    """The column of an expression; ``scope.column(binding, column, line)`` finds the ones it reads."""
    if isinstance(e, Lit):
        if isinstance(e.value, bool) or not isinstance(e.value, int):
            return F.lit(e.value)
        return F.lit(e.value).cast("bigint")
    if isinstance(e, ColRef):
        return scope.column(e.binding, e.column, e.line)
    if isinstance(e, Concat):
        parts = [F.lit(p) if isinstance(p, str) else lexical(render(p, scope), type_of(p, scope)) for p in e.parts]
        return F.concat(*parts) if parts else F.lit("")
    if isinstance(e, IsNull):
        inner = render(e.operand, scope)
        return inner.isNotNull() if e.negated else inner.isNull()
    if isinstance(e, LangLit):
        return F.struct(F.lit(e.text).alias("value"), F.lit(e.tag).alias("lang"))
    if isinstance(e, Assert):
        return render(e.inner, scope)
    if isinstance(e, Call):
        known = FUNCTIONS[e.name]
        args = [a.value if i in known.constant else render(a, scope) for i, a in enumerate(arguments(e))]
        return known.column(*args)
    if isinstance(e, UnaryOp):
        return ~render(e.operand, scope) if e.op == "not" else -render(e.operand, scope)
    if isinstance(e, Ternary):
        return F.when(render(e.condition, scope), render(e.then, scope)).otherwise(render(e.otherwise, scope))
    if isinstance(e, BinOp):
        a, b = render(e.left, scope), render(e.right, scope)
        if e.op == "/":
            return _divide(a, b)
        made = {
            "==": a.__eq__, "!=": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__,
            "and": a.__and__, "or": a.__or__, "+": a.__add__, "-": a.__sub__, "*": a.__mul__, "%": a.__mod__,
        }
        return made[e.op](b)
    raise Refusal("unsupported/expression", f"{type(e).__name__} has no value here", e.line)


def equals(left: Expr, right: Expr, op: str = "==", line: int = 0) -> Expr:
    """``==`` and ``!=``; beside the literal null they ask whether the other side is null."""
    for a, b in ((left, right), (right, left)):
        if isinstance(b, Lit) and b.value is None:
            return IsNull(a, op == "!=", line=line)
    return BinOp(op, left, right, line=line)


def columns_read(e) -> set[tuple[str, str]]:
    """(binding, column) pairs that an expression reads."""
    if isinstance(e, ColRef):
        return {(e.binding, e.column)}
    out: set[tuple[str, str]] = set()
    for value in vars(e).values() if isinstance(e, Expr) else ():
        for item in value if isinstance(value, tuple) else (value,):
            item = item[1] if isinstance(item, tuple) and len(item) == 2 else item
            if isinstance(item, Expr):
                out |= columns_read(item)
    return out
