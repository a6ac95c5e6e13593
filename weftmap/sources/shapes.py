"""Shapes: what a type's vertices look like; read from ShEx and SHACL, or declared by a program."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from weftmap import types
from weftmap.errors import Refusal
from weftmap.sources import turtle

MANY = None  # no upper bound


def local_name(iri: str) -> str:
    """What follows the last ``#``, ``/`` or ``:`` of an IRI."""
    return re.split(r"[#/:]", iri.rstrip("#/"))[-1]


@dataclass(frozen=True)
class Constraint:
    name: str
    predicate: str
    datatype: str | None = None  # an IRI; None: not narrowed
    targets: tuple[str, ...] = ()  # classes that a value refers to
    least: int = 1
    most: int | None = 1
    languages: tuple[str, ...] = ()
    iri: bool = False  # values are IRIs

    @property
    def single(self) -> bool:
        return self.most is not None and self.most <= 1 and self.type != types.LANG

    @property
    def type(self):
        if self.targets:
            return types.reference(self.targets)
        if self.iri:
            return types.URI
        if self.datatype is None:
            return types.LANG if self.languages else types.UNKNOWN
        return types.of_datatype(self.datatype) or types.STRING


@dataclass(frozen=True)
class Shape:
    iri: str
    constraints: tuple[Constraint, ...]
    annotations: tuple = field(default=(), compare=False)

    @property
    def label(self) -> str:
        return local_name(self.iri)

    def constraint(self, name: str) -> Constraint | None:
        return next((c for c in self.constraints if c.name == name), None)


def check(shape: Shape) -> Shape:
    """A short name must say one predicate."""
    seen: dict[str, str] = {}
    for c in shape.constraints:
        if seen.setdefault(c.name, c.predicate) != c.predicate:
            raise Refusal("shape/name-collision", f"two predicates of {shape.label} are both called `{c.name}`")
    return shape


def ordered(shapes: list[Shape]) -> list[Shape]:
    return sorted(shapes, key=lambda s: s.iri)


# ShEx, compact syntax

_SHEX = re.compile(
    r"""
    (?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>\s]*>)
  | (?P<text>"(?:[^"\\\n]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^\S+)?)
  | (?P<annotation>//)
  | (?P<ref>@)
  | (?P<count>\{\s*\d+\s*(?:,\s*(?:\d+|\*)?\s*)?\}|[?*+])
  | (?P<punct>[{}();|\[\]~,=&$^.-])
  | (?P<name>[A-Za-z_][\w.-]*:[\w.-]*|:[\w.-]+)
  | (?P<number>[+-]?\d+(?:\.\d+)?)
  | (?P<word>[A-Za-z][\w]*)
    """,
    re.VERBOSE,
)


class _ShEx:
    def __init__(self, text: str):
        self._tokens, at, line = [], 0, 1
        while at < len(text):
            m = _SHEX.match(text, at)
            if not m:
                raise Refusal("document/unparseable", f"ShEx: unexpected {text[at : at + 20]!r}", line)
            if m.lastgroup != "skip":
                self._tokens.append((m.lastgroup, m[0], line))
            line += m[0].count("\n")
            at = m.end()
        self._tokens.append(("end", "", line))
        self._at = 0
        self._prefixes: dict[str, str] = {}
        self._base = ""

    def _peek(self, n: int = 0):
        return self._tokens[min(self._at + n, len(self._tokens) - 1)]

    def _next(self):
        self._at += 1
        return self._tokens[self._at - 1]

    def _fail(self, token, wanted):
        raise Refusal("document/unparseable", f"ShEx: expected {wanted}, found {token[1]!r}", token[2])

    def _iri(self, token) -> str:
        kind, value, _ = token
        if kind == "iri":
            iri = value[1:-1]
            return iri if ":" in iri else self._base + iri
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix in self._prefixes:
                return self._prefixes[prefix] + local
        return self._fail(token, "an IRI")

    def parse(self) -> list[Shape]:
        shapes = []
        while self._peek()[0] != "end":
            kind, value, _ = self._peek()
            if kind == "word" and value.upper() == "PREFIX":
                self._next()
                name = self._next()[1]
                self._prefixes[name.rstrip(":")] = self._iri(self._next())
            elif kind == "word" and value.upper() == "BASE":
                self._next()
                self._base = self._iri(self._next())
            elif kind == "word" and value.lower() == "start":
                while self._peek()[1] not in ("", "}") and self._peek()[0] not in ("iri", "name"):
                    self._next()
                self._next()
            else:
                shapes.append(self._shape())
        return shapes

    def _shape(self) -> Shape:
        iri = self._iri(self._next())
        extra: list[str] = []
        while self._peek()[0] == "word":
            word = self._next()[1].upper()
            if word == "EXTRA":
                while self._peek()[0] in ("iri", "name"):
                    extra.append(self._iri(self._next()))
            elif word not in ("CLOSED", "AND", "ABSTRACT"):
                self._fail(self._peek(), "a shape")
        if self._next()[1] != "{":
            self._fail(self._peek(-1), "'{'")
        found: list[Constraint] = []
        cls = iri
        while self._peek()[1] != "}":
            if self._peek()[1] == ";":
                self._next()
                continue
            if self._peek()[1] in ("|", "("):
                raise Refusal("shape/unsupported-disjunction", f"a choice between triples in {local_name(iri)}", self._peek()[2])
            kind, value, _ = self._peek()
            if (kind, value) == ("word", "a"):
                self._next()
                predicate = turtle.RDF + "type"
            else:
                predicate = self._iri(self._next())
            c = self._value(predicate)
            if predicate == turtle.RDF + "type":
                cls = c if isinstance(c, str) else cls
            elif isinstance(c, Constraint):
                found.append(c)
        self._next()
        notes = self._annotations()
        return Shape(cls, tuple(found), tuple(notes))

    def _value(self, predicate: str):
        datatype, targets, languages, iri, classes = None, [], [], False, []
        while True:
            kind, value, line = self._peek()
            if kind == "ref":
                self._next()
                targets.append(self._iri(self._next()))
            elif kind == "punct" and value == ".":
                self._next()
            elif kind == "punct" and value == "[":
                self._next()
                while self._peek()[1] != "]":
                    kind, value, _ = self._next()
                    if kind == "ref":
                        languages.append(self._next()[1].lower())
                        while self._peek()[1] == "-":
                            self._next()
                            languages[-1] += "-" + self._next()[1].lower()
                    elif kind in ("iri", "name"):
                        classes.append(self._iri((kind, value, line)))
                self._next()
            elif kind == "word" and value.upper() in ("IRI", "LITERAL", "BNODE", "NONLITERAL"):
                self._next()
                iri = iri or value.upper() in ("IRI", "NONLITERAL")
            elif kind in ("iri", "name"):
                datatype = self._iri(self._next())
            else:
                self._fail(self._peek(), "a value")
            if self._peek()[0] == "word" and self._peek()[1].upper() == "OR":
                self._next()
                continue
            break
        least, most = 1, 1
        if self._peek()[0] == "count":
            least, most = _count(self._next()[1])
        self._annotations()
        if predicate == turtle.RDF + "type" and len(classes) == 1:
            return classes[0]
        if targets and datatype:
            raise Refusal("shape/unsupported-disjunction", f"`{local_name(predicate)}` is a reference or a literal")
        return Constraint(local_name(predicate), predicate, datatype, tuple(targets), least, most, tuple(languages), iri or bool(classes))

    def _annotations(self) -> list:
        out = []
        while self._peek()[0] == "annotation":
            self._next()
            predicate = self._iri(self._next())
            out.append((predicate, self._next()[1]))
        return out


def _count(mark: str) -> tuple[int, int | None]:
    if mark in "?*+":
        return {"?": (0, 1), "*": (0, MANY), "+": (1, MANY)}[mark]
    low, comma, high = mark.strip("{} ").partition(",")
    if not comma:
        return int(low), int(low)
    high = high.strip()
    return int(low), MANY if high in ("", "*") else int(high)


def _shexj(document: dict) -> list[Shape]:
    out = []
    for declared in document.get("shapes", []):
        body = declared.get("shapeExpr", declared)
        found = []
        expression = body.get("expression")
        if expression and expression["type"] == "OneOf":
            raise Refusal("shape/unsupported-disjunction", f"a choice between triples in {local_name(declared['id'])}")
        for t in [] if not expression else expression.get("expressions", [expression]):
            value = t.get("valueExpr") or {}
            targets = [value] if isinstance(value, str) else [v for v in value.get("shapeExprs", []) if isinstance(v, str)]
            value = {} if isinstance(value, str) else value
            tags = [v["languageTag"].lower() for v in value.get("values", []) if isinstance(v, dict) and v.get("type") == "Language"]
            most = t.get("max", 1)
            found.append(
                Constraint(local_name(t["predicate"]), t["predicate"], value.get("datatype"), tuple(targets), t.get("min", 1), MANY if most == -1 else most, tuple(tags), value.get("nodeKind") == "iri")
            )
        out.append(Shape(declared["id"], tuple(found)))
    return out


def read_shex(text: str) -> list[Shape]:
    """The shapes of a ShEx document in compact or JSON syntax, in order of their IRIs."""
    shapes = _shexj(json.loads(text)) if text.lstrip().startswith("{") else _ShEx(text).parse()
    known = {s.iri for s in shapes}
    for s in shapes:
        for c in s.constraints:
            for target in c.targets:
                if target not in known:
                    raise Refusal("shape/unresolved-reference", f"`{c.name}` of {s.label} refers to {target}, which is not in the document")
    return ordered(shapes)


# SHACL

SH = "http://www.w3.org/ns/shacl#"


def read_shacl(text: str) -> list[Shape]:
    """The node shapes of a Turtle document, by their target class, in order of their IRIs."""
    by: dict = {}
    for s, p, o in turtle.parse(text):
        by.setdefault(s, {}).setdefault(p, []).append(o)

    def one(node, name, default=None):
        return by.get(node, {}).get(SH + name, [default])[0]

    def items(node) -> list:
        out = []
        while node in by and turtle.RDF + "first" in by[node]:
            out.append(by[node][turtle.RDF + "first"][0])
            node = by[node][turtle.RDF + "rest"][0]
        return out

    nodes = [s for s, ps in by.items() if ("iri", SH + "NodeShape") in ps.get(turtle.RDF + "type", []) or SH + "targetClass" in ps]
    cls = {s: one(s, "targetClass", s)[1] for s in nodes}

    def targets(p) -> list[str]:
        found = [o[1] for o in by[p].get(SH + "class", [])] + [cls.get(o, o[1]) for o in by[p].get(SH + "node", [])]
        for alternatives in by[p].get(SH + "or", []):
            for node in items(alternatives):
                found += targets(node) if node in by else []
        return found

    out = []
    for s in nodes:
        found = []
        for p in by[s].get(SH + "property", []):
            path = one(p, "path")
            if path is None or path[0] != "iri":
                raise Refusal("document/unparseable", f"a property of {local_name(cls[s])} has no predicate as its path")
            datatype = one(p, "datatype")
            most = one(p, "maxCount")
            tags = [o[1].lower() for node in by[p].get(SH + "languageIn", []) for o in items(node)]
            order = one(p, "order")
            c = Constraint(
                local_name(path[1]), path[1], datatype and datatype[1], tuple(targets(p)), int(one(p, "minCount", ("", "0"))[1]),
                MANY if most is None else int(most[1]), tuple(tags), one(p, "nodeKind") == ("iri", SH + "IRI") and not targets(p),
            )
            found.append((float(order[1]) if order else 0.0, len(found), c))
        out.append(Shape(cls[s], tuple(c for _, _, c in sorted(found, key=lambda f: f[:2]))))
    return ordered(out)
