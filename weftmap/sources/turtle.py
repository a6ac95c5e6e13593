"""Turtle (and N-Triples, which is part of it): a small parser to triples.

A term is a tuple: ("iri", value), ("blank", label), or ("literal", text,
datatype IRI or None, language tag or None).
"""

from __future__ import annotations

import re

from weftmap.errors import Refusal

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)
  | (?P<long>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')
  | (?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[a-z]+)?)
  | (?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
  | (?P<blank>_:[^\s;,.()\[\]<>"']+(?:\.[^\s;,.()\[\]<>"']+)*)
  | (?P<type>\^\^)
  | (?P<punct>[.;,\[\]()])
  | (?P<name>(?:[^\s:;,.()\[\]<>"'\\]+(?:\.[^\s:;,.()\[\]<>"'\\]+)*)?:(?:\\[^\s]|[^\s;,.()\[\]<>"'\\])*(?:\.(?:\\[^\s]|[^\s;,.()\[\]<>"'\\])+)*)
  | (?P<word>[A-Za-z]+)
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


def tokens(text: str):
    at, line = 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Refusal("document/unparseable", f"Turtle: unexpected {text[at : at + 20]!r}", line)
        if m.lastgroup != "skip":
            yield m.lastgroup, m[0], line
        line += m[0].count("\n")
        at = m.end()
    yield "end", "", line


class Parser:
    def __init__(self, text: str, base: str = ""):
        self._tokens = list(tokens(text))
        self._at = 0
        self._base = base
        self.prefixes: dict[str, str] = {}
        self.triples: list[tuple] = []
        self._blanks = 0

    def _peek(self):
        return self._tokens[self._at]

    def _next(self):
        self._at += 1
        return self._tokens[self._at - 1]

    def _expect(self, punct: str):
        kind, value, line = self._next()
        if value != punct:
            raise Refusal("document/unparseable", f"Turtle: expected {punct!r}, found {value!r}", line)

    def parse(self) -> list[tuple]:
        while self._peek()[0] != "end":
            kind, value, _ = self._peek()
            if kind == "directive":
                self._directive()
            else:
                subject = self._subject()
                if not (subject[0] == "blank" and self._peek()[1] == "."):
                    self._predicates(subject)
                self._expect(".")
        return self.triples

    def _directive(self):
        _, word, line = self._next()
        if word.lower().endswith("prefix"):
            kind, name, line = self._next()
            if kind != "name" or not name.endswith(":"):
                raise Refusal("document/unparseable", f"Turtle: {name!r} is no prefix", line)
            self.prefixes[name[:-1]] = self._iri(self._next())
        else:
            self._base = self._iri(self._next())
        if word.startswith("@"):
            self._expect(".")

    def _iri(self, token) -> str:
        kind, value, line = token
        if kind == "iri":
            iri = unescape(value[1:-1])
            return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else self._base + iri
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise Refusal("document/unparseable", f"Turtle: the prefix {prefix!r} is not declared", line)
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise Refusal("document/unparseable", f"Turtle: expected an IRI, found {value!r}", line)

    def _fresh(self):
        self._blanks += 1
        return ("blank", f"b{self._blanks}")

    def _subject(self):
        return self._term(literal=False)

    def _term(self, literal: bool = True):
        kind, value, line = self._next()
        if kind in ("iri", "name"):
            return ("iri", self._iri((kind, value, line)))
        if kind == "blank":
            return ("blank", value[2:])
        if value == "[":
            node = self._fresh()
            if self._peek()[1] != "]":
                self._predicates(node)
            self._expect("]")
            return node
        if value == "(":
            items = []
            while self._peek()[1] != ")":
                items.append(self._term())
            self._next()
            rest = ("iri", RDF + "nil")
            for item in reversed(items):
                node = self._fresh()
                self.triples += [(node, RDF + "first", item), (node, RDF + "rest", rest)]
                rest = node
            return rest
        if literal and kind in ("text", "long"):
            text = unescape(value[3:-3] if kind == "long" else value[1:-1])
            after = self._peek()
            if after[0] == "lang":
                self._next()
                if "--" in after[1]:
                    raise Refusal("document/unparseable", "a base direction is not supported", line)
                return ("literal", text, RDF + "langString", after[1][1:])
            if after[0] == "type":
                self._next()
                return ("literal", text, self._iri(self._next()), None)
            return ("literal", text, XSD + "string", None)
        if literal and kind == "number":
            datatype = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return ("literal", value, XSD + datatype, None)
        if literal and kind == "word" and value in ("true", "false"):
            return ("literal", value, XSD + "boolean", None)
        raise Refusal("document/unparseable", f"Turtle: unexpected {value!r}", line)

    def _predicates(self, subject):
        while True:
            kind, value, line = self._next()
            predicate = RDF + "type" if (kind, value) == ("word", "a") else self._iri((kind, value, line))
            while True:
                self.triples.append((subject, predicate, self._term()))
                if self._peek()[1] != ",":
                    break
                self._next()
            if self._peek()[1] != ";":
                return
            while self._peek()[1] == ";":
                self._next()
            if self._peek()[1] in (".", "]"):
                return


def parse(text: str, base: str = "") -> list[tuple]:
    """(subject, predicate IRI, object) of a document."""
    return Parser(text, base).parse()
