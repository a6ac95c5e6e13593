"""A model that a profile implies, and the program that says it.

A source with a key is a type, named after the source. A column that is included
in another type's key is a relation, named by the column without a trailing
``id``. A source without a key whose two inclusions land on types is a link, and
so a relation across it, or, where that is chosen, a type of its own that both
ends identify. Every other column is a field. Where more than one
reading stands, it is an ambiguity with options, the first of which is taken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from weftmap import types
from weftmap.plans.profile import Inclusion, Profile


@dataclass(frozen=True)
class Ambiguity:
    id: str
    question: str
    options: tuple[str, ...]


@dataclass
class FieldModel:
    name: str
    column: str
    type: object
    optional: bool


@dataclass
class RelationModel:
    name: str
    column: str
    target: str  # name of the type
    optional: bool
    link: str | None = None  # the source it goes across
    far: str | None = None  # that source's column for the other end


@dataclass
class TypeModel:
    name: str
    source: str
    keys: tuple[str, ...]  # columns that identify a row
    fields: list[FieldModel] = field(default_factory=list)
    relations: list[RelationModel] = field(default_factory=list)

    @property
    def key(self) -> str:
        return self.keys[0]


@dataclass
class Model:
    types: list[TypeModel]
    ambiguities: list[Ambiguity]
    left_out: list[str]

    def type(self, name: str) -> TypeModel:
        return next(t for t in self.types if t.name == name)


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)) if w]


def pascal(text: str) -> str:
    made = "".join(w[:1].upper() + w[1:] for w in words(text)) or "Source"
    return made if made[0].isalpha() else f"T{made}"


def identifier(text: str) -> str:
    made = "_".join(words(text)).lower() or "value"
    made = made if made[0].isalpha() else f"c_{made}"
    return f"{made}_" if made in ("from", "and", "or", "not", "true", "false", "null") else made


def _without_id(column: str) -> str:
    own = words(column)
    return identifier(" ".join(own[:-1]) if len(own) > 1 and own[-1].lower() == "id" else column)


def _unique(name: str, taken: set[str]) -> str:
    free, n = name, 1
    while free in taken:
        n += 1
        free = f"{name}_{n}"
    taken.add(free)
    return free


def infer(profile: Profile, choices: dict[str, str] | None = None) -> Model:
    """The model of a profile; ``choices`` answers ambiguities by id."""
    choices = choices or {}
    ambiguities: list[Ambiguity] = []

    def ask(id_: str, question: str, options: list[str]) -> str:
        if len(options) > 1:
            ambiguities.append(Ambiguity(id_, question, tuple(options)))
        return choices[id_] if choices.get(id_) in options else options[0]

    keys = {}
    for s in profile.sources:
        if s.keys:
            landed = [k for k in s.keys if any(i.referenced == s.name and i.key == k for i in profile.inclusions)]
            keys[s.name] = ask(f"key:{s.name}", f"what identifies a row of {s.name}?", landed + [k for k in s.keys if k not in landed])
    names, taken = {}, set()
    for name in keys:
        names[name] = _unique(pascal(name), taken)

    def target(source: str, column: str) -> Inclusion | None:
        found = [i for i in profile.inclusions if (i.source, i.column) == (source, column) and keys.get(i.referenced) == i.key]
        if not found:
            return None
        own = ask(f"target:{source}.{column}", f"what does {column} of {source} refer to?", [i.referenced for i in found])
        return next(i for i in found if i.referenced == own)

    made, left_out = [], []

    def filled(s, t: TypeModel, ends: tuple[str, ...] = ()) -> TypeModel:
        """A type with the source's columns as fields and relations; ``ends`` are relations although they identify a row."""
        own: set[str] = set()
        for c in s.columns:
            optional = c.present < s.rows
            i = target(s.name, c.name) if c.name in ends or c.name not in t.keys else None
            if i is not None:
                t.relations.append(RelationModel(_unique(_without_id(c.name), own), c.name, names[i.referenced], optional))
            else:
                t.fields.append(FieldModel(_unique(identifier(c.name), own), c.name, c.type, optional))
        return t

    for s in profile.sources:
        if s.name in keys:
            made.append(filled(s, TypeModel(names[s.name], s.name, (keys[s.name],))))
    by_source = {t.source: t for t in made}
    for s in profile.sources:
        if s.name in keys:
            continue
        ends = [(c.name, i) for c in s.columns if (i := target(s.name, c.name)) is not None]
        if len(ends) != 2:
            left_out.append(s.name)
            continue
        (near, a), (far, b) = ends
        if ask(f"count:{s.name}", f"is {s.name} a relation or a type of its own?", ["link", "thing"]) == "thing":
            made.append(filled(s, TypeModel(_unique(pascal(s.name), taken), s.name, (near, far)), (near, far)))
            continue
        t = by_source[a.referenced]
        own = {f.name for f in t.fields} | {r.name for r in t.relations}
        t.relations.append(RelationModel(_unique(_without_id(far), own), near, names[b.referenced], True, s.name, far))
    return Model(made, ambiguities, left_out)


def _member(binding: str, column: str) -> str:
    plain = re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", column)
    return f"{binding}.{column}" if plain else f'{binding}."{column}"'


def write(model: Model, places: dict[str, str], base: str) -> str:
    """The program of a model: ``places`` says what each source is read by, as ``io.csv("x.csv")``; ``base`` is an IRI."""
    base = base.rstrip("/") + "/"
    out = []
    for t in model.types:
        out.append(f'@iri("{base}vocab/{t.name}")\ntype {t.name}')
        for f in t.fields:
            ty = f"Option<{f.type}>" if f.optional else f.type
            out.append(f'    @iri("{base}vocab/{t.name}/{f.name}") {f.name}: {ty}')
        for r in t.relations:
            ty = f"Seq<Ref<{r.target}>>" if r.link else f"Option<Ref<{r.target}>>" if r.optional else f"Ref<{r.target}>"
            out.append(f'    @iri("{base}vocab/{t.name}/{r.name}") {r.name}: {ty}')
        out.append("")
    used = [t.source for t in model.types] + [r.link for t in model.types for r in t.relations if r.link]
    rows = {s: f"{pascal(s)}Row" for s in dict.fromkeys(used)}
    out += [f"{rows[s]} := {places[s]}" for s in rows] + [""]
    for t in model.types:
        row = rows[t.source]

        def body(t=t, row=row):
            yield f'    @subject = "{base}{identifier(t.name)}/{"/".join("{" + _member(row, k) + "}" for k in t.keys)}"'
            yield from (f"    {f.name} = {_member(row, f.column)}" for f in t.fields)
            yield from (f"    {r.name} = {r.target}({_member(row, r.column)})" for r in t.relations if not r.link)

        out += [f"{t.name}Rows : {t.name} from {row}", *body(), ""]
        for k, r in enumerate(r for r in t.relations if r.link):
            link = rows[r.link]
            out.append(f"{t.name}Links{k + 1} : {t.name} from {row}.join({link}, on = {_member(row, t.key)} == {_member(link, r.column)})")
            out += [*body(), f"    {r.name} = {r.target}({_member(link, r.far)})", ""]
    return "\n".join(out)


def spelled(model: Model) -> list[tuple[str, str, str]]:
    """(type, property, its type) of a model, for reading."""
    found = []
    for t in model.types:
        found += [(t.name, f.name, types.spelled(f.type)) for f in t.fields]
        found += [(t.name, r.name, r.target) for r in t.relations]
    return found
