"""What the tables mean as RDF: an RML-Core mapping in Turtle."""

from __future__ import annotations

from weftmap import types
from weftmap.operators import graph as G

PREFIXES = "@prefix rml: <http://w3id.org/rml/> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"


def _source(iterator: str, query: bool = False) -> str:
    formulation = "rml:SQL2008Query" if query else "rml:SQL2008Table"
    text = iterator.replace("\\", "\\\\").replace('"', '\\"')
    return f'rml:logicalSource [ rml:source [ a rml:Source ] ;\n    rml:referenceFormulation {formulation} ; rml:iterator "{text}" ]'


def _term(p: G.Property) -> str:
    if p.item == types.LANG:
        return f'rml:reference "{p.name}" ; rml:languageMap [ rml:reference "lang" ]'
    if p.item == types.URI:
        return f'rml:reference "{p.name}" ; rml:termType rml:IRI'
    datatype = p.datatype or (types.XSD + types.PRIMITIVES[p.item][2])
    shown = f"xsd:{datatype[len(types.XSD) :]}" if datatype.startswith(types.XSD) else f"<{datatype}>"
    return f'rml:reference "{p.name}" ; rml:datatype {shown}'


def _named(name: str) -> str:
    """An identifier of SQL."""
    return '"' + name.replace('"', '""') + '"'


def _sql(wanted: dict[str, tuple[str, str]], tables: str) -> str:
    """``wanted``: output column -> (row, column)."""
    return f"SELECT {', '.join(f'{_named(row)}.{_named(c)} AS {_named(out)}' for out, (row, c) in wanted.items())} FROM {tables}"


def _elements(label: str, p: G.Property) -> str:
    """A row for each element of a set: its owner, its value, and its language if it has one."""
    tagged = p.item == types.LANG
    element = f"UNNEST({_named(p.name)}, recursive := true)" if tagged else f"UNNEST({_named(p.name)}) AS {_named('value')}"
    rows = f"(SELECT {_named('subject')}, {element} FROM {_named(label)}) AS {_named('each')}"
    return _sql({out: ("each", c) for out, c in (("subject", "subject"), (p.name, "value"), *([("lang", "lang")] if tagged else []))}, rows)


#: The columns of an adjacency list, which vertex each says, and what that is called here.
_ENDS = (("_graphArSrcIndex", "source", "src"), ("_graphArDstIndex", "target", "dst"))


def _pairs(e: G.EdgeTable) -> str:
    """The subjects of both ends of each edge."""
    tables = f"{_named(e.name)} AS {_named('edge')}"
    for index, end, role in _ENDS:
        tables += f" JOIN {_named(getattr(e, end))} AS {_named(role)} ON {_named(role)}.{_named('_graphArVertexIndex')} = {_named('edge')}.{_named(index)}"
    return _sql({role: (role, "subject") for _, _, role in _ENDS}, tables)


def turtle(graph: G.Graph) -> str:
    """A triples map for each vertex type, each multi-valued property and each relation."""
    out = [PREFIXES]
    for v in graph.vertices:
        lines = [f"<#{v.label}> a rml:TriplesMap", _source(v.label), f'rml:subjectMap [ rml:reference "subject" ; rml:termType rml:IRI ;\n    rml:class <{v.shape.iri}> ]']
        lines += [f"rml:predicateObjectMap [ rml:predicate <{p.predicate}> ;\n    rml:objectMap [ {_term(p)} ] ]" for p in v.properties if p.single]
        out.append(" ;\n  ".join(lines) + " .\n")
        for p in v.properties:
            if not p.single:
                lines = [f"<#{v.label}_{p.name}> a rml:TriplesMap", _source(_elements(v.label, p), True), 'rml:subjectMap [ rml:reference "subject" ; rml:termType rml:IRI ]']
                lines.append(f"rml:predicateObjectMap [ rml:predicate <{p.predicate}> ;\n    rml:objectMap [ {_term(p)} ] ]")
                out.append(" ;\n  ".join(lines) + " .\n")
    for e in graph.edges:
        lines = [f"<#{e.name}> a rml:TriplesMap", _source(_pairs(e), True), 'rml:subjectMap [ rml:reference "src" ; rml:termType rml:IRI ]']
        lines.append(f'rml:predicateObjectMap [ rml:predicate <{e.predicate}> ;\n    rml:objectMap [ rml:reference "dst" ; rml:termType rml:IRI ] ]')
        out.append(" ;\n  ".join(lines) + " .\n")
    return "\n".join(out)
