"""Running a program: its sources are opened, its vertices and edges built, its graph written."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftmap import types
from weftmap.errors import Refusal
from weftmap.functions import expr as X
from weftmap.operators import graph as G
from weftmap.operators.algebra import Source
from weftmap.operators.relation import Relation, Slot
from weftmap.plans.compile import Host, Program, compile_program, diagnose
from weftmap.session import beside, filesystem, fresh_path, scratch
from weftmap.sources import rdf, tables
from weftmap.sources.location import read_text, resolve


TABLES_AT_ONCE = 4


class Reader:
    """Opens what a program names. ``base`` is the folder that the program is in, ``limit`` the rows read of each source."""

    def __init__(self, spark: SparkSession, base: str | None = None, connections: dict[str, str] | None = None, limit: int | None = None, frames: dict | None = None):
        self._spark = spark
        self._base = base
        self._connections = connections
        self._limit = limit
        self._frames = frames or {}
        self._triples: dict = {}

    def host(self) -> Host:
        return Host(self.document, self.source)

    def document(self, uri: str) -> str:
        return read_text(self._spark, resolve(uri, self._base, self._connections))

    def source(self, op: Source, shape=None) -> Relation:
        if op.uri in self._frames:
            df = self._frames[op.uri]
        else:
            path = resolve(op.uri, self._base, self._connections)
            if op.format == "csv":
                return Relation.source(tables.read_csv(self._spark, path, dict(op.options).get("delimiter"), self._limit), op.binding, op.uri)
            elif op.format == "json":
                df = tables.read_json(self._spark, path)
            elif op.format == "parquet":
                df = tables.read_parquet(self._spark, path)
            else:
                return self._rdf(path, shape, op)
        if self._limit is not None:
            df = tables.first_rows(df, self._limit)
        return Relation.source(df, op.binding, op.uri)

    def _rdf(self, path: str, shape, op: Source) -> Relation:
        if path not in self._triples:
            self._triples[path] = rdf.read_triples(self._spark, path)
        triples = self._triples[path]
        df = rdf.pivot(triples, shape)
        if self._limit is not None:
            df = tables.first_rows(df, self._limit)
        many = [c.name for c in shape.constraints if not c.single]
        held = df.select([F.to_json(c) if c in many else F.col(f"`{c}`") for c in df.columns]).toDF(*df.columns)
        relation = Relation.source(held, op.binding, op.uri)
        # lists stay lists
        kept = df.toDF(*[s.physical for _, _, s in relation.slots()])
        slots = {c: Slot(s.physical, types.sequence(types.STRING) if c in many else types.STRING) for _, c, s in relation.slots()}
        return Relation(kept, {op.binding: slots}, (op.uri,))


def build(program: Program) -> G.Graph:
    """All vertices first, numbered type by type in order of class IRIs; then all edges."""
    out = G.Graph()

    def vertices(shape) -> G.VertexTable:
        parts = []
        for m in program.mappings:
            if m.shape.iri != shape.iri:
                continue
            scope = program.relations[m.relation]
            properties = {c.name: (G.Property.of(c, got) if not types.is_sequence(got) else _sequence(c, got), X.render(e, scope)) for c, e, got in m.properties}
            parts.append(G.VertexPart(scope.df, X.render(m.identity, scope), properties, scope.sources))
        return G.build_vertices(shape, parts, 0)

    # types do not depend on each other but for where their numbers begin
    first = 0
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        for table in [t.result() for t in [beside(pool, vertices, shape) for shape in program.classes()]]:
            out.vertices.append(G.shifted(table, first))
            first += table.count
    keys: list[tuple[str, str, str]] = []
    for m in program.mappings:
        for c, target, _ in m.edges:
            if (m.shape.iri, c.name, target) not in keys:
                keys.append((m.shape.iri, c.name, target))
    by_class = {v.shape.iri: v for v in out.vertices}

    def edges(key: tuple[str, str, str]) -> G.EdgeTable:
        source, label, target = key
        parts, constraint = [], None
        for m in program.mappings:
            for c, t, identity in m.edges:
                if (m.shape.iri, c.name, t) == key:
                    scope = program.relations[m.relation]
                    many = types.is_sequence(X.type_of(identity, scope))
                    parts.append(G.EdgePart(scope.df, X.render(m.identity, scope), X.render(identity, scope), many))
                    constraint = c
        return G.build_edges(label, constraint.predicate, constraint.single, parts, by_class[source], by_class[target])

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        twice = beside(pool, G.duplicate_subject, _may_meet(program, out.vertices))
        made = [beside(pool, edges, k) for k in keys if k[2] in by_class]
        twice.result()
        out.edges = [e.result() for e in made]
    return out


def _may_meet(program: Program, vertices: list[G.VertexTable]) -> list[G.VertexTable]:
    """The types whose subjects may be those of another type: subjects that begin with different texts are not."""

    def begins(v: G.VertexTable) -> set[str]:
        found = set()
        for m in program.mappings:
            if m.shape.iri == v.shape.iri:
                first = m.identity.parts[:1] if isinstance(m.identity, X.Concat) else (m.identity.value,) if isinstance(m.identity, X.Lit) else ()
                found.add(first[0] if first and isinstance(first[0], str) else "")
        return found

    own = {v.label: begins(v) for v in vertices}

    def meet(a: str, b: str) -> bool:
        return a.startswith(b) or b.startswith(a)

    return [v for v in vertices if any(meet(a, b) for w in vertices if w.label != v.label for a in own[v.label] for b in own[w.label])]


def _sequence(c, got) -> G.Property:
    own = G.Property.of(c, got[1])
    return G.Property(own.name, types.sequence(own.type), own.predicate, False, own.least, own.languages, own.datatype)


def load(spark: SparkSession, text: str, **reads) -> Program:
    return compile_program(text, Reader(spark, **reads).host())


def check(spark: SparkSession, text: str, **reads) -> list[Refusal]:
    return diagnose(text, Reader(spark, **reads).host())


FILES_AT_MOST = 1 << 28


def files(spark: SparkSession, place: str) -> dict[str, bytes]:
    """The files under a place, by their paths within it; refused before any is read if they are too large together."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(place)
    size = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > FILES_AT_MOST:
        raise Refusal("run/too-large", f"the files of the graph are {size} bytes")
    root = filesystem(spark, place)[1].toUri().getPath().rstrip("/") + "/"
    return {r.path.partition(root)[2]: bytes(r.content) for r in found.select("path", "content").collect()}


def run(spark: SparkSession, text: str, into: str | None = None, form: str = "graph", chunk_size: int | None = None, **reads) -> dict:
    """Compile, build, and write where asked (``form``: graph or ntriples): {location, dropped, graph, files}.

    With ``form`` files and no place the graph's files are handed back, path by
    path, for a host that keeps them itself; only a small graph is (``FILES_AT_MOST`` bytes).
    ``chunk_size`` is the number of vertices in a file of the graph; without one
    a table is cut into chunks of ``graphar.CHUNK`` vertices.
    """
    from weftmap.sinks import graphar, ntriples

    if chunk_size is not None and chunk_size < 1:
        raise Refusal("run/invalid-option", "a chunk holds one vertex at least")
    try:
        program = load(spark, text, **reads)
    except Refusal as e:
        found = tuple(check(spark, text, **reads)) or (e,)
        raise Refusal("run/does-not-compile", f"nothing was run: {found[0]}", related=found) from e
    graph = build(program)
    held = None
    if form == "files":
        with scratch(spark):
            place = fresh_path(spark, "files")
            graphar.write(spark, graph, place, chunk_size)
            held = files(spark, place)
    elif into is not None and form == "graph":
        graphar.write(spark, graph, into, chunk_size)
    elif into is not None:
        ntriples.write(spark, graph, into)
    dropped = [{"edge": e.name, "rows": e.dropped} for e in graph.edges if e.dropped]
    return {"location": into, "dropped": dropped, "graph": graph, "files": held}
