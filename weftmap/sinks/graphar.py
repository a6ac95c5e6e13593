"""The graph in Apache GraphAr's format: YAML information files over Parquet chunks, and an RML mapping.

The graph document is written last: a folder without it is no graph.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmap import types
from weftmap.errors import Refusal
from weftmap.operators import graph as G
from weftmap.session import beside, partitions
from weftmap.sinks import rml
from weftmap.sinks.files import put, put_many, put_numbered

#: The graph's name; its document is NAME.graph.yml.
NAME = "graph"
VERSION = "gar/v1"
TABLES_AT_ONCE = 4
#: Vertices in a file where nothing else is asked for; a smaller table is one file.
CHUNK = 1 << 20


def admissible(graph: G.Graph) -> None:
    """Distinct classes, and within a class distinct predicates; checked before anything is written."""
    classes: dict[str, str] = {}
    for v in graph.vertices:
        if classes.setdefault(v.shape.iri, v.label) != v.label or [w.label for w in graph.vertices].count(v.label) > 1:
            raise Refusal("write/ambiguous-iri", f"two vertex types are both {v.label}")
        predicates: dict[str, str] = {}
        for name, iri in [(p.name, p.predicate) for p in v.properties] + [(e.label, e.predicate) for e in graph.edges if e.source == v.label]:
            if predicates.setdefault(iri, name) != name:
                raise Refusal("write/ambiguous-iri", f"`{predicates[iri]}` and `{name}` of {v.label} are one predicate")


def group_name(v: G.VertexTable) -> str:
    return "_".join(["subject", *[p.name for p in ordered(v)]])


def ordered(v: G.VertexTable) -> list[G.Property]:
    """Single-valued properties, then sets."""
    return [p for p in v.properties if p.single] + [p for p in v.properties if not p.single]


def _yaml(value: str) -> str:
    plain = value and all(c.isalnum() or c in "_-./" for c in value) and not value[0].isdigit() and value.lower() not in ("true", "false", "null", "yes", "no", "on", "off")
    return value if plain else '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def vertex_info(v: G.VertexTable, chunk: int) -> str:
    lines = [f"type: {_yaml(v.label)}", f"chunk_size: {chunk}", f"prefix: {_yaml(f'vertex/{v.label}/')}", "property_groups:", f"  - prefix: {_yaml(group_name(v) + '/')}", "    file_type: parquet", "    properties:"]
    lines += ["      - name: subject", "        data_type: string", "        is_primary: true"]
    for p in ordered(v):
        lines += [f"      - name: {_yaml(p.name)}", f"        data_type: {types.PRIMITIVES[p.item][1]}", "        is_primary: false"]
        lines += [f"        is_nullable: {str(p.least == 0).lower()}"] if p.single else ["        is_nullable: true", "        cardinality: set"]
    return "\n".join([*lines, f"version: {VERSION}", ""])


def edge_info(e: G.EdgeTable, chunk: int, source_chunk: int, target_chunk: int) -> str:
    lines = [
        f"src_type: {_yaml(e.source)}", f"edge_type: {_yaml(e.label)}", f"dst_type: {_yaml(e.target)}", f"chunk_size: {chunk}",
        f"src_chunk_size: {source_chunk}", f"dst_chunk_size: {target_chunk}", "directed: true", f"prefix: {_yaml(f'edge/{e.name}/')}",
        "adj_lists:", "  - ordered: true", "    aligned_by: src", "    prefix: ordered_by_source/", "    file_type: parquet", f"version: {VERSION}", "",
    ]
    return "\n".join(lines)


def representable(v: G.VertexTable) -> None:
    """A timestamp finer than a millisecond has no place in the files."""
    stamps = [p.name for p in v.properties if p.single and p.item == types.DATETIME]
    if stamps:
        fine = [F.max(F.date_trunc("millisecond", F.col(f"`{n}`")) != F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(stamps)]
        told = v.rows.agg(*fine).first()
        bad = [n for i, n in enumerate(stamps) if told[f"c{i}"]]
        if bad:
            raise Refusal("write/unrepresentable", f"`{bad[0]}` of {v.label} holds a time finer than a millisecond")


def _stored(p: G.Property) -> Column:
    return F.col(f"`{p.name}`")


def vertex_rows(v: G.VertexTable) -> DataFrame:
    """What a vertex table's chunks hold: the index within the type, the subject, the properties; sets as sorted lists."""
    rows = v.rows.select((F.col("dense_id") - v.first).alias("_graphArVertexIndex"), "subject", *[_stored(p) for p in ordered(v) if p.single])
    for p in ordered(v):
        if p.single:
            continue
        values = v.multi[p.name]
        value = F.struct("value", "lang") if "lang" in values.columns else F.col("value")
        sets = values.groupBy((F.col("src") - v.first).alias("_wm_src")).agg(F.sort_array(F.collect_list(value)).alias("_wm_set"))
        rows = rows.join(sets, rows["_graphArVertexIndex"] == sets["_wm_src"], "left").drop("_wm_src").withColumnRenamed("_wm_set", p.name)
    return rows


def edge_rows(graph: G.Graph, e: G.EdgeTable) -> DataFrame:
    a, b = graph.vertex(e.source).first, graph.vertex(e.target).first
    return e.rows.select((F.col("src") - a).alias("_graphArSrcIndex"), (F.col("dst") - b).alias("_graphArDstIndex"))


def _count(n: int) -> bytes:
    return n.to_bytes(8, "little", signed=True)


def offset_rows(edges: DataFrame, vertices: int, chunk: int) -> DataFrame:
    """(part, _graphArOffset): for each chunk of source vertices where the edges of each begin in that part, and where the last end."""
    starts = G.offsets(edges.select(F.col("_graphArSrcIndex").alias("src")), vertices)
    if vertices <= chunk:
        return starts.select(F.lit(0).cast("long").alias("part"), F.col("offset").alias("_graphArOffset"))
    v = F.col("vertex")
    own = F.when(v < vertices, F.array(F.floor(v / chunk))).otherwise(F.array().cast("array<bigint>"))
    ends = F.when((v > 0) & ((v % chunk == 0) | (v == vertices)), F.array(F.floor((v - 1) / chunk))).otherwise(F.array().cast("array<bigint>"))
    rows = starts.select("vertex", "offset", F.explode(F.concat(own, ends)).alias("part"))
    first = starts.filter((v % chunk == 0) & (v < vertices)).select(F.floor(v / chunk).alias("part"), F.col("offset").alias("first"))
    return rows.join(first, "part").select("part", (F.col("offset") - F.col("first")).alias("_graphArOffset"))


def write(spark: SparkSession, graph: G.Graph, into: str, chunk_size: int | None = None) -> None:
    """Write a graph under ``into`` in chunks of ``chunk_size`` vertices, or at most ``CHUNK``.

    A task writes a chunk, or of small chunks as many as leave work for all
    tasks, at most ``CHUNK`` vertices together.
    """
    into = into.rstrip("/")
    admissible(graph)
    for v in graph.vertices:
        representable(v)
    chunks = {v.label: max(1, chunk_size or min(v.count, CHUNK)) for v in graph.vertices}

    def each(parts: int, chunk: int) -> int:
        return max(1, min(CHUNK // chunk, parts // partitions(spark)))

    def put_vertices(v: G.VertexTable) -> None:
        place, chunk = f"{into}/vertex/{v.label}/{group_name(v)}", chunks[v.label]
        rows = vertex_rows(v).withColumn("_wm_chunk", F.floor(F.col("_graphArVertexIndex") / chunk))
        parts = max(1, -(-v.count // chunk))
        put_numbered(rows, "_wm_chunk", parts, ["_graphArVertexIndex"], lambda i: f"{place}/chunk{i}", place, each(parts, chunk))
        put(spark, f"{into}/vertex/{v.label}/vertex_count", _count(v.count))
        put(spark, f"{into}/{v.label}.vertex.yml", vertex_info(v, chunk))

    def put_edges(e: G.EdgeTable) -> None:
        n, chunk = graph.vertex(e.source).count, chunks[e.source]
        parts = max(1, -(-n // chunk))
        place = f"{into}/edge/{e.name}/ordered_by_source"
        rows = edge_rows(graph, e).withColumn("part", F.floor(F.col("_graphArSrcIndex") / chunk))
        lists = beside(files, put_numbered, rows, "part", parts, ["_graphArSrcIndex", "_graphArDstIndex"], lambda i: f"{place}/adj_list/part{i}/chunk0", f"{place}/adj_list", each(parts, chunk))
        starts = beside(files, lambda: put_numbered(offset_rows(rows, n, chunk), "part", parts, ["_graphArOffset"], lambda i: f"{place}/offset/chunk{i}", f"{place}/offset", each(parts, chunk)))
        counts = {0: e.count} if parts == 1 else {r.part: r["count"] for r in rows.groupBy("part").count().collect()}  # a number per part
        put_many(spark, place, [(f"edge_count{i}", _count(counts.get(i, 0))) for i in range(parts)])
        lists.result()
        starts.result()
        put(spark, f"{place}/vertex_count", _count(n))
        put(spark, f"{into}/{e.name}.edge.yml", edge_info(e, max([1, *counts.values()]), chunk, chunks[e.target]))

    # tables do not depend on each other: a few are written at a time
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool, ThreadPoolExecutor(2 * TABLES_AT_ONCE) as files:
        for done in [beside(pool, put_edges, e) for e in graph.edges] + [beside(pool, put_vertices, v) for v in graph.vertices]:
            done.result()
    put(spark, f"{into}/mapping.ttl", rml.turtle(graph))
    lines = [f"name: {NAME}"]
    if graph.vertices:
        lines += ["vertices:", *[f"  - {v.label}.vertex.yml" for v in graph.vertices]]
    if graph.edges:
        lines += ["edges:", *[f"  - {e.name}.edge.yml" for e in graph.edges]]
    put(spark, f"{into}/{NAME}.graph.yml", "\n".join([*lines, f"version: {VERSION}", ""]))
