"""Queries that run whole programs, read back what was written, and go through sources, shapes, refusals and models.

They are registered beside those of :mod:`weftmap.queries`, each with SQL that
says the same from the driver's tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmap import types
from weftmap.errors import Refusal
from weftmap.functions import expr as X
from weftmap.operators import graph as G
from weftmap.operators.relation import Relation
from weftmap.plans import model as M
from weftmap.plans import profile as P
from weftmap.plans.compile import compile_program, expression
from weftmap.plans.run import Reader, build, check, run
from weftmap.queries import BASE, cols, outs, query, relation, table
from weftmap.session import fresh_path, partitions
from weftmap.sinks import graphar, ntriples
from weftmap.sinks.files import put
from weftmap.sources import rdf, shapes, tables
from weftmap.sources.location import check_extension, resolve
from weftmap.sources.shapes import Constraint, Shape

TABLES = ("customer", "nation", "orders", "supplier", "region", "part", "events")


def values(*rows: tuple, names: str) -> str:
    """SQL for a few rows that are known."""

    def shown(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


def frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {f"{n}.parquet": table(spark, sf, n) for n in TABLES}


def compiled(spark: SparkSession, sf: str, text: str, document: str, **more: DataFrame):
    host = Reader(spark, frames=frames(spark, sf) | more).host()
    host.document = lambda uri: document
    return compile_program(text, host)


def place(spark: SparkSession, **documents: str) -> str:
    """A folder that holds some small documents."""
    folder = fresh_path(spark, "program")
    for name, text in documents.items():
        put(spark, f"{folder}/{name.replace('__', '.')}", text)
    return folder


def rows(spark: SparkSession, found, schema: str) -> DataFrame:
    return spark.createDataFrame(list(found), schema)


# A shop: customers with money, their nations, and orders, of which those of poor customers find no vertex

SHOP_SHAPES = """
PREFIX s: <https://shop.example/voc#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>
s:Customer { s:name xsd:string ; s:segment xsd:string ; s:balance xsd:double ? ; s:nation @s:Nation }
s:Nation { s:label xsd:string ; s:sells xsd:string * ; s:known rdf:langString * }
s:Order { s:total xsd:double ; s:day xsd:date ; s:placed_by @s:Customer }
"""

SHOP = """
type { Customer, Nation, Order } := io.shex("shapes.shex")
C := io.parquet("customer.parquet")
N := io.parquet("nation.parquet")
O := io.parquet("orders.parquet")
Rich := C.where(C.c_acctbal > 0)

Nations : Nation from N
    @subject = "https://shop.example/nation/{N.n_nationkey}"
    label    = N.n_name
    known    = N.n_name.lower().lang("EN")

Sold : Nation from N.join(C, on = N.n_nationkey == C.c_nationkey)
    @subject = "https://shop.example/nation/{N.n_nationkey}"
    label    = N.n_name
    sells    = C.c_mktsegment

Customers : Customer from Rich
    @subject = "https://shop.example/customer/{C.c_custkey}"
    name     = C.c_name
    segment  = C.c_mktsegment
    balance  = C.c_acctbal
    nation   = Nation(C.c_nationkey)

Orders : Order from O
    @subject  = "https://shop.example/order/{O.o_orderkey}"
    total     = O.o_totalprice
    day       = parse.date(str.slice("{O.o_orderdate}", 1), format = "%Y-%m-%dT%H:%M:%S")
    placed_by = Customer(O.o_custkey)
"""


def shop(spark: SparkSession, sf: str, into: str | None = None, **how) -> dict:
    return run(spark, SHOP, into, base=place(spark, shapes__shex=SHOP_SHAPES), frames=frames(spark, sf), **how)


def written(spark: SparkSession, sf: str, **how) -> tuple[str, G.Graph]:
    into = fresh_path(spark, "shop")
    return into, shop(spark, sf, into, **how)["graph"]


def chunks(spark: SparkSession, into: str, v: G.VertexTable) -> DataFrame:
    return spark.read.parquet(f"{into}/vertex/{v.label}/{graphar.group_name(v)}/chunk*")


def adjacency(spark: SparkSession, into: str, edge: str) -> DataFrame:
    return spark.read.parquet(f"{into}/edge/{edge}/ordered_by_source/adj_list/part*/chunk*")


def counted(spark: SparkSession, path: str) -> list[int]:
    """The numbers in the count files of a path, in order of the parts that end their names."""
    read = spark.read.format("binaryFile").load(path).select("path", "content").collect()
    numbers = {int("0" + re.search("[0-9]*$", r.path)[0]): int.from_bytes(r.content, "little") for r in read}
    return [numbers[i] for i in sorted(numbers)]


_RICH = f"""
WITH c AS (SELECT '{BASE}customer/' || c_custkey AS s, c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey,
  row_number() OVER (ORDER BY '{BASE}customer/' || c_custkey) - 1 AS i FROM customer WHERE c_acctbal > 0),
n AS (SELECT n_nationkey, n_name, '{BASE}nation/' || n_nationkey AS s, row_number() OVER (ORDER BY '{BASE}nation/' || n_nationkey) - 1 AS i FROM nation),
o AS (SELECT o_custkey, o_totalprice, o_orderdate, '{BASE}order/' || o_orderkey AS s, row_number() OVER (ORDER BY '{BASE}order/' || o_orderkey) - 1 AS i FROM orders)
"""


@query("graph_program", _RICH + "SELECT o.s AS source, c.s AS target, o.o_totalprice AS total, o.o_orderdate::DATE AS day, c.c_name AS name, n.s AS nation FROM o JOIN c ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey")
def _(spark, sf):
    """A whole program is run, its graph written, and the written tables are joined by their indices."""
    into, graph = written(spark, sf)
    o, c, n = (chunks(spark, into, graph.vertex(label)) for label in ("Order", "Customer", "Nation"))
    placed = adjacency(spark, into, "Order_placed_by_Customer").toDF("o", "c")
    lives = adjacency(spark, into, "Customer_nation_Nation").toDF("c", "n")
    o = o.select(F.col("_graphArVertexIndex").alias("o"), F.col("subject").alias("source"), "total", "day")
    c = c.select(F.col("_graphArVertexIndex").alias("c"), F.col("subject").alias("target"), "name")
    n = n.select(F.col("_graphArVertexIndex").alias("n"), F.col("subject").alias("nation"))
    return placed.join(o, "o").join(lives, "c").join(c, "c").join(n, "n").select("source", "target", "total", "day", "name", "nation")


@query("gar_vertices", _RICH + "SELECT i AS place, s AS subject, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM c")
def _(spark, sf):
    into, graph = written(spark, sf)
    return chunks(spark, into, graph.vertex("Customer")).withColumnRenamed("_graphArVertexIndex", "place")


@query("gar_edges", _RICH + "SELECT o.i AS src, c.i AS dst FROM o JOIN c ON o_custkey = c_custkey")
def _(spark, sf):
    into, _ = written(spark, sf)
    return adjacency(spark, into, "Order_placed_by_Customer").toDF("src", "dst")


@query("gar_offsets", _RICH + "SELECT (SELECT count(*) FROM c WHERE c.i < v.i) AS starts FROM (SELECT i FROM c UNION ALL SELECT count(*) FROM c) v")
def _(spark, sf):
    """Offsets begin anew in each part of the sources, and the last of a part is the first of the next."""
    into, graph = written(spark, sf)
    place = f"{into}/edge/Customer_nation_Nation/ordered_by_source"
    counts = counted(spark, f"{place}/edge_count*")
    begins, chunk = [sum(counts[:i]) for i in range(len(counts))], min(graph.vertex("Customer").count, graphar.CHUNK)
    part = F.regexp_extract("_metadata.file_path", "chunk([0-9]+)$", 1).cast("int")
    read = spark.read.parquet(f"{place}/offset/chunk*").select(F.col("_graphArOffset").alias("own"), part.alias("part"), F.col("_metadata.row_index").alias("at"))
    kept = read.filter((F.col("at") < chunk) | (F.col("part") == len(counts) - 1))
    return kept.select((F.get(F.lit(begins).cast("array<bigint>"), F.col("part")) + F.col("own")).alias("starts"))


@query("gar_chunks", _RICH + "SELECT i // 200 AS chunk, count(*) AS n, min(i) AS least, max(i) AS greatest FROM c GROUP BY 1")
def _(spark, sf):
    into, graph = written(spark, sf, chunk_size=200)
    rows = chunks(spark, into, graph.vertex("Customer"))
    chunk = F.regexp_extract("_metadata.file_path", "chunk([0-9]+)$", 1).cast("long")
    rows = rows.select(chunk.alias("chunk"), F.col("_graphArVertexIndex").alias("i"))
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"), F.max("i").alias("greatest"))


@query("gar_multi_values", _RICH + "SELECT n.s AS subject, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS sells FROM n LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n.s")
def _(spark, sf):
    into, graph = written(spark, sf)
    return chunks(spark, into, graph.vertex("Nation")).select("subject", F.array_join("sells", ",").alias("sells"))


@query("gar_tagged_values", _RICH + "SELECT s AS subject, lower(n_name) AS value, 'en' AS lang FROM n")
def _(spark, sf):
    into, graph = written(spark, sf)
    tagged = chunks(spark, into, graph.vertex("Nation")).select("subject", F.explode("known").alias("known"))
    return tagged.select("subject", "known.value", "known.lang")


@query("gar_counts", _RICH + "SELECT 'Customer' AS name, count(*) AS n FROM c UNION ALL SELECT 'Nation', count(*) FROM n UNION ALL SELECT 'Order', count(*) FROM o UNION ALL SELECT 'placed_by', count(*) FROM o JOIN c ON o_custkey = c_custkey")
def _(spark, sf):
    into, _ = written(spark, sf)
    held = {name: f"{into}/vertex/{name}/vertex_count" for name in ("Customer", "Nation", "Order")}
    held["placed_by"] = f"{into}/edge/Order_placed_by_Customer/ordered_by_source/edge_count*"  # a file for each part of the sources
    return rows(spark, ((name, sum(counted(spark, path))) for name, path in held.items()), "name string, n long")


_YAML = (
    "type: Nation", "chunk_size: 25", "prefix: vertex/Nation/", "property_groups:", "  - prefix: subject_label_known_sells/", "    file_type: parquet", "    properties:",
    "      - name: subject", "        data_type: string", "        is_primary: true", "      - name: label", "        is_primary: false",
    "        is_nullable: false", "      - name: known", "      - name: sells", "        data_type: langString", "        is_nullable: true", "        cardinality: set", "version: gar/v1",
)


@query("gar_yaml", values(*[(line,) for line in _YAML], names="line"))
def _(spark, sf):
    into, _ = written(spark, sf)
    return spark.read.text(f"{into}/Nation.vertex.yml").select(F.col("value").alias("line")).distinct()


@query(
    "gar_mapping",
    values(("Customer", "class", BASE + "voc#Customer"), ("Nation", "class", BASE + "voc#Nation"), ("Order", "class", BASE + "voc#Order"), ("Nation_sells", "predicate", BASE + "voc#sells"), ("Order_placed_by_Customer", "predicate", BASE + "voc#placed_by"), names="map, what, iri"),
)
def _(spark, sf):
    """What the written mapping says of types, of a set and of an edge."""
    into, _ = written(spark, sf)
    triples = rdf.read_triples(spark, f"{into}/mapping.ttl")
    maps = triples.filter(F.col("p").endswith("#subjectMap") | F.col("p").endswith("/subjectMap")).select(F.regexp_extract("s", "#(.*)$", 1).alias("map"), "s", F.col("o").alias("node"))
    named = triples.filter(F.col("p").endswith("/class")).select(F.col("s").alias("node"), F.col("o").alias("iri"))
    classes = maps.join(named, "node").select("map", F.lit("class").alias("what"), "iri")
    lists = maps.filter(F.col("map").isin("Nation_sells", "Order_placed_by_Customer")).select("map", F.col("s").alias("owner"))
    objects = triples.filter(F.col("p").endswith("/predicateObjectMap")).select(F.col("s").alias("owner"), F.col("o").alias("po"))
    predicates = triples.filter(F.col("p").endswith("/predicate")).select(F.col("s").alias("po"), F.col("o").alias("iri"))
    return classes.union(lists.join(objects, "owner").join(predicates, "po").select("map", F.lit("predicate"), "iri"))


@query("run_report", _RICH + "SELECT 'Order_placed_by_Customer' AS edge, count(*) AS rows FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)")
def _(spark, sf):
    return rows(spark, ((d["edge"], d["rows"]) for d in shop(spark, sf)["dropped"]), "edge string, rows long")


_FILES = [
    "graph.graph.yml", "mapping.ttl", "Customer.vertex.yml", "Nation.vertex.yml", "Order.vertex.yml", "Customer_nation_Nation.edge.yml", "Order_placed_by_Customer.edge.yml",
    *[f"vertex/{t}/{f}" for t, g in (("Customer", "subject_name_segment_balance"), ("Nation", "subject_label_known_sells"), ("Order", "subject_total_day")) for f in ("vertex_count", f"{g}/chunk0")],
    *[f"edge/{e}/ordered_by_source/{f}" for e in ("Customer_nation_Nation", "Order_placed_by_Customer") for f in ("vertex_count", "edge_count0", "offset/chunk0", "adj_list/part0/chunk0")],
]


@query("run_files", values(*[(f, True) for f in _FILES], names="path, filled"))
def _(spark, sf):
    """The files of a graph in memory, of the first rows of each source."""
    files = shop(spark, sf, form="files", limit=30)["files"]
    return rows(spark, ((path, len(data) > 0) for path, data in files.items()), "path string, filled boolean")


@query("run_limit", "SELECT 'Nation' AS label, 7::BIGINT AS n UNION ALL SELECT 'Customer', count(*) FROM (SELECT * FROM customer LIMIT 7) WHERE c_acctbal > 0 UNION ALL SELECT 'Order', 7")
def _(spark, sf):
    return rows(spark, ((v.label, v.count) for v in shop(spark, sf, limit=7)["graph"].vertices), "label string, n long")


@query(
    "nt_file",
    _RICH
    + f"""SELECT '<' || s || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{BASE}voc#Land> .' AS value FROM n
    UNION SELECT '<' || s || '> <{BASE}voc#label> "' || n_name || '" .' FROM n
    UNION SELECT '<' || s || '> <{BASE}voc#known> "' || lower(n_name) || '"@en-gb .' FROM n
    UNION SELECT '<' || n.s || '> <{BASE}voc#beside> <' || m.s || '> .' FROM n JOIN nation x USING (n_nationkey) JOIN nation y ON x.n_regionkey = y.n_regionkey JOIN n m ON m.n_nationkey = y.n_nationkey""",
)
def _(spark, sf):
    """A program whose triples are written and read again."""
    text = f"""
@iri("{BASE}voc#Land")
type Land
    @iri("{BASE}voc#label")  label: String
    @iri("{BASE}voc#known")  known: Seq<String<Lang>>
    @iri("{BASE}voc#beside") beside: Seq<Ref<Land>>
N := io.parquet("nation.parquet")
Lands : Land from N.join(N as Other, on = N.n_regionkey == Other.n_regionkey)
    @subject = "{BASE}nation/{{N.n_nationkey}}"
    label    = N.n_name
    known    = N.n_name.lower().lang("en-GB")
    beside   = Land(Other.n_nationkey)
"""
    into = fresh_path(spark, "triples")
    run(spark, text, into, form="ntriples", frames=frames(spark, sf))
    return spark.read.text(f"{into}/graph.nt")


@query(
    "nt_lexical",
    "SELECT o_orderkey AS k, '\"' || o_custkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS i, '\"' || (o_custkey > 100) || '\"^^<http://www.w3.org/2001/XMLSchema#boolean>' AS b, "
    "'\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"^^<http://www.w3.org/2001/XMLSchema#date>' AS d, '\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '\"^^<http://www.w3.org/2001/XMLSchema#dateTime>' AS t, "
    "'\"' || year(o_orderdate) || '\"^^<http://www.w3.org/2001/XMLSchema#gYear>' AS y, '<https://shop.example/' || o_orderkey || '>' AS u, '\"a\\\"b' || o_orderkey || '\\n\"' AS s FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders")

    def shown(ty: str, c, name: str):
        return ntriples.term(G.Property(name, ty, BASE + name, True), c).alias(name)

    at = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        F.col("o_orderkey").alias("k"), shown(types.INTEGER, F.col("o_custkey"), "i"), shown(types.BOOL, F.col("o_custkey") > 100, "b"), shown(types.DATE, at.cast("date"), "d"),
        shown(types.DATETIME, at, "t"), shown(types.YEAR, F.year(at), "y"), shown(types.URI, F.concat(F.lit(BASE), F.col("o_orderkey").cast("string")), "u"),
        shown(types.STRING, F.concat(F.lit('a"b'), F.col("o_orderkey").cast("string"), F.lit("\n")), "s"),
    )


# Vertices and edges


@query("vertex_lineage", values(("Customer", "customer.parquet"), ("Nation", "customer.parquet,nation.parquet"), ("Order", "orders.parquet"), names="label, sources"))
def _(spark, sf):
    return rows(spark, ((v.label, ",".join(v.sources)) for v in shop(spark, sf)["graph"].vertices), "label string, sources string")


@query(
    "vertex_typed",
    values(("Customer", "name", "String", True), ("Customer", "segment", "String", True), ("Customer", "balance", "Float", True), ("Nation", "label", "String", True), ("Nation", "sells", "String", False), ("Nation", "known", "String<Lang>", False), ("Order", "total", "Float", True), ("Order", "day", "Time<Date>", True), names="label, property, type, single"),
)
def _(spark, sf):
    found = ((v.label, p.name, p.item, p.single) for v in shop(spark, sf)["graph"].vertices for p in v.properties)
    return rows(spark, found, "label string, property string, type string, single boolean")


@query("vertex_label_groups", "SELECT 'Party' AS label, (SELECT count(DISTINCT c_nationkey) FROM customer) + (SELECT count(*) FROM region) AS n")
def _(spark, sf):
    """Two mappings, one of them of an imported type under another name, are one type by the local name of its class."""
    text = f"""
type {{ Party as Side }} := io.shex("shapes.shex")
C := io.parquet("customer.parquet")
R := io.parquet("renamed.parquet")
Cs : Side from C.select(C.c_nationkey).distinct()
    @subject = "{BASE}party/n{{C.c_nationkey}}"
    name     = "nation {{C.c_nationkey}}"
Rs : Side from R.distinct()
    @subject = "{BASE}party/n{{R.c_nationkey}}"
    name     = "region {{R.c_nationkey}}"
"""
    renamed = table(spark, sf, "region").select((F.col("r_regionkey") + 1000).alias("c_nationkey"))
    program = compiled(spark, sf, text, "PREFIX s: <https://shop.example/voc#>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\ns:Party { s:name xsd:string }", **{"renamed.parquet": renamed})
    return rows(spark, ((v.label, v.count) for v in build(program).vertices), "label string, n long")


TWO_ENDS = f"""
type {{ Customer, Supplier, Deal }} := io.shex("shapes.shex")
C := io.parquet("customer.parquet")
S := io.parquet("supplier.parquet")
Cs : Customer from C
    @subject = "{BASE}party/{{C.c_name}}"
    name     = C.c_name
Ss : Supplier from S
    @subject = "{BASE}party/{{S.s_name}}"
    name     = S.s_name
Bought : Deal from C
    @subject = "{BASE}deal/{{C.c_name}}"
    by       = "{BASE}party/{{C.c_name}}"
Sold : Deal from S
    @subject = "{BASE}deal/{{S.s_name}}"
    by       = "{BASE}party/{{S.s_name}}"
"""


@query("edge_union_targets", "SELECT 'Deal_by_Customer' AS edge, count(*) AS n FROM customer UNION ALL SELECT 'Deal_by_Supplier', count(*) FROM supplier")
def _(spark, sf):
    """A property that refers to either of two types is an edge type for each."""
    shapes_ = "PREFIX s: <https://shop.example/voc#>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\ns:Customer { s:name xsd:string }\ns:Supplier { s:name xsd:string }\ns:Deal { s:by @s:Customer OR @s:Supplier }"
    text = TWO_ENDS.replace("{C.c_name}", "{C.name}").replace("{S.s_name}", "{S.name}").replace("= C.c_name", "= C.name").replace("= S.s_name", "= S.name")
    more = {"customer.parquet": table(spark, sf, "customer").select(F.col("c_name").alias("name")), "supplier.parquet": table(spark, sf, "supplier").select(F.col("s_name").alias("name"))}
    return rows(spark, ((e.name, e.rows.count()) for e in build(compiled(spark, sf, text, shapes_, **more)).edges), "edge string, n long")


_MEMBERS = "PREFIX s: <https://shop.example/voc#>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\ns:Region { s:name xsd:string ; s:holds @s:Nation * }\ns:Nation { s:label xsd:string }"
MEMBERS = f"""
type {{ Region, Nation }} := io.shex("shapes.shex")
R := io.parquet("listed.parquet")
N := io.parquet("nation.parquet")
Nations : Nation from N
    @subject = "{BASE}nation/{{N.n_nationkey}}"
    label    = N.n_name
Regions : Region from R
    @subject = "{BASE}region/{{R.r_regionkey}}"
    name     = R.r_name
    holds    = R.iris.split(" ")
"""


def _ended(graph: G.Graph, name: str) -> DataFrame:
    """The subjects of both ends of an edge table."""
    e = graph.edge(name)
    a = graph.vertex(e.source).rows.select(F.col("dense_id").alias("src"), F.col("subject").alias("source"))
    b = graph.vertex(e.target).rows.select(F.col("dense_id").alias("dst"), F.col("subject").alias("target"))
    return e.rows.join(a, "src").join(b, "dst").select("source", "target")


@query("edge_multi_target", f"SELECT '{BASE}region/' || n_regionkey AS source, '{BASE}nation/' || n_nationkey AS target FROM nation")
def _(spark, sf):
    """A list of identities is an edge for each; one of them finds no vertex."""
    iri = F.concat(F.lit(BASE + "nation/"), F.col("n_nationkey").cast("string"))
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.sort_array(F.collect_list(iri)), " ").alias("iris"))
    listed = table(spark, sf, "region").join(n, "r_regionkey").withColumn("iris", F.concat("iris", F.lit(f" {BASE}nation/none")))
    return _ended(build(compiled(spark, sf, MEMBERS, _MEMBERS, **{"listed.parquet": listed})), "Region_holds_Nation")


@query("edge_call", f"SELECT '{BASE}order/' || o_orderkey AS source, '{BASE}customer/' || o_custkey AS target FROM orders")
def _(spark, sf):
    """The identities that an edge's call fills in, before they are resolved."""
    program = compiled(spark, sf, SHOP, SHOP_SHAPES)
    m = next(m for m in program.mappings if m.name == "Orders")
    scope = program.relations[m.relation]
    ((_, _, identity),) = m.edges
    return scope.df.select(X.render(m.identity, scope).alias("source"), X.render(identity, scope).alias("target"))


def _table(spark, df, key: str, label: str, name: str) -> G.VertexTable:
    """A vertex table of the rows of one frame, by its key."""
    shape = Shape(f"{BASE}voc#{label}", ())
    part = G.VertexPart(df, F.concat(F.lit(f"{BASE}{name}/"), F.col(key).cast("string")), {})
    return G.build_vertices(shape, [part], 0)


def _identity(name: str, column: str):
    return F.concat(F.lit(f"{BASE}{name}/"), F.col(column).cast("string"))


@query(
    "edge_merge_mappings",
    f"SELECT DISTINCT '{BASE}order/' || l_orderkey AS source, '{BASE}supplier/' || l_suppkey AS target FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_suppkey IN (SELECT s_suppkey FROM supplier)",
)
def _(spark, sf):
    """Two mappings of one edge, with pairs that repeat within and across them, are a set."""
    lines = table(spark, sf, "lineitem")
    a, b = _table(spark, table(spark, sf, "orders"), "o_orderkey", "Order", "order"), _table(spark, table(spark, sf, "supplier"), "s_suppkey", "Supplier", "supplier")
    parts = [G.EdgePart(some, _identity("order", "l_orderkey"), _identity("supplier", "l_suppkey")) for some in (lines.filter("l_linenumber <= 4"), lines.filter("l_linenumber >= 3"))]
    e = G.build_edges("by", BASE + "by", False, parts, a, b)
    return _ended(G.Graph([a, b], [e]), e.name)


@query(
    "edge_dangling_dropped",
    "SELECT count(*) AS read, count(*) FILTER (WHERE s_suppkey IS NOT NULL) AS resolved, count(*) FILTER (WHERE s_suppkey IS NULL) AS dropped FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
)
def _(spark, sf):
    """Customers that refer to the supplier of their own number: those that there is none of are counted."""
    c = table(spark, sf, "customer")
    a, b = _table(spark, c, "c_custkey", "Customer", "customer"), _table(spark, table(spark, sf, "supplier"), "s_suppkey", "Supplier", "supplier")
    e = G.build_edges("like", BASE + "like", True, [G.EdgePart(c, _identity("customer", "c_custkey"), _identity("supplier", "c_custkey"))], a, b)
    return e.rows.agg((F.count(F.lit(1)) + e.dropped).alias("read"), F.count(F.lit(1)).alias("resolved"), F.lit(e.dropped).cast("long").alias("dropped"))


@query(
    "edge_single_valued",
    "SELECT 'order to customer' AS edge, CASE WHEN max(n) > 1 THEN 'write/too-many-values' ELSE 'accepted' END AS result FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderkey) "
    "UNION ALL SELECT 'customer to order', CASE WHEN max(n) > 1 THEN 'write/too-many-values' ELSE 'accepted' END FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey)",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    o, c = _table(spark, orders, "o_orderkey", "Order", "order"), _table(spark, table(spark, sf, "customer"), "c_custkey", "Customer", "customer")
    ends = {"order": (o, _identity("order", "o_orderkey")), "customer": (c, _identity("customer", "o_custkey"))}
    found = []
    for a, b in (("order", "customer"), ("customer", "order")):
        told = _code(lambda a=a, b=b: G.build_edges("to", BASE + "to", True, [G.EdgePart(orders, ends[a][1], ends[b][1])], ends[a][0], ends[b][0]))
        found.append((f"{a} to {b}", told))
    return rows(spark, found, "edge string, result string")


# Sources


def _lines(spark: SparkSession, df: DataFrame, name: str, header: str, columns: list) -> str:
    """Text files of a header and a line per row, each column as it is given; where they are.

    A task writes its rows as they come and a header before the first of them;
    a file of the header alone is there for a table without rows.
    """
    path = fresh_path(spark, name, ".csv")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.concat_ws("|", *columns)
    body = df.select(F.when(within == 0, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value"))
    spark.createDataFrame([(header,)], "value string").coalesce(1).union(body).write.text(path)
    return path


@query("src_csv_leading_zero", "SELECT lpad(s_suppkey::VARCHAR, 9, '0') AS code, s_suppkey AS n FROM supplier")
def _(spark, sf):
    """A column in which some value begins with a zero is text."""
    code = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    return tables.read_csv(spark, _lines(spark, table(spark, sf, "supplier"), "zeros", "code|n", [code, F.col("s_suppkey")]), "|")


@query('src_csv_headers', 'SELECT n_nationkey::BIGINT AS a, n_name AS a_1, n_regionkey::BIGINT AS a_1_1, n_name AS b, n_nationkey::BIGINT AS "A_2" FROM nation')
def _(spark, sf):
    """Headers that repeat, whatever their case."""
    n = table(spark, sf, "nation")
    path = _lines(spark, n, "headers", "a|a|a_1|b|A", [F.col(c) for c in ("n_nationkey", "n_name", "n_regionkey", "n_name", "n_nationkey")])
    return tables.read_csv(spark, path, "|")


@query("src_csv_line_breaks", "SELECT n_nationkey::BIGINT AS k, 'say \"' || n_name || '\"' || chr(10) || '| and' AS text FROM nation")
def _(spark, sf):
    """Quoted fields with doubled quotes, delimiters and line breaks."""
    text = F.concat(F.lit('"say ""'), F.col("n_name"), F.lit('""\n| and"'))
    return tables.read_csv(spark, _lines(spark, table(spark, sf, "nation"), "breaks", "k|text", [F.col("n_nationkey"), text]), "|")


@query("src_csv_types", "SELECT o_orderkey AS i, o_orderkey / 4.0 AS f, o_orderkey > 50 AS b, o_orderdate::DATE AS d, o_orderdate AS t, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s FROM orders")
def _(spark, sf):
    """The type of each column, from all of its values."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    columns = [F.col("o_orderkey"), F.col("o_orderkey") / 4, F.when(F.col("o_orderkey") > 50, "TRUE").otherwise("false"), F.substring(at, 1, 10), at, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")]
    return tables.read_csv(spark, _lines(spark, table(spark, sf, "orders"), "types", "i|f|b|d|t|s", [c.cast("string") for c in columns]), "|")


@query("src_csv_multi", "SELECT n_nationkey::DOUBLE AS key, n_name AS name, NULL::BIGINT AS region FROM nation UNION ALL SELECT r_regionkey + 0.5, NULL, r_regionkey::BIGINT FROM region")
def _(spark, sf):
    """Files under one place with headers of their own, merged by name; types are those that hold for all."""
    folder = fresh_path(spark, "several")
    table(spark, sf, "nation").selectExpr("n_nationkey AS key", "n_name AS name").coalesce(1).write.option("header", True).csv(f"{folder}/a")
    table(spark, sf, "region").selectExpr("r_regionkey AS region", "r_regionkey + 0.5D AS key").coalesce(1).write.option("header", True).csv(f"{folder}/b")
    return tables.read_csv(spark, f"{folder}/*")


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """Rows sorted by a key over all partitions, so over the names of the files that they are written to; a task sorts its range."""
    return df.repartitionByRange(partitions(df.sparkSession), key).sortWithinPartitions(key)


@query("src_limit_files", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def _(spark, sf):
    """The first rows over several files in their order, however Spark packs them: the first file holds one row."""
    folder, o = fresh_path(spark, "files"), table(spark, sf, "orders").select("o_orderkey")
    cut = o.agg(F.min("o_orderkey").alias("a"), F.percentile_approx("o_orderkey", 0.05).alias("b")).first()
    for i, some in enumerate((o.filter(F.col("o_orderkey") <= cut.a), o.filter((F.col("o_orderkey") > cut.a) & (F.col("o_orderkey") <= cut.b)), o.filter(F.col("o_orderkey") > cut.b))):
        _in_order(some, "o_orderkey").write.parquet(f"{folder}/p{i}")
    return tables.first_rows(tables.read_parquet(spark, f"{folder}/p*"), 1000)


@query("src_json_array", "SELECT n_name, n_nationkey::BIGINT AS n_nationkey, '2024-01-01' AS day FROM nation")
def _(spark, sf):
    """One array of objects over several lines; dates in it stay text."""
    path = fresh_path(spark, "array", ".json")
    one = F.to_json(F.struct(F.lit("2024-01-01").alias("day"), "n_name", "n_nationkey"))
    table(spark, sf, "nation").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return Relation.source(tables.read_json(spark, path), "J").select(cols("J.n_name", "J.n_nationkey", "J.day")).named()


_LAND = Shape(BASE + "Land", (Constraint("name", BASE + "name"), Constraint("size", BASE + "size"), Constraint("held", BASE + "held"), Constraint("near", BASE + "near", least=0, most=None)))


def _turtle(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "lands", ".ttl")
    n = table(spark, sf, "nation")
    near = F.concat(F.lit(f"<{BASE}r"), F.col("n_regionkey").cast("string"), F.lit(f">, <{BASE}all>"))
    body = F.concat(
        F.lit(f"<{BASE}n"), F.col("n_nationkey").cast("string"), F.lit(f'> a v:Land ;\n  v:name "'), F.col("n_name"), F.lit('"@en ;\n  v:size '), (F.col("n_nationkey") * 2.5).cast("string"),
        F.lit(" ; v:held true ; v:near "), near, F.lit(" ."),
    )
    text = F.concat(F.lit(f"@prefix v: <{BASE}> .\n"), F.array_join(F.collect_list(body), "\n"))
    n.agg(text.alias("value")).coalesce(1).write.text(path)
    return path


@query("src_rdf_turtle", f"SELECT '{BASE}n' || n_nationkey AS subject, n_name AS name, (n_nationkey * 2.5::DOUBLE)::VARCHAR AS size, 'true' AS held, '{BASE}all,{BASE}r' || n_regionkey AS near FROM nation")
def _(spark, sf):
    """Turtle: lexical forms without tags and datatypes, IRIs as text, lists sorted."""
    pivoted = rdf.pivot(rdf.read_triples(spark, _turtle(spark, sf)), _LAND)
    return pivoted.withColumn("near", F.array_join("near", ","))


@query("src_rdf_pruned", f"SELECT '{BASE}n' || n_nationkey AS subject, n_name AS name FROM nation")
def _(spark, sf):
    """Of an RDF source only what the program reads is built."""
    document = f"PREFIX v: <{BASE}>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\nv:Land {{ v:name xsd:string ; v:size xsd:double ? ; v:near . * }}"
    text = '\ntype { Land } := io.shex("shapes.shex")\n{ Land } := io.rdf("%s")\nLands : Land from Land\n    @subject = Land.subject\n    name     = Land.name\n' % _turtle(spark, sf)
    program = compiled(spark, sf, text, document)
    return program.relations[program.mappings[0].relation].named()


@query("src_frames", "SELECT r_name AS name FROM region")
def _(spark, sf):
    """A table that the host hands over stands in for a file."""
    reader = Reader(spark, frames={"hosted.parquet": table(spark, sf, "region").filter("r_regionkey >= 0")})
    host = reader.host()
    host.document = lambda uri: ""
    program = compile_program(f'\n@iri("{BASE}T")\ntype T\n    @iri("{BASE}name") name: String\nR := io.parquet("hosted.parquet")\nTs : T from R\n    @subject = "{BASE}{{R.r_regionkey}}"\n    name = R.r_name\n', host)
    return build(program).vertex("T").rows.select("name")


_PLACES = [("a.csv", "/data/a.csv"), ("sub/a.csv", "/data/sub/a.csv"), ("/x/a.csv", "/x/a.csv"), ("s3a://b/a.csv", "s3a://b/a.csv"), ("@lake/x/a.csv", "s3a://lake/root/x/a.csv"), ("@none/a.csv", "source/not-found")]


@query("src_location", values(*_PLACES, names="uri, place"))
def _(spark, sf):
    def told(uri: str) -> str:
        try:
            return resolve(uri, "/data/", {"lake": "s3a://lake/root/"})
        except Refusal as e:
            return e.code

    return rows(spark, ((uri, told(uri)) for uri, _ in _PLACES), "uri string, place string")


# Shapes and types

_SHEX = """
PREFIX s: <https://shop.example/voc#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
s:Zed { s:name xsd:string ; s:age xsd:integer ? ; s:tag xsd:string + ; s:few xsd:date {2,3} ; s:said [ @en @de ] * ; s:page IRI ; s:knows @s:Zed OR @s:Ann * }
s:Ann { s:name xsd:string }
"""
_SHEX_ROWS = [
    ("Ann", "name", 1, 1, "String"), ("Zed", "name", 1, 1, "String"), ("Zed", "age", 0, 1, "Integer"), ("Zed", "tag", 1, None, "String"), ("Zed", "few", 2, 3, "Time<Date>"),
    ("Zed", "said", 0, None, "String<Lang>"), ("Zed", "page", 1, 1, "Uri"), ("Zed", "knows", 0, None, "Ref<Ann or Zed>"),
]
_SHACL = """
@prefix sh: <http://www.w3.org/ns/shacl#> .
@prefix s: <https://shop.example/voc#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
s:A a sh:NodeShape ; sh:targetClass s:Zed ;
  sh:property [ sh:path s:age ; sh:datatype xsd:integer ; sh:maxCount 1 ; sh:order 2 ] ;
  sh:property [ sh:path s:name ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ; sh:order 1 ] ;
  sh:property [ sh:path s:said ; sh:languageIn ( "en" "de" ) ; sh:order 3 ] ;
  sh:property [ sh:path s:page ; sh:nodeKind sh:IRI ; sh:maxCount 1 ; sh:order 4 ] ;
  sh:property [ sh:path s:knows ; sh:or ( [ sh:class s:Ann ] [ sh:node s:A ] ) ; sh:order 5 ] .
s:B a sh:NodeShape ; sh:targetClass s:Ann ; sh:property [ sh:path s:name ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] .
"""
_SHACL_ROWS = [
    ("Ann", "name", 1, 1, "String"), ("Zed", "name", 1, 1, "String"), ("Zed", "age", 0, 1, "Integer"), ("Zed", "said", 0, None, "String<Lang>"), ("Zed", "page", 0, 1, "Uri"),
    ("Zed", "knows", 0, None, "Ref<Ann or Zed>"),
]
_SHAPE = "place long, shape string, property string, least long, most long, type string"


def _shape_rows(found: list[Shape]) -> list[tuple]:
    return [(s.label, c.name, c.least, c.most, types.spelled(c.type)) for s in found for c in s.constraints]


def _placed(found: list[tuple]) -> list[tuple]:
    return [(i, *row) for i, row in enumerate(found)]


@query("src_shex", values(*_placed(_SHEX_ROWS), names="place, shape, property, least, most, type"))
def _(spark, sf):
    """Cardinalities, datatypes, languages and references; shapes in order of their IRIs."""
    return rows(spark, _placed(_shape_rows(shapes.read_shex(_SHEX))), _SHAPE)


@query("src_shacl", values(*_placed(_SHACL_ROWS), names="place, shape, property, least, most, type"))
def _(spark, sf):
    return rows(spark, _placed(_shape_rows(shapes.read_shacl(_SHACL))), _SHAPE)


_DECLARED = f"""
@iri("{BASE}T")
@annotation("http://www.w3.org/2000/01/rdf-schema#label", "a type"@en)
type T
    @iri("{BASE}a") a: String
    @iri("{BASE}b") b: Option<Integer>
    @iri("{BASE}c") c: Seq<Time<Date>, 1, 4>
    @iri("{BASE}d") d: Seq<Ref<T>>
    @iri("{BASE}e") e: Option<Ref<T>>
"""


@query("types_declared", values(*_placed([("T", "a", 1, 1, "String"), ("T", "b", 0, 1, "Integer"), ("T", "c", 1, 4, "Time<Date>"), ("T", "d", 0, None, "Ref<T>"), ("T", "e", 0, 1, "Ref<T>")]), names="place, shape, property, least, most, type"))
def _(spark, sf):
    return rows(spark, _placed(_shape_rows(list(compiled(spark, sf, _DECLARED, "").shapes.values()))), _SHAPE)


@query("types_imported", values(("Person", "Zed"), ("Ann", "Ann"), names="name, label"))
def _(spark, sf):
    """Types under names of the program's own."""
    program = compiled(spark, sf, '\ntype { Zed as Person, Ann } := io.shex("shapes.shex")\n', _SHEX)
    return rows(spark, ((name, s.label) for name, s in program.shapes.items()), "name string, label string")


# Expressions


@query(
    "expr_precedence",
    "SELECT l_orderkey AS k, -l_linenumber + 2 * l_linenumber % 5 - 1 AS a, (NOT (l_linenumber > 3) AND l_quantity > 20.0) OR l_quantity < 2.0 AS b, -(l_linenumber + 2) * 3 AS c FROM lineitem",
)
def _(spark, sf):
    r = relation(spark, sf, "lineitem", "L")
    return outs(r, k="L.l_orderkey", a="-L.l_linenumber + 2 * L.l_linenumber % 5 - 1", b="not (L.l_linenumber > 3) and L.l_quantity > 20.0 or L.l_quantity < 2.0", c="-(L.l_linenumber + 2) * 3")


@query("expr_lang_literal", "SELECT r_regionkey AS k, 'water' AS value, 'en-GB' AS tag FROM region")
def _(spark, sf):
    made = outs(relation(spark, sf, "region", "R"), k="R.r_regionkey", t='"water"@en-GB')
    return made.select("k", F.col("t.value").alias("value"), F.col("t.lang").alias("tag"))


@query("expr_assert", "SELECT c_custkey AS k, c_acctbal * 2 AS a FROM customer")
def _(spark, sf):
    """An assertion stands for what it holds."""
    r = relation(spark, sf, "customer", "C")
    held = X.Assert("twice", expression("C.c_acctbal * 2", r))
    assert X.type_of(held, r) == types.FLOAT
    return r.df.select(r.column("C", "c_custkey").alias("k"), X.render(held, r).alias("a"))


@query("relation_lineage", values(("customer.parquet",), ("nation.parquet",), ("orders.parquet",), names="source"))
def _(spark, sf):
    """What a relation was derived from, through a filter, two joins and a distinct."""
    r = relation(spark, sf, "orders", "O")
    r = r.where(expression("O.o_orderkey > 1", r)).join(relation(spark, sf, "customer", "C"), X.BinOp("==", *cols("O.o_custkey", "C.c_custkey")))
    r = r.join(relation(spark, sf, "nation", "N"), X.BinOp("==", *cols("C.c_nationkey", "N.n_nationkey"))).distinct()
    return rows(spark, ((s,) for s in r.sources), "source string")


# Refusals


def _code(f) -> str:
    try:
        f()
        return "accepted"
    except Refusal as e:
        return e.code


def _refusals(spark: SparkSession, sf: str, cases) -> DataFrame:
    """(case, code): what is wrong with the shop's program when a piece of it is another."""
    base = place(spark, shapes__shex=SHOP_SHAPES)
    found = []
    for old, new, _ in cases:
        assert old in SHOP, old
        told = check(spark, SHOP.replace(old, new, 1), base=base, frames=frames(spark, sf))
        found.append((new, told[0].code if told else "accepted"))
    return rows(spark, found, "text string, code string")


def _refusal_query(name: str, cases: list[tuple[str, str, str]]) -> None:
    query(name, values(*[(new, code) for _, new, code in cases], names="text, code"))(lambda spark, sf: _refusals(spark, sf, cases))


_refusal_query(
    "refuse_joins",
    [
        ("on = N.n_nationkey == C.c_nationkey", "on = N.n_nationkey < C.c_nationkey", "pipeline/join-not-equality"),
        ("on = N.n_nationkey == C.c_nationkey", "on = N.n_nationkey == C.c_nationkey or N.n_name == C.c_name", "pipeline/join-not-equality"),
        ("on = N.n_nationkey == C.c_nationkey", "on = N.n_nationkey == 3", "pipeline/join-key-not-column"),
        ("on = N.n_nationkey == C.c_nationkey", "on = N.n_nationkey == N.n_regionkey", "pipeline/join-one-side"),
        ("on = N.n_nationkey == C.c_nationkey", "on = N.n_name == C.c_nationkey", "type/incomparable"),
        ("N.join(C, on = N.n_nationkey == C.c_nationkey)", "N.join(N, on = N.n_nationkey == N.n_nationkey)", "pipeline/invalid-stage-argument"),
        ("N.join(C, on = N.n_nationkey == C.c_nationkey)", "N.left_join(C, on = N.n_nationkey == C.c_nationkey)", "pipeline/unknown-verb"),
        ("N.join(C, on = N.n_nationkey == C.c_nationkey)", "N.join(C)", "pipeline/stage-arity"),
    ],
)
_refusal_query(
    "refuse_aggregates",
    [
        ("= C.c_acctbal\n", "= math.sum(C.c_acctbal)\n", "unsupported/expression"),
        ("C.where(C.c_acctbal > 0)", "C.group_by(C.c_nationkey)", "pipeline/stage-arity"),
        ("C.where(C.c_acctbal > 0)", "C.group_by(most = math.max(C.c_acctbal))", "pipeline/stage-arity"),
        ("C.where(C.c_acctbal > 0)", "C.group_by(C.c_nationkey, name = str.trim(C.c_name))", "pipeline/not-an-aggregate"),
        ("C.where(C.c_acctbal > 0)", "C.group_by(C.c_nationkey, most = math.max(C.c_name))", "type/argument-mismatch"),
    ],
)
_refusal_query(
    "refuse_sources",
    [
        ('C := io.parquet("customer.parquet")', 'C := io.csv("gone.csv")', "source/not-found"),
        ('C := io.parquet("customer.parquet")', 'C := io.csv("@nowhere/customer.csv")', "source/not-found"),
        ('C := io.parquet("customer.parquet")', 'C := io.csv("customer.parquet")', "provider/wrong-extension"),
        ('C := io.parquet("customer.parquet")', 'C := io.shex("shapes.shex")', "provider/wrong-capability"),
        ('C := io.parquet("customer.parquet")', 'C := io.xml("customer.xml")', "provider/unknown"),
        ('C := io.parquet("customer.parquet")', 'C := io.parquet("customer.parquet", delimiter = ";")', "provider/foreign-reader-option"),
        ("Rich := C.where", "Rich := Rich.where", "pipeline/cycle"),
        ("Rich := C.where", "Rich := Elsewhere.where", "name/unknown-source"),
    ],
)
_refusal_query(
    "refuse_expressions",
    [
        ("C.where(C.c_acctbal > 0)", "C.where(1 < C.c_acctbal < 9)", "syntax/unexpected-token"),
        ("C.where(C.c_acctbal > 0)", "C.where(C.c_acctbal)", "type/expected-bool"),
        ("C.where(C.c_acctbal > 0)", "C.where(C.c_name > 0)", "type/incomparable"),
        ("C.where(C.c_acctbal > 0)", "C.where(C.balance > 0)", "name/unknown-field"),
        ("= C.c_name", '= C.c_name + "!"', "type/expected-number"),
        ("= C.c_name", '= C.c_acctbal > 0 ? "a" : 1', "type/branch-mismatch"),
        ("= C.c_name", "= str.trim(C.c_name, C.c_name)", "argument/arity"),
        ("= C.c_name", "= C.c_name.shout()", "name/unknown-function"),
        ("= C.c_name", "= str.slice(C.c_name, begin = 1)", "name/unknown-parameter"),
        ("= C.c_name", "= null", "type/property-mismatch"),
    ],
)
_refusal_query(
    "refuse_shapes",
    [
        ("    name     = C.c_name\n", "", "shape/missing-required-property"),
        ("    name     = C.c_name\n", "    title    = C.c_name\n", "name/unknown-property"),
        ("    name     = C.c_name\n", "    name     = C.c_acctbal\n", "type/property-mismatch"),
        ("type { Customer, Nation, Order }", "type { Customer, Nation, Order, Debt }", "shape/not-in-document"),
        ("Customers : Customer from", "Customers : Client from", "name/unknown-shape"),
        ("Nation(C.c_nationkey)", "Nation(C.c_nationkey, C.c_custkey)", "identity/edge-arity"),
        ("Nation(C.c_nationkey)", "Order(C.c_nationkey)", "type/property-mismatch"),
        ('"https://shop.example/nation/{N.n_nationkey}"\n    label    = N.n_name\n    sells', '"https://shop.example/land/{N.n_nationkey}"\n    label    = N.n_name\n    sells', "identity/conflicting"),
    ],
)


_ASSERTED = f"""
@iri("{BASE}T")
type T
    @iri("{BASE}kind") @assert(str.length(kind) >= 3 and kind.starts_with("k")) kind: String
R := io.parquet("region.parquet")
Ts : T from R
    @subject = "{BASE}t/{{R.r_regionkey}}"
    kind     = KIND
"""
_KINDS = [('"kind"', "accepted"), ('"ki"', "shape/assert-failed"), ('"other"', "shape/assert-failed"), ("R.r_name", "accepted")]


@query("refuse_assertions", values(*_KINDS, names="text, code"))
def _(spark, sf):
    """Constants that an assertion of their field does not hold of; what is read from rows is not decided."""
    found = []
    for text, _ in _KINDS:
        told = check(spark, _ASSERTED.replace("KIND", text), frames=frames(spark, sf))
        found.append((text, told[0].code if told else "accepted"))
    return rows(spark, found, "text string, code string")


_DATA = f"""
@iri("{BASE}T")
type T
    @iri("{BASE}a") a: Option<Float>
    @iri("{BASE}u") u: Option<Uri>
    @iri("{BASE}t") t: Option<Time<DateTime>>
    @iri("{BASE}l") l: Seq<String<Lang>>
Row := io.parquet("rows.parquet")
Ts : T from Row
    @subject = "{{Row.s}}"
    a = Row.a
    u = Row.u
    t = Row.t
    l = Row.v.lang(Row.g)
"""
_WRONG = [
    ("fine", "", "accepted"),
    ("not absolute", "s = 'nowhere'", "write/invalid-subject"),
    ("no subject", "s = CAST(NULL AS STRING)", "write/invalid-subject"),
    ("two values", "s = 'https://shop.example/one'", "write/too-many-values"),
    ("no double", "a = 9007199254740993", "write/unrepresentable"),
    ("no IRI", "u = 'a b'", "write/invalid-iri"),
    ("too fine a time", "t = TIMESTAMP_NTZ'2024-01-01 00:00:00.000001'", "write/unrepresentable"),
    ("no tag", "g = 'not a tag'", "write/invalid-language-tag"),
]


@query("refuse_data", values(*[(case, code) for case, _, code in _WRONG], names="text, code"))
def _(spark, sf):
    """What a run refuses once it sees the rows: subjects, values, times and tags."""
    n = table(spark, sf, "nation")
    fine = {"s": f"concat('{BASE}', n_nationkey)", "a": "CAST(n_nationkey AS BIGINT)", "u": f"concat('{BASE}', n_name)", "t": "TIMESTAMP_NTZ'2024-01-01 00:00:00.001'", "v": "n_name", "g": "'en'"}
    found = []
    for case, change, _ in _WRONG:
        name, _, value = change.partition(" = ")
        held = n.selectExpr(*[f"{v} AS {k}" for k, v in (fine | ({name: value} if name else {})).items()])
        into = fresh_path(spark, "refused")
        found.append((case, _code(lambda held=held, into=into: run(spark, _DATA, into, frames={"rows.parquet": held}))))
    return rows(spark, found, "text string, code string")


# Profiles and models


@query("profile_describe", values(*_placed([("o_orderkey", "Integer"), ("o_custkey", "Integer"), ("o_orderstatus", "String"), ("o_totalprice", "Float"), ("o_orderdate", "Time<DateTime>"), ("o_orderpriority", "String")]), names="place, name, type"))
def _(spark, sf):
    return rows(spark, ((i, n, t) for i, (n, t) in enumerate(P.describe(table(spark, sf, "orders")))), "place long, name string, type string")


@query(
    "profile_columns",
    " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(DISTINCT {c}) AS n, count({c}) AS present FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")),
)
def _(spark, sf):
    """Rows, distinct and present values of every column of a wide table."""
    profiled = P.profile({"lineitem": table(spark, sf, "lineitem")}, shown=0).source("lineitem")
    return rows(spark, ((c.name, profiled.rows, c.distinct, c.present) for c in profiled.columns), "name string, rows long, n long, present long")


@query("profile_depth", "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers, 3::BIGINT AS shown FROM (SELECT * FROM orders LIMIT 100)")
def _(spark, sf):
    """A profile of the first rows, with a few of them shown."""
    p = P.profile({"orders": table(spark, sf, "orders")}, depth=100, shown=3).source("orders")
    return rows(spark, [(p.rows, p.column("o_custkey").distinct, len(p.sample))], "rows long, customers long, shown long")


@query("profile_long_values", "SELECT doc_id, CASE WHEN strlen(text) <= 64 THEN text END AS shown FROM documents")
def _(spark, sf):
    """A long value is left out of a profile, never cut."""
    return table(spark, sf, "documents").select("doc_id", P._short(F.col("text")).alias("shown"))


@query("profile_inclusions", values(("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("nation", "n_regionkey", "nation", "n_nationkey"), ("region", "r_regionkey", "nation", "n_nationkey"), names='source, "column", referenced, key'))
def _(spark, sf):
    read = {n: table(spark, sf, n).select(*c) for n, c in (("customer", ["c_custkey", "c_nationkey"]), ("nation", ["n_nationkey", "n_regionkey"]), ("region", ["r_regionkey", "r_name"]))}
    found = P.profile(read, shown=0).inclusions
    own = {(i.source, i.column, i.referenced, i.key) for i in found if i.column != "c_custkey" and i.key != "c_custkey" and (i.source, i.column) != ("nation", "n_nationkey")}
    return rows(spark, sorted(own), "source string, column string, referenced string, key string")


def _modelled(spark: SparkSession, sf: str, choices: dict[str, str] | None = None) -> tuple[M.Model, dict[str, DataFrame]]:
    read = {"nation": table(spark, sf, "nation").select("n_nationkey", "n_name"), "supplier": table(spark, sf, "supplier").select("s_suppkey", "s_name")}
    pairs = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).cast("int").alias("n_nationkey"), F.col("l_suppkey").alias("s_suppkey"))
    read["offers"] = pairs.filter("s_suppkey IS NOT NULL").union(pairs.limit(1))
    held = [P.Inclusion("offers", "n_nationkey", "nation", "n_nationkey"), P.Inclusion("offers", "s_suppkey", "supplier", "s_suppkey")]
    profiled = P.profile(read, shown=0)
    return M.infer(P.Profile(profiled.sources, held), {"key:nation": "n_nationkey", "key:supplier": "s_suppkey"} | (choices or {})), read


@query("model_infer", values(("Nation", "n_name", "String"), ("Nation", "n_nationkey", "Integer"), ("Nation", "s_suppkey", "Supplier"), ("Supplier", "s_name", "String"), ("Supplier", "s_suppkey", "Integer"), names="type, property, target"))
def _(spark, sf):
    """Types by their keys, and a table of two references as a relation across it."""
    return rows(spark, M.spelled(_modelled(spark, sf)[0]), "type string, property string, target string")


@query(
    "model_thing",
    values(("Nation", "n_name", "String"), ("Nation", "n_nationkey", "Integer"), ("Offers", "n_nationkey", "Nation"), ("Offers", "s_suppkey", "Supplier"), ("Supplier", "s_name", "String"), ("Supplier", "s_suppkey", "Integer"), names="type, property, target"),
)
def _(spark, sf):
    """The same table as a type of its own, where that is chosen."""
    return rows(spark, M.spelled(_modelled(spark, sf, {"count:offers": "thing"})[0]), "type string, property string, target string")


@query(
    "model_program",
    "WITH pairs AS (SELECT DISTINCT l_suppkey % 25 AS n, l_suppkey AS s FROM lineitem) "
    "SELECT 'Nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation_s_suppkey_Supplier', count(*) FROM pairs JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = n",
)
def _(spark, sf):
    """The program that an inferred model writes, run over the tables it was inferred from."""
    model, read = _modelled(spark, sf)
    text = M.write(model, {n: f'io.parquet("{n}.parquet")' for n in read}, BASE)
    graph = run(spark, text, frames={f"{n}.parquet": df for n, df in read.items()})["graph"]
    return rows(spark, [(v.label, v.count) for v in graph.vertices] + [(e.name, e.rows.count()) for e in graph.edges], "name string, n long")


@query("profile_extension_check", values(("csv", "a.csv", "accepted"), ("csv", "a.parquet", "provider/wrong-extension"), ("rdf", "a.nt", "accepted"), ("rdf", "a.json", "provider/wrong-extension"), ("json", "folder", "accepted"), names="reader, uri, result"))
def _(spark, sf):
    found = [(r, u, _code(lambda r=r, u=u: check_extension(r, u))) for r, u in (("csv", "a.csv"), ("csv", "a.parquet"), ("rdf", "a.nt"), ("rdf", "a.json"), ("json", "folder"))]
    return rows(spark, found, "reader string, uri string, result string")
