"""A query for each operator and function, over the driver's tables, with the SQL that says the same.

Each goes through the library's own layers: relations with their scopes,
expressions in the language's own text, vertices and edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmap.functions import expr as X
from weftmap.operators import graph as G
from weftmap.operators.relation import Relation
from weftmap.plans import profile as P
from weftmap.plans.compile import compile_program, expression
from weftmap.plans.run import Reader
from weftmap.session import fresh_path
from weftmap.sinks import ntriples
from weftmap.sources import rdf, tables
from weftmap.sources.shapes import Constraint, Shape

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

BASE = "https://shop.example/"


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str, binding: str) -> Relation:
    return Relation.source(table(spark, sf_dir, name), binding, f"{name}.parquet")


def cols(*names: str) -> list[X.ColRef]:
    return [X.ColRef(*n.split(".")) for n in names]


def outs(r: Relation, **texts: str) -> DataFrame:
    """Expressions of the language as columns."""
    return r.df.select([X.render(expression(t, r), r).alias(n) for n, t in texts.items()])


# Relations


@query("src_parquet", "SELECT * FROM region")
def _(spark, sf):
    return relation(spark, sf, "region", "R").named()


@query("src_csv", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    at = fresh_path(spark, "csv")
    table(spark, sf, "customer").write.mode("overwrite").option("header", True).option("sep", "|").csv(at)
    return Relation.source(tables.read_csv(spark, at, "|"), "C").named()


@query("src_json", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def _(spark, sf):
    at = fresh_path(spark, "json")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.mode("overwrite").json(at)
    return Relation.source(tables.read_json(spark, at), "P").select(cols("P.p_partkey", "P.p_name", "P.p_size")).named()


_NATION_SHAPE = Shape(BASE + "Nation", (Constraint("name", BASE + "name"), Constraint("region", BASE + "region"), Constraint("supplier", BASE + "supplier", least=0, most=None)))


@query(
    "src_rdf",
    f"SELECT '{BASE}n' || n_nationkey AS subject, any_value(n_name) AS name, any_value(n_regionkey)::VARCHAR AS region, "
    "string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey",
)
def _(spark, sf):
    n = table(spark, sf, "nation").withColumn("s", F.concat(F.lit(f"<{BASE}n"), "n_nationkey", F.lit(">")))

    def line(s, p, o):
        return F.concat(s, F.lit(f" <{p}> "), o, F.lit(" ."))

    def text(c):
        return F.concat(F.lit('"'), ntriples.escaped(c.cast("string")), F.lit('"'))

    lines = n.select(F.explode(F.array(line(F.col("s"), rdf.RDF + "type", F.lit(f"<{BASE}Nation>")), line(F.col("s"), BASE + "name", text(F.col("n_name"))), line(F.col("s"), BASE + "region", text(F.col("n_regionkey"))))).alias("value"))
    s = table(spark, sf, "supplier")
    lines = lines.union(s.select(line(F.concat(F.lit(f"<{BASE}n"), "s_nationkey", F.lit(">")), BASE + "supplier", text(F.col("s_name")))))
    at = fresh_path(spark, "nations", ".nt")
    lines.write.mode("overwrite").text(at)
    pivoted = rdf.pivot(rdf.read_triples(spark, at), _NATION_SHAPE)
    return pivoted.select("subject", "name", "region", F.array_join("supplier", ",").alias("suppliers"))


@query("op_project", "SELECT o_totalprice, o_orderkey FROM orders")
def _(spark, sf):
    return relation(spark, sf, "orders", "O").select(cols("O.o_totalprice", "O.o_orderkey")).named()


@query("op_extend", "SELECT s_suppkey, s_acctbal, s_acctbal * 2 AS doubled FROM supplier")
def _(spark, sf):
    r = relation(spark, sf, "supplier", "S")
    return r.extend("S", "doubled", expression("S.s_acctbal * 2", r)).select(cols("S.s_suppkey", "S.s_acctbal", "S.doubled")).named()


@query("op_rename", "SELECT r_regionkey AS key, r_name FROM region")
def _(spark, sf):
    return relation(spark, sf, "region", "R").rename("R", "r_regionkey", "key").named()


@query("op_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus <> 'F'")
def _(spark, sf):
    r = relation(spark, sf, "orders", "O")
    r = r.where(expression('O.o_totalprice > 100000.0 and O.o_orderstatus != "F"', r))
    return r.select(cols("O.o_orderkey", "O.o_totalprice")).named()


@query("op_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, sf):
    return relation(spark, sf, "lineitem", "L").select(cols("L.l_returnflag", "L.l_linestatus")).distinct().named()


@query("op_union", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(spark, sf):
    c = relation(spark, sf, "customer", "C").select(cols("C.c_nationkey")).rename("C", "c_nationkey", "nation")
    s = relation(spark, sf, "supplier", "S").select(cols("S.s_nationkey")).rename("S", "s_nationkey", "nation")
    return c.union(s, "Both").named()


@query("op_empty", "SELECT n_name FROM nation")
def _(spark, sf):
    r = relation(spark, sf, "nation", "N").select(cols("N.n_name"))
    return r.union(Relation.empty(r), "Same").named()


@query("op_limit", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders LIMIT 1000")
def _(spark, sf):
    """The first rows as they stand in the file."""
    return tables.first_rows(table(spark, sf, "orders"), 1000).select("o_orderkey", "o_custkey", "o_totalprice")


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    o, c = relation(spark, sf, "orders", "O"), relation(spark, sf, "customer", "C")
    joined = o.join(c, X.BinOp("==", *cols("C.c_custkey", "O.o_custkey")))
    return joined.select(cols("O.o_orderkey", "C.c_name")).named()


@query(
    "join_compound",
    "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey AS other_part FROM lineitem a JOIN lineitem b "
    "ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45.0",
)
def _(spark, sf):
    a = relation(spark, sf, "lineitem", "A")
    on = X.BinOp("and", X.BinOp("==", *cols("A.l_orderkey", "B.l_orderkey")), X.BinOp("==", *cols("A.l_linenumber", "B.l_linenumber")))
    joined = a.where(expression("A.l_quantity > 45.0", a)).join(a.alias("B"), on)
    return joined.rename("B", "l_partkey", "other_part").select(cols("A.l_orderkey", "A.l_linenumber", "B.other_part")).named()


@query(
    "join_chained",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def _(spark, sf):
    r = relation(spark, sf, "orders", "O")
    for name, binding, a, b in (("customer", "C", "O.o_custkey", "C.c_custkey"), ("nation", "N", "C.c_nationkey", "N.n_nationkey"), ("region", "R", "N.n_regionkey", "R.r_regionkey")):
        r = r.join(relation(spark, sf, name, binding), X.BinOp("==", *cols(a, b)))
    return r.select(cols("O.o_orderkey", "C.c_name", "N.n_name", "R.r_name")).named()


@query("join_self_alias", "SELECT a.n_name AS n_name, b.n_name AS beside FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def _(spark, sf):
    a = relation(spark, sf, "nation", "N")
    joined = a.join(a.alias("Other"), X.BinOp("==", *cols("N.n_regionkey", "Other.n_regionkey")))
    return joined.rename("Other", "n_name", "beside").select(cols("N.n_name", "Other.beside")).named()


for _f in ("sum", "avg", "min", "max"):

    @query(f"group_{_f}", f"SELECT l_returnflag, l_linestatus, {_f}(l_quantity) AS q FROM lineitem GROUP BY ALL")
    def _(spark, sf, f=_f):
        r = relation(spark, sf, "lineitem", "L")
        return r.group_by(cols("L.l_returnflag", "L.l_linestatus"), [("q", f"math.{f}", *cols("L.l_quantity"))], "G").named()


@query(
    "group_after_join",
    "SELECT r_name, sum(s_nationkey)::BIGINT AS total, max(s_acctbal) AS most FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
def _(spark, sf):
    r = relation(spark, sf, "supplier", "S")
    r = r.join(relation(spark, sf, "nation", "N"), X.BinOp("==", *cols("S.s_nationkey", "N.n_nationkey")))
    r = r.join(relation(spark, sf, "region", "R"), X.BinOp("==", *cols("R.r_regionkey", "N.n_regionkey")))
    return r.group_by(cols("R.r_name"), [("total", "math.sum", *cols("S.s_nationkey")), ("most", "math.max", *cols("S.s_acctbal"))], "G").named()


# Expressions: name -> (table, binding, columns in the language, SQL)

EXPRESSIONS: dict[str, tuple[str, str, dict[str, str], str]] = {
    "expr_literals": ("region", "R", {"k": "R.r_regionkey", "t": '"a {{b}}"', "i": "3", "f": "0.5", "b": "true"}, "SELECT r_regionkey AS k, 'a {b}' AS t, 3::BIGINT AS i, 0.5::DOUBLE AS f, true AS b FROM region"),
    "expr_arith": (
        "lineitem", "L",
        {"k": "L.l_orderkey", "a": "L.l_orderkey + L.l_linenumber * 2 - 1", "b": "L.l_extendedprice * (1 - L.l_discount)"},
        "SELECT l_orderkey AS k, l_orderkey + l_linenumber * 2 - 1 AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem",
    ),
    "expr_div": (
        "lineitem", "L", {"k": "L.l_orderkey", "a": "L.l_orderkey / 4", "z": "(L.l_linenumber - 2.5) / (L.l_linenumber - L.l_linenumber)"},
        "SELECT l_orderkey AS k, l_orderkey::DOUBLE / 4 AS a, CASE WHEN l_linenumber > 2.5 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END AS z FROM lineitem",
    ),
    "expr_rem": ("orders", "O", {"k": "O.o_orderkey", "a": "(O.o_orderkey - 500) % 7"}, "SELECT o_orderkey AS k, (o_orderkey - 500) % 7 AS a FROM orders"),
    "expr_compare": (
        "part", "P", {"k": "P.p_partkey", "a": "P.p_size < 10", "b": "P.p_size <= 10", "c": "P.p_size == 10", "d": "P.p_size != 10", "e": "P.p_size >= 10", "f": "P.p_size > 10"},
        "SELECT p_partkey AS k, p_size < 10 AS a, p_size <= 10 AS b, p_size = 10 AS c, p_size <> 10 AS d, p_size >= 10 AS e, p_size > 10 AS f FROM part",
    ),
    "expr_bool": (
        "part", "P", {"k": "P.p_partkey", "a": "P.p_size < 10 or P.p_size > 40 and P.p_retailprice > 1000"},
        "SELECT p_partkey AS k, p_size < 10 OR p_size > 40 AND p_retailprice > 1000 AS a FROM part",
    ),
    "expr_not_neg": ("customer", "C", {"k": "C.c_custkey", "a": "-C.c_acctbal", "b": "not (C.c_acctbal > 0)"}, "SELECT c_custkey AS k, -c_acctbal AS a, NOT (c_acctbal > 0) AS b FROM customer"),
    "expr_ternary": (
        "customer", "C", {"k": "C.c_custkey", "a": 'C.c_acctbal > 5000 ? "rich" : C.c_acctbal > 0 ? "some" : "none"'},
        "SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'some' ELSE 'none' END AS a FROM customer",
    ),
    "expr_null": ("orders", "O", {"k": "O.o_orderkey", "a": "O.o_orderpriority == null", "b": "null != O.o_orderstatus"}, "SELECT o_orderkey AS k, o_orderpriority IS NULL AS a, o_orderstatus IS NOT NULL AS b FROM orders"),
    "expr_interpolate": (
        "nation", "N", {"k": "N.n_nationkey", "a": '"https://shop.example/{N.n_regionkey}/{N.n_name.lower()}"'},
        "SELECT n_nationkey AS k, 'https://shop.example/' || n_regionkey || '/' || lower(n_name) AS a FROM nation",
    ),
    "fn_length": ("documents", "D", {"k": "D.doc_id", "a": "D.text.length()"}, "SELECT doc_id AS k, length(text) AS a FROM documents"),
    "fn_slice": ("documents", "D", {"k": "D.doc_id", "a": "str.slice(D.text, start = 12)"}, "SELECT doc_id AS k, substring(text, 12) AS a FROM documents"),
    "fn_contains": ("documents", "D", {"k": "D.doc_id", "a": 'D.text.contains("the")'}, "SELECT doc_id AS k, contains(text, 'the') AS a FROM documents"),
    "fn_starts_with": ("part", "P", {"k": "P.p_partkey", "a": 'P.p_type.starts_with("S")'}, "SELECT p_partkey AS k, starts_with(p_type, 'S') AS a FROM part"),
    "fn_ends_with": ("part", "P", {"k": "P.p_partkey", "a": 'P.p_type.ends_with("L")'}, "SELECT p_partkey AS k, ends_with(p_type, 'L') AS a FROM part"),
    "fn_matches": ("documents", "D", {"k": "D.doc_id", "a": 'D.text.matches("[0-9]+[a-z]")'}, "SELECT doc_id AS k, regexp_matches(text, '[0-9]+[a-z]') AS a FROM documents"),
    "fn_replace": ("documents", "D", {"k": "D.doc_id", "a": 'D.text.replace("th", ".*")'}, "SELECT doc_id AS k, replace(text, 'th', '.*') AS a FROM documents"),
    "fn_trim": ("documents", "D", {"k": "D.doc_id", "a": 'str.trim("  {D.lang}\\t ")'}, "SELECT doc_id AS k, trim('  ' || lang || chr(9) || ' ') AS a FROM documents"),
    "fn_lower": ("documents", "D", {"k": "D.doc_id", "a": "D.text.lower()"}, "SELECT doc_id AS k, lower(text) AS a FROM documents"),
    "fn_upper": ("part", "P", {"k": "P.p_partkey", "a": "P.p_name.upper()"}, "SELECT p_partkey AS k, upper(p_name) AS a FROM part"),
    "fn_slug": (
        "part", "P", {"k": "P.p_partkey", "a": "P.p_type.slug()", "b": 'str.slug(" -{P.p_name} é/ü. ")'},
        r"SELECT p_partkey AS k, trim(regexp_replace(lower(trim(p_type)), '[^\p{L}\p{N}.-]', '-', 'g'), '-') AS a, trim(regexp_replace(lower(trim(' -' || p_name || ' é/ü. ')), '[^\p{L}\p{N}.-]', '-', 'g'), '-') AS b FROM part",
    ),
    "fn_strip_html": (
        "pages", "P", {"k": "P.page_id", "a": "P.html.strip_html()"},
        r"""SELECT page_id AS k, regexp_replace(html, '<(?:>|$|[^\s](?:"[^"]*"|''[^'']*''|[^>"''])*(?:>|$))', '', 'g') AS a FROM pages""",
    ),
    "fn_parse_integer": ("orders", "O", {"k": "O.o_orderkey", "a": 'parse.integer("{O.o_custkey}")'}, "SELECT o_orderkey AS k, o_custkey AS a FROM orders"),
    "fn_parse_float": ("orders", "O", {"k": "O.o_orderkey", "a": 'parse.float("{O.o_custkey}.25")'}, "SELECT o_orderkey AS k, o_custkey + 0.25::DOUBLE AS a FROM orders"),
    "fn_parse_date": (
        "orders", "O", {"k": "O.o_orderkey", "a": 'parse.date(str.slice("{O.o_orderdate}", 1), format = "%Y-%m-%dT%H:%M:%S")'},
        "SELECT o_orderkey AS k, o_orderdate::DATE AS a FROM orders",
    ),
    "fn_parse_datetime": (
        "orders", "O", {"k": "O.o_orderkey", "a": 'parse.datetime("{O.o_orderdate}", "%Y-%m-%dT%H:%M:%S")'},
        "SELECT o_orderkey AS k, o_orderdate AS a FROM orders",
    ),
    "fn_parse_year": ("region", "R", {"k": "R.r_regionkey", "a": 'parse.year("200{R.r_regionkey}")'}, "SELECT r_regionkey AS k, (2000 + r_regionkey)::INTEGER AS a FROM region"),
    "fn_abs": ("customer", "C", {"k": "C.c_custkey", "a": "math.abs(C.c_acctbal)"}, "SELECT c_custkey AS k, abs(c_acctbal) AS a FROM customer"),
    "fn_round": ("customer", "C", {"k": "C.c_custkey", "a": "math.round(C.c_acctbal / 10)"}, "SELECT c_custkey AS k, CAST(round(c_acctbal / 10) AS BIGINT) AS a FROM customer"),
}

for _name, (_table, _binding, _texts, _sql) in EXPRESSIONS.items():

    @query(_name, _sql)
    def _(spark, sf, t=_table, b=_binding, texts=_texts):
        return outs(relation(spark, sf, t, b), **texts)


@query("fn_split", "SELECT doc_id AS k, len(string_split(text, '. ')) AS n, string_split(text, '. ')[1] AS a FROM documents")
def _(spark, sf):
    made = outs(relation(spark, sf, "documents", "D"), k="D.doc_id", parts='D.text.split(". ")')
    return made.select("k", F.size("parts").cast("long").alias("n"), F.element_at("parts", 1).alias("a"))


@query("fn_lang", "SELECT doc_id AS k, source AS value, lang AS tag FROM documents")
def _(spark, sf):
    made = outs(relation(spark, sf, "documents", "D"), k="D.doc_id", t="D.source.lang(D.lang)")
    return made.select("k", F.col("t.value").alias("value"), F.col("t.lang").alias("tag"))


# The graph

SHAPES = """
PREFIX s: <https://shop.example/voc#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
s:Customer { s:name xsd:string ; s:balance xsd:double ? ; s:nation @s:Nation }
s:Nation { s:label xsd:string ; s:segment xsd:string * ; s:beside @s:Nation * }
s:Order { s:total xsd:double ; s:placed_by @s:Customer }
"""

PROGRAM = """
type { Customer, Nation, Order } := io.shex("shapes.shex")
C := io.parquet("customer.parquet")
N := io.parquet("nation.parquet")
O := io.parquet("orders.parquet")
Rich := C.where(C.c_acctbal > 0)

Nations : Nation from N
    @subject = "https://shop.example/nation/{N.n_nationkey}"
    label    = N.n_name

Segments : Nation from N.join(C, on = N.n_nationkey == C.c_nationkey)
    @subject = "https://shop.example/nation/{N.n_nationkey}"
    label    = N.n_name
    segment  = C.c_mktsegment

Customers : Customer from Rich
    @subject = "https://shop.example/customer/{C.c_custkey}"
    name     = C.c_name
    balance  = C.c_acctbal
    nation   = Nation(C.c_nationkey)

Orders : Order from O.join(N, on = O.o_custkey == N.n_nationkey).join(C, on = O.o_custkey == C.c_custkey)
    @subject  = "https://shop.example/order/{O.o_orderkey}"
    total     = O.o_totalprice
    placed_by = Customer(O.o_custkey)
"""


class _Frames(dict):
    """The driver's tables by the names that a program reads them by."""

    def __init__(self, spark, sf):
        super().__init__({f"{n}.parquet": table(spark, sf, n) for n in ("customer", "nation", "orders", "supplier", "documents")})


def _parts(spark: SparkSession, sf: str, label: str):
    """(shape, vertex parts) of one type of the program."""
    host = Reader(spark, frames=_Frames(spark, sf)).host()
    host.document = lambda uri: SHAPES
    program = compile_program(PROGRAM, host)
    shape = next(s for s in program.classes() if s.label == label)
    parts = []
    for m in program.mappings:
        if m.shape.iri == shape.iri:
            scope = program.relations[m.relation]
            parts.append(G.VertexPart(scope.df, X.render(m.identity, scope), {c.name: (G.Property.of(c, got), X.render(e, scope)) for c, e, got in m.properties}, scope.sources))
    return program, shape, parts


def _ids(spark: SparkSession, sf: str, label: str, first: int = 0) -> DataFrame:
    _, _, parts = _parts(spark, sf, label)
    rows, _ = G.merged(parts)
    return G.number(rows.select("subject").distinct(), "subject", first)


def _edges(spark: SparkSession, sf: str, label: str) -> tuple[list[G.EdgePart], object]:
    program, _, _ = _parts(spark, sf, "Customer")
    parts, constraint = [], None
    for m in program.mappings:
        for c, _, identity in m.edges:
            if c.name == label:
                scope = program.relations[m.relation]
                parts.append(G.EdgePart(scope.df, X.render(m.identity, scope), X.render(identity, scope)))
                constraint = c
    return parts, constraint


@query("vertex_merge", "SELECT DISTINCT 'https://shop.example/nation/' || n_nationkey AS subject, n_name AS label, false AS two FROM nation")
def _(spark, sf):
    _, _, parts = _parts(spark, sf, "Nation")
    rows, properties = G.merged(parts)
    collapsed = G.collapse(rows, properties)
    return collapsed.select("subject", F.col("p0").alias("label"), G.conflict_of(properties).alias("two"))


@query(
    "vertex_conflict",
    "SELECT 'https://shop.example/line/' || l_orderkey || '/' || l_linenumber AS subject FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING min(l_quantity) IS DISTINCT FROM max(l_quantity)",
)
def _(spark, sf):
    r = relation(spark, sf, "lineitem", "L")
    subject = X.render(expression('"https://shop.example/line/{L.l_orderkey}/{L.l_linenumber}"', r), r)
    p = G.Property("quantity", "Float", BASE + "quantity", True)
    rows, properties = G.merged([G.VertexPart(r.df, subject, {"quantity": (p, r.column("L", "l_quantity"))})])
    collapsed = G.collapse(rows, properties)
    return collapsed.filter(G.conflict_of(properties)).select("subject")


@query(
    "vertex_union_two_sources",
    "SELECT 'https://shop.example/party/' || n AS subject, max(a) AS customer, max(b) AS supplier FROM (SELECT c_custkey AS n, c_name AS a, NULL AS b FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier) GROUP BY n",
)
def _(spark, sf):
    c, s = relation(spark, sf, "customer", "C"), relation(spark, sf, "supplier", "S")
    a, b = (G.Property(n, "String", BASE + n, True, 0) for n in ("customer", "supplier"))
    parts = [
        G.VertexPart(c.df, X.render(expression('"https://shop.example/party/{C.c_custkey}"', c), c), {"customer": (a, c.column("C", "c_name"))}),
        G.VertexPart(s.df, X.render(expression('"https://shop.example/party/{S.s_suppkey}"', s), s), {"supplier": (b, s.column("S", "s_name"))}),
    ]
    rows, properties = G.merged(parts)
    return G.collapse(rows, properties).select("subject", F.col("p0").alias("customer"), F.col("p1").alias("supplier"))


@query(
    "vertex_multi_value",
    "SELECT DISTINCT 'https://shop.example/nation/' || c_nationkey AS subject, c_mktsegment AS value FROM customer",
)
def _(spark, sf):
    _, _, parts = _parts(spark, sf, "Nation")
    rows, properties = G.merged(parts)
    at = [p.name for p in properties].index("segment")
    return rows.select("subject", F.explode(f"p{at}").alias("value")).filter("value IS NOT NULL").distinct()


@query(
    "vertex_dense_id",
    "SELECT row_number() OVER (ORDER BY s) - 1 + 7 AS dense_id, s AS subject FROM (SELECT 'https://shop.example/customer/' || c_custkey AS s FROM customer WHERE c_acctbal > 0)",
)
def _(spark, sf):
    return _ids(spark, sf, "Customer", 7)


_RESOLVED = """
WITH c AS (SELECT 'https://shop.example/customer/' || c_custkey AS s, row_number() OVER (ORDER BY 'https://shop.example/customer/' || c_custkey) - 1 AS id, c_nationkey FROM customer WHERE c_acctbal > 0),
n AS (SELECT n_nationkey, row_number() OVER (ORDER BY 'https://shop.example/nation/' || n_nationkey) - 1 AS id FROM nation)
"""


@query("edge_resolve", _RESOLVED + "SELECT c.id AS src, n.id AS dst FROM c JOIN n ON c_nationkey = n_nationkey")
def _(spark, sf):
    parts, _ = _edges(spark, sf, "nation")
    _, resolved = G.resolve(parts, _ids(spark, sf, "Customer"), _ids(spark, sf, "Nation"))
    return resolved.distinct()


@query(
    "edge_offsets",
    _RESOLVED + ", e AS (SELECT c.id AS src FROM c JOIN n ON c_nationkey = n_nationkey), v AS (SELECT unnest(range((SELECT count(*) + 1 FROM c))) AS vertex) "
    "SELECT vertex, (SELECT count(*) FROM e WHERE src < vertex) AS \"offset\" FROM v",
)
def _(spark, sf):
    parts, _ = _edges(spark, sf, "nation")
    customers = _ids(spark, sf, "Customer")
    _, resolved = G.resolve(parts, customers, _ids(spark, sf, "Nation"))
    return G.offsets(resolved.distinct(), customers.count())


@query(
    "nt_triples",
    """
    SELECT '<https://shop.example/nation/' || n_nationkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <https://shop.example/voc#Nation> .' AS value FROM nation
    UNION SELECT '<https://shop.example/nation/' || n_nationkey || '> <https://shop.example/voc#label> "' || n_name || '" .' FROM nation
    UNION SELECT '<https://shop.example/nation/' || c_nationkey || '> <https://shop.example/voc#segment> "' || c_mktsegment || '" .' FROM customer
    """,
)
def _(spark, sf):
    _, shape, parts = _parts(spark, sf, "Nation")
    return ntriples.triples(G.Graph([G.build_vertices(shape, parts, 0)]))


# Profiles


@query(
    "profile_counts",
    "SELECT count(*) AS rows, count(DISTINCT n_nationkey) AS distinct_0, count(n_nationkey) AS present_0, min(n_nationkey)::VARCHAR AS low_0, max(n_nationkey)::VARCHAR AS high_0, "
    "count(DISTINCT n_name) AS distinct_1, count(n_name) AS present_1, min(n_name) AS low_1, max(n_name) AS high_1, "
    "count(DISTINCT n_regionkey) AS distinct_2, count(n_regionkey) AS present_2, min(n_regionkey)::VARCHAR AS low_2, max(n_regionkey)::VARCHAR AS high_2 FROM nation",
)
def _(spark, sf):
    return P.counts(table(spark, sf, "nation"))


@query("profile_topk", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type HAVING count(*) >= 2 ORDER BY n DESC, value LIMIT 10")
def _(spark, sf):
    return P.top_values(table(spark, sf, "part"), "p_type")


@query(
    "profile_inclusion",
    "SELECT count(*) AS distinct_values, count(*) FILTER (WHERE s_suppkey IS NULL) AS missing FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN supplier ON s_suppkey = c_custkey",
)
def _(spark, sf):
    return P.inclusion(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "supplier"), "s_suppkey")


@query("profile_sample", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM (SELECT * FROM region LIMIT 3)")
def _(spark, sf):
    return P.sample(table(spark, sf, "region"), 3)


@query("profile_keys", "SELECT 'c_custkey' AS key UNION ALL SELECT 'c_name' FROM (SELECT count(*) AS n, count(DISTINCT c_name) AS d FROM customer) WHERE n = d")
def _(spark, sf):
    found = P.profile({"customer": table(spark, sf, "customer")}, shown=0).source("customer").keys
    return spark.createDataFrame([(k,) for k in found], "key string")


# The flagship


@query(
    "graph_orders",
    "SELECT 'https://shop.example/order/' || o_orderkey AS source, 'https://shop.example/customer/' || c_custkey AS target, c_name AS name, n_name AS nation "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, customers and nations as a graph: each order's edge to the customer who placed it, by identity."""
    o, c = relation(spark, sf, "orders", "O"), relation(spark, sf, "customer", "C")
    c = c.join(relation(spark, sf, "nation", "N"), X.BinOp("==", *cols("C.c_nationkey", "N.n_nationkey")))
    vertices = c.df.select(
        X.render(expression('"https://shop.example/customer/{C.c_custkey}"', c), c).alias("target"),
        c.column("C", "c_name").alias("name"),
        c.column("N", "n_name").alias("nation"),
    )
    edges = o.df.select(
        X.render(expression('"https://shop.example/order/{O.o_orderkey}"', o), o).alias("source"),
        X.render(expression('"https://shop.example/customer/{O.o_custkey}"', o), o).alias("target"),
    )
    return edges.join(vertices, "target").select("source", "target", "name", "nation")


def queries() -> dict[str, Query]:
    from weftmap import graph_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from weftmap import graph_queries  # noqa: F401

    return dict(_SQL)
