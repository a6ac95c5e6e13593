"""Relations, expressions and readers, one case each."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmap import types
from weftmap.errors import Refusal
from weftmap.functions import expr as X
from weftmap.functions.catalogue import FUNCTIONS, date_pattern
from weftmap.operators import algebra as A
from weftmap.operators import graph as G
from weftmap.operators.relation import Relation
from weftmap.plans.compile import expression
from weftmap.plans.run import Reader
from weftmap.sources import rdf, shapes, tables, turtle
from weftmap.sources.location import resolve


def rel(spark, name, rows, schema):
    return Relation.source(spark.createDataFrame(rows, schema), name)


def value(spark, text, schema="x int", row=(1,)):
    r = rel(spark, "R", [row], schema)
    return r.df.select(X.render(expression(text, r), r).alias("v")).first()["v"]


def test_names_count_case_and_may_hold_dots(spark):
    r = rel(spark, "R", [(1, 2, 3)], "`a.b` int, id int, ID int")
    assert [r.df.select(r.column("R", c)).first()[0] for c in ("a.b", "id", "ID")] == [1, 2, 3]
    assert r.select([X.ColRef("R", "ID"), X.ColRef("R", "a.b")]).named().columns == ["ID", "a.b"]
    with pytest.raises(Refusal, match="name/unknown-field"):
        r.type("R", "Id")


def test_where_drops_null(spark):
    r = rel(spark, "R", [(1,), (None,), (5,)], "x int")
    assert [t[0] for t in r.where(expression("R.x > 2", r)).df.collect()] == [5]
    assert r.where(expression("R.x == null", r)).df.count() == 1
    assert r.where(expression("null != R.x", r)).df.count() == 2


def test_compound_key_needs_both(spark):
    lines = rel(spark, "L", [(1, 1, 10), (1, 2, 10), (2, 1, 10), (2, 3, 11)], "tenant int, id int, order_id int")
    orders = rel(spark, "O", [(1, 10, "a"), (2, 10, "b"), (2, 11, "c")], "tenant int, id int, day string")
    on = X.BinOp("and", X.BinOp("==", X.ColRef("L", "order_id"), X.ColRef("O", "id")), X.BinOp("==", X.ColRef("O", "tenant"), X.ColRef("L", "tenant")))
    assert lines.join(orders, on).df.count() == 4
    assert lines.join(orders, on.left).df.count() == 7


def test_join_keeps_both_rows_and_nulls_match_nothing(spark):
    a = rel(spark, "A", [(1, "x"), (None, "y")], "k int, v string")
    b = rel(spark, "B", [(1, "p"), (None, "q")], "k int, v string")
    joined = a.join(b, X.BinOp("==", X.ColRef("A", "k"), X.ColRef("B", "k")))
    assert joined.named().columns == ["A.k", "A.v", "B.k", "B.v"] and joined.df.count() == 1
    with pytest.raises(Refusal, match="unsupported"):
        a.join(b, X.BinOp("==", X.ColRef("A", "k"), X.ColRef("B", "k")), "left")


def test_self_join_of_a_derived_relation(spark):
    r = rel(spark, "N", [(1, None), (2, 1), (3, 1)], "id int, up int")
    some = r.where(expression("N.id > 0", r))
    assert some.join(some.alias("U"), X.BinOp("==", X.ColRef("N", "up"), X.ColRef("U", "id"))).df.count() == 2


def test_union_is_by_position_and_keeps_repeats(spark):
    a, b = rel(spark, "A", [("x", 1)], "n string, k int"), rel(spark, "B", [("x", 1), ("y", 2)], "n string, k int")
    assert sorted(map(tuple, a.union(b, "U").named().collect())) == [("x", 1), ("x", 1), ("y", 2)]
    for schema in ("k int, n string", "n string, k string", "n string"):
        with pytest.raises(Refusal, match="union-mismatch"):
            a.union(rel(spark, "C", [], schema), "U")


def test_group_by_skips_nulls(spark):
    r = rel(spark, "R", [("a", 1.0), ("a", None), ("b", None)], "k string, v double")
    out = {t.k: (t.s, t.m) for t in r.group_by([X.ColRef("R", "k")], [("s", "math.sum", X.ColRef("R", "v")), ("m", "math.avg", X.ColRef("R", "v"))], "G").named().collect()}
    assert out == {"a": (1.0, 1.0), "b": (None, None)}


def test_the_algebra_plans_what_is_needed(spark):
    plan = A.Plan()
    a = plan.add(A.Source("a", "csv", "A"))
    b = plan.add(A.Source("b", "csv", "B"))
    f = plan.add(A.Filter(a, X.Lit(True)))
    j = plan.add(A.Join(f, a, X.Lit(True)))
    assert plan.needed(f) == [a, f] and plan.needed(j) == [a, f, j] and plan.sources(j) == ["a"] and b not in plan.needed(j)
    opened = []

    def read(op):
        opened.append(op.uri)
        return rel(spark, op.binding, [(1,)], "x int")

    assert A.evaluate(plan, f, read).df.count() == 1 and opened == ["a"]
    empty = plan.add(A.Empty(f))
    assert A.evaluate(plan, empty, read).df.count() == 0


EXPRESSIONS = [
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("7 / 2", 3.5), ("-7 % 3", -1), ("2 - 3 - 4", -5), ("-R.x", -1), ("not true or true", True),
    ("true or false and false", True), ("1 == 1 ? 2 : 3", 2), ("false ? 1 : false ? 2 : 3", 3), ('"a{{b}}{R.x}c"', "a{b}1c"), ("1_000", 1000),
    ('" x\\t ".trim()', "x\t"), ('"abc".slice(2)', "bc"), ('str.slice("abc", start = 0)', "abc"), ('"a.b".replace(".", "")', "ab"), ('"A-é".lower()', "a-é"),
    ('"a|b||".split("|")', ["a", "b", "", ""]), ('"ab".split("")', ["a", "b"]), ('" A  b_c! ".slug()', "a--b-c"), ('"<p class=\'x>y\'>t</p> 1 < 2".strip_html()', "t 1 < 2"),
    ('"x1".matches("[0-9]")', True), ('parse.integer("42")', 42), ('parse.float("1e3")', 1000.0), ('parse.year("1999")', 1999), ("math.round(2.5)", 3), ("math.round(-1.5)", -2),
    ("math.abs(-4)", 4), ('parse.date("3 Feb 2024", "%d %b %Y")', "2024-02-03"), ('parse.datetime("2024-02-03 04:05", "%Y-%m-%d %H:%M")', "2024-02-03 04:05:00"), ("1 / 0", float("inf")), ("-1 / 0", float("-inf")),
]


@pytest.mark.parametrize("text, wanted", EXPRESSIONS, ids=[t for t, _ in EXPRESSIONS])
def test_expressions(spark, text, wanted):
    got = value(spark, text)
    assert (str(got) if not isinstance(got, (bool, int, float, str, list)) else got) == wanted


def test_null_goes_through_interpolation(spark):
    assert value(spark, '"a{R.x}"', "x int", (None,)) is None
    assert value(spark, "R.x > 1 ? 1 : 2", "x int", (None,)) == 2


def test_an_unclosed_tag_is_read_once(spark):
    assert value(spark, "R.x.strip_html()", "x string", ("<a " + "y" * 30_000,)) == ""


def test_a_bad_number_is_an_error(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        value(spark, 'parse.integer("{R.x}x")')


def test_every_function_is_listed():
    assert len(FUNCTIONS) == 25 and sum(f.aggregate for f in FUNCTIONS.values()) == 4
    with pytest.raises(Refusal):
        date_pattern("%Q")
    assert date_pattern("%Y'T'%m") == "yyyy'''T'''M"


def test_subtypes():
    assert types.subtypes("Integer", "Float") and not types.subtypes("Float", "Integer")
    assert types.subtypes(types.sequence("Integer"), types.sequence("Float"))
    assert types.subtypes(types.reference(["a"]), types.reference(["a", "b"])) and not types.subtypes(types.reference(["a", "b"]), types.reference(["a"]))
    assert types.comparable("Null", "String") and not types.subtypes("Null", "String")


def test_headers():
    assert tables.unique_headers(["a", "a", "a_1", "b", "a"]) == ["a", "a_1", "a_1_1", "b", "a_2"]
    assert tables.unique_headers(["Id", "ID"]) == ["Id", "ID_1"]


@settings(max_examples=100)
@given(st.lists(st.text("aAb_1", max_size=3), max_size=8))
def test_headers_are_unique(names):
    out = tables.unique_headers(names)
    assert len({n.lower() for n in out}) == len(names)


def test_csv_types_come_from_all_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("zip,n,f,b,d,t,e,mixed,name\n007,1,1,true,2024-01-01,2024-01-01T02:03:04,,1,x\n100,+5,2.5,FALSE,2024-02-30,2024-01-01 02:03,,x,\"a, \"\"b\"\"\"\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    kinds = dict(df.dtypes)
    assert kinds == {"zip": "string", "n": "bigint", "f": "double", "b": "boolean", "d": "string", "t": "timestamp_ntz", "e": "string", "mixed": "string", "name": "string"}
    assert [r.zip for r in df.collect()] == ["007", "100"] and df.collect()[1]["name"] == 'a, "b"'


def test_csv_of_several_files_and_none(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_text(f"a;b\n{i};x\n")
    assert tables.read_csv(spark, str(tmp_path / "p*.csv"), ";").count() == 3
    # another order of columns, a column more, one less: merged by name, with types that hold for all
    (tmp_path / "p7.csv").write_text("b;a\ny;2.5\n")
    (tmp_path / "p 8.csv").write_text("b;more\nz;007\n")
    (tmp_path / "p9.csv").write_text("")
    df = tables.read_csv(spark, str(tmp_path / "p*.csv"), ";")
    assert df.dtypes == [("b", "string"), ("more", "string"), ("a", "double")]
    assert sorted(df.collect(), key=repr) == [("x", None, 0.0), ("x", None, 1.0), ("x", None, 2.0), ("y", None, 2.5), ("z", "007", None)]
    assert tables.read_csv(spark, str(tmp_path / "p*.csv"), ";", limit=3).collect() == [("z", "007", None), ("x", None, 0.0), ("x", None, 1.0)]
    with pytest.raises(Refusal, match="source/not-found"):
        tables.read_csv(spark, str(tmp_path / "gone.csv"))


def test_the_first_rows_are_those_of_the_first_files(spark, tmp_path):
    """Spark reads large files first; a limit takes rows in the order of the files all the same."""
    for name, first, n in (("a", 0, 1), ("b", 1, 500), ("c", 501, 7)):
        rows = range(first, first + n)
        (tmp_path / f"{name}.csv").write_text("n\n" + "".join(f"{i}\n" for i in rows))
        (tmp_path / f"{name}.json").write_text("".join(f'{{"n": {i}}}\n' for i in rows))
        spark.createDataFrame([(i,) for i in rows], "n long").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for n in (2, 300, 504):
        for df in (tables.read_json(spark, str(tmp_path / "*.json")), tables.read_parquet(spark, str(tmp_path / "*.parquet"))):
            assert [r.n for r in tables.first_rows(df, n).collect()] == list(range(n))
        assert [r.n for r in tables.read_csv(spark, str(tmp_path / "*.csv"), limit=n).collect()] == list(range(n))


def test_schemas_of_parquet_files_are_merged(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a long, b string").write.parquet(str(tmp_path / "t" / "p1"))
    spark.createDataFrame([(2, 0.5)], "a long, c double").write.parquet(str(tmp_path / "t" / "p2"))
    assert sorted(tables.read_parquet(spark, str(tmp_path / "t" / "*")).select("a", "b", "c").collect(), key=repr) == [(1, "x", None), (2, None, 0.5)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_fields_with_line_breaks(spark, tmp_path, end):
    import csv
    import io

    rows = [["id", "text", "n"], ["1", "a\nb", "5"], ["2", 'say ""\n"", then "x"', "6"], ["3", "c", "7"], ["4", "d\n\n\n,e", "8"], ["5", '",\n"', "9"]]
    for name, some in (("a", rows), ("b", [["id", "te\nxt"], ["1", "x"]]), ("c", [r for r in rows if "\n" not in r[1]] + [["6", 'p "q", r', "1"]])):
        out = io.StringIO()
        csv.writer(out, lineterminator=end).writerows(some)
        (tmp_path / f"{name}.csv").write_text(out.getvalue(), newline="")
        df = tables.read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == some[0] and [[str(v) for v in r] for r in df.collect()] == some[1:]
        assert dict(df.dtypes)["id"] == "bigint"
    assert [tables._survey(spark, str(tmp_path / f"{name}.csv"), ",")[1] for name in "ac"] == [True, False]
    (tmp_path / "d.csv").write_text(f'a|b{end}x"y|"p{end}q"{end}', newline="")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "d.csv"), "|").collect()] == [('x"y', f"p{end}q")]
    (tmp_path / "e1.csv").write_text('a,b\n1,"p\nq"\n', newline="")
    (tmp_path / "e2.csv").write_text(f"a,b{end}2,x{end}3,y{end}", newline="")
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "e*.csv")).collect())) == [(1, "p\nq"), (2, "x"), (3, "y")]


def test_json_by_line_and_as_an_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":1,"d":"2024-01-01"}\n{"a":2,"d":null}\n')
    (tmp_path / "b.json").write_text('[{"a":1,"d":"2024-01-01"},\n {"a":2,"d":null}]')
    a, b = tables.read_json(spark, str(tmp_path / "a.json")), tables.read_json(spark, str(tmp_path / "b.json"))
    assert a.dtypes == b.dtypes == [("a", "bigint"), ("d", "string")] and a.collect() == b.collect()
    (tmp_path / "c.json").write_text("[]")
    with pytest.raises(Refusal, match="source/unparseable"):
        tables.read_json(spark, str(tmp_path / "c.json"))


TURTLE = """
@prefix ex: <http://x/> .  # a comment
ex:a a ex:T ; ex:name "Ann"@en, 'A\\u00e9' ; ex:n 5, 2.5, 1e3 ; ex:ok true .
<http://x/b> a ex:T ; ex:knows ex:a, [ ex:name \"\"\"long "text\"\"\" ] ; ex:list ( 1 2 ) .
_:c a ex:Other .
"""


def test_turtle():
    triples = turtle.parse(TURTLE)
    assert (("iri", "http://x/a"), "http://x/name", ("literal", "Aé", turtle.XSD + "string", None)) in triples
    assert (("iri", "http://x/a"), "http://x/name", ("literal", "Ann", turtle.RDF + "langString", "en")) in triples
    assert sum(p == turtle.RDF + "first" for _, p, _ in triples) == 2
    with pytest.raises(Refusal, match="document/unparseable"):
        turtle.parse('<http://a> <http://b> "c"@en--ltr .')


def test_rdf_rows(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TURTLE)
    shape = shapes.Shape("http://x/T", (shapes.Constraint("name", "http://x/name"), shapes.Constraint("knows", "http://x/knows", least=0, most=None)))
    rows = rdf.pivot(rdf.read_triples(spark, str(tmp_path / "a.ttl")), shape).collect()
    assert [r.subject for r in rows] == ["http://x/a", "http://x/b"]
    assert rows[0].name == "Ann" and rows[0].knows is None and rows[1].name is None and len(rows[1].knows) == 2
    assert rdf.pivot(rdf.read_triples(spark, str(tmp_path / "a.ttl")), shape, {"name"}).columns == ["subject", "name"]


def test_escapes_of_ntriples_are_those_of_turtle(spark, tmp_path):
    literals = [r"C:\\new", r"C:\\\\new\\", r"caf\u00e9 \U0001F600!", r"\t\b\n\r\f\"\'\\", r"\\u00e9 \\\u00e9", r"\u005Cn", "plain", "", "ü 𝒳"]
    lines = [f'<http://x/s{i}\\u00e9> <http://x/n\\U000000e9> "{text}"@en .' for i, text in enumerate(literals)]
    lines += [r"<http://x/\u00fc> <http://x/knows> <http://x/s0\u00e9> .", r'_:b <http://x/n> "1"^^<http://www.w3.org/2001/XMLSchema#int> .']
    for end in ("nt", "ttl"):
        (tmp_path / f"a.{end}").write_text("\n".join(lines) + "\n", encoding="utf-8")
    nt, ttl = (sorted(map(tuple, rdf.read_triples(spark, str(tmp_path / f"a.{end}")).select("s", "p", "o").collect())) for end in ("nt", "ttl"))
    assert nt == ttl and len(nt) == len(lines)
    assert ("http://x/s0é", "http://x/né", "C:\\new") in nt and ("http://x/ü", "http://x/knows", "http://x/s0é") in nt


def test_shex():
    a, b = shapes.read_shex(
        """PREFIX x: <http://x/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
        x:B { x:p @x:A OR @x:B + ; x:q xsd:int {2,5} ; x:r IRI ? // x:note "n" ; x:s . * ; x:t [@en @de-AT] }
        x:A EXTRA x:p CLOSED { }"""
    )
    assert a.iri == "http://x/A" and [c.name for c in b.constraints] == list("pqrst")
    p, q, r, s, t = b.constraints
    assert p.targets == ("http://x/A", "http://x/B") and (p.least, p.most) == (1, None) and (q.least, q.most, q.type) == (2, 5, "Integer")
    assert r.type == "Uri" and r.single and s.type == "Unknown" and t.languages == ("en", "de-at")
    with pytest.raises(Refusal, match="unresolved-reference"):
        shapes.read_shex("<http://a> { <http://p> @<http://b> }")
    with pytest.raises(Refusal, match="unsupported-disjunction"):
        shapes.read_shex("<http://a> { ( <http://p> . | <http://q> . ) }")
    (j,) = shapes.read_shex('{"type":"Schema","shapes":[{"type":"ShapeDecl","id":"http://a","shapeExpr":{"type":"Shape","expression":{"type":"TripleConstraint","predicate":"http://p","min":0,"max":-1}}}]}')
    assert (j.constraints[0].least, j.constraints[0].most) == (0, None)


def test_names_collide():
    with pytest.raises(Refusal, match="shape/name-collision"):
        shapes.check(shapes.Shape("x:T", (shapes.Constraint("n", "a:n"), shapes.Constraint("n", "b:n"))))


def test_places():
    assert resolve("@lake/x.csv", None, {"lake": "s3a://b/"}) == "s3a://b/x.csv"
    assert resolve("x.csv", "/base/") == "/base/x.csv" and resolve("s3a://b/x", "/base") == "s3a://b/x" and resolve("/x", None) == "/x"
    for uri, base in (("x.csv", None), ("@gone/x", "/b")):
        with pytest.raises(Refusal):
            resolve(uri, base, {})


def test_numbers_follow_subjects_over_partitions(spark):
    df = spark.createDataFrame([(f"k{i:05d}",) for i in range(5000)][::-1], "k string").repartition(7)
    rows = sorted((r.k, r.dense_id) for r in G.number(df, "k", 100).collect())
    assert [i for _, i in rows] == list(range(100, 5100))


def test_offsets(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (3, 1), (49, 0)], "src long, dst long")
    assert [r.offset for r in G.offsets(edges, 50).orderBy("vertex").collect()] == [0, 2, 2, 2] + [3] * 46 + [4]
    assert [r.offset for r in G.offsets(edges.limit(0), 0).collect()] == [0]


def test_list_columns_are_read_as_text(spark, sf_dir):
    r = Reader(spark, frames={"e": spark.read.parquet(f"{sf_dir}/embeddings.parquet")}).source(A.Source("e", "parquet", "E"))
    assert r.type("E", "embedding") == "String" and r.df.select(r.column("E", "embedding")).first()[0].startswith("[")


def test_queries_say_what_their_sql_says(spark, sf_dir):
    from weftmap import queries

    duck = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql = queries.oracle_sql()

    def shown(rows, names):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)

    for name, query in queries.queries().items():
        df = query(spark, sf_dir)
        theirs = duck.execute(sql[name])
        names = [d[0] for d in theirs.description]
        assert shown([tuple(r) for r in df.collect()], df.columns) == shown(theirs.fetchall(), names), name
