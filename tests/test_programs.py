"""Programs end to end: what they compile to, what a run writes, and what is refused."""

import os

import duckdb
import pytest
from programs import PROGRAMS, WRONG

from weftmap.errors import Refusal
from weftmap.plans.run import check, load, run
from weftmap.sinks import graphar, ntriples
from weftmap.sources import tables


def lay_out(folder, program):
    for name, text in program.items():
        if "." in name:
            (folder / name).write_text(text)
    return {"base": str(folder)}


@pytest.fixture(scope="module")
def graphs(spark, tmp_path_factory):
    out = {}
    for name, program in PROGRAMS.items():
        folder = tmp_path_factory.mktemp(name)
        into = str(tmp_path_factory.mktemp(name + "-out"))
        reads = lay_out(folder, program)
        out[name] = (run(spark, program["program"], into, **reads), into, reads)
    return out


@pytest.mark.parametrize("name", PROGRAMS)
def test_counts(graphs, name):
    done, _, _ = graphs[name]
    graph = done["graph"]
    assert {v.label: v.count for v in graph.vertices} == PROGRAMS[name]["vertices"]
    assert {e.name: (e.rows.count(), e.dropped) for e in graph.edges} == PROGRAMS[name]["edges"]
    assert done["dropped"] == [{"edge": e, "rows": d} for e, (_, d) in PROGRAMS[name]["edges"].items() if d]


@pytest.mark.parametrize("name", PROGRAMS)
def test_ids_have_no_gaps_and_follow_subjects(graphs, name):
    graph = graphs[name][0]["graph"]
    at = 0
    for v in graph.vertices:
        rows = v.rows.orderBy("dense_id").collect()
        assert [r.dense_id for r in rows] == list(range(at, at + len(rows)))
        assert [r.subject for r in rows] == sorted(r.subject for r in rows)
        at += len(rows)


def rows_of(graphs, name, label):
    return {r.subject.rpartition("/")[2]: r for r in graphs[name][0]["graph"].vertex(label).rows.collect()}


def test_values(graphs):
    readers = rows_of(graphs, "library", "Reader")
    assert readers["007"].name == "Ada" and readers["007"].mail == "a@x.example" and set(readers) == {"007", "009"}
    stars = rows_of(graphs, "observatory", "Star")
    assert (stars["S1"].label, stars["S1"].band, stars["S1"].ratio, stars["S1"].left, stars["S1"].bright) == ("Vega  Prime", "far", 1.0, 7, True)
    assert (stars["S2"].band, stars["S2"].ratio, stars["S2"].left, str(stars["S2"].seen)) == ("near", float("-inf"), -3, "2025-01-01")
    assert (stars["S3"].band, stars["S3"].ratio, stars["S3"].seen, stars["S3"].bright) == ("mid", 0.0, None, True)
    tags = graphs["observatory"][0]["graph"].vertex("Star").multi["tags"].collect()
    assert sorted((r.src, r.value) for r in tags) == [(0, "a"), (0, "b"), (1, "c")]
    totals = rows_of(graphs, "market", "Total")
    assert {k: (r.sum, r.most) for k, r in totals.items()} == {"x": (4.0, 3.0), "y": (12.0, 10.0), "z": (4.0, 4.0)}
    assert {k: r.above for k, r in rows_of(graphs, "market", "Pair").items()} == {"2": "root", "3": "root", "4": "left"}
    flags = graphs["harbour"][0]["graph"].vertex("Ship").multi["flag"].collect()
    assert sorted((r.value, r.lang) for r in flags) == [("Blue", "en"), ("Red", "en"), ("Rot", "de")]


@pytest.mark.parametrize("name", PROGRAMS)
def test_files(graphs, name):
    done, into, _ = graphs[name]
    graph = done["graph"]
    duck = duckdb.connect()
    info = open(f"{into}/{graphar.NAME}.graph.yml").read()
    for v in graph.vertices:
        assert f"- {v.label}.vertex.yml" in info
        place = f"{into}/vertex/{v.label}"
        assert int.from_bytes(open(f"{place}/vertex_count", "rb").read(), "little") == v.count
        rows = duck.execute(f"SELECT * FROM read_parquet('{place}/{graphar.group_name(v)}/chunk0')").fetchall()
        assert [r[0] for r in rows] == list(range(v.count))
        assert [r[1] for r in rows] == sorted(r[1] for r in rows)
    for e in graph.edges:
        place = f"{into}/edge/{e.name}/ordered_by_source"
        pairs = duck.execute(f"SELECT * FROM read_parquet('{place}/adj_list/part0/chunk0')").fetchall()
        assert pairs == sorted(pairs) and len(pairs) == PROGRAMS[name]["edges"][e.name][0]
        starts = [r[0] for r in duck.execute(f"SELECT * FROM read_parquet('{place}/offset/chunk0')").fetchall()]
        n = graph.vertex(e.source).count
        assert starts == [sum(s < i for s, _ in pairs) for i in range(n + 1)]
        assert int.from_bytes(open(f"{place}/edge_count0", "rb").read(), "little") == len(pairs)
    assert "rml:TriplesMap" in open(f"{into}/mapping.ttl").read()
    assert not [f for _, _, fs in os.walk(into) for f in fs if f.endswith((".writing", ".empty"))]


def rml_triples(into, graph):
    """What the mapping makes of the written tables, computed by DuckDB."""
    from weftmap.sources.turtle import parse

    duck = duckdb.connect()
    for v in graph.vertices:
        duck.execute(f"CREATE VIEW \"{v.label}\" AS SELECT * FROM read_parquet('{into}/vertex/{v.label}/{graphar.group_name(v)}/chunk0')")
    for e in graph.edges:
        duck.execute(f"CREATE VIEW \"{e.name}\" AS SELECT * FROM read_parquet('{into}/edge/{e.name}/ordered_by_source/adj_list/part0/chunk0')")
    by = {}
    for s, p, o in parse(open(f"{into}/mapping.ttl").read(), "x:"):
        by.setdefault(s, {}).setdefault(p.rpartition("/")[2], []).append(o)
    out = set()
    for s, ps in by.items():
        if "logicalSource" not in ps:
            continue
        source = by[ps["logicalSource"][0]]
        text = source["iterator"][0][1]
        query = text if "Query" in source["referenceFormulation"][0][1] else f'SELECT * FROM "{text}"'
        subject = by[ps["subjectMap"][0]]
        cur = duck.execute(query)
        names = [d[0] for d in cur.description]
        for row in cur.fetchall():
            r = dict(zip(names, row, strict=True))
            who = r[subject["reference"][0][1]]
            for c in subject.get("class", []):
                out.add((who, "type", c[1], None))
            for po in ps.get("predicateObjectMap", []):
                o = by[by[po]["objectMap"][0]]
                value = r[o["reference"][0][1]]
                if value is not None:
                    tag = r[by[o["languageMap"][0]]["reference"][0][1]] if "languageMap" in o else None
                    out.add((who, by[po]["predicate"][0][1], shown(value), tag))
    return out


def shown(value):
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return repr(value).replace("inf", "INF")
    return str(value)


@pytest.mark.parametrize("name", PROGRAMS)
def test_both_sinks_say_the_same(spark, graphs, name):
    from weftmap.sources.turtle import RDF, parse

    done, into, _ = graphs[name]
    lines = [r.value for r in ntriples.triples(done["graph"]).collect()]
    assert lines == sorted(set(lines))
    said = set()
    for s, p, o in parse("\n".join(lines)):
        value, datatype = o[1], o[2] if o[0] == "literal" else None
        if datatype and datatype.endswith(("double", "decimal", "float")):
            value = repr(float(value.replace("INF", "inf"))).replace("inf", "INF")
        said.add((s[1], "type" if p == RDF + "type" else p, value, o[3] if o[0] == "literal" else None))
    assert said == rml_triples(into, done["graph"])


@pytest.mark.parametrize("name, old, new, code", WRONG, ids=[f"{w[3]}-{i}" for i, w in enumerate(WRONG)])
def test_refused(spark, tmp_path, name, old, new, code):
    program = PROGRAMS[name]
    assert old in program["program"]
    reads = lay_out(tmp_path, program)
    with pytest.raises(Refusal) as e:
        load(spark, program["program"].replace(old, new), **reads)
    assert e.value.code == code
    assert code in [r.code for r in check(spark, program["program"].replace(old, new), **reads)]


def test_refused_from_data(spark, tmp_path):
    program = PROGRAMS["library"]
    reads = lay_out(tmp_path, program)
    for old, new, code in [
        ("reader/{Row.card}", "reader/x{Row.mail}", "write/invalid-subject"),
        ("https://library.example/reader/{Row.card}", "reader {Row.card}", "write/invalid-subject"),
        ("https://library.example/loan/{Lent.id}", "https://library.example/loan/{Lent.card}", "write/too-many-values"),
        ("https://library.example/loan/{Lent.id}", "https://library.example/reader/00{Lent.id}", None),
    ]:
        text = program["program"].replace(old, new)
        if code is None:
            text = text.replace("reader/{Row.card}", "reader/{Row.card}").replace("00{Lent.id}", "00{Lent.id}")
            run(spark, text, **reads)
            continue
        with pytest.raises(Refusal) as e:
            run(spark, text.replace("Reader from Grown", "Reader from Row") if "mail" in new else text, **reads)
        assert e.value.code == code


def test_limit_reads_the_first_rows(spark, tmp_path):
    reads = lay_out(tmp_path, PROGRAMS["market"])
    graph = run(spark, PROGRAMS["market"]["program"], limit=1, **reads)["graph"]
    assert {v.label: v.count for v in graph.vertices} == {"Total": 2, "Pair": 0}


PROJECTS = {
    "shapes.shex": """
PREFIX v: <https://hub.example/voc#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
v:Hub { v:label xsd:string ; v:about xsd:string * ; v:runs @v:Project * ; v:lead @v:Project ? }
v:Project { v:title xsd:string ; v:page . * }
""",
    "hubs.ttl": """
@prefix v: <https://hub.example/voc#> .
<https://hub.example/h/1> a v:Hub ; v:label "one" ; v:about "x", "y" ; v:runs <https://hub.example/p/1>, <https://hub.example/p/2>, <https://hub.example/p/9> ; v:lead <https://hub.example/p/2> .
<https://hub.example/h/2> a v:Hub ; v:label "two" ; v:runs <https://hub.example/p/2> .
<https://hub.example/p/1> a v:Project ; v:title "P1" .
<https://hub.example/p/2> a v:Project ; v:title "P2" .
""",
    "program": """
type { Hub, Project } := io.shex("shapes.shex")
{ Hub, Project } := io.rdf("hubs.ttl")

Hubs : Hub from Hub
    @subject = Hub.subject
    label    = Hub.label
    runs     = Hub.runs
    lead     = Hub.lead

Projects : Project from Project
    @subject = Project.subject
    title    = Project.title
""",
}


def test_a_list_is_an_edge_for_each_of_its_values(spark, tmp_path):
    done = run(spark, PROJECTS["program"], **lay_out(tmp_path, PROJECTS))
    graph = done["graph"]
    names = {r.dense_id: r.subject.rpartition("example/")[2] for v in graph.vertices for r in v.rows.collect()}
    found = {e.name: sorted((names[r.src], names[r.dst]) for r in e.rows.collect()) for e in graph.edges}
    assert found == {"Hub_runs_Project": [("h/1", "p/1"), ("h/1", "p/2"), ("h/2", "p/2")], "Hub_lead_Project": [("h/1", "p/2")]}
    assert done["dropped"] == [{"edge": "Hub_runs_Project", "rows": 1}]
    assert [p.name for p in graph.vertex("Hub").properties] == ["label"]


def test_only_columns_that_are_read_are_built_from_triples(spark, tmp_path):
    program = load(spark, PROJECTS["program"], **lay_out(tmp_path, PROJECTS))
    assert {c for m in program.mappings for _, c, _ in program.relations[m.relation].slots()} == {"subject", "label", "runs", "lead", "title"}


EXACT = """
@iri("https://m.example/voc#M")
type M
    @iri("https://m.example/voc#size") size: Float
    @iri("https://m.example/voc#page") page: Uri
    @iri("https://m.example/voc#more") more: Seq<Uri>
Row := io.parquet("m.parquet")
Ms : M from Row
    @subject = "https://m.example/{Row.id}"
    size     = Row.size
    page     = Row.page
    more     = Row.page
"""


def test_values_that_have_no_place_are_refused(spark, tmp_path):
    def go(size, kind, page="https://m.example/"):
        df = spark.createDataFrame([(1, size, page)], f"id long, size {kind}, page string")
        return run(spark, EXACT, base=str(tmp_path), frames={"m.parquet": df})["graph"].vertex("M").rows.first().size

    from decimal import Decimal

    assert (go(1 << 53, "long"), go(Decimal("0.25"), "decimal(10,2)"), go(None, "long")) == (2.0**53, 0.25, None)
    for size, kind in (((1 << 53) + 1, "long"), ((1 << 63) - 1, "long"), (Decimal("12345678901234567.89"), "decimal(38,2)")):
        with pytest.raises(Refusal) as e:
            go(size, kind)
        assert e.value.code == "write/unrepresentable" and str(size) in e.value.message
    for page in ("no iri", "relative/x"):
        with pytest.raises(Refusal) as e:
            go(1, "long", page)
        assert e.value.code == "write/invalid-iri"


ASSERTED = """
@iri("https://m.example/voc#M")
type M
    @iri("https://m.example/voc#kind")
    @assert(str.length(kind) >= 3 and kind.starts_with("k"))
    @severity(info)
    kind: String
    @iri("https://m.example/voc#rank")
    @assert(rank > 0 and not (rank == 13), severity = {severity})
    rank: Integer
Row := io.csv("m.csv")
Ms : M from Row
    @subject = "https://m.example/{{Row.id}}"
    kind     = {kind}
    rank     = {rank}
"""


@pytest.mark.parametrize("kind, rank, severity, code", [
    ('"kind"', "7", "violation", None), ('"ki"', "7", "violation", "shape/assert-failed"), ('"other"', "7", "violation", "shape/assert-failed"), ('"kind"', "2 - 5", "violation", "shape/assert-failed"),
    ('"kind"', "13", "violation", "shape/assert-failed"), ('"kind"', "13", "warning", None), ("Row.name", "Row.id", "violation", None), ('"kind"', "7", "fatal", "name/unknown-severity"),
])
def test_assertions_on_constants(spark, tmp_path, kind, rank, severity, code):
    (tmp_path / "m.csv").write_text("id,name\n1,x\n")
    text = ASSERTED.format(kind=kind, rank=rank, severity=severity)
    assert [r.code for r in check(spark, text, base=str(tmp_path))] == ([code] if code else [])
    out = text.replace("rank > 0", "kind > 0")
    assert [r.code for r in check(spark, out, base=str(tmp_path))] == ["shape/out-of-scope"]


def test_a_run_that_does_not_compile_tells_why(spark, tmp_path):
    program = PROGRAMS["library"]
    text = program["program"].replace("Row.name\n", "Row.nmae\n").replace("fee      = Lent.fee", "fee      = Lent.cost")
    with pytest.raises(Refusal) as e:
        run(spark, text, **lay_out(tmp_path, program))
    assert e.value.code == "run/does-not-compile" and [r.code for r in e.value.related] == ["name/unknown-field"] * 2


def test_bytes_that_are_no_utf8_are_refused(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b"id,name\n1,caf\xe9\n")
    with pytest.raises(Refusal) as e:
        tables.read_csv(spark, str(tmp_path / "m.csv"))
    assert e.value.code == "source/not-utf8"


def test_ntriples_are_written(spark, tmp_path):
    reads = lay_out(tmp_path, PROGRAMS["harbour"])
    into = str(tmp_path / "nt")
    run(spark, PROGRAMS["harbour"]["program"], into, form="ntriples", **reads)
    lines = [r.value for r in spark.read.text(f"{into}/graph.nt").collect()]
    assert '<https://harbour.example/ship/1> <https://harbour.example/voc#flag> "Rot"@de .' in lines
    # what was written is a source again
    again = """
@iri("https://harbour.example/voc#Ship")
type Ship
    @iri("https://harbour.example/voc#title")  name: String
    @iri("https://harbour.example/voc#flag")   flag: Seq<String>
{ Ship as Row } := io.rdf("nt/graph.nt")
Ships : Ship from Row
    @subject = "{Row.subject}"
    name     = Row.name
    flag     = Row.flag
"""
    graph = run(spark, again, **reads)["graph"]
    assert graph.vertex("Ship").count == 3 and graph.vertex("Ship").multi["flag"].count() == 3


def test_chunks(spark, graphs, tmp_path):
    _, _, reads = graphs["harbour"]
    graph = run(spark, PROGRAMS["harbour"]["program"], str(tmp_path), chunk_size=2, **reads)["graph"]
    with pytest.raises(Refusal):
        run(spark, PROGRAMS["harbour"]["program"], str(tmp_path), chunk_size=0, **reads)
    duck = duckdb.connect()
    place = f"{tmp_path}/vertex/Ship/{graphar.group_name(graph.vertex('Ship'))}"
    got = [[r[0] for r in duck.execute(f"SELECT * FROM read_parquet('{place}/chunk{i}')").fetchall()] for i in (0, 1)]
    assert got == [[0, 1], [2]]
    edges = f"{tmp_path}/edge/Ship_met_Ship/ordered_by_source"

    def rows(path):
        return duck.execute(f"SELECT * FROM read_parquet('{edges}/{path}')").fetchall()

    assert [rows(f"adj_list/part{i}/chunk0") for i in (0, 1)] == [[(0, 1), (0, 2), (1, 0)], []]
    assert [[r[0] for r in rows(f"offset/chunk{i}")] for i in (0, 1)] == [[0, 2, 3], [0, 0]]
