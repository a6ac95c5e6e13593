"""Profiles against DuckDB, and the model and program that follow from one."""

import duckdb

from weftmap.plans import model as M
from weftmap.plans import profile as P
from weftmap.plans.run import run
from weftmap.sources import tables

FILES = {
    "team.csv": "id,title,city\n01,Red,Ost\n02,Blue,Ost\n03,Green,\n",
    "player.csv": "number,name,team_id,height\n1,Ada,01,1.7\n2,Bo,02,1.8\n3,Cy,01,\n4,Di,,1.9\n",
    "medal.csv": "code,kind\n10,gold\n11,silver\n",
    "won.csv": "number,code\n1,10\n1,11\n3,10\n",
    "noise.csv": "x,y\na,1\na,1\n",
}


def frames(spark, folder):
    for name, text in FILES.items():
        (folder / name).write_text(text)
    return {name[:-4]: tables.read_csv(spark, str(folder / name)) for name in FILES}


def test_profile_and_model(spark, tmp_path):
    profile = P.profile(frames(spark, tmp_path))
    assert {s.name: (s.rows, s.keys) for s in profile.sources} == {
        "team": (3, ["id", "title"]), "player": (4, ["number", "name"]), "medal": (2, ["code", "kind"]), "won": (3, []), "noise": (2, []),
    }
    assert profile.source("team").column("city").top == [("Ost", 2)]
    assert profile.source("player").column("height").present == 3
    held = {(i.source, i.column, i.referenced, i.key) for i in profile.inclusions}
    assert {("player", "team_id", "team", "id"), ("won", "number", "player", "number"), ("won", "code", "medal", "code")} <= held
    model = M.infer(profile)
    assert [t.name for t in model.types] == ["Team", "Player", "Medal"] and model.left_out == ["noise"]
    assert ("Player", "team", "Team") in M.spelled(model) and ("Player", "code", "Medal") in M.spelled(model)
    text = M.write(model, {n[:-4]: f'io.csv("{n}")' for n in FILES}, "https://club.example")
    graph = run(spark, text, base=str(tmp_path))["graph"]
    assert {v.label: v.count for v in graph.vertices} == {"Team": 3, "Player": 4, "Medal": 2}
    assert {e.name: e.rows.count() for e in graph.edges} == {"Player_team_Team": 3, "Player_code_Medal": 3}
    other = M.infer(profile, {"key:team": "title"})
    assert other.type("Team").key == "title" and any(a.id == "key:team" for a in other.ambiguities)


def test_long_values_are_left_out(spark):
    df = spark.createDataFrame([("x" * 65,), ("x" * 65,), ("y",)], "v string")
    column = P.profile({"t": df}).source("t").column("v")
    assert column.top == [] and column.low is None and column.high == "y"


def test_depth_reads_the_first_rows(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    assert P.profile({"c": df}, depth=10).source("c").rows == 10


def test_counts_are_those_of_duckdb(spark, sf_dir):
    for name in ("customer", "events", "documents"):
        path = f"{sf_dir}/{name}.parquet"
        df = spark.read.parquet(path)
        told = P.counts(df).first()
        duck = duckdb.connect()
        for i, c in enumerate(df.columns):
            n, d = duck.execute(f'SELECT count("{c}"), count(DISTINCT "{c}") FROM \'{path}\'').fetchone() if hasattr(duck, "fetchone") else duck.execute(f'SELECT count("{c}"), count(DISTINCT "{c}") FROM \'{path}\'').fetchall()[0]
            assert (told[f"present_{i}"], told[f"distinct_{i}"]) == (n, d)
