"""Results that do not depend on how many files a graph or a table takes, and steps that many tasks share."""

import glob
import math
import os
import re

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftmap import graph_queries as Q
from weftmap.operators import graph as G
from weftmap.sinks import graphar
from weftmap.sinks.files import put_numbered
from weftmap.sources import tables
from weftmap.sources.shapes import Shape


def same_as_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("customer", "nation", "orders", "lineitem", "supplier"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    got = duck.execute(entry.oracle_sql()[name])
    at = [df.columns.index(d[0]) for d in got.description]
    return sorted(tuple(r[i] for i in at) for r in df.collect()) == sorted(got.fetchall())


def most_tasks(spark, work):
    """The greatest number of tasks of a stage that ``work`` runs."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    work()
    stages = [s for job in set(tracker.getJobIdsForGroup(None)) - before for s in tracker.getJobInfo(job).stageIds]
    return max(tracker.getStageInfo(s).numTasks for s in stages)


def test_a_task_writes_many_small_chunks(spark, sf_dir, tmp_path):
    _, graph = Q.written(spark, sf_dir)
    v = graph.vertex("Order")
    assert most_tasks(spark, lambda: graphar.write(spark, graph, str(tmp_path / "g"), 3)) <= 16
    files = glob.glob(f"{tmp_path}/g/vertex/Order/{graphar.group_name(v)}/chunk*")
    assert len(files) == math.ceil(v.count / 3) > 100
    for i in range(len(files)):
        held = pq.ParquetFile(f"{tmp_path}/g/vertex/Order/{graphar.group_name(v)}/chunk{i}").read().column("_graphArVertexIndex").to_pylist()
        assert held == list(range(3 * i, min(3 * i + 3, v.count)))
    edges = f"{tmp_path}/g/edge/Order_placed_by_Customer/ordered_by_source"
    assert {len(glob.glob(f"{edges}/{p}")) for p in ("adj_list/part*/chunk0", "offset/chunk*", "edge_count*")} == {len(files)}


def test_files_of_many_numbers_are_sorted_and_may_be_empty(spark, tmp_path):
    df = spark.range(1000, numPartitions=4).select((F.col("id") % 50 * 2).alias("number"), (999 - F.col("id")).alias("v"))
    for _ in range(2):  # the second time over the files of the first
        put_numbered(df, "number", 100, ["v"], lambda i: f"{tmp_path}/at/file{i}", f"{tmp_path}/at", 30)
        assert sorted(os.listdir(tmp_path)) == ["at"]
        for i in range(100):
            held = pq.ParquetFile(f"{tmp_path}/at/file{i}").read()
            assert held.column_names == ["v"]
            assert held.column("v").to_pylist() == ([] if i % 2 else sorted(999 - k for k in range(i // 2, 1000, 50)))


@pytest.mark.parametrize("name", ["gar_counts", "gar_offsets", "gar_edges", "gar_vertices"])
def test_graphs_of_several_parts(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(graphar, "CHUNK", 40)
    assert same_as_sql(spark, sf_dir, name)


def test_lines_are_written_by_many_tasks(spark):
    df = spark.range(100, numPartitions=4)
    path = Q._lines(spark, df, "many", "k|t", [F.col("id"), F.concat(F.lit("t"), F.col("id"))])
    assert len(glob.glob(f"{path}/part-*")) >= 4
    assert sorted(tuple(r) for r in tables.read_csv(spark, path, "|").collect()) == [(i, f"t{i}") for i in range(100)]
    none = tables.read_csv(spark, Q._lines(spark, df.filter("id < 0"), "none", "k|t", [F.col("id"), F.col("id")]), "|")
    assert none.columns == ["k", "t"] and none.count() == 0


def test_first_rows_of_files_that_many_tasks_sort(spark, sf_dir, monkeypatch):
    wrote = []
    monkeypatch.setattr(Q, "fresh_path", lambda *a, _own=Q.fresh_path: wrote.append(_own(*a)) or wrote[-1])
    assert same_as_sql(spark, sf_dir, "src_limit_files")
    assert len([f for f in glob.glob(f"{wrote[0]}/p2/part-*") if pq.ParquetFile(f).metadata.num_rows]) > 1


@pytest.fixture
def unbroadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_identities_are_sorted_by_digests_the_smaller_end_first(spark, sf_dir, monkeypatch, unbroadcast):
    plans = {}

    def held(df, name="table", *more, _own=G.cut):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return _own(df, name, *more)

    monkeypatch.setattr(G, "cut", held)
    assert same_as_sql(spark, sf_dir, "edge_merge_mappings")
    keys = [re.sub("#[0-9]+L?", "", k) for k in re.findall(r"SortMergeJoin \[(.*?)\], \[", plans["edges"])]
    assert keys == ["xxhash64(s, 42)", "xxhash64(t, 42)"]  # the last is run first: fewer suppliers than orders


@pytest.mark.parametrize("name", ["edge_merge_mappings", "edge_resolve", "edge_multi_target", "edge_dangling_dropped", "gar_multi_values"])
def test_digests_that_meet_join_no_other_identities(spark, sf_dir, monkeypatch, unbroadcast, name):
    monkeypatch.setattr(F, "xxhash64", lambda c, _own=F.xxhash64: F.pmod(_own(c), F.lit(3)))
    assert same_as_sql(spark, sf_dir, name)


def test_edges_of_vertices_with_the_greatest_numbers(spark):
    ids = {"a": 0, "b": (1 << 31) - 1, "c": 1 << 31, "d": (1 << 32) - 1}
    table = G.VertexTable(Shape("https://e.example/voc#V", ()), [], spark.createDataFrame([(i, s) for s, i in ids.items()], "dense_id long, subject string"), {}, 0, len(ids))
    asked = [(s, t) for s in ids for t in ids] * 2 + [("a", "none"), ("none", "a"), ("none", "none"), (None, "a"), ("a", None)]
    part = G.EdgePart(spark.createDataFrame(asked, "s string, t string"), F.col("s"), F.col("t"))
    e = G.build_edges("to", "https://e.example/voc#to", False, [part], table, table)
    assert sorted(tuple(r) for r in e.rows.collect()) == sorted((a, b) for a in ids.values() for b in ids.values())
    assert (e.count, e.dropped) == (16, 4)
