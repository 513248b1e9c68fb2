"""Driver-table queries against DuckDB, and operators on odd inputs."""

import os

import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from codeseam.functions import text as T
from codeseam.operators import edits, graph, interval, search
from codeseam.plans import table_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame, columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    cells = lambda r: tuple(None if x is None or x is pd.NA or x != x else x for x in r)
    return sorted((cells(r) for r in frame[columns].astype(object).itertuples(index=False)), key=key)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(table_queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = table_queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(table_queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
def test_graph_operators_match_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "src bigint, dst bigint")
    out = {n: {b for a, b in pairs if a == n} for n in range(10)}
    reach = {}
    for n in range(10):
        seen, todo = set(), [n]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[n] = seen
    got = {r["node"] for r in graph.reachable(df, spark.createDataFrame([(0,)], "node bigint")).collect()}
    assert got == reach[0] | {0}
    scc = {(r["node"], r["component"]) for r in graph.strong_components(df).collect()}
    want = set()
    for n in range(10):
        same = {m for m in range(10) if m in reach[n] and n in reach[m]} | {n}
        if len(same) > 1:
            want.add((n, min(same)))
    assert scc == want


def test_flows_keep_paths_with_fewer_calls(spark):
    """A longer path with fewer calls behind it goes on where a shorter one may not; more edges never lose a flow."""
    from codeseam.operators.flow import interprocedural

    seeds = spark.createDataFrame([("o", "a", 1)], "method string, variable string, line int")
    assigns = spark.createDataFrame([("o", "a", "b", 2), ("o", "b", "c", 3)], "method string, source string, target string, line int")
    parameters = spark.createDataFrame([("p", 0, "x"), ("m", 0, "v"), ("n", 0, "w")], "method string, position int, name string")
    sinks = spark.createDataFrame([("n", "w", "w.use()", 9)], "method string, variable string, what string, line int")
    long_way = [("o", "c", "m", 0, 4), ("m", "v", "n", 0, 5)]
    short_way = [("o", "a", "p", 0, 6), ("p", "x", "m", 0, 7)]

    def found(arguments, depth):
        df = spark.createDataFrame(arguments, "method string, variable string, callee string, position int, line int")
        return [r["steps"] for r in interprocedural(seeds, assigns, df, parameters, sinks, depth, "null").collect()]

    want = ["alias b @2; alias c @3; argument 0 v @4; argument 0 w @5"]
    assert found(long_way, 2) == want and found(long_way + short_way, 2) == want
    assert found(long_way + short_way, 3) == ["argument 0 x @6; argument 0 v @7; argument 0 w @5"]
    assert found(long_way + short_way, 1) == []


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from codeseam.operators.shared import shared_dir

    def session(master, path=None):
        held = SimpleNamespace(isDefined=lambda: False)
        sc = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)))
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: path))

    assert shared_dir(session("spark://x", "hdfs://a/")) == "hdfs://a"
    assert shared_dir(session("local[4]"))
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://x"))


def test_globs(spark):
    names = spark.createDataFrame([(x,) for x in ["Foo", "FooBar", "foo", "F.o", "Fxo", "", "a\nb", None]], "n string")
    hit = lambda g, **k: [r[0] for r in names.filter(T.glob_match(F.col("n"), g, **k)).collect()]
    assert hit("Foo") == ["Foo"] and hit("Foo*") == ["Foo", "FooBar"] and hit("*o") == ["Foo", "foo", "F.o", "Fxo"]
    assert hit("F.o") == ["F.o"] and hit("F?o") == ["Foo", "F.o", "Fxo"] and hit("foo*", ignore_case=True) == ["Foo", "FooBar", "foo"]
    assert len(hit("*")) == 7 and hit("a?b") == ["a\nb"] and hit("*oB*") == ["FooBar"]


def test_edits():
    assert edits.apply_edits("abcdef", [(0, 1, "X"), (3, 2, ""), (6, 0, "!")]) == "Xbcf!"
    with pytest.raises(edits.CrossingEdits):
        edits.apply_edits("abcdef", [(0, 3, "x"), (2, 2, "y")])
    start, length, new = edits.minimal_replacement("hello world", "hello brave world")
    assert "hello world"[:start] + new + "hello world"[start + length :] == "hello brave world"
    assert edits.minimal_replacement("a", "a") is None


def test_apply_edits_to_files(spark):
    files = spark.createDataFrame([("a", "one two"), ("b", "same")], "file string, content string")
    todo = spark.createDataFrame([("a", 4, 3, "2"), ("a", 0, 3, "1")], "file string, start int, length int, new_text string")
    assert {tuple(r) for r in edits.apply_all(files, todo).collect()} == {("a", "1 2"), ("b", "same")}


def test_innermost_and_longest_prefix(spark):
    points = spark.createDataFrame([("f", 5), ("f", 50), ("g", 5), ("f", None)], "k string, pos int")
    spans = spark.createDataFrame([("f", 0, 100, "outer"), ("f", 4, 8, "inner"), ("f", 9, 9, "none")], "k string, s int, e int, name string")
    got = interval.innermost(points, spans, "k", "pos", "s", "e", 16, ["k", "pos"], ["name"])
    assert {tuple(r) for r in got.collect()} == {("f", 5, "inner"), ("f", 50, "outer")}
    names = spark.createDataFrame([("a.b.C",), ("x.y",), ("a",), (None,)], "n string")
    known = spark.createDataFrame([("a",), ("a.b",), ("b",)], "p string")
    assert {tuple(r) for r in interval.longest_prefix(names, "n", known, "p").collect()} == {("a.b.C", "a.b"), ("x.y", None), ("a", "a"), (None, None)}


def test_paths_and_limits(spark):
    df = spark.createDataFrame([("/api/", "//x/"), ("", ""), (None, "y"), ("a", "/")], "a string, b string")
    assert [r[0] for r in df.select(T.join_path(F.col("a"), F.col("b"))).collect()] == ["/api/x", "/", "/y", "/a"]
    with pytest.raises(search.InvalidParameter):
        search.checked_limit(-1)
    assert search.checked_limit(5000, 1000) == 1000


def test_plans_push_down_and_avoid_cartesian_products(spark):
    df = table_queries.glob_prefix(spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_type,S)" in plan and "p_brand" not in plan
    for name in ("interval_containment", "longest_prefix", "graph_edges_weighted", "snapshot_diff"):
        text = table_queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("source", ["shop_projects", "zoo_projects", "program_graph"])
def test_project_queries_equal_their_rows(spark, duck, source):
    import importlib

    module = importlib.import_module(source)
    for name, build in module.QUERIES.items():
        got, want = build(spark, DATA).toPandas(), duck.execute(module.SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        assert plain(got, columns) == plain(want, columns), name
