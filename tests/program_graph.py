"""Unreachable code and callers of a small program graph, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeseam.operators import graph

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


FIXTURE_NODES = [
    ("p.Main", "TYPE", None), ("p.Main#main(String[])", "METHOD", "p.Main"), ("p.Service", "TYPE", None), ("p.Service#run()", "METHOD", "p.Service"),
    ("p.ServiceImpl", "TYPE", None), ("p.ServiceImpl#run()", "METHOD", "p.ServiceImpl"), ("p.ServiceImpl#helper()", "METHOD", "p.ServiceImpl"),
    ("p.Data", "TYPE", None), ("p.Data#Data()", "METHOD", "p.Data"), ("p.Data#size", "FIELD", "p.Data"), ("p.Dead", "TYPE", None),
    ("p.Dead#a()", "METHOD", "p.Dead"), ("p.Dead#b()", "METHOD", "p.Dead"), ("p.Spare", "TYPE", None),
]
FIXTURE_EDGES = [
    ("p.Main#main(String[])", "p.Service#run()", "CALLS"), ("p.Main#main(String[])", "p.Data#Data()", "CREATES"), ("p.ServiceImpl#run()", "p.ServiceImpl#helper()", "CALLS"),
    ("p.ServiceImpl#helper()", "p.Data#size", "READS"), ("p.Dead#a()", "p.Dead#b()", "CALLS"), ("p.Dead#b()", "p.Dead#a()", "CALLS"), ("p.Dead#a()", "p.ServiceImpl#helper()", "CALLS"),
]
FIXTURE_OVERRIDES = [("p.ServiceImpl#run()", "p.Service#run()")]


def _values(rows) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_FIXTURE_SQL = (
    f"n(key, kind, owner_key) AS (VALUES {_values(FIXTURE_NODES)}), g(from_key, to_key, kind) AS (VALUES {_values(FIXTURE_EDGES)}), "
    f"o(key, overridden_key) AS (VALUES {_values(FIXTURE_OVERRIDES)}), "
    "x AS (SELECT from_key AS src, to_key AS dst FROM g WHERE to_key IN (SELECT key FROM n) UNION SELECT from_key, owner_key FROM g JOIN n ON n.key = to_key WHERE g.kind = 'CREATES' AND n.kind = 'METHOD' "
    "UNION SELECT overridden_key, key FROM o)"
)


def fixture(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(FIXTURE_EDGES, "from_key string, to_key string, kind string"),
        spark.createDataFrame(FIXTURE_OVERRIDES, "key string, overridden_key string"),
        spark.createDataFrame(FIXTURE_NODES, "key string, kind string, owner_key string"),
    )


@query(
    f"WITH RECURSIVE {_FIXTURE_SQL}, r AS (SELECT 'p.Main#main(String[])' AS node UNION SELECT 'p.Main' UNION SELECT dst FROM r JOIN x ON x.src = r.node) "
    "SELECT key, kind FROM n WHERE key NOT IN (SELECT node FROM r) AND NOT (kind = 'TYPE' AND key IN (SELECT owner_key FROM n JOIN r ON r.node = n.key WHERE owner_key IS NOT NULL))"
)
def fixture_unreachable(spark, sf_dir):
    root = spark.createDataFrame([("p.Main#main(String[])",)], "node string")
    return graph.unreachable(*fixture(spark), root).select("key", "kind")


@query(
    f"WITH RECURSIVE {_FIXTURE_SQL}, m AS (SELECT to_key AS key, from_key AS nxt, 1 AS via FROM g UNION SELECT key, overridden_key, 0 FROM o), "
    "r AS (SELECT 'p.ServiceImpl#helper()' AS key, 0 AS via UNION SELECT m.nxt, m.via FROM r JOIN m ON m.key = r.key) "
    "SELECT DISTINCT r.key FROM r JOIN n USING (key) WHERE via = 1 AND n.kind = 'METHOD' AND r.key <> 'p.ServiceImpl#helper()'"
)
def fixture_callers(spark, sf_dir):
    return graph.transitive_callers(*fixture(spark), "p.ServiceImpl#helper()")
