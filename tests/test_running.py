"""Running values against plain loops, with groups that cross ranges."""

import random

import pytest

from codeseam.operators.running import running


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_values_match_a_loop(spark, parts):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(1000), i, rng.choice([None, 1, 5, -2])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, _r int, id int, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r for r in running(df, ["k"], ["_r", "id"], {"s": ("v", "sum"), "l": ("v", "last"), "m": ("v", "max")}).collect()}
        alone = {r["id"]: r["s"] for r in running(df, [], ["id"], {"s": ("id", "sum")}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state = {}
    for k, r, i, v in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])):
        s, last, m = state.get(k, (None, None, None))
        if v is not None:
            s, last, m = (s or 0) + v, v, v if m is None else max(m, v)
        state[k] = (s, last, m)
        assert (got[i]["s"], got[i]["l"], got[i]["m"]) == (s, last, m)
    assert alone == {i: i * (i + 1) // 2 for i in range(400)}


def test_running_of_nothing(spark):
    assert running(spark.createDataFrame([], "k string, v int"), ["k"], ["v"], {"v": ("v", "sum")}).columns == ["k", "v"]
    assert running(spark.createDataFrame([], "k string, v int"), ["k"], ["v"], {"t": ("v", "sum")}).count() == 0
