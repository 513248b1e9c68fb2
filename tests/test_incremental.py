"""Maintained reachability against building it again."""

import random

import pytest

from codeseam.operators import graph, incremental


def plain(edges, roots):
    """node -> reached, with ranks left out."""
    seen, todo = set(roots), list(roots)
    while todo:
        n = todo.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def check(reach, edges, roots):
    rows = {r["node"]: r for r in reach.state.rows.collect()}
    assert set(rows) == plain(edges, roots)
    for n, r in rows.items():  # every support is well founded, and counted
        own = sum(b == n and a in rows and rows[a]["rank"] < r["rank"] for a, b in edges) + (n in roots)
        assert own == r["support"] >= 1


@pytest.mark.parametrize("seed", [2])
def test_batches_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "src int, dst int")
    nodes = lambda some: spark.createDataFrame([(n,) for n in sorted(some)], "node int")
    pick = lambda n: {(rng.randrange(30), rng.randrange(30)) for _ in range(n)}
    edges, roots = {e for e in pick(45) if e[0] != e[1]}, {0, 1}
    reach = incremental.build(frame(edges), nodes(roots))
    check(reach, edges, roots)
    for k in range(2):
        gone, new = set(rng.sample(sorted(edges), 8)) | pick(2), pick(5)
        lost, came = ({rng.choice(sorted(roots))} if k else set()), {rng.randrange(30)}
        reach = incremental.maintain(reach, frame(new), frame(gone), nodes(came), nodes(lost))
        edges = (edges - gone) | {e for e in new if e[0] != e[1]}
        roots = (roots - lost) | came
        check(reach, edges, roots)


def test_a_cycle_does_not_hold_itself_up(spark):
    frame = lambda pairs: spark.createDataFrame(pairs, "src string, dst string")
    edges = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("r", "x"), (None, "x"), ("x", None)]
    reach = incremental.build(frame(edges), spark.createDataFrame([("r",), (None,)], "node string"))
    reach = incremental.maintain(reach, frame([]), frame([("r", "a")]))
    assert {r["node"] for r in reach.nodes.collect()} == {"r", "x"}
    reach = incremental.maintain(reach, frame([("x", "c")]), frame([]))
    assert {r["node"] for r in reach.nodes.collect()} == {"r", "x", "a", "b", "c"}


def test_a_small_batch_touches_few_rows(spark):
    """A tree of 2,000 nodes: one cut near the leaves and one new leaf."""
    tree = spark.range(1, 2000).selectExpr("cast((id - 1) div 3 as bigint) as src", "id as dst")
    reach = incremental.build(tree, spark.createDataFrame([(0,)], "node bigint"))
    assert reach.nodes.count() == 2000
    edge = lambda a, b: spark.createDataFrame([(a, b)], "src bigint, dst bigint")
    after = incremental.maintain(reach, edge(5, 5000), edge(100, 301))
    gone = plain([((i - 1) // 3, i) for i in range(1, 2000)], {301})
    assert after.nodes.count() == 2001 - len(gone)
    assert after.rows_touched() < 100
    assert after.edges.out.base.count() == 1999  # nothing of the base is written again


def test_later_rounds_read_what_is_unseen(spark, monkeypatch):
    from codeseam.operators import graph

    made, write = [], graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda *a: made.append(write(*a)) or made[-1])
    sizes = []
    monkeypatch.setattr(graph, "discard", lambda *t: sizes.extend(x.count() for x in t))
    fan = [(0, n) for n in range(100, 400)] + [(n, n + 1) for n in range(100, 399)] + [(n, 0) for n in range(100, 400)]
    tail = [(n, n + 1) for n in range(10)] + [(7, 200), (10, 3), (50, 51)]
    edges, roots = spark.createDataFrame(fan + tail, "src int, dst int"), spark.createDataFrame([(0,), (0,), (None,)], "node int")
    found = {r["node"]: r["depth"] for r in graph.reachable(edges, roots).collect()}
    assert found == {n: n for n in range(11)} | {n: 1 for n in range(100, 400)}
    assert [t.count() for t in made[1:]] == [7, 3]  # 4 to 10 and 50 to 51; later 8 to 10 and 50 to 51


def test_components_move_numbers_and_drop_what_is_settled(spark, monkeypatch):
    from codeseam.operators import graph

    written, settle = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append(settle(df)) or written[-1])
    monkeypatch.setattr(graph, "discard", lambda *t: None)
    rings = [(f"r{k}-{i:02}", f"r{k}-{(i + 1) % 30:02}") for k in range(6) for i in range(30)]
    tails = [(f"t{k}-{i}", f"t{k}-{i + 1}") for k in range(2) for i in range(12)] + [("r0-03", "t0-0"), ("t1-12", "r1-00"), ("r0-00", "r1-00")]
    found = {r["node"]: r["component"] for r in graph.strong_components(spark.createDataFrame(rings + tails, "src string, dst string")).collect()}
    assert found == {f"r{k}-{i:02}": f"r{k}-00" for k in range(6) for i in range(30)}
    names = sum(t.count() for t in written if "string" in dict(t.dtypes).values())
    assert names <= 4 * len(rings + tails)  # every round wrote names before


def test_rounds_exchange_the_batch_and_not_the_base(spark):
    """A forest of 4,000 chains, nothing broadcast: a batch in one of them leaves edges and states where they are."""
    chains = spark.range(4000).selectExpr("id * 10 as a", "explode(sequence(0, 4)) as k").selectExpr("a + k as src", "a + k + 1 as dst")
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        none = gateway.new_array(gateway.jvm.double, 0)
        found = store.stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reach = incremental.build(chains, spark.range(4000).selectExpr("id * 10 as node"))
        edge = lambda a, b: spark.createDataFrame([(a, b)], "src bigint, dst bigint")
        last = max(stages())
        reach = incremental.maintain(reach, edge(13, 50001), edge(11, 12), exact=True)
        assert sum(n for stage, n in stages().items() if stage > last) < 1000
        last = max(stages())
        reach = incremental.maintain(reach, edge(11, 12), edge(21, 22), exact=True)  # beside changes of a batch before
        assert sum(n for stage, n in stages().items() if stage > last) < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert reach.nodes.count() == 4000 * 6 - 4 + 1


def test_leaving_out_exchanges_what_is_left(spark):
    """2,000 wheels seen by round 3 and one tail of 9, nothing broadcast: the edges of what was seen stay where they are."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    wheels = spark.range(2000).selectExpr("id * 100 as a").selectExpr("a", "explode(sequence(1, 20)) as k")
    rims = wheels.selectExpr("a + k as src", "explode(array(a, a + k % 20 + 1, a + (k + 6) % 20 + 1)) as dst")
    tail = spark.range(9).selectExpr("-id as src", "-id - 1 as dst")
    edges = incremental.Edges.of(wheels.selectExpr("a as src", "a + k as dst").union(rims).union(tail)).out.base
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = max(stages())
        found = graph.reachable(edges, spark.range(2000).selectExpr("id * 100 as node"), steps=edges)
        moved = sum(n for stage, n in stages().items() if stage > last)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert edges.count() == 2000 * 80 + 9
    assert {r["depth"]: r["count"] for r in found.groupBy("depth").count().collect()} == {0: 2000, 1: 40001} | {d: 1 for d in range(2, 10)}
    assert moved < 3 * 2000 * 80
