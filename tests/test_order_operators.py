"""Cycle paths, interval labels and scopes against plain walks."""

import random

from pyspark.sql import functions as F

from codeseam.operators import cycles, diff, edits, graph, interval, labels, running, scopes, search
from codeseam.plans import graph_queries


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_shortest_cycles_match_a_search(spark):
    rng = random.Random(4)
    pairs = sorted({(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(40)} | {("x1", "x2"), ("x2", "x1"), ("x1", "x1"), ("y", "n01")})
    df = spark.createDataFrame([*pairs, pairs[0], (None, "n01")], "src string, dst string")
    components = graph.strong_components(df)
    of = {r["node"]: r["component"] for r in components.collect()}
    want = []
    for c in sorted(set(of.values())):
        depth, level = {c: 0}, [c]
        while level:
            level = sorted({b for a, b in pairs if a in level and of.get(a) == of.get(b) == c and b not in depth})
            depth |= {n: depth[max((a for a, b in pairs if b == n and a in depth), key=lambda a: -depth[a])] + 1 for n in level}
        at = min((depth[a], a) for a, b in pairs if b == c and a in depth and a != c)[1]
        path = [at]
        while path[-1] != c:
            path.append(min(a for a, b in pairs if b == path[-1] and a in depth and depth[a] == depth[path[-1]] - 1))
        want += [(c, len(path), k, n) for k, n in enumerate(reversed(path))]
    got = cycles.shortest_cycles(df, components)
    assert rows(got, "component", "length", "position", "node") == sorted(want, key=str)
    texts = rows(cycles.listed(got, "component", "node", "position", 2, "path", ">"), "component", "path")
    assert texts == sorted(((c, ">".join(n for d, _, _, n in want if d == c)) for c in {w[0] for w in want if w[1] <= 2}), key=str)
    assert cycles.shortest_cycles(df.limit(0), components.limit(0)).count() == 0


def test_interval_labels_match_walks(spark):
    rng = random.Random(8)
    parent = {i: rng.choice([None, 0, 0, *range(max(0, i - 6), i)]) if i else None for i in range(60)}
    parent |= {100: 77, 101: 101, 200: 201, 201: 200, 202: 201} | {300 + i: 299 + i for i in range(1, 12)} | {300: 0}
    df = spark.createDataFrame([*parent.items(), (5, parent[5]), (None, 3)], "node int, parent int")
    made = labels.interval_labels(df).cache()

    def up(n):
        out = []
        while parent[n] is not None and parent[n] in parent and parent[n] != n and len(out) < 400:
            n = parent[n]
            out.append(n)
        return out

    got = {r["node"]: r for r in made.collect()}
    assert set(got) == set(parent)
    on_cycle = {200, 201, 202}
    for n, r in got.items():
        if n in on_cycle:
            assert r["root"] is None and r["size"] is None
            continue
        assert (r["root"], r["depth"], r["size"]) == ((up(n) or [n])[-1], len(up(n)), 1 + sum(n in up(m) for m in parent if m not in on_cycle))
    every = spark.createDataFrame([(n,) for n in parent], "node int")
    want = sorted(((n, a, k + 1) for n in parent if n not in on_cycle for k, a in enumerate(up(n))), key=str)
    assert rows(labels.ancestors(made, every, cell=8), "node", "ancestor", "distance") == want
    assert rows(labels.descendants(made, every, cell=8), "node", "ancestor", "distance") == want
    values = spark.createDataFrame([(n, n + 1) for n in parent if n % 3], "node int, w long")
    sums = {r["node"]: r["total"] for r in labels.subtree_sums(made, values, "w").collect()}
    assert sums == {n: sum(m + 1 for m in parent if m % 3 and (m == n or n in up(m))) for n in parent if n not in on_cycle}
    assert labels.interval_labels(df.limit(0)).count() == 0


def test_labels_of_a_shallow_forest_move_each_node_a_few_times(spark, monkeypatch):
    made, want, hot = [], {}, 40
    write = labels.bucketed
    monkeypatch.setattr(labels, "bucketed", lambda *a: made.append(write(*a)) or made[-1])
    counts = []
    monkeypatch.setattr(labels, "discard", lambda *t: counts.extend(x.count() for x in t))
    monkeypatch.setattr(labels, "CHILDREN", hot // 2)  # the hot parent's leaves go over ranges
    pairs = [(f"c{i}", None) for i in range(5)] + [(f"o{i}", f"c{i % 4}") for i in range(20)]
    pairs += [(f"l{i}", f"o{i % 18}") for i in range(100)] + [(f"h{i}", "c4") for i in range(hot)] + [("lost", "nobody")]
    found = {r["node"]: r for r in labels.interval_labels(spark.createDataFrame(pairs, "node string, parent string")).collect()}
    assert sum(counts) <= 5 * len(pairs)  # pointers along a walk of 2 steps a node came to more than 20 rows a node
    up = dict(pairs)
    for n in up:
        path = [n]
        while up.get(path[-1]) in up:
            path.append(up[path[-1]])
        for a in path:
            want.setdefault(a, set()).add(n)
        assert (found[n]["root"], found[n]["depth"]) == (path[-1], len(path) - 1)
    assert {n: r["size"] for n, r in found.items()} == {n: len(below) for n, below in want.items()}
    inside = lambda a, d: found[a]["root"] == found[d]["root"] and found[a]["low"] <= found[d]["low"] < found[a]["high"]
    assert all({d for d in up if inside(a, d)} == want[a] for a in up)


def test_labels_bring_totals_with_nulls_chains_cycles_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(labels, "CHILDREN", 8)  # parents of more leaves go over ranges
    parent = {0: None, 100: None, 101: 77} | {i: 0 for i in range(1, 15)} | {20 + i: 1 + i % 3 for i in range(9)}
    parent |= {200: 201, 201: 200, 202: 201} | {300 + i: 299 + i for i in range(1, 14)} | {300: 0}  # a cycle, what hangs on it, a chain
    value = {n: None if n in parent and n % 3 == 0 else n for n in parent}
    more = [(5, 0, 1000), (5, 9, 2000), (25, parent[25], None)]  # the least parent counts, all values do
    df = spark.createDataFrame([*((n, p, value[n]) for n, p in parent.items()), *more], "node int, parent int, v int")
    want = {}
    for n in [n for n in parent if n not in (200, 201, 202)]:
        values, at = [v for v in (value[n], *(v for m, _, v in more if m == n)) if v is not None], n
        while at in parent:
            want.setdefault(at, []).extend(values)
            at = parent[at]
    want = {n: sum(v) if v else None for n, v in want.items()} | dict.fromkeys((200, 201, 202))
    assert None in (want[300 + 12], want[9]) and want[300] > 0
    made = labels.interval_labels(df, "v")
    assert {r["node"]: r["total"] for r in made.collect()} == want
    assert made.schema["total"].dataType.typeName() == "long" and made.count() == len(parent)
    chain = df.filter("node >= 200")  # nothing but the walk's
    assert {r["node"]: r["total"] for r in labels.interval_labels(chain, "v").collect()} == {n: want[n] for n in want if n >= 200}
    assert "total" in labels.interval_labels(df.limit(0), "v").columns and labels.interval_labels(df.limit(0), "v").count() == 0


def test_hierarchy_labels_write_each_node_a_few_times(spark, monkeypatch):
    made = []
    for module, name in ((labels, "bucketed"), (labels, "settled"), (graph_queries, "settled"), (running, "written")):
        monkeypatch.setattr(module, name, lambda *a, write=getattr(module, name): made.append(write(*a)) or made[-1])
    monkeypatch.setattr(labels, "discard", lambda *t: None)  # what is written stays, to be counted
    nodes = graph_queries.hierarchy_labels(spark, "/root/testdata/sf0.001").count()
    assert sum(t.count() for t in made) <= 3.5 * nodes  # all rows to their nodes, leaves once more; sums over ranges of places came to 7.7


def test_scopes_match_a_stack(spark):
    rng = random.Random(6)
    kinds = ["open"] * 4 + ["close"] * 4 + ["declare", "use", "use"]
    events = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice(kinds), rng.choice("xy")) for i in range(300)]
    df = spark.createDataFrame(events, "k string, at int, kind string, name string")
    got = {r["at"]: r for r in scopes.bound(df, ["k"], ["at"], F.col("kind") == "open", F.col("kind") == "close", "at").collect()}
    means = {r["at"]: r["bound"] for r in scopes.resolved(df, ["k"], ["at"], "name", "kind", "at").collect()}
    stacks, seen = {}, set()
    for k, at, kind, name in events:
        stack = stacks.setdefault(k, [(None, {})])
        if kind == "open":
            stack.append((at, {}))
        elif kind == "close" and len(stack) > 1:
            stack.pop()
        elif kind == "declare":
            stack[-1][1][name] = at
        elif kind == "use":
            seen.add(at)
            assert means[at] == next((d[name] for _, d in reversed(stack) if name in d), None), at
        assert (got[at]["depth"], got[at]["scope"]) == (len(stack) - 1, stack[-1][0])
    assert set(means) == seen


def test_asof_takes_the_last_before(spark):
    left = spark.createDataFrame([("a", 1, "p"), ("a", 5, "q"), ("b", 9, "r"), (None, 3, "s"), ("c", 1, "t")], "k string, at int, v string")
    right = spark.createDataFrame([("a", 1, "one"), ("a", 4, None), ("b", 10, "no"), (None, 2, "null")], "k string, at int, w string")
    got = lambda **more: rows(scopes.asof(left, right, ["k"], ["at"], ["w"], **more), "v", "w")
    assert got() == [("p", "one"), ("q", None), ("r", None), ("s", "null"), ("t", None)]
    assert got(strict=True) == [("p", None), ("q", None), ("r", None), ("s", "null"), ("t", None)]
    plan = scopes.asof(left, right, ["k"], ["at"], ["w"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_null_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 1, 7, "m"), (None, 2, 7, "m"), ("a", 3, 7, "m")], "k string, v int, total int, rank string")
    top = search.top_per_group(df, ["k"], [F.col("v")], 1)
    assert rows(top, "k", "v", "rank_", "total_") == sorted([(None, 1, 1, 2), ("a", 3, 1, 1)], key=str)
    assert rows(search.first_per_key(df, ["k"], [F.desc("v")]), "k", "v", "rank") == sorted([(None, 2, "m"), ("a", 3, "m")], key=str)
    assert rows(search.top_with_total(df, [F.col("v")], 2), "v", "total", "total_") == [(1, 7, 3), (2, 7, 3)]
    names = spark.createDataFrame([("a.b", "x", 1)], "n string, match string, __name int")
    found = interval.longest_prefix(names, "n", spark.createDataFrame([("a",)], "p string"), "p")
    assert rows(found, "n", "match", "__name", "match_") == [("a.b", "x", 1, "a")]
    points = spark.createDataFrame([("f", 5, "p")], "k string, pos int, __cell string")
    spans = spark.createDataFrame([("f", 0, 9, "s")], "k string, s int, e int, cell string")
    assert rows(interval.containing(points, spans, "k", "pos", "s", "e", 4), "__cell", "cell") == [("p", "s")]
    pieces = spark.createDataFrame([(1, 0, 2, 5), (1, 2, 3, 5), (1, 9, 10, 5)], "g int, a int, b int, __island int")
    assert rows(edits.merge_adjacent(pieces, ["g"], "a", "b"), "island_start", "island_end", "pieces") == [(0, 3, 2), (9, 10, 1)]


def test_snapshots_with_null_and_repeated_keys(spark):
    side = lambda data: spark.createDataFrame(data, "k string, h string")
    was = side([(None, "1"), ("a", "1"), ("a", "2"), ("b", "1"), ("c", None), ("d", "1"), ("e", "1"), ("e", "1"), ("g", None)])
    now = side([(None, "1"), ("a", "2"), ("a", "1"), ("b", "2"), ("c", None), ("e", "1"), ("f", None), ("g", "1")])
    assert rows(diff.snapshot_diff(was, now, "k", "h"), "k", "change") == [("b", "edited"), ("d", "deleted"), ("e", "edited"), ("f", "added"), ("g", "edited")]
    assert rows(diff.snapshot_diff(side([(None, "1")]), side([]), "k", "h"), "k", "change") == [(None, "deleted")]


def test_locals_of_blocks_beside_each_other_are_two(spark, tmp_path):
    from codeseam.plans.store import FactStore
    from codeseam.plans.tools import query

    source = tmp_path / "src/src/main/java/p/A.java"
    source.parent.mkdir(parents=True)
    lines = ["package p;", "class A {", "  int m(int n) {", "    if (n > 0) { int x = n; n += x; }", "    for (int x = 0; x < n; x++) { n -= x; }", "    int x = n;", "    return x;", "  }", "}"]
    source.write_text("\n".join(lines))
    (tmp_path / "src/pom.xml").write_text("<project/>")
    store = FactStore(spark, str(tmp_path / "src"), str(tmp_path / "facts"))
    store.load()
    path = "src/main/java/p/A.java"
    at = lambda line, text: {"file": path, "line": line, "column": lines[line].index(text)}
    places = lambda place: rows(query(store.resolved, "rename_symbol", new_name="y", **place), "line", "col")
    assert places(at(3, "x = n")) == [(3, 21), (3, 33)]
    assert places(at(4, "x = 0")) == [(4, 13), (4, 20), (4, 27), (4, 39)]
    assert places(at(5, "x = n")) == [(5, 8), (6, 11)]
    assert len(places(at(2, "n) {"))) == 7
