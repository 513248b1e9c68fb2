"""Indexed globs, budgets, edits in DataFrame terms and payload digests against plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from codeseam.functions import text as T
from codeseam.operators import edits, payload
from codeseam.operators.postings import GlobIndex


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_indexed_globs_equal_a_scan(spark, tmp_path):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcAé") for _ in range(rng.randrange(0, 7))) for _ in range(400)} | {"a\nb", "x*y", "ab", "日本語"}
    names = lambda some: spark.createDataFrame([(w,) for w in [*some, None]], "n string")
    index = GlobIndex(spark, str(tmp_path / "index"))
    index.refresh("one", names([*words, "ab"]), "n")
    index.refresh("two", names(["abcabc"]), "n")
    for glob in ("*abc*", "ab*", "*ca", "a?c*", "ab", "", "*", "?", "*é*a*", "b*b*b", "zzz*", "??????", "*語"):
        for case in (False, True):
            want = rows(names(words).distinct().filter(T.glob_match(F.col("n"), glob, ignore_case=case)), "n")
            assert rows(index.search(glob, ["one"], case), "name") == want, (glob, case)
    assert rows(index.search("abc*bc"), "source", "name")[-1] == ("two", "abcabc")
    index.refresh("two", names(["bbb"]), "n")
    assert ("two", "abcabc") not in rows(index.search("abc*"), "source", "name") and ("two", "bbb") in rows(index.search("bbb"), "source", "name")
    assert ("one", "ab") in rows(index.search("ab"), "source", "name")


def test_a_rare_gram_reads_few_postings(spark, tmp_path):
    index = GlobIndex(spark, str(tmp_path / "index"))
    index.refresh("s", spark.range(60_000).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("name")))
    assert index.rarest("*name*12345*") in ("123", "234", "345")
    read = {}
    for gram in ("nam", index.rarest("*name*59999*")):
        found = index.postings().filter(F.col("gram") == gram)
        plan = found._jdf.queryExecution()
        found.write.format("noop").mode("overwrite").save()
        assert "PushedFilters: [IsNotNull(gram), EqualTo(gram" in plan.executedPlan().toString()
        read[gram] = found.count()
    assert min(read.values()) * 50 < max(read.values())


def test_globs_without_grams_scan_names_and_not_postings(spark, tmp_path):
    index = GlobIndex(spark, str(tmp_path / "index"))
    index.refresh("a", spark.createDataFrame([("to",), ("",), (None,), ("jazzy",), ("to",)], "name string"))
    index.refresh("b", spark.createDataFrame([("go",), ("to",)], "name string"))
    found = lambda glob, **more: sorted(map(tuple, index.search(glob, **more).collect()))
    assert found("?o") == [("a", "to"), ("b", "go"), ("b", "to")]
    assert found("*zz*") == [("a", "jazzy")] and found("*", sources=["a"]) == [("a", ""), ("a", "jazzy"), ("a", "to")]
    assert all("/names/" in path for path in index.search("*").inputFiles())
    index.refresh("a", spark.createDataFrame([("do",)], "name string"))
    assert found("?o") == [("a", "do"), ("b", "go"), ("b", "to")]



def test_edits_as_pieces_match_splicing(spark):
    rng = random.Random(1)
    texts, todo, want = [], [], {}
    for k in range(30):
        t = "".join(rng.choice("ab\né😀") for _ in range(rng.randrange(0, 40)))
        at, own = 0, []
        while at < len(t) and rng.random() < 0.8:
            a = rng.randrange(at, len(t) + 1)
            b = rng.randrange(a, len(t) + 1)
            if own and own[-1][1] == a == b:
                break
            own.append((a, b, rng.choice(["", "X", "Ωy", None])))
            at = b
        out = t
        for a, b, new in reversed(own):
            out = out[:a] + (new or "") + out[b:]
        texts.append((k, t, "keep"))
        todo += [(k, *e) for e in own]
        want[k] = out
    texts += [(100, None, "keep"), (101, "as is", "keep")]
    rng.shuffle(todo)
    files, df = spark.createDataFrame(texts, "file int, content string, start string"), spark.createDataFrame(todo, "file int, start int, end int, new_text string")
    got = edits.applied(files, df, "file", "content")
    assert got.columns == files.columns
    assert rows(got, "file", "content") == sorted([*want.items(), (100, None), (101, "as is")], key=str)
    assert edits.crossings(df, ["file"]).count() == 0
    long = spark.createDataFrame([(1, "ab" * 200_000)], "file int, content string")
    many = spark.range(100_000).select(F.lit(1).alias("file"), (F.col("id") * 4).cast("int").alias("start"), (F.col("id") * 4 + 1).cast("int").alias("end"), F.lit("Z").alias("new_text"))
    assert edits.applied(long, many, "file", "content").first()["content"] == "Zbab" * 100_000


def test_crossing_edits_are_rows(spark):
    spans = [("f", 0, 5), ("f", 5, 5), ("f", 5, 9), ("f", 7, 8), ("f", 8, 12), ("g", 0, 9), ("g", 3, 3), ("g", 9, 10), (None, 0, 2), (None, 1, 3)]
    df = spark.createDataFrame(spans, "file string, start int, end int")
    assert rows(edits.crossings(df, ["file"]), "file", "start", "end", "reach") == sorted([("f", 7, 8, 9), ("f", 8, 12, 9), ("g", 3, 3, 9), (None, 1, 3, 2)], key=str)


def test_replacements_equal_the_plain_ones(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("aé😀") for _ in range(rng.randrange(0, 9))), "".join(rng.choice("aé😀") for _ in range(rng.randrange(0, 9)))) for _ in range(150)]
    pairs += [("same", "same"), ("", "x"), ("aaaa", "aa"), ("x" * 5000 + "1" + "y" * 4000, "x" * 5000 + "22" + "y" * 4000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pairs, (None, "a"), ("a", None)])], "i int, a string, b string")
    got = {r["i"]: tuple(r["r"]) if r["r"] else None for r in df.select("i", edits.replacement(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got == {i: edits.minimal_replacement(a, b) for i, (a, b) in enumerate(pairs)} | {len(pairs): None, len(pairs) + 1: None}


def digest(x):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if isinstance(x, dict):
        return sha("{" + ",".join(sorted(sha(k) + ":" + digest(v) for k, v in x.items() if v is not None and k not in payload.VOLATILE)))
    if isinstance(x, list):
        return sha("[" + ",".join(sorted(map(digest, x))))
    return sha("null" if x is None else "s" + x if isinstance(x, str) else ("b" if isinstance(x, bool) else "n") + json.dumps(x))


def shuffled(x, rng):
    if isinstance(x, dict):
        items = [(k, shuffled(v, rng)) for k, v in x.items()] + ([("uptime", rng.randrange(99))] if rng.random() < 0.5 else [])
        rng.shuffle(items)
        return dict(items)
    if isinstance(x, list):
        out = [shuffled(v, rng) for v in x]
        rng.shuffle(out)
        return out
    return x


def test_payload_digests(spark):
    rng = random.Random(7)

    def made(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind < 4:
            return rng.choice([1, 2, "1", "é\"/,", True, False, None, 0, ""])
        if kind == 4:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abc/:") + str(i): made(depth - 1) for i in range(rng.randrange(4))}

    values = [made(4) for _ in range(60)] + [{}, [], [[]], {"a": None}, {"a": {"b": [{"c": [None]}]}}]
    texts = [(i, json.dumps(shuffled(v, rng), ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values) for _ in range(2)]
    df = spark.createDataFrame([*texts, (900, None), (901, "{not json")], "digest int, json string")
    got = payload.canonical_digests(df, "json", out="made")
    assert got.columns == ["digest", "json", "made"]
    assert {(r["digest"], r["made"]) for r in got.collect()} == {(i, digest(v)) for i, v in enumerate(values)} | {(900, None), (901, None)}
    assert payload.canonical_digests(df.limit(0), "json").count() == 0


def test_first_rows_read_few_groups(spark, tmp_path):
    from codeseam.operators.budget import Grouped

    rng = random.Random(5)
    data = [(rng.choice([None, *range(500)]), i, "xy"[i % 2]) for i in range(4000)]
    grouped = Grouped(spark, str(tmp_path / "g"), "v").write(spark.createDataFrame(data, "v int, group int, s string"), 40)
    for last in (False, True):
        key = lambda r: (r[0] is None, (-r[0] if last else r[0]) if r[0] is not None else 0, r[1])  # noqa: E731, B023
        for k, where in ((0, None), (1, None), (30, None), (30, "s = 'x'"), (5, "s = 'z'"), (3990, None), (9000, None)):
            want = sorted((r for r in data if where is None or f"s = '{r[2]}'" == where), key=key)[:k]
            found = grouped.first(k, last, ["group"], where)
            assert [tuple(r) for r in found.rows.collect()] == want, (last, k, where)
            assert found.total == 4000 and (found.groups_read <= 3) == (k <= 30 and where != "s = 'z'")
            assert (found.seen == 4000) == (found.groups_read == found.groups)
    empty = Grouped(spark, str(tmp_path / "e"), "v").write(spark.createDataFrame([(None, 1, "x")], "v int, group int, s string"), 3)
    assert [tuple(r) for r in empty.first(2, True, []).rows.collect()] == [(None, 1, "x")]


def test_a_round_exchanges_the_frontier_alone(spark):
    from codeseam.operators.graph import onward
    from codeseam.operators.shared import bucketed, settled

    steps = bucketed(spark, spark.range(5000).selectExpr("id as src", "id * 7 % 5000 as dst"), "src")
    frontier = settled(spark.range(2000).select(F.col("id").alias("node")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = onward(frontier, steps)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # one for the frontier, one for the distinct nodes it leads to
    assert plan.count("Exchange hashpartitioning(node") == plan.count("Exchange ") == 2 and "SortMergeJoin" in plan
    small = onward(frontier.limit(3), steps)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(src" not in small


def test_replacement_compares_ends_from_behind(spark):
    pairs = [("\U0001f600x" * 5000 + "a" + "é" * 70000, "\U0001f600x" * 5000 + "bb" + "é" * 70000), ("aa", "aaa"), ("", "q"), ("xyx", "x")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", edits.replacement(F.col("a"), F.col("b")).alias("r"))
    for r in df.collect():
        assert tuple(r["r"]) == edits.minimal_replacement(r["a"], r["b"])
    assert "reverse(" not in df._jdf.queryExecution().optimizedPlan().toString()  # it was computed again for every step


def test_payloads_of_few_levels_are_digested_in_their_rows(spark, monkeypatch):
    few = ['{"a": [1, null, {"b": 1.50, "n": null, "uptime": 3}], "c": {}}', '[]', '"x"', 'null', '1e3', 'true', None, '{oops', '[[["q"], []], null]', '{"t": "", "u": []}']
    deep = ['[[[[["d", {"k": [2]}]]]]]', '{"a": {"b": {"c": {"d": {"e": null, "f": 1}}}}}']
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "i int, json string")
    digests = lambda texts: {r["i"]: r["digest"] for r in payload.canonical_digests(frame(texts), "json").collect()}
    in_rows = digests(few + deep)
    monkeypatch.setattr(payload, "_in_row", lambda v, *more: F.lit(None).cast("string"))
    assert digests(few + deep) == in_rows and len(set(in_rows.values())) == 11
    monkeypatch.undo()
    tables, settle = [], payload.settled
    monkeypatch.setattr(payload, "settled", lambda df: tables.append(settle(df)) or tables[-1])
    digests(few)
    assert len(tables) == 1
