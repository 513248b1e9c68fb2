"""A small project of our own: parsing, resolution, queries, freshness."""

import pytest
from pyspark.sql import functions as F

from codeseam.operators import graph
from codeseam.operators.diff import SourceMissing
from codeseam.operators.search import InvalidParameter
from codeseam.plans.store import FactStore, ReloadRequired
from codeseam.plans.tools import TOOLS, SymbolNotFound, query
from codeseam.sources import tree
from codeseam.sources.facts import extract, loc
from codeseam.sources.java_lexer import SyntaxProblem
from codeseam.sources.java_parser import parse

FILES = {
    "pom.xml": "<project><properties><maven.compiler.source>17</maven.compiler.source></properties><modules><module>a</module></modules></project>",
    "src/main/java/shop/Main.java": '''package shop;

import java.util.List;
import java.util.Map;
import shop.core.Basket;

/** Starts it. */
public class Main {
    public static void main(String[] args) {
        Basket b = new Basket();
        b.add("x");
        Priced p = b;
        p.price();
    }

    private int unused() { return 1; }
    private String name = null;
    int Bad_Name;
}
''',
    "src/main/java/shop/Priced.java": "package shop;\n\npublic interface Priced {\n    int price();\n}\n",
    "src/main/java/shop/core/Basket.java": '''package shop.core;

import shop.Priced;

public class Basket implements Priced {
    private int total;
    static final int LIMIT = 10;

    public void add(String item) {
        if (item == "free" || item.isEmpty() || item.length() > LIMIT) {
            return;
        }
        for (int i = 0; i < 3; i++) {
            total += item.length();
        }
        try {
            check(item);
        } catch (RuntimeException e) {
        }
    }

    @Override
    public int price() { return total; }

    private void check(String text) {
        String s = null;
        Object o = (Object) text;
        if (o instanceof String t && t.length() > 2) { use(s); }
    }

    void use(String given) { given.trim(); }

    void dead() { dead2(); }
    void dead2() { }
}
''',
    "src/test/java/shop/BasketTest.java": '''package shop;

import org.junit.jupiter.api.Disabled;
import org.junit.jupiter.api.Test;
import shop.core.Basket;

class BasketTest {
    @Test void adds() { new Basket().add("y"); }
    @Test @Disabled void later() { }
}
''',
    "build/skipped/Gone.java": "package gone; class Gone { }",
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """A loaded project that no test changes."""
    return made(spark, tmp_path_factory.mktemp("shared"))


@pytest.fixture
def project(spark, tmp_path):
    """A loaded project of a test's own."""
    return made(spark, tmp_path)


def made(spark, tmp_path):
    root = tmp_path / "shop"
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    store = FactStore(spark, str(root), str(tmp_path / "facts"))
    return store, root, store.load()


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


MAIN, BASKET = "src/main/java/shop/Main.java", "src/main/java/shop/core/Basket.java"


def test_load_and_structure(loaded):
    store, _, summary = loaded
    assert summary["buildSystem"] == "MAVEN" and summary["files"] == 4 and summary["packages"] == ["shop", "shop.core"] and summary["problems"] == 0
    r = store.resolved
    assert rows(query(r, "get_project_structure"), "root", "package", "files") == [("src/main/java", "shop", 2), ("src/main/java", "shop.core", 1), ("src/test/java", "shop", 1)]


def test_graph_of_the_loaded(loaded):
    r = loaded[0].resolved
    edges = set(rows(r.edges))
    assert {
        ("shop.Main#main(String[])", "shop.core.Basket", "CREATES"), ("shop.Main#main(String[])", "shop.core.Basket#add(String)", "CALLS"), ("shop.Main#main(String[])", "shop.Priced#price()", "CALLS"),
        ("shop.core.Basket#add(String)", "shop.core.Basket#total", "WRITES"), ("shop.core.Basket#add(String)", "shop.core.Basket#total", "READS"), ("shop.core.Basket#add(String)", "shop.core.Basket#LIMIT", "READS"),
        ("shop.core.Basket#add(String)", "shop.core.Basket#check(String)", "CALLS"), ("shop.core.Basket#check(String)", "shop.core.Basket#use(String)", "CALLS"),
    } <= edges
    assert rows(r.overrides) == [("shop.core.Basket#price()", "shop.Priced#price()")]
    dead = {k for (k,) in rows(query(r, "find_unreachable_code"), "key")}
    assert dead == {"shop.Main#unused()", "shop.Main#name", "shop.Main#Bad_Name", "shop.core.Basket#dead()", "shop.core.Basket#dead2()"}
    callers = {k for (k,) in rows(graph.transitive_callers(r.edges, r.overrides, r.nodes, "shop.core.Basket#price()"))}
    assert callers == {"shop.Main#main(String[])"}


def test_long_chains_are_settled(spark, tmp_path):
    root = tmp_path / "fluent"
    root.mkdir()
    steps = [f"s{i}" for i in range(7)]
    links = " ".join(f"class T{i} {{ T{i + 1} s{i}() {{ return new T{i + 1}(); }} }}" for i in range(7))
    (root / "Fluent.java").write_text(f"class Fluent {{ void run() {{ new T0().{'().'.join(steps)}(); }} }} {links} class T7 {{ }}")
    store = FactStore(spark, str(root), str(tmp_path / "facts"))
    store.load()
    called = {k for (k,) in rows(store.resolved.calls.filter("name like 's_'"), "target_key")}
    assert called == {f"T{i}#s{i}()" for i in range(7)}


@pytest.mark.parametrize("k", [0, 1, 4, 5, 6, 10**6])
def test_limits_keep_exact_totals(loaded, k):
    found = query(loaded[0].resolved, "find_unreachable_code", max_results=k)
    assert found.filter("key is not null").count() == min(k, 5)
    assert {t for (t,) in rows(found, "total")} == {5}  # told even where nothing is shown
    assert query(loaded[0].resolved, "search_symbols", query="No*", max_results=k).count() == 0


def test_bad_arguments(loaded):
    r = loaded[0].resolved
    with pytest.raises(InvalidParameter):
        query(r, "find_unreachable_code", max_results=-1)
    with pytest.raises(InvalidParameter):
        query(r, "get_symbol_info", file=MAIN, line=-1, column=0)
    with pytest.raises(InvalidParameter):
        query(r, "nothing")
    with pytest.raises(InvalidParameter):
        query(r, "rename_symbol", file=BASKET, line=8, column=17, new_name="class")
    with pytest.raises(SymbolNotFound):
        query(r, "get_symbol_info", file=MAIN, line=6, column=5)  # in a comment


def test_places_and_references(loaded):
    r = loaded[0].resolved
    assert rows(query(r, "go_to_definition", file=MAIN, line=10, column=11), "key") == [("shop.core.Basket#add(String)",)]
    assert rows(query(r, "get_enclosing_element", file=MAIN, line=10, column=11), "method", "type") == [("shop.Main#main(String[])", "shop.Main")]
    sites = rows(query(r, "find_references", file=BASKET, line=8, column=18), "file", "line")
    assert sorted(sites) == [(MAIN, 10), ("src/test/java/shop/BasketTest.java", 7)]
    assert rows(query(r, "find_casts", type_name="Object"), "line") == [(26,)]
    assert rows(query(r, "find_instanceof_checks", type_name="String"), "line") == [(27,)]
    assert rows(query(r, "find_catch_blocks", type_name="RuntimeException"), "line") == [(17,)]
    assert rows(query(r, "find_implementations", file="src/main/java/shop/Priced.java", line=2, column=19), "key") == [("shop.core.Basket",)]
    assert rows(query(r, "get_super_method", file=BASKET, line=22, column=17), "key") == [("shop.Priced#price()",)]
    assert rows(query(r, "find_affected_tests", file=BASKET, line=24, column=18), "key", "disabled") == [("shop.BasketTest#adds()", False)]


def test_rename_covers_the_family(loaded):
    r = loaded[0].resolved
    got = rows(query(r, "rename_symbol", file=BASKET, line=22, column=17, new_name="cost"), "file", "line", "col", "position")
    assert sorted((f, n) for f, n, _, _ in got) == [(MAIN, 12), ("src/main/java/shop/Priced.java", 3), (BASKET, 22)]


CLASSES = {
    "src/a/Base.java": "package a;\n\npublic class Base {\n    int keep;\n\n    /** Both. */\n    public int both(int x, String s) {\n        return x + s.length();\n    }\n}\n",
    "src/a/Child.java": "package a;\n\npublic class Child extends Base {\n    private int own() { return both(1 + 2, \"y\"); }\n    void refer() { F f = this::both; }\n    int twice() { return own() * 2; }\n}\n",
    "src/a/F.java": "package a;\n\ninterface F { int go(int x, String s); }\n",
}


def test_rewrites_across_files(spark, tmp_path):
    from codeseam.operators.edits import apply_edits
    from codeseam.sources.java_parser import parse

    for name, text in CLASSES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    store = FactStore(spark, str(tmp_path), str(tmp_path / "facts"))
    store.load()
    r = store.resolved
    base, child = "src/a/Base.java", "src/a/Child.java"

    def applied(name, **arguments):
        out = dict(CLASSES)
        made = {}
        for e in query(r, name, **arguments).collect():
            if e["start"] is None:
                out[e["file"]] = e["new_text"]
            elif not e["warnings"]:
                made.setdefault(e["file"], []).append((e["start"], e["length"], e["new_text"]))
        for file, todo in made.items():
            out[file] = apply_edits(out[file], todo)
        for text in out.values():
            parse(text)
        return out

    up = applied("pull_up", file=child, line=3, column=17)
    assert "own()" in up[base] and "protected int own()" in up[base] and "private int own" not in up[child]
    down = applied("push_down", file=base, line=6, column=16)
    assert "both(int x" in down[child] and "/** Both. */" in down[child] and "both(int x" not in down[base] and "int keep;" in down[base]
    top = applied("extract_superclass", file=base, line=6, column=16, superclass_name="Root")
    assert "class Base extends Root {" in top[base] and "public int both" in top["src/a/Root.java"]
    inlined = applied("inline_method", file=child, line=5, column=27)
    assert 'return both(1 + 2, "y") * 2;' in inlined[child]
    swapped = applied(
        "change_method_signature", file=base, line=6, column=16, new_name="sum", new_return_type="long",
        new_parameters=[{"type": "String", "name": "s"}, {"type": "int", "name": "x"}, {"type": "boolean", "name": "b", "default": "true"}],
    )
    assert "public long sum(String s, int x, boolean b)" in swapped[base] and 'sum("y", 1 + 2, true)' in swapped[child]
    warned = [e["warnings"] for e in query(r, "change_method_signature", file=base, line=6, column=16, new_name="sum").collect() if e["warnings"]]
    assert warned == ["method reference, not rewritten"]
    boxed = applied("introduce_parameter_object", file=base, line=6, column=16)
    assert "both(BothParameters parameterObject)" in boxed[base] and "parameterObject.getX() + parameterObject.getS().length()" in boxed[base]
    assert 'both(new Base.BothParameters(1 + 2, "y"))' in boxed[child]


def test_rules(loaded):
    r = loaded[0].resolved
    assert rows(query(r, "find_unused_code"), "key") == [("shop.Main#unused()",), ("shop.Main#name",)]
    assert ("Bad_Name", "camelCase") in rows(query(r, "find_naming_violations"), "name", "expected")
    codes = {c for (c,) in rows(query(r, "find_possible_bugs"), "code")}
    assert codes == {"EMPTY_CATCH", "STRING_COMPARISON"}
    flows = rows(query(r, "find_flows"), "method", "variable", "steps", "sink")
    assert flows == [("shop.core.Basket#check(String)", "s", "argument 0 given @27", "given.trim()")]
    metrics = {m: (cc, cog) for m, cc, cog in rows(query(r, "get_complexity_metrics", file=BASKET), "method_key", "cyclomatic", "cognitive")}
    # if, one || chain, for, catch; cognitive: if 1, chain 1, for 1, try 1, catch inside it 2
    assert metrics["shop.core.Basket#add(String)"] == (5, 6)
    assert rows(query(r, "find_circular_dependencies"), "members", "severity") == [("shop,shop.core", "medium")]
    assert rows(query(r, "find_tests", include_disabled=True), "test_class", "framework", "tests") == [("shop.BasketTest", "JUnit5", ["adds", "later"])]
    unused = {m for (m,) in rows(query(r, "get_diagnostics").filter("category = 'unused_import'"), "message")}
    assert unused == {"unused import java.util.List", "unused import java.util.Map"}
    assert "import shop.core.Basket;" == rows(query(r, "organize_imports", file=MAIN), "new_text")[0][0]


def test_every_query_builds(loaded):
    r = loaded[0].resolved
    import inspect

    place = {"file": BASKET, "line": 8, "column": 18}
    special = {
        "search_symbols": {"query": "B*"}, "rename_symbol": {**place, "new_name": "put"}, "extract_interface": {**place, "interface_name": "Cart"}, "apply_quick_fix": {"file": MAIN, "fix_id": "remove_import:java.util.List"},
        "find_field_writes": {"file": BASKET, "line": 5, "column": 17}, "encapsulate_field": {"file": BASKET, "line": 5, "column": 17}, "get_dependency_graph": {"scope": "type", "name": "Basket"}, "suggest_imports": {"type_name": "Basket"}, "get_type_hierarchy": {"type_name": "Basket"}, "validate_syntax": {"content": "class A {"},
    }
    ranged = {"start_line": 13, "end_line": 13}
    special |= {
        "extract_variable": {"file": BASKET, **ranged, "start_column": 21, "end_column": 34}, "extract_constant": {"file": BASKET, "start_line": 9, "start_column": 20, "end_line": 9, "end_column": 26, "constant_name": "FREE"},
        "extract_method": {"file": BASKET, "start_line": 12, "start_column": 8, "end_line": 14, "end_column": 9, "method_name": "loop"}, "apply_cleanup": {"file": BASKET, "cleanup_id": "invert_equals"},
    }
    refused = {"inline_variable", "convert_anonymous_to_lambda", "move_type_to_new_file", "pull_up", "push_down", "inline_method", "extract_superclass"}
    for name, build in TOOLS.items():
        if name in refused:
            with pytest.raises(ValueError):
                query(r, name, **place, **({"superclass_name": "class"} if name == "extract_superclass" else {}))
            continue
        needs = [p for p, v in inspect.signature(build).parameters.items() if v.default is inspect.Parameter.empty][1:]
        arguments = special.get(name) or {p: {**place, "type_name": "Basket"}[p] for p in needs}
        assert query(r, name, **arguments).columns, name


def test_generated_sources_and_jars(spark, tmp_path):
    import zipfile

    places = {
        "src/main/java/a/A.java": "src/main/java", "target/generated-sources/jaxws/a/B.java": "target/generated-sources/jaxws", "m/target/generated-test-sources/x/T.java": "m/target/generated-test-sources/x",
        "build/generated/sources/mapper/java/main/C.java": "build/generated/sources/mapper/java/main", "src/D.java": "src", "E.java": "",
    }
    for name in [*places, "target/classes/F.java", "build/generated/other/G.java", "bazel-bin/H.java"]:
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("class X { }")
    found = tree.source_files(spark, str(tmp_path / "tree"))
    assert {p: r for p, r in rows(found.select("path", tree.source_root(F.col("path")).alias("r")), "path", "r")} == places
    for name, entry in (("bazel-bin/a.jar", "META-INF/services/javax.annotation.processing.Processor"), ("bazel-out/x/b.jar", "c/D.class"), ("lib/c.jar", "e/F.class")):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(zipfile.ZipInfo(entry), "x")
    (tmp_path / "tree/bazel-out/copy.jar").write_bytes((tmp_path / "tree/bazel-bin/a.jar").read_bytes())
    (tmp_path / "tree/bazel-out/torn.jar").write_bytes(b"PK no jar")
    got = dict(rows(tree.jars(spark, str(tmp_path / "tree"), ("bazel-bin", "bazel-out")), "path", "is_processor"))
    assert got == {"bazel-bin/a.jar": True, "bazel-out/x/b.jar": False, "bazel-out/torn.jar": False}
    assert len(rows(tree.jars(spark, str(tmp_path / "tree")), "path")) == 4


def test_folders_follow_the_size_and_lookups_read_one(spark, tmp_path, monkeypatch):
    from codeseam.plans import store as plans_store

    monkeypatch.setattr(plans_store, "FILES_PER_BUCKET", 4)
    root = tmp_path / "many"
    root.mkdir()
    for i in range(30):
        (root / f"C{i}.java").write_text(f"class C{i} {{ int held; int get() {{ return held; }} }}")
    store = FactStore(spark, str(root), str(tmp_path / "facts"))
    store.load()
    assert store.buckets == 8 and 2 <= len(list((tmp_path / "facts/facts").glob("bucket=*"))) <= 8
    one = store.resolved.file("C7.java")
    assert one.count() == 1 and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket" in plan.split("PartitionFilters")[1]
    assert rows(query(store.resolved, "go_to_definition", file="C7.java", line=0, column=43), "key") == [("C7#held",)]
    for i in range(0, 30, 2):
        (root / f"C{i}.java").unlink()
    (root / "C7.java").write_text("class C7 { }")
    (root / "D.java").write_text("class D { }")
    changed = FactStore(spark, str(root), str(tmp_path / "facts")).fresh()
    assert changed.totals == {"deleted": 15, "edited": 1, "added": 1} and changed.edited == ["C7.java"] and changed.rows.count() == 17
    again = FactStore(spark, str(root), str(tmp_path / "facts"))
    assert {p for (p,) in rows(again.facts, "path")} == {f"C{i}.java" for i in range(1, 30, 2)} | {"D.java"}
    assert not again.fresh()


def test_incremental_facts_equal_a_full_load(spark, project, tmp_path):
    store, root, _ = project
    assert not store.fresh()
    (root / MAIN).write_text(FILES[MAIN].replace("unused()", "spared()"))
    (root / "src/main/java/shop/New.java").write_text("package shop; class New { Main m; }")
    (root / "src/test/java/shop/BasketTest.java").unlink()
    changed = store.fresh()
    assert (changed.edited, changed.added, changed.deleted) == ([MAIN], ["src/main/java/shop/New.java"], ["src/test/java/shop/BasketTest.java"])
    again = FactStore(spark, str(root), str(tmp_path / "again"))
    again.load()
    key = lambda s: sorted(map(str, s.facts.drop("bucket").collect()))
    assert key(store) == key(again)
    assert rows(query(store.resolved, "find_unused_code"), "simple_name")[0] == ("spared",)
    (root / "pom.xml").write_text("<project/>")
    with pytest.raises(ReloadRequired):
        store.fresh()


def test_resolved_tables_are_kept_and_pruned(project, spark):
    store = project[0]
    first = sorted(rows(store.resolved.refs.select("file", "start", "target_key", "match_kind")), key=str)
    again = FactStore(spark, store.root, store.path).resolved
    refs = again.refs.filter("match_kind = 'METHOD' and target_key = 'shop.core.Basket#add(String)'")
    plan = refs._jdf.queryExecution().executedPlan().toString()
    assert "match_kind" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(target_key" in plan
    assert refs.count() == 2
    assert sorted(rows(again.refs.select("file", "start", "target_key", "match_kind")), key=str) == first


def test_missing_root_fails_loudly(project):
    import shutil

    store, root, _ = project
    shutil.rmtree(root)
    with pytest.raises(SourceMissing):
        store.changes()


def test_watch_refreshes(project, tmp_path):
    from codeseam.streaming.freshness import strict, watch

    store, root, _ = project
    (root / "src/main/java/shop/Extra.java").write_text("package shop; class Extra { }")
    seen = []
    stream = watch(store, str(tmp_path / "offsets"), seen.append, once=True)
    assert stream.awaitTermination(60)
    assert seen[0].added == ["src/main/java/shop/Extra.java"]
    assert store.facts.filter(F.col("path").contains("Extra")).count() == 1
    (root / "src/main/java/shop/Extra.java").unlink()
    assert strict(store, "search_symbols", query="Extra").count() == 0


# ---- front end


def test_parser_reads_modern_forms():
    source = '''
        import module java.base;
        sealed interface Shape permits Circle, Square { }
        record Circle(double r) implements Shape { Circle { if (r < 0) throw new IllegalArgumentException("r"); } }
        non-sealed class Square<T extends Comparable<T> & Runnable> implements Shape {
            @SuppressWarnings({"a", "b"}) int[] a[] = {{1}, {2}};
            <U> Map<String, List<? super U>> m(final U... us) throws Exception {
                var text = """
                    hi "there"
                    """;
                int x = a[0][0] >> 2 >>> 1, y = (int) 3L;
                Runnable q = () -> { }, z = this::m2;
                java.util.function.Function<Integer, int[]> f = int[]::new;
                String s = switch (x) { case 1, 2 -> "a"; case 3 -> { yield "b"; } default -> throw new Error(); };
                if (o instanceof Circle(double d) && d > 1) { label: for (;;) { break label; } }
                switch (o) { case String t when t.isEmpty() -> { } case null, default -> { } }
                List<String>[] l = (List<String>[]) new List[3];
                boolean b = x < y && y > (x);
                new Outer().new Inner(1) { int k; };
                do { x--; } while (x > 0);
                try (var in = open(); in) { } catch (A | B e) { } finally { }
                synchronized (this) { assert x > 0 : "no"; }
                return null;
            }
            enum E { A { int v() { return 1; } }, B(2); E(int... i) { } int v() { return 0; } }
            @interface N { int value() default 1; }
        }
    '''
    unit, comments = parse(source)
    assert [k.name for k in unit.of("TypeDeclaration")] == ["Shape", "Circle", "Square"]


@pytest.mark.parametrize("source", ["class A {", "class { }", "class A { int x = ; }", "class A { void m() { if } }", "`"])
def test_parser_reports_problems(source):
    with pytest.raises(SyntaxProblem):
        parse(source)
    assert len(extract("A.java", source.encode())["problems"]) == 1


def test_lines_and_odd_files():
    assert loc("a\n\n// c\n/* d\n e */\nb\n\n") == {"physical": 6, "blank": 1, "comment": 3, "code": 2}
    assert extract("A.java", "﻿class Ä {\r\n int ü;\r\n}".encode())["symbols"][1]["key"] == "Ä#ü"
    assert extract("A.java", b"")["symbols"] == []


def test_build_files():
    pom = "<project xmlns='x'><modules><module>b</module></modules><build><plugins><plugin><artifactId>maven-compiler-plugin</artifactId><configuration><release>21</release></configuration></plugin></plugins></build></project>"
    assert tree.maven_facts(pom)["level"] == "21"
    assert tree.maven_modules({"pom.xml": pom, "b/pom.xml": "<project><modules><module>../b</module></modules></project>"}) == [".", "b"]
    assert tree.gradle_includes("include ':app', 'lib:core'\ninclude(\"web\")") == ["app", "lib/core", "web"]
    assert tree.bazel_level(['javacopts = ["-source", "11"]', "javacopts=['--release 17']"]) == "17"


def test_compliance(spark):
    df = spark.createDataFrame([("1.5",), ("17",), ("99",), ("x",), (None,), ("8",)], "v string")
    assert rows(df.select(tree.compliance(F.col("v")))) == [("1.8",), ("17",), ("25",), ("1.8",), ("1.8",), ("1.8",)]
