"""Project queries over a small project of our own, each with its expected rows as SQL.

The sources are parsed, resolved and queried as any project is; the expected rows were derived from the sources by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.operators import graph
from codeseam.plans import tools
from codeseam.plans.resolve import Resolved
from codeseam.sources import tree

WEB = "org.springframework.web.bind.annotation"
FILES = {
    "src/main/java/shop/Main.java": """package shop;

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
""",
    "src/main/java/shop/Priced.java": "package shop;\n\npublic interface Priced {\n    int price();\n}\n",
    "src/main/java/shop/core/Basket.java": """package shop.core;

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
""",
    "src/main/java/shop/web/Orders.java": f"""package shop.web;

import {WEB}.GetMapping;
import {WEB}.PostMapping;
import {WEB}.RequestMapping;
import {WEB}.RestController;
import org.springframework.beans.factory.annotation.Autowired;
import jakarta.persistence.Entity;
import jakarta.persistence.Id;
import jakarta.persistence.ManyToOne;
import jakarta.persistence.OneToMany;
import jakarta.persistence.Table;
import java.util.List;

@RestController
@RequestMapping("/api")
public class Orders {{
    @Autowired private shop.core.Basket basket;

    @GetMapping("/orders/{{id}}") public String one(long id) throws java.io.IOException {{ return Class.forName("x").getMethod("y").toString(); }}
    @PostMapping public void make() {{ Runnable r = this::saved; r.run(); }}
    void saved() {{ }}

    @Entity @Table(name = "buyers") static class Buyer {{
        @Id long id;
        @OneToMany(mappedBy = "buyer") List<Sale> sales;
    }}

    @Entity static class Sale {{
        @Id long key;
        @ManyToOne Buyer buyer;
    }}
}}
""",
    "src/test/java/shop/BasketTest.java": """package shop;

import org.junit.jupiter.api.Disabled;
import org.junit.jupiter.api.Test;
import shop.core.Basket;

class BasketTest {
    @Test void adds() { new Basket().add("y"); }
    @Test @Disabled void later() { }
}
""",
}
MAIN, BASKET, ORDERS = "src/main/java/shop/Main.java", "src/main/java/shop/core/Basket.java", "src/main/java/shop/web/Orders.java"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SHARED: dict[str, Resolved] = {}


def project(spark: SparkSession) -> Resolved:
    """The resolved fixture, once a session."""
    key = spark.sparkContext.applicationId
    if key not in _SHARED:
        files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary")
        _SHARED.clear()
        _SHARED[key] = Resolved(tree.facts(files.coalesce(1)).persist())
    return _SHARED[key]


def values(columns: str, rows: list[tuple]) -> str:
    """The SQL of literal rows; numbers are written bare."""
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def expect(columns: str, rows: list[tuple]) -> Callable:
    """Register a query with its expected rows."""

    def add(f):
        SQL[f.__name__] = values(columns, rows)
        names = [c.strip() for c in columns.split(",")]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(project(spark)).select(*names)
        return f

    return add


@expect("key, kind", [
    ("shop.Main#unused()", "METHOD"), ("shop.Main#name", "FIELD"), ("shop.Main#Bad_Name", "FIELD"), ("shop.core.Basket#dead()", "METHOD"), ("shop.core.Basket#dead2()", "METHOD"),
    ("shop.web.Orders", "TYPE"), ("shop.web.Orders#basket", "FIELD"), ("shop.web.Orders#one(long)", "METHOD"), ("shop.web.Orders#make()", "METHOD"), ("shop.web.Orders#saved()", "METHOD"),
    ("shop.web.Orders.Buyer", "TYPE"), ("shop.web.Orders.Buyer#id", "FIELD"), ("shop.web.Orders.Buyer#sales", "FIELD"), ("shop.web.Orders.Sale", "TYPE"),
    ("shop.web.Orders.Sale#key", "FIELD"), ("shop.web.Orders.Sale#buyer", "FIELD"),
])
def java_unreachable(r):
    return tools.find_unreachable_code(r)


@expect("from_key, to_key, kind", [
    ("shop.Main#main(String[])", "shop.core.Basket", "CREATES"), ("shop.Main#main(String[])", "shop.core.Basket#add(String)", "CALLS"), ("shop.Main#main(String[])", "shop.Priced#price()", "CALLS"),
    ("shop.core.Basket#add(String)", "shop.core.Basket#total", "READS"), ("shop.core.Basket#add(String)", "shop.core.Basket#total", "WRITES"), ("shop.core.Basket#add(String)", "shop.core.Basket#LIMIT", "READS"),
    ("shop.core.Basket#add(String)", "shop.core.Basket#check(String)", "CALLS"), ("shop.core.Basket#price()", "shop.core.Basket#total", "READS"), ("shop.core.Basket#check(String)", "shop.core.Basket#use(String)", "CALLS"),
    ("shop.core.Basket#dead()", "shop.core.Basket#dead2()", "CALLS"), ("shop.web.Orders#make()", "shop.web.Orders#saved()", "CALLS"),
    ("shop.BasketTest#adds()", "shop.core.Basket", "CREATES"), ("shop.BasketTest#adds()", "shop.core.Basket#add(String)", "CALLS"),
])
def java_edges(r):
    return r.edges


@expect("key, overridden_key", [("shop.core.Basket#price()", "shop.Priced#price()")])
def java_overrides(r):
    return r.overrides


@expect("key", [("shop.core.Basket#check(String)",), ("shop.core.Basket#add(String)",), ("shop.Main#main(String[])",), ("shop.BasketTest#adds()",)])
def java_callers(r):
    return graph.transitive_callers(r.edges, r.overrides, r.nodes, "shop.core.Basket#use(String)")


@expect("key", [("shop.BasketTest#adds()",), ("shop.Main#main(String[])",)])
def java_type_callers(r):
    return graph.type_callers(r.edges, r.overrides, r.nodes, "shop.core.Basket")


@expect("http, path, handler, framework", [("GET", "/api/orders/{id}", "shop.web.Orders#one(long)", "spring"), ("POST", "/api", "shop.web.Orders#make()", "spring")])
def java_http_endpoints(r):
    return tools.get_http_endpoints(r)


@expect("entity, table_name, id, relations", [
    ("shop.web.Orders.Buyer", "buyers", "id", "sales OneToMany shop.web.Orders.Sale buyer"), ("shop.web.Orders.Sale", None, "key", "buyer ManyToOne shop.web.Orders.Buyer"),
])
def java_jpa_model(r):
    told = F.array_join(F.transform("relations", lambda x: F.concat_ws(" ", x["field"], x["kind"], x["target"], x["mapped_by"])), "; ")
    return tools.get_jpa_model(r).select("entity", F.col("table").alias("table_name"), "id", told.alias("relations"))


@expect("category, target", [("component", "shop.web.Orders"), ("injection", "shop.web.Orders#basket")])
def java_di_registrations(r):
    return tools.get_di_registrations(r)


@expect("label, line", [("Class.forName", 19), ("Class.getMethod", 19)])
def java_reflection_usage(r):
    return tools.find_reflection_usage(r)


@expect("test_class, framework, tests, disabled", [("shop.BasketTest", "JUnit5", "adds", 1)])
def java_tests(r):
    return tools.find_tests(r).withColumn("tests", F.array_join("tests", ","))


@expect("key, disabled", [("shop.BasketTest#adds()", False)])
def java_affected_tests(r):
    return tools.find_affected_tests(r, BASKET, 24, 18)


@expect("members, size, severity", [("shop,shop.core", 2, "medium")])
def java_cycles(r):
    return tools.find_circular_dependencies(r)


@expect("src, dst, weight", [("shop", "shop.core", 2), ("shop.core", "shop", 1)])
def java_package_graph(r):
    return tools.package_edges(r)


@expect("method, cyclomatic, cognitive, risk", [
    ("add", 5, 6, "low"), ("price", 1, 0, "low"), ("check", 3, 2, "low"), ("use", 1, 0, "low"), ("dead", 1, 0, "low"), ("dead2", 1, 0, "low"),
])
def java_complexity(r):
    return tools.get_complexity_metrics(r, BASKET).select(F.regexp_extract("method_key", "#([^(]*)", 1).alias("method"), "cyclomatic", "cognitive", "risk")


@expect("path, physical, blank, comment, code", [(MAIN, 19, 3, 1, 15)])
def java_lines(r):
    return tools.get_file_metrics(r, MAIN)


@expect("key, kind", [("shop.Main#unused()", "METHOD"), ("shop.Main#name", "FIELD"), ("shop.web.Orders#basket", "FIELD")])
def java_unused_code(r):
    return tools.find_unused_code(r)


@expect("code, severity, line", [("STRING_COMPARISON", "high", 9), ("EMPTY_CATCH", "medium", 17)])
def java_possible_bugs(r):
    return tools.find_possible_bugs(r)


@expect("method, variable, steps, sink", [("shop.core.Basket#check(String)", "s", "argument 0 given @27", "given.trim()")])
def java_null_flows(r):
    return tools.find_flows(r)


@expect("name, element, expected", [("Bad_Name", "field", "camelCase")])
def java_naming(r):
    return tools.find_naming_violations(r)


@expect("file, line, col", [(MAIN, 10, 10), ("src/test/java/shop/BasketTest.java", 7, 37)])
def java_references(r):
    return tools.find_references(r, BASKET, 8, 18)


@expect("kind, line", [("cast", 26), ("instanceof", 27), ("catch", 17), ("instantiation", 9), ("throws", 19), ("type_argument", 25), ("annotation", 21)])
def java_fine_references(r):
    find = (
        ("cast", "find_casts", "Object"), ("instanceof", "find_instanceof_checks", "String"), ("catch", "find_catch_blocks", "RuntimeException"), ("throws", "find_throws_declarations", "java.io.IOException"),
        ("type_argument", "find_type_arguments", "Sale"), ("annotation", "find_annotation_usages", "Override"),
    )
    out = tools.TOOLS["find_type_instantiations"](r, "Basket").filter(F.col("file") == MAIN).select(F.lit("instantiation").alias("kind"), "line")
    for kind, name, wanted in find:
        out = out.union(tools.TOOLS[name](r, wanted).select(F.lit(kind), "line"))
    return out


@expect("file, line, col, position", [(MAIN, 12, 10, 1), ("src/main/java/shop/Priced.java", 3, 8, 1), (BASKET, 22, 15, 1)])
def java_rename(r):
    return tools.rename_symbol(r, BASKET, 22, 17, "cost")


@expect("list, key, depth", [("interface", "shop.Priced", 1)])
def java_type_hierarchy(r):
    return tools.get_type_hierarchy(r, "Basket")


@expect("caller, line", [("shop.Main#main(String[])", 10), ("shop.BasketTest#adds()", 7)])
def java_incoming_calls(r):
    return tools.get_call_hierarchy_incoming(r, BASKET, 8, 18)


@expect("target_key, line", [
    ("java.lang.String#isEmpty", 9), ("java.lang.String#length", 9), ("shop.core.Basket#check(String)", 16),
])
def java_outgoing_calls(r):
    return tools.get_call_hierarchy_outgoing(r, BASKET, 8, 18)


@expect("root, package, files", [("src/main/java", "shop", 2), ("src/main/java", "shop.core", 1), ("src/main/java", "shop.web", 1), ("src/test/java", "shop", 1)])
def java_structure(r):
    return tools.get_project_structure(r)


@expect("message, category", [
    ("unused import java.util.List", "unused_import"), ("unused import java.util.Map", "unused_import"), ("never used: shop.Main#unused()", "unused_private"),
    ("never used: shop.Main#name", "unused_private"), ("never used: shop.web.Orders#basket", "unused_private"),
])
def java_diagnostics(r):
    return tools.get_diagnostics(r)


@expect("new_text", [("import shop.core.Basket;",)])
def java_organize_imports(r):
    return tools.organize_imports(r, MAIN)


@expect("fqn, relevance", [("shop.core.Basket", 30)])
def java_suggest_imports(r):
    return tools.suggest_imports(r, "Basket")


@expect("line, fix_id", [(2, "remove_import:java.util.List"), (3, "remove_import:java.util.Map")])
def java_quick_fixes(r):
    return tools.diagnose_and_fix(r, MAIN)


@expect("name, form, reads, writes", [("o", "local", 1, 1), ("s", "local", 1, 1), ("t", "pattern", 1, 0), ("text", "parameter", 1, 0)])
def java_data_flow(r):
    return tools.analyze_data_flow(r, BASKET, 24, 18)


@expect("method, branches, loops, returns, tries, catches, max_nesting", [("shop.core.Basket#add(String)", 1, 1, 1, 1, 1, 1)])
def java_control_flow(r):
    return tools.analyze_control_flow(r, BASKET, 8, 18)


@expect("key, simple_name", [("shop.core.Basket", "Basket"), ("shop.BasketTest", "BasketTest")])
def java_search_symbols(r):
    return tools.search_symbols(r, "Bask*")
