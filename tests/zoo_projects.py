"""Project queries over a second small project and over a generated one, each with its expected rows as SQL.

The small project's rows were derived from its sources by hand; those of the generated one, of a thousand classes of one
form, are what SQL derives from the rule that wrote them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.plans import tools
from shop_projects import values
from codeseam.plans.resolve import Resolved
from codeseam.sources import tree

ROOT = "src/main/java/zoo/"
FILES = {
    ROOT + "Animal.java": """package zoo;

/** An animal.
 * @author Ann
 * @since 1.0
 */
public abstract class Animal {
    protected String name;
    public int legs = 4;

    /**
     * Says something.
     * @param times how often
     * @return the sound
     * @throws IllegalStateException if asleep
     */
    public String say(int times) { return name + times; }

    public String say() { return say(1); }

    public abstract int weight();
}
""",
    ROOT + "Dog.java": """package zoo;

import java.util.Comparator;

public class Dog extends Animal {
    private int age;

    @Override
    public String say(int times) {
        int twice = times * 2;
        return "woof" + twice;
    }

    @Override
    public int weight() { return 30 + age; }

    public int older(int years, boolean strict) {
        if (years > 0) {
            age += years;
        }
        return age;
    }

    Comparator<Dog> byAge() {
        return new Comparator<Dog>() {
            public int compare(Dog a, Dog b) { return a.age - b.age; }
        };
    }

    static int half(int x) { return x / 2; }
}

class Puppy extends Dog {
    int toys;

    @Override
    public int weight() { return half(super.weight()); }

    int play() { return toys; }
}
""",
    ROOT + "Keeper.java": """package zoo;

import java.util.Map;

public class Keeper<T extends Animal> {
    T best;
    Comparator<Dog> order;

    static class Ticket {
        int price;
    }

    public int care(Dog d) {
        d.legs = 3;
        d.legs += 1;
        int n = d.legs;
        d.older(2, true);
        java.util.function.IntUnaryOperator s = Dog::half;
        return n + Dog.half(n);
    }

    void log(String text) { System.out.println(text); }

    public static void main(String[] args) {
        new Keeper<Dog>().care(new Dog());
    }
}
""",
    ROOT + "Broken.java": "package zoo;\n\nclass Broken {\n    int x = ;\n}\n",
}
SHAPE, SQUARE = "src/main/java/bad/Shape.java", "src/main/java/bad/Square.java"
FAULTS = {
    SHAPE: """package bad;

public abstract class Shape {
    private int hidden;
    final int sides = 4;
    @Deprecated public int old() { return hidden; }
    public final int fixed() { return sides; }
    abstract int area();
    void risky() throws java.io.IOException { }
}
""",
    SQUARE: """package bad;

import java.util.List;
import java.util.List;
import bad.Gone;

class Square extends Shape {
    @Override public int areas() { return 1; }
    public int fixed() { return 2; }
    private void spare() { }
    void run(Shape other) {
        int idle = 3;
        other.sides = 5;
        other.old();
        other.nothing();
        risky();
        new Shape();
        new Shape() { int area() { return 0; } };
        try { risky(); } catch (java.io.IOException e) { risky(); }
    }
    int peek(Shape s) { return s.hidden; }
}

final class Last { }
class After extends Last { int n; int n; }
class Ring extends Gnir { }
class Gnir extends Ring { }
""",
    "src/main/java/bad/Half.java": "package bad;\n\nclass Half {\n    int x = ;\n}\n",
}
ANIMAL, DOG, KEEPER, BROKEN = (ROOT + n + ".java" for n in ("Animal", "Dog", "Keeper", "Broken"))
CLASSES = 1000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SHARED: dict[tuple[str, str], Resolved] = {}


def scale_files() -> dict[str, str]:
    """An interface, a class with a method and a field, and ``CLASSES`` classes that implement the one and use the other."""
    out = {
        "scale/Base.java": "package scale;\n\npublic interface Base {\n    int run(int x);\n}\n",
        "scale/Hub.java": "package scale;\n\npublic class Hub {\n    static int shared;\n    static int twice(int x) { return x * 2; }\n}\n",
    }
    for i in range(CLASSES):
        out[f"scale/C{i}.java"] = f"package scale;\n\nclass C{i} implements Base {{\n    public int run(int x) {{\n        return Hub.twice(x) + Hub.twice(Hub.shared);\n    }}\n}}\n"
    return out


def project(spark: SparkSession, name: str) -> Resolved:
    """A resolved project, once a session."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _SHARED:
        for old in [k for k in _SHARED if k[0] != key[0]]:
            del _SHARED[old]
        files = {"zoo": FILES, "faults": FAULTS}.get(name) or scale_files()
        rows = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")
        _SHARED[key] = Resolved(tree.facts(rows.coalesce(8 if name == "scale" else 1)).persist())
    return _SHARED[key]


def at(file: str, text: str, inner: str = "") -> tuple[str, int, int]:
    """The place of a text in a file, or of a part of it."""
    source = (FILES | FAULTS).get(file) or scale_files()[file]
    offset = source.index(text) + (text.index(inner) if inner else 0)
    return file, source.count("\n", 0, offset), offset - (source.rfind("\n", 0, offset) + 1)


def span(file: str, text: str) -> tuple[str, int, int, int, int]:
    """A file and the place where a text begins and ends in it."""
    _, line, col = at(file, text)
    return file, line, col, line, col + len(text)


def expect(columns: str, rows: list[tuple], name: str = "zoo") -> Callable:
    """Register a query over a small project with its expected rows."""

    def add(f):
        SQL[f.__name__] = values(columns, rows)
        names = [c.strip() for c in columns.split(",")]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(project(spark, name)).select(*names)
        return f

    return add


def scale(sql: str) -> Callable:
    """Register a query over the generated project with the SQL of its rows."""

    def add(f):
        SQL[f.__name__] = sql
        QUERIES[f.__name__] = lambda spark, sf_dir: f(project(spark, "scale"))
        return f

    return add


@expect("key, line, col", [
    ('zoo.Dog#older(int,boolean)', 16, 15),
])
def zoo_definition(r):
    return tools.go_to_definition(r, *at(KEEPER, 'd.older', 'older'))


@expect("key, form, signature, modifiers_text", [
    ('zoo.Animal#legs', 'field', 'legs: int', 'public'),
])
def zoo_symbol_info(r):
    return tools.get_symbol_info(r, *at(ANIMAL, 'legs')).withColumn('modifiers_text', F.array_join('modifiers', ' '))


@expect("key, kind, form, signature, return_type", [
    ('zoo.Dog#say(int)/twice', 'VARIABLE', 'local', 'int twice', 'int'),
])
def zoo_symbol_info_local(r):
    return tools.get_symbol_info(r, *at(DOG, '+ twice', 'twice'))


@expect("key, method_count, field_count, is_nested", [
    ('zoo.Dog', 5, 1, False),
])
def zoo_type_at(r):
    return tools.get_type_at_position(r, *at(DOG, 'age += years'))


@expect("key, signature, return_type", [
    ('zoo.Dog#older(int,boolean)', 'older(int years, boolean strict): int', 'int'),
])
def zoo_method_at(r):
    return tools.get_method_at_position(r, *at(DOG, 'age += years'))


@expect("key, return_type", [
    ('zoo.Animal#legs', 'int'),
])
def zoo_field_at(r):
    return tools.get_field_at_position(r, *at(ANIMAL, 'legs'))


@expect("key, signature, documentation", [
    ('zoo.Animal', 'class zoo.Animal', 'An animal.\n@author Ann\n@since 1.0'),
])
def zoo_hover(r):
    return tools.get_hover_info(r, *at(ANIMAL, 'Animal {'))


@expect("key, summary, returns, params_text, throws_text", [
    ('zoo.Animal#say(int)', 'Says something.', 'the sound', 'times how often', 'IllegalStateException if asleep'),
])
def zoo_javadoc(r):
    return tools.get_javadoc(r, *at(ANIMAL, 'say(int')).withColumn('params_text', F.concat_ws(' ', F.col('params')[0]['name'], F.col('params')[0]['text'])).withColumn('throws_text', F.concat_ws(' ', F.col('throws')[0]['name'], F.col('throws')[0]['text']))


@expect("key, signature", [
    ('zoo.Animal#say()', 'say(): String'),
    ('zoo.Animal#say(int)', 'say(int times): String'),
])
def zoo_signatures(r):
    return tools.get_signature_help(r, *at(ANIMAL, 'say(1)'))


@expect("method, type, outer_type, package", [
    ('zoo.Dog#older(int,boolean)', 'zoo.Dog', 'zoo.Dog', 'zoo'),
])
def zoo_enclosing(r):
    return tools.get_enclosing_element(r, *at(DOG, 'age += years'))


@expect("key", [
    ('zoo.Animal#weight()',),
])
def zoo_super_method(r):
    return tools.get_super_method(r, *at(DOG, 'weight'))


@expect("key, owner_key, ordinal, total", [
    ('zoo.Animal', None, 0, 6),
    ('zoo.Animal#name', 'zoo.Animal', 0, 6),
    ('zoo.Animal#legs', 'zoo.Animal', 1, 6),
    ('zoo.Animal#say(int)', 'zoo.Animal', 2, 6),
    ('zoo.Animal#say()', 'zoo.Animal', 3, 6),
    ('zoo.Animal#weight()', 'zoo.Animal', 4, 6),
])
def zoo_outline(r):
    return tools.get_document_symbols(r, ANIMAL)


@expect("key, inherited", [
    ('zoo.Puppy#play()', False),
    ('zoo.Puppy#toys', False),
    ('zoo.Puppy#weight()', False),
    ('zoo.Animal#legs', True),
    ('zoo.Animal#name', True),
    ('zoo.Animal#say()', True),
    ('zoo.Animal#say(int)', True),
    ('zoo.Animal#weight()', True),
    ('zoo.Dog#age', True),
    ('zoo.Dog#byAge()', True),
    ('zoo.Dog#half(int)', True),
    ('zoo.Dog#older(int,boolean)', True),
    ('zoo.Dog#say(int)', True),
    ('zoo.Dog#weight()', True),
])
def zoo_members(r):
    return tools.get_type_members(r, 'Puppy', include_inherited=True)


@expect("file, line, col", [
    (KEEPER, 17, 53),
])
def zoo_method_references(r):
    return tools.find_method_references(r, *at(DOG, 'half'))


@expect("file, line, col, total", [
    (KEEPER, 13, 10, 2),
    (KEEPER, 14, 10, 2),
])
def zoo_field_writes(r):
    return tools.find_field_writes(r, *at(ANIMAL, 'legs'))


@expect("key, total", [
    ('zoo.Dog', 2),
    ('zoo.Puppy', 2),
])
def zoo_implementations(r):
    return tools.find_implementations(r, *at(ANIMAL, 'Animal {'))


@expect("key, total", [
    ('zoo.Dog#weight()', 2),
    ('zoo.Puppy#weight()', 2),
])
def zoo_overriding(r):
    return tools.find_implementations(r, *at(ANIMAL, 'weight'))


@expect("key, level, in_file, total", [
    ('zoo.Keeper#care(Dog)', 1, 2, 2),
    ('zoo.Keeper#main(String[])', 2, 2, 2),
])
def zoo_change_impact(r):
    return tools.analyze_change_impact(r, *at(ANIMAL, 'legs'), depth=2)


@expect("fine_kind, total, shown, examples_text", [
    ('EXTENDS', 1, 1, 'src/main/java/zoo/Dog.java:32:20'),
    ('INSTANTIATION', 1, 1, 'src/main/java/zoo/Keeper.java:24:35'),
    ('OTHER', 2, 2, 'src/main/java/zoo/Keeper.java:17:48 src/main/java/zoo/Keeper.java:18:19'),
    ('PARAMETER_TYPE', 3, 3, 'src/main/java/zoo/Dog.java:25:31 src/main/java/zoo/Dog.java:25:38 src/main/java/zoo/Keeper.java:12:20'),
    ('TYPE_ARGUMENT', 4, 4, 'src/main/java/zoo/Dog.java:23:15 src/main/java/zoo/Dog.java:24:30 src/main/java/zoo/Keeper.java:24:19 src/main/java/zoo/Keeper.java:6:15'),
])
def zoo_usage_summary(r):
    return tools.get_type_usage_summary(r, 'Dog').withColumn('examples_text', F.array_join('examples', ' '))


@expect("src, dst, weight", [
    ('zoo.Keeper', 'zoo.Dog', 1),
])
def zoo_dependencies(r):
    return tools.get_dependency_graph(r, 'type', 'Keeper')


@expect("kind, path, uses", [
    ('library', 'java.util', 2),
    ('source', 'src/main/java', 4),
])
def zoo_classpath(r):
    return tools.get_classpath_info(r)


@expect("path, package, imports_text, types_text", [
    (DOG, 'zoo', 'java.util.Comparator', 'zoo.Dog class 5 1; zoo.Puppy class 2 1'),
])
def zoo_analyze_file(r):
    return tools.analyze_file(r, DOG).withColumn('imports_text', F.array_join('imports', ' ')).withColumn('types_text', F.array_join(F.transform('types', lambda t: F.concat_ws(' ', t['key'], t['form'], t['methods'].cast('string'), t['fields'].cast('string'))), '; '))


@expect("key, members_text, ancestors_text, subtypes_text, subtypes_total", [
    ('zoo.Dog', 'zoo.Dog#age zoo.Dog#byAge() zoo.Dog#half(int) zoo.Dog#older(int,boolean) zoo.Dog#say(int) zoo.Dog#weight()', 'zoo.Animal', 'zoo.Puppy', 1),
])
def zoo_analyze_type(r):
    return tools.analyze_type(r, 'Dog').withColumn('members_text', F.array_join('members', ' ')).withColumn('ancestors_text', F.array_join('ancestors', ' ')).withColumn('subtypes_text', F.array_join('subtypes', ' '))


@expect("key, callers_text, callers_total, callees_text, overrides_text, overridden_by_text", [
    ('zoo.Dog#weight()', 'zoo.Puppy#weight()', 1, '', 'zoo.Animal#weight()', 'zoo.Puppy#weight()'),
])
def zoo_analyze_method(r):
    return tools.analyze_method(r, *at(DOG, 'weight')).withColumn('callers_text', F.array_join('callers', ' ')).withColumn('callees_text', F.array_join('callees', ' ')).withColumn('overrides_text', F.array_join('overrides', ' ')).withColumn('overridden_by_text', F.array_join('overridden_by', ' '))


@expect("key, methods, messages", [
    ('zoo.Dog', 5, 'methods > 3'),
])
def zoo_large_classes(r):
    return tools.find_large_classes(r, max_methods=3)


@expect("method, depth, name, reads, writes", [
    ('zoo.Keeper#care(Dog)', 0, 'd', 4, 0),
    ('zoo.Keeper#care(Dog)', 0, 'n', 2, 1),
    ('zoo.Keeper#care(Dog)', 0, 's', 0, 1),
    ('zoo.Dog#half(int)', 1, 'x', 1, 0),
    ('zoo.Dog#older(int,boolean)', 1, 'strict', 0, 0),
    ('zoo.Dog#older(int,boolean)', 1, 'years', 2, 0),
])
def zoo_data_flow_calls(r):
    return tools.analyze_data_flow(r, *at(KEEPER, 'd.legs = 3'), follow_calls=True, max_call_depth=1)


@expect("line", [
    (3,),
])
def zoo_syntax(r):
    return tools.validate_syntax(r, BROKEN)


@expect("line, fix_id, relevance, rank", [
    (2, 'remove_import:java.util.Map', 100, 1),
    (6, 'add_import:java.util.Comparator', 100, 1),
])
def zoo_quick_fixes(r):
    return tools.get_quick_fixes(r, KEEPER)


@expect("file, new_text", [
    (KEEPER, '\nimport java.util.List;'),
])
def zoo_apply_fix(r):
    return tools.apply_quick_fix(r, KEEPER, 'add_import:java.util.List')


@expect("file, line, col, old_text, new_text, position", [
    (DOG, 10, 24, 'twice', 'doubled', 1),
    (DOG, 9, 12, 'twice', 'doubled', 2),
])
def zoo_rename_local(r):
    return tools.rename_symbol(r, *at(DOG, 'int twice', 'twice'), 'doubled')


@expect("file, line, col, position", [
    (DOG, 18, 19, 1),
    (DOG, 17, 12, 2),
    (DOG, 16, 25, 3),
])
def zoo_rename_parameter(r):
    return tools.rename_symbol(r, *at(DOG, 'years > 0'), 'span')


@expect("file, start_text, new_text, warnings", [
    (ANIMAL, '424 0', '    public int getLegs() {\n        return legs;\n    }\n\n    public void setLegs(int legs) {\n        this.legs = legs;\n    }\n', ''),
    (ANIMAL, '124 6', 'private', ''),
    (KEEPER, '257 4', 'getLegs()', ''),
    (KEEPER, '228 9', 'setLegs(d.getLegs() + 1)', ''),
    (KEEPER, '208 8', 'setLegs(3)', ''),
])
def zoo_encapsulate(r):
    return tools.encapsulate_field(r, *at(ANIMAL, 'legs')).withColumn('start_text', F.concat_ws(' ', 'start', 'length'))


@expect("file, start, new_text", [
    (KEEPER, 74, ' implements Caring<T>'),
    ('src/main/java/zoo/Caring.java', None, 'package zoo;\n\npublic interface Caring<T extends Animal> {\n    int care(Dog d);\n}\n'),
])
def zoo_extract_interface(r):
    return tools.extract_interface(r, *at(KEEPER, 'Keeper<T'), 'Caring')


@expect("file, new_text", [
    (KEEPER, ' extends Carer'),
    (KEEPER, ''),
    ('src/main/java/zoo/Carer.java', 'package zoo;\n\npublic class Carer {\n    public int care(Dog d) {\n        d.legs = 3;\n        d.legs += 1;\n        int n = d.legs;\n        d.older(2, true);\n        java.util.function.IntUnaryOperator s = Dog::half;\n        return n + Dog.half(n);\n    }\n}\n'),
])
def zoo_extract_superclass(r):
    return tools.extract_superclass(r, *at(KEEPER, 'care('), 'Carer')


@expect("file, new_text", [
    (DOG, ''),
    (ANIMAL, '    public int older(int years, boolean strict) {\n        if (years > 0) {\n            age += years;\n        }\n        return age;\n    }\n'),
])
def zoo_pull_up(r):
    return tools.pull_up(r, *at(DOG, 'older('))


@expect("file, new_text", [
    (DOG, ''),
    (DOG, '    public int older(int years, boolean strict) {\n        if (years > 0) {\n            age += years;\n        }\n        return age;\n    }\n'),
])
def zoo_push_down(r):
    return tools.push_down(r, *at(DOG, 'older('))


@expect("file, start, length, new_text", [
    (DOG, 157, 0, 'var product = times * 2;\n        '),
    (DOG, 169, 9, 'product'),
])
def zoo_extract_variable(r):
    return tools.extract_variable(r, *span(DOG, 'times * 2'), 'product')


@expect("file, new_text", [
    (DOG, '\n    private static final String SOUND = "woof";'),
    (DOG, 'SOUND'),
])
def zoo_extract_constant(r):
    return tools.extract_constant(r, *span(DOG, '"woof"'), 'SOUND')


@expect("file, new_text", [
    (DOG, 'int twice = doubled(times);'),
    (DOG, '\n\n    private int doubled(int times) {\n        int twice = times * 2;\n        return twice;\n    }'),
])
def zoo_extract_method(r):
    return tools.extract_method(r, *span(DOG, 'int twice = times * 2;'), 'doubled')


@expect("file, start, length, new_text", [
    (DOG, 204, 5, '(times * 2)'),
    (DOG, 149, 31, ''),
])
def zoo_inline_variable(r):
    return tools.inline_variable(r, *at(DOG, 'int twice', 'twice'))


@expect("file, new_text", [
    (KEEPER, '(n / 2)'),
])
def zoo_inline_method(r):
    return tools.inline_method(r, *at(KEEPER, 'Dog.half', 'half'))


@expect("file, new_text", [
    (DOG, '(a, b) -> a.age - b.age'),
])
def zoo_to_lambda(r):
    return tools.convert_anonymous_to_lambda(r, *at(DOG, 'new Comparator<Dog>()', 'Comparator'))


@expect("file, new_text", [
    (KEEPER, ''),
    ('src/main/java/zoo/Ticket.java', 'package zoo;\n\nimport java.util.Map;\n\nclass Ticket {\n    int price;\n}\n'),
])
def zoo_move_type(r):
    return tools.move_type_to_new_file(r, *at(KEEPER, 'class Ticket', 'Ticket'))


@expect("file, line_text, new_text", [
    (DOG, '299 25', 'int years, String why'),
    (DOG, '293 5', 'grow'),
    (KEEPER, '279 7', '2, ""'),
    (KEEPER, '273 5', 'grow'),
])
def zoo_change_signature(r):
    return tools.change_method_signature(r, *at(DOG, 'older('), new_name='grow', new_parameters=[{'type': 'int', 'name': 'years'}, {'type': 'String', 'name': 'why', 'default': '""'}]).withColumn('line_text', F.concat_ws(' ', 'start', 'length'))


@expect("file, new_text", [
    (DOG, '    public static class OlderParameters {\n        private final int years;\n        private final boolean strict;\n\n        public OlderParameters(int years, boolean strict) { this.years = years; this.strict = strict; }\n\n        public int getYears() { return years; }\n        public boolean getStrict() { return strict; }\n    }\n'),
    (DOG, 'parameterObject.getYears()'),
    (DOG, 'parameterObject.getYears()'),
    (DOG, 'OlderParameters parameterObject'),
    (KEEPER, 'new Dog.OlderParameters(2, true)'),
])
def zoo_parameter_object(r):
    return tools.introduce_parameter_object(r, *at(DOG, 'older('))


@expect("line, fix_id", [
    (2, 'remove_import:java.util.Map'),
    (6, 'add_import:java.util.Comparator'),
])
def zoo_diagnose(r):
    return tools.diagnose_and_fix(r, KEEPER)


@expect("file, changed", [
    (DOG, True),
])
def zoo_cleanup(r):
    return tools.apply_cleanup(r, DOG, 'convert_to_lambda')


@expect("status, files", [
    ('ready', 4),
])
def zoo_health(r):
    return tools.health_check(r)


@expect("method, variable, sink", [
    ('zoo.Keeper#log(String)', 'text', 'println'),
])
def zoo_taint_flows(r):
    return tools.find_flows(r, kind='taint')


@expect("file, line, severity, category, message", [
    ("src/main/java/bad/Half.java", 3, "error", "syntax", "unexpected ';'"),
    (SQUARE, 2, "warning", "unused_import", "unused import java.util.List"),
    (SQUARE, 3, "warning", "unused_import", "unused import java.util.List"),
    (SQUARE, 3, "warning", "duplicate_import", "imported before: java.util.List"),
    (SQUARE, 4, "error", "unresolved_import", "no type bad.Gone"),
    (SQUARE, 4, "warning", "unused_import", "unused import bad.Gone"),
    (SQUARE, 6, "error", "missing_implementation", "does not implement bad.Shape#area()"),
    (SQUARE, 7, "error", "must_override", "overrides nothing: bad.Square#areas()"),
    (SQUARE, 8, "error", "final_method", "overrides a final method: bad.Shape#fixed()"),
    (SQUARE, 9, "warning", "unused_private", "never used: bad.Square#spare()"),
    (SQUARE, 11, "warning", "unused_variable", "never read: idle"),
    (SQUARE, 12, "error", "final_assignment", "final: bad.Shape#sides"),
    (SQUARE, 13, "warning", "deprecated_use", "deprecated: bad.Shape#old()"),
    (SQUARE, 14, "error", "undefined_method", "no method nothing in bad.Shape"),
    (SQUARE, 15, "error", "unhandled_exception", "nothing takes IOException"),
    (SQUARE, 16, "error", "abstract_creation", "cannot be created: bad.Shape"),
    (SQUARE, 18, "error", "unhandled_exception", "nothing takes IOException"),
    (SQUARE, 20, "error", "not_visible", "private: bad.Shape#hidden"),
    (SQUARE, 24, "error", "final_type", "extends a final type: bad.Last"),
    (SQUARE, 24, "error", "duplicate_declaration", "declared before: bad.After#n"),
    (SQUARE, 25, "error", "cyclic_hierarchy", "its own ancestor: bad.Ring"),
    (SQUARE, 26, "error", "cyclic_hierarchy", "its own ancestor: bad.Gnir"),
], "faults")
def faults_diagnostics(r):
    return tools.get_diagnostics(r)


@expect("line, fix_id, relevance, rank", [
    (2, "remove_import:java.util.List", 100, 1),
    (3, "remove_import:java.util.List", 100, 1),
    (4, "remove_import:bad.Gone", 100, 1),
    (15, "add_throws:java.io.IOException", 80, 1),
    (15, "surround_try_catch:java.io.IOException", 75, 2),
    (18, "add_throws:java.io.IOException", 80, 1),
    (18, "surround_try_catch:java.io.IOException", 75, 2),
], "faults")
def faults_quick_fixes(r):
    return tools.get_quick_fixes(r, SQUARE)


@expect("file, new_text", [(SQUARE, " throws java.io.IOException")], "faults")
def faults_add_throws(r):
    return tools.apply_quick_fix(r, SQUARE, "add_throws:java.io.IOException", 15)


# ---------------------------------------------------------------- a thousand classes of one form

_CLASSES = f"c AS (SELECT i, 'scale/C' || i || '.java' AS file FROM range({CLASSES}) t(i))"
_USES = f"{_CLASSES}, u AS (SELECT file, 4 AS line, unnest([19, 34]) AS col FROM c)"


@scale(f"WITH {_USES} SELECT *, (SELECT count(*) FROM u) AS total FROM u ORDER BY file, col LIMIT 1000")
def scale_references(r):
    return tools.find_references(r, *at("scale/Hub.java", "twice"), max_results=5000).select("file", "line", "col", "total")


@scale(f"WITH {_CLASSES} SELECT 'scale.C' || i AS key, file, {CLASSES} AS total FROM c")
def scale_implementations(r):
    return tools.find_implementations(r, *at("scale/Base.java", "Base"), max_results=5000).select("key", "file", "total")


@scale(f"WITH {_CLASSES}, n AS (SELECT 'C' || i AS simple_name FROM c) SELECT simple_name, {CLASSES} AS total FROM n ORDER BY simple_name LIMIT 300 OFFSET 600")
def scale_search_page(r):
    return tools.search_symbols(r, "C*", max_results=300, offset=600).select("simple_name", "total")


@scale(f"SELECT NULL::VARCHAR AS simple_name, {CLASSES} AS total")
def scale_search_nothing_shown(r):
    return tools.search_symbols(r, "C*", max_results=0).select("simple_name", "total")


@scale(
    f"WITH {_USES}, e AS (SELECT * FROM u UNION ALL SELECT 'scale/Hub.java', 4, 15) "
    "SELECT *, row_number() OVER (PARTITION BY file ORDER BY line DESC, col DESC) AS position FROM e"
)
def scale_rename(r):
    return tools.rename_symbol(r, *at("scale/Hub.java", "twice"), "doubled").select("file", "line", "col", "position")


@scale(f"WITH {_CLASSES} SELECT 'scale.C' || i || '#run(int)' AS key FROM c")
def scale_callers(r):
    from codeseam.operators import graph

    return graph.type_callers(r.edges, r.overrides, r.nodes, "scale.Hub")


@scale(f"WITH {_CLASSES}, n AS (SELECT 'scale.C' || i AS key FROM c UNION ALL SELECT 'scale.C' || i || '#run(int)' FROM c UNION ALL SELECT unnest(['scale.Base', 'scale.Base#run(int)', 'scale.Hub', 'scale.Hub#shared', 'scale.Hub#twice(int)'])) SELECT key, count(*) OVER () AS total FROM n")
def scale_unreachable(r):
    return tools.find_unreachable_code(r, max_results=5000).select("key", "total")


@scale(f"WITH {_CLASSES} SELECT file, 4 AS line, 44 AS col, 'getShared()' AS new_text FROM c")
def scale_encapsulate(r):
    made = tools.encapsulate_field(r, *at("scale/Hub.java", "shared")).filter(F.col("file") != "scale/Hub.java")
    sites = r.accesses.select("file", "start", "line", "col")
    return made.join(sites, ["file", "start"]).select("file", "line", "col", "new_text")


@scale(f"SELECT 'IMPLEMENTS' AS kind, {CLASSES} AS n")
def scale_usage(r):
    return tools.get_type_usage_summary(r, "Base").select(F.col("fine_kind").alias("kind"), F.col("total").alias("n"))
