"""Rewrites of one file."""

import pytest

from codeseam.operators.edits import apply_edits
from codeseam.sources import rewrite
from codeseam.sources.java_parser import parse
from codeseam.sources.rewrite import Refused

SOURCE = '''class A {
    static final int LIMIT = 3;
    int field;

    int m(int p, String s) {
        int twice = p + p;
        int x = twice * 2;
        if (s.length() > 1 && check(s)) {
            use("text" + 1);
        }
        while (p < LIMIT + 4) { p++; }
        Runnable r = new Runnable() { public void run() { use(s); } };
        int sum = x + field;
        use(s);
        return sum;
    }

    boolean check(String s) { return s.equals("a") == true; }
    void use(String s) { }
    static class In { int k; }
}
'''


def done(made, source=SOURCE):
    out = apply_edits(source, made.edits)
    parse(out)
    return out


def span(text, source=SOURCE):
    at = source.index(text)
    return at, at + len(text)


def test_extract_variable():
    out = done(rewrite.extract_variable(SOURCE, *span('"text" + 1'), "label"))
    assert 'var label = "text" + 1;\n            use(label);' in out
    for text in ("check(s)", "LIMIT + 4"):
        with pytest.raises(Refused):
            rewrite.extract_variable(SOURCE, *span(text))
    with pytest.raises(Refused):
        rewrite.extract_variable(SOURCE, *span("p + p;"))


def test_extract_constant():
    out = done(rewrite.extract_constant(SOURCE, *span('"text" + 1'), "TEXT"))
    assert 'LIMIT = 3;\n    private static final String TEXT = "text" + 1;' in out and "use(TEXT);" in out
    for text in ("p + p", "x + field", "check(s)"):
        with pytest.raises(Refused):
            rewrite.extract_constant(SOURCE, *span(text), "C")


def test_inline_variable():
    out = done(rewrite.inline_variable(SOURCE, SOURCE.index("twice")))
    assert "int x = (p + p) * 2;" in out and "twice" not in out
    with pytest.raises(Refused):
        rewrite.inline_variable(SOURCE, SOURCE.index("p, String"))


def test_extract_method():
    out = done(rewrite.extract_method(SOURCE, *span("int sum = x + field;\n        use(s);"), "total"))
    assert "int sum = total(x, s);" in out and "private int total(int x, String s) {" in out and out.count("return sum;") == 2
    with pytest.raises(Refused):
        rewrite.extract_method(SOURCE, *span("return sum;"), "f")
    with pytest.raises(Refused):
        rewrite.extract_method(SOURCE, *span("sum = x"), "f")


def test_lambda_and_move():
    out = done(rewrite.convert_anonymous_to_lambda(SOURCE, SOURCE.index("new Runnable") + 2))
    assert "Runnable r = () -> use(s);" in out
    with pytest.raises(Refused):
        rewrite.convert_anonymous_to_lambda(SOURCE.replace("Runnable", "Thing"), SOURCE.index("new Runnable") + 2)
    made = rewrite.move_type_to_new_file(SOURCE, SOURCE.index("In {"), "src")
    assert made.created == {"src/In.java": "class In { int k; }\n"} and "In" not in done(made)


@pytest.mark.parametrize(
    ("cleanup", "old", "new"),
    [
        ("invert_equals", 'boolean b = s.equals("a");', 'boolean b = "a".equals(s);'),
        ("boolean_value_rather_than_comparison", "boolean b = f() == true || (x && y) == false;", "boolean b = f() || !(x && y);"),
        ("else_if", "if (a) { } else { if (b) { } }", "if (a) { } else if (b) { }"),
        ("pattern_matching_instanceof", "if (o instanceof String) { String t = (String) o; f(t); }", "if (o instanceof String t) { f(t); }"),
        ("convert_loops", "for (int i = 0; i < names.length; i++) { f(names[i]); }", "for (var name : names) { f(name); }"),
        ("convert_loops", "for (int i = 0; i < names.length; i++) { f(i, names[i]); }", "for (int i = 0; i < names.length; i++) { f(i, names[i]); }"),
        ("overridden_assignment", "int x = 0; x = f();", "int x; x = f();"),
        ("convert_to_lambda", "Runnable r = new Runnable() { public void run() { f(); } };", "Runnable r = () -> f();"),
    ],
)
def test_cleanups(cleanup, old, new):
    wrap = "class A {{ void m() {{ {} }} }}".format
    assert rewrite.apply_cleanup(wrap(old), cleanup) == wrap(new)
    with pytest.raises(Refused):
        rewrite.apply_cleanup(wrap(old), "unheard_of")


def test_text_blocks():
    out = rewrite.apply_cleanup('class A { String s = "a\\n" + "b \\"c\\"\\n" + "d"; }', "string_concat_to_text_block")
    assert '"""\n' in out and 'b "c"' in out
    parse(out)


def test_switch_expression():
    out = rewrite.apply_cleanup("class A { int m(int k) { switch (k) { case 1: case 2: return 5; default: return 6; } } }", "convert_to_switch_expression")
    assert "return switch (k) {" in out and "case 1, 2 -> 5;" in out and "default -> 6;" in out
    parse(out)
    kept = "class A { int m(int k) { switch (k) { case 1: f(); return 5; default: return 6; } } }"
    assert rewrite.apply_cleanup(kept, "convert_to_switch_expression") == kept


def test_throws_and_try():
    source = "class A {\n    void m(int k) {\n        f();\n    }\n    void n() throws E { }\n}\n"
    assert "void m(int k) throws IOException {" in done(rewrite.add_throws(source, source.index("f();"), "IOException"), source)
    assert "throws E, IOException" in done(rewrite.add_throws(source, source.index("throws E"), "IOException"), source)
    assert "try {\n            f();\n        } catch (IOException e) {" in done(rewrite.surround_try_catch(source, source.index("f();"), "IOException"), source)
