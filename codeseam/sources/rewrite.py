"""Edits within one file: extractions, inlining, lambdas, moving nested types, clean-ups.

A rewrite works on the parsed file and gives edits (start, length, new text) and, where a file is made, its content; it
refuses with a reason instead of guessing.  Nothing is written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from codeseam.sources.java_parser import Node, parse

#: Functional interfaces of the platform that a lambda may stand for.
FUNCTIONAL = frozenset(
    "Runnable Callable Comparator Supplier Consumer BiConsumer Function BiFunction UnaryOperator BinaryOperator Predicate BiPredicate "
    "IntFunction IntPredicate IntUnaryOperator IntBinaryOperator ToIntFunction ToLongFunction ToDoubleFunction BooleanSupplier IntSupplier "
    "ActionListener FileFilter FilenameFilter Thread.UncaughtExceptionHandler".split()
)
_LOOSE = ("InfixExpression", "ConditionalExpression", "Assignment", "Lambda", "CastExpression", "InstanceofExpression", "PrefixExpression", "SwitchExpression")


class Refused(ValueError):
    code = "INVALID_PARAMETER"


@dataclass
class Rewrite:
    edits: list[tuple[int, int, str]] = field(default_factory=list)
    created: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


class File:
    def __init__(self, source: str):
        self.source = source
        self.unit, self.comments = parse(source)
        self.parent: dict[int, Node] = {}
        self.all: list[Node] = list(self.unit.walk())
        for n in self.all:
            for k in n.kids:
                self.parent[id(k)] = n

    def text(self, n: Node) -> str:
        return self.source[n.start : n.end]

    def up(self, n: Node):
        while (n := self.parent.get(id(n))) is not None:
            yield n

    def above(self, n: Node, *kinds: str) -> Node | None:
        return next((u for u in self.up(n) if u.kind in kinds), None)

    def selected(self, start: int, end: int) -> Node:
        while start < end and self.source[start].isspace():
            start += 1
        while end > start and self.source[end - 1].isspace():
            end -= 1
        found = [n for n in self.all if (n.start, n.end) == (start, end) and n.kind not in ("Type", "Block", "Parameter") and not n.kind.endswith(("Statement", "Declaration"))]
        if not found:
            raise Refused("the selection is not one expression")
        return found[0]

    def at(self, offset: int, *kinds: str) -> Node | None:
        inside = [n for n in self.all if n.kind in kinds and n.start <= offset <= n.end]
        return min(inside, key=lambda n: n.end - n.start, default=None)

    def indent(self, at: int) -> str:
        line = self.source.rfind("\n", 0, at) + 1
        return re.match(r"[ \t]*", self.source[line:])[0]

    def statement(self, n: Node) -> Node:
        for s in (n, *self.up(n)):
            if s.kind.endswith("Statement") or s.kind == "VariableDeclaration":
                if self.parent[id(s)].kind not in ("Block", "SwitchStatement", "SwitchExpression"):
                    raise Refused("the statement does not stand in a block")
                return s
        raise Refused("the selection is in no statement")


def _evaluated_once(f: File, n: Node, stop: Node) -> None:
    """Refuse where an expression may run more than once or not at all."""
    child = n
    for p in f.up(n):
        k = p.kids.index(child) if child in p.kids else -1
        if p.kind in ("WhileStatement",) and k == 0 or p.kind == "DoStatement" and k == 1 or p.kind == "ForStatement" and k < len(p.kids) - 1 and child.kind != "VariableDeclaration":
            raise Refused("a loop evaluates the expression again")
        if p.kind == "InfixExpression" and p.name in ("&&", "||") and k > 0:
            raise Refused(f"{p.name} may skip the expression")
        if p.kind == "ConditionalExpression" and k > 0:
            raise Refused("only one branch of a conditional is evaluated")
        if p.kind == "Lambda":
            raise Refused("a lambda's body runs elsewhere")
        if p is stop:
            return
        child = p


def literal_type(n: Node) -> str | None:
    if n.kind == "Literal":
        kind = n.data["literal"]
        if kind == "number":
            low = n.name.lower()
            if low.startswith("0x"):
                return "long" if low.endswith("l") else "int"
            return "long" if low.endswith("l") else "float" if low.endswith("f") else "double" if low.endswith("d") or "." in low or "e" in low else "int"
        return {"string": "String", "text": "String", "char": "char", "boolean": "boolean"}.get(kind)
    if n.kind == "Parenthesized":
        return literal_type(n.kids[0])
    if n.kind == "ClassInstanceCreation":
        return n.data["type"]
    if n.kind == "CastExpression":
        return n.kids[0].name
    if n.kind == "InfixExpression":
        if n.name in ("&&", "||", "==", "!=", "<", ">", "<=", ">="):
            return "boolean"
        kinds = {literal_type(k) for k in n.kids}
        if "String" in kinds and n.name == "+":
            return "String"
        order = ["int", "long", "float", "double"]
        return max(kinds, key=order.index) if kinds <= set(order) else None
    if n.kind == "PrefixExpression":
        return "boolean" if n.name == "!" else literal_type(n.kids[0])
    return None


def suggested_name(f: File, n: Node) -> str:
    base = literal_type(n)
    if n.kind == "MethodInvocation":
        base = re.sub(r"^(?:get|is|find|create|to)(?=[A-Z])", "", n.name)
    elif n.kind == "FieldAccess":
        base = n.name
    base = (base or "extracted").rsplit(".", 1)[-1].split("<")[0]
    name = base[0].lower() + base[1:]
    return name if name.isidentifier() and name not in ("int", "long", "float", "double", "boolean", "char") else "value"


def extract_variable(source: str, start: int, end: int, name: str | None = None) -> Rewrite:
    f = File(source)
    n = f.selected(start, end)
    s = f.statement(n)
    if s is n:
        raise Refused("the selection is a whole statement")
    _evaluated_once(f, n, s)
    name = name or suggested_name(f, n)
    text = f.text(n)
    return Rewrite([(s.start, 0, f"var {name} = {text};\n{f.indent(s.start)}"), (n.start, n.end - n.start, name)])


def _declared(f: File, scope: Node) -> dict[str, str]:
    return {n.name: n.data.get("type") or "var" for n in scope.walk() if n.kind in ("VariableDeclarationFragment", "Parameter")}


def extract_constant(source: str, start: int, end: int, name: str) -> Rewrite:
    f = File(source)
    n = f.selected(start, end)
    kind = literal_type(n)
    owner = f.above(n, "TypeDeclaration")
    if owner is None:
        raise Refused("the selection is in no type")
    inside = _declared(f, n)
    static = {v.name for d in owner.of("FieldDeclaration") if "static" in d.data["modifiers"] for v in d.of("VariableDeclarationFragment")}
    method = f.above(n, "MethodDeclaration", "Initializer")
    outside = _declared(f, method) if method else {}
    fields = {v.name for d in owner.of("FieldDeclaration") for v in d.of("VariableDeclarationFragment")}
    static_methods = {m.name for m in owner.of("MethodDeclaration") if "static" in m.data["modifiers"]}
    for x in n.walk():
        if x.kind in ("This", "Super"):
            raise Refused("the expression needs an instance")
        if x.kind == "Name" and x.name not in inside and (x.name in outside or x.name in fields and x.name not in static):
            raise Refused(f"the expression needs {x.name}")
        if x.kind == "MethodInvocation" and x.data["receiver"] is None and x.name not in static_methods:
            raise Refused(f"the expression calls {x.name} on an instance")
    if kind is None:
        raise Refused("the type of the expression is not plain")
    constants = [d for d in owner.of("FieldDeclaration") if {"static", "final"} <= set(d.data["modifiers"])]
    if constants:
        at, pad = constants[-1].end, f.indent(constants[-1].start)
    else:
        at = source.index("{", max([owner.data["name_start"], *(k.end for k in (*owner.data["extends"], *owner.data["implements"], *owner.data["components"]))])) + 1
        pad = f.indent(owner.start) + "    "
    return Rewrite([(at, 0, f"\n{pad}private static final {kind} {name} = {f.text(n)};"), (n.start, n.end - n.start, name)])


def inline_variable(source: str, offset: int) -> Rewrite:
    f = File(source)
    here = f.at(offset, "Name", "VariableDeclarationFragment", "Parameter")
    if here is None or here.kind == "Parameter":
        raise Refused("not a local variable")
    name = here.name
    method = f.above(here, "MethodDeclaration", "Initializer", "Lambda") or f.unit
    found = [n for n in method.walk() if n.kind == "VariableDeclarationFragment" and n.name == name and f.parent[id(n)].kind == "VariableDeclaration"]
    if here.kind == "VariableDeclarationFragment":
        found = [here] if here in found else []
    if len(found) != 1:
        raise Refused("not one local variable")
    (frag,) = found
    if not frag.kids:
        raise Refused("the variable has no initial value")
    scope = f.parent[id(f.parent[id(frag)])]
    uses = []
    for n in scope.walk():
        if n.kind == "Name" and n.name == name and n.start >= frag.end:
            p = f.parent[id(n)]
            if p.kind == "Assignment" and p.kids[0] is n or p.kind == "PostfixExpression" or p.kind == "PrefixExpression" and p.name in ("++", "--"):
                raise Refused("the variable changes later")
            uses.append((n, p))
    if not uses:
        raise Refused("the variable is not used")
    value = frag.kids[0]
    text = f.text(value)
    out = Rewrite()
    for n, p in uses:
        tight = value.kind in _LOOSE and p.kind in (*_LOOSE[:1], "MethodInvocation", "FieldAccess", "PrefixExpression", "CastExpression", "ConditionalExpression", "ArrayAccess", "InstanceofExpression")
        in_argument = p.kind == "MethodInvocation" and n in p.data["args"]
        out.edits.append((n.start, n.end - n.start, f"({text})" if tight and not in_argument else text))
    decl = f.parent[id(frag)]
    if len(decl.of("VariableDeclarationFragment")) > 1:
        raise Refused("the variable is declared together with others")
    stop = decl.end
    while stop < len(source) and source[stop] in " \t":
        stop += 1
    if source[stop : stop + 1] == "\n":
        stop += 1
    begin = decl.start - len(f.indent(decl.start)) if source[decl.start - len(f.indent(decl.start)) - 1 : decl.start - len(f.indent(decl.start))] in ("\n", "") else decl.start
    out.edits.append((begin, stop - begin, ""))
    if any(x.kind in ("MethodInvocation", "ClassInstanceCreation", "Assignment", "PostfixExpression") for x in value.walk()) and len(uses) > 1:
        out.warnings.append("the initial value is evaluated at every use")
    return out


def extract_method(source: str, start: int, end: int, name: str) -> Rewrite:
    f = File(source)
    while start < end and source[start].isspace():
        start += 1
    while end > start and source[end - 1].isspace():
        end -= 1
    blocks = [b for b in f.all if b.kind == "Block" and b.start < start and end < b.end]
    if not blocks:
        raise Refused("the selection is in no block")
    block = min(blocks, key=lambda b: b.end - b.start)
    chosen = [s for s in block.kids if s.start < end and s.end > start]
    if not chosen or chosen[0].start != start or chosen[-1].end != end:
        raise Refused("the selection is not whole statements")
    method = f.above(block, "MethodDeclaration")
    if method is None:
        raise Refused("the selection is in no method")
    if any(n.kind in ("ReturnStatement", "BreakStatement", "ContinueStatement") for s in chosen for n in s.walk()):
        raise Refused("the selection jumps out of itself")
    types = _declared(f, method)
    inside = {v.name for s in chosen for v in s.walk() if v.kind in ("VariableDeclarationFragment", "Parameter")}
    used = [n.name for s in chosen for n in s.walk() if n.kind == "Name"]
    params = [v for v in dict.fromkeys(used) if v in types and v not in inside]
    changed = {
        n.kids[0].name for s in chosen for n in s.walk()
        if n.kind in ("Assignment", "PostfixExpression") or n.kind == "PrefixExpression" and n.name in ("++", "--") if n.kids[0].kind == "Name"
    }
    later = {n.name for n in method.walk() if n.kind == "Name" and n.start >= end}
    back = [v for v in dict.fromkeys([*inside, *changed]) if v in later and v in types]
    out = Rewrite()
    if len(back) > 1:
        out.warnings.append(f"several variables are used later: {', '.join(back)}; only {back[0]} is returned")
    result = back[0] if back else None
    pad = f.indent(method.start)
    body = source[start:end]
    old = f.indent(start)
    lines = [pad + "    " + (line[len(old) :] if line.startswith(old) else line.lstrip()) for line in (old + body).split("\n")]
    if result:
        lines.append(f"{pad}    return {result};")
    static = "static " if "static" in method.data["modifiers"] else ""
    kind = types[result] if result else "void"
    throws = f" throws {', '.join(method.data['throws'])}" if method.data["throws"] else ""
    made = f"\n\n{pad}private {static}{kind} {name}({', '.join(f'{types[p]} {p}' for p in params)}){throws} {{\n" + "\n".join(lines) + f"\n{pad}}}"
    call = f"{name}({', '.join(params)});"
    if result:
        call = (f"{kind} {result} = " if result in inside else f"{result} = ") + call
    out.edits = [(start, end - start, call), (method.end, 0, made)]
    return out


def _lambda(f: File, n: Node) -> str:
    (body,) = n.of("AnonymousClass")
    if len(body.kids) != 1 or body.kids[0].kind != "MethodDeclaration":
        raise Refused("the class has more than one method")
    m = body.kids[0]
    if any(x.kind in ("This", "Super") for x in m.walk()):
        raise Refused("the method speaks of itself")
    params = [p.name for p in m.data["params"]]
    head = params[0] if len(params) == 1 else f"({', '.join(params)})"
    block = m.data["body"]
    if len(block.kids) == 1 and block.kids[0].kind == "ReturnStatement" and block.kids[0].kids:
        return f"{head} -> {f.text(block.kids[0].kids[0])}"
    if len(block.kids) == 1 and block.kids[0].kind == "ExpressionStatement":
        return f"{head} -> {f.text(block.kids[0].kids[0])}"
    return f"{head} -> {f.text(block)}"


def convert_anonymous_to_lambda(source: str, offset: int, functional: frozenset[str] | set[str] = FUNCTIONAL) -> Rewrite:
    f = File(source)
    inside = [n for n in f.all if n.kind == "ClassInstanceCreation" and n.data["anonymous"] and n.start <= offset <= n.end]
    if not inside:
        raise Refused("no anonymous class here")
    n = min(inside, key=lambda x: x.end - x.start)
    if n.data["type"].rsplit(".", 1)[-1] not in functional and n.data["type"] not in functional:
        raise Refused(f"{n.data['type']} is not known to be functional")
    return Rewrite([(n.start, n.end - n.start, _lambda(f, n))])


def move_type_to_new_file(source: str, offset: int, folder: str) -> Rewrite:
    f = File(source)
    n = f.at(offset, "TypeDeclaration")
    owner = f.above(n, "TypeDeclaration") if n else None
    if owner is None or n.data.get("local"):
        raise Refused("not a nested type")
    if n.data["form"] == "class" and "static" not in n.data["modifiers"]:
        raise Refused("an inner class needs its outer instance")
    text = re.sub(r"\b(?:static|private|protected)\s+", "", source[n.start : n.data["name_start"]]) + source[n.data["name_start"] : n.end]
    package = next((f"package {k.name};\n\n" for k in f.unit.kids if k.kind == "PackageDeclaration"), "")
    imports = "".join(f.text(k) + "\n" for k in f.unit.kids if k.kind == "ImportDeclaration")
    pad = f.indent(n.start)
    text = "\n".join(line[len(pad) :] if line.startswith(pad) else line for line in text.split("\n"))
    begin = n.start - len(pad)
    path = f"{folder}/{n.name}.java" if folder else f"{n.name}.java"
    return Rewrite([(begin, n.end - begin, "")], {path: package + (imports + "\n" if imports else "") + text + "\n"})


# ---------------------------------------------------------------- clean-ups


def _invert_equals(f: File, n: Node):
    if n.kind == "MethodInvocation" and n.name == "equals" and len(n.data["args"]) == 1 and n.data["receiver"] is not None:
        r, a = n.data["receiver"], n.data["args"][0]
        if a.kind == "Literal" and a.data["literal"] in ("string", "text") and not (r.kind == "Literal" or r.kind == "Super"):
            yield n.start, n.end - n.start, f"{f.text(a)}.equals({f.text(r)})"


def _boolean_value(f: File, n: Node):
    if n.kind == "InfixExpression" and n.name in ("==", "!=") and len(n.kids) == 2:
        for k, other in ((n.kids[0], n.kids[1]), (n.kids[1], n.kids[0])):
            if k.kind == "Literal" and k.name in ("true", "false"):
                plain = (k.name == "true") == (n.name == "==")
                text = f.text(other)
                loose = other.kind in _LOOSE
                yield n.start, n.end - n.start, text if plain else f"!({text})" if loose else f"!{text}"
                return


def _else_if(f: File, n: Node):
    if n.kind == "IfStatement" and len(n.kids) == 3 and n.kids[2].kind == "Block" and len(n.kids[2].kids) == 1 and n.kids[2].kids[0].kind == "IfStatement":
        block = n.kids[2]
        if not any(a >= block.start and b <= block.end and not (a >= block.kids[0].start and b <= block.kids[0].end) for a, b, _ in f.comments):
            yield block.start, block.end - block.start, f.text(block.kids[0])


def _pattern_instanceof(f: File, n: Node):
    if n.kind == "IfStatement" and n.kids[0].kind == "InstanceofExpression" and n.kids[0].kids[1].kind == "Type" and n.kids[1].kind == "Block" and n.kids[1].kids:
        test, first = n.kids[0], n.kids[1].kids[0]
        if first.kind == "VariableDeclaration" and len(first.of("VariableDeclarationFragment")) == 1:
            (v,) = first.of("VariableDeclarationFragment")
            if v.kids and v.kids[0].kind == "CastExpression" and f.text(v.kids[0].kids[0]) == f.text(test.kids[1]) and f.text(v.kids[0].kids[1]) == f.text(test.kids[0]):
                yield test.end, 0, f" {v.name}"
                stop = first.end
                while stop < len(f.source) and f.source[stop].isspace():
                    stop += 1
                yield first.start, stop - first.start, ""


def _index_loops(f: File, n: Node):
    if n.kind != "ForStatement" or len(n.kids) != 4 or n.kids[0].kind != "VariableDeclaration":
        return
    init, test, step, body = n.kids
    m = re.fullmatch(r"int\s+(\w+)\s*=\s*0", f.text(init))
    if not m or not (t := re.fullmatch(rf"{m[1]}\s*<\s*(\w+)\.length", f.text(test))) or f.text(step) not in (f"{m[1]}++", f"++{m[1]}"):
        return
    index, array = m[1], t[1]
    uses = [x for x in body.walk() if x.kind == "Name" and x.name == index]
    cells = [f.parent[id(x)] for x in uses]
    if not uses or any(c.kind != "ArrayAccess" or f.text(c) != f"{array}[{index}]" for c in cells):
        return
    if any(f.parent[id(c)].kind in ("Assignment", "PostfixExpression", "PrefixExpression") and f.parent[id(c)].kids[0] is c for c in cells):
        return
    name = array[:-1] if array.endswith("s") and len(array) > 1 else "element"
    if any(x.kind == "Name" and x.name == name for x in body.walk()):
        return
    yield n.start, body.start - n.start, f"for (var {name} : {array}) "
    for c in cells:
        yield c.start, c.end - c.start, name


def _lambdas(f: File, n: Node):
    if n.kind == "ClassInstanceCreation" and n.data["anonymous"] and n.data["type"].rsplit(".", 1)[-1] in FUNCTIONAL:
        try:
            yield n.start, n.end - n.start, _lambda(f, n)
        except Refused:
            return


def _text_blocks(f: File, n: Node):
    if n.kind == "InfixExpression" and n.name == "+" and len(n.kids) > 1 and all(k.kind == "Literal" and k.data["literal"] == "string" for k in n.kids):
        parts = [k.name[1:-1] for k in n.kids]
        if all(p.endswith("\\n") for p in parts[:-1]) and not any(re.search(r'\\[^n"]', p) for p in parts):
            pad = f.indent(n.start) + "    "
            lines = "".join(parts).replace('\\"', '"').split("\\n")
            yield n.start, n.end - n.start, '"""\n' + "\n".join(pad + x if x else "" for x in lines[:-1]) + ("\n" if len(lines) > 1 else "") + pad + lines[-1] + '"""'


def _overridden(f: File, n: Node):
    if n.kind == "Block":
        for a, b in zip(n.kids, n.kids[1:]):
            if a.kind == "VariableDeclaration" and len(frags := a.of("VariableDeclarationFragment")) == 1 and frags[0].kids and frags[0].kids[0].kind == "Literal" and frags[0].data["type"] != "var":
                v = frags[0]
                if b.kind == "ExpressionStatement" and b.kids[0].kind == "Assignment" and b.kids[0].name == "=" and f.text(b.kids[0].kids[0]) == v.name:
                    if not any(x.kind == "Name" and x.name == v.name for x in b.kids[0].kids[1].walk()) and "final" not in a.data["modifiers"]:
                        stop = v.data["name_end"]
                        yield stop, v.end - stop, ""


def _switch_expression(f: File, n: Node):
    """A switch whose every group of labels returns one value, with a default."""
    if n.kind != "SwitchStatement" or any(k.kind == "SwitchCase" and k.data["arrow"] for k in n.kids):
        return
    arms, labels, default, saw_default = [], [], False, False
    for k in n.kids[1:]:
        if k.kind == "SwitchCase":
            labels += [f.text(x) for x in k.kids]
            default = default or k.data["default"]
        elif k.kind == "ReturnStatement" and k.kids and (labels or default):
            if default and labels:
                return
            arms.append(("default" if default else "case " + ", ".join(labels)) + f" -> {f.text(k.kids[0])};")
            saw_default = saw_default or default
            labels, default = [], False
        else:
            return
    if not saw_default or labels or default:
        return
    pad = f.indent(n.start)
    yield n.start, n.end - n.start, f"return switch ({f.text(n.kids[0])}) {{\n" + "".join(f"{pad}    {a}\n" for a in arms) + f"{pad}}};"


CLEAN_UPS = {
    "invert_equals": _invert_equals, "boolean_value_rather_than_comparison": _boolean_value, "else_if": _else_if, "pattern_matching_instanceof": _pattern_instanceof,
    "convert_loops": _index_loops, "convert_to_lambda": _lambdas, "string_concat_to_text_block": _text_blocks,
    "overridden_assignment": _overridden, "convert_to_switch_expression": _switch_expression,
}


def apply_cleanup(source: str, cleanup: str) -> str:
    """The file with one clean-up applied wherever it fits (where two places overlap, to the outer one)."""
    from codeseam.operators.edits import apply_edits

    if cleanup not in CLEAN_UPS:
        raise Refused(f"no such clean-up: {cleanup}; known: {', '.join(sorted(CLEAN_UPS))}")
    f = File(source)
    edits: list[tuple[int, int, str]] = []
    held = -1
    for n in f.all:
        made = list(CLEAN_UPS[cleanup](f, n))
        if made and min(e[0] for e in made) >= held:
            edits += made
            held = max(n.end, *(e[0] + e[1] for e in made))
    return apply_edits(source, edits)


# ---------------------------------------------------------------- members between types, signatures, calls


def _member(f: File, offset: int) -> tuple[Node, Node]:
    n = f.at(offset, "MethodDeclaration", "FieldDeclaration")
    owner = f.above(n, "TypeDeclaration") if n else None
    if owner is None or n.kind == "MethodDeclaration" and n.data["constructor"]:
        raise Refused("not a method or field")
    return n, owner


def member_text(source: str, offset: int) -> tuple[str, tuple[int, int, str]]:
    """A member's own lines, and the edit that takes it out."""
    f = File(source)
    n, _ = _member(f, offset)
    begin = n.start
    for a, b, kind in f.comments:  # its documentation goes with it
        if kind == "javadoc" and b <= n.start and not source[b : n.start].strip():
            begin = a
    pad = f.indent(begin)
    text = "\n".join(line[len(pad) :] if line.startswith(pad) else line for line in source[begin : n.end].split("\n"))
    start = begin - len(pad)
    stop = n.end + (1 if source[n.end : n.end + 1] == "\n" else 0)
    return text, (start, stop - start, "")


def insert_member(source: str, type_start: int, type_end: int, text: str) -> tuple[int, int, str]:
    """The edit that puts a member last into a type's body."""
    at = source.rindex("}", type_start, type_end)
    pad = re.match(r"[ \t]*", source[source.rfind("\n", 0, type_start) + 1 :])[0] + "    "
    body = "\n".join(pad + line if line.strip() else line for line in text.split("\n"))
    lead = "" if source[:at].rstrip(" \t").endswith("\n") else "\n"
    line = source.rfind("\n", 0, at) + 1
    if source[line:at].strip() == "":
        at = line
    return at, 0, f"{lead}{body}\n"


def header_end(source: str, type_name_start: int) -> int:
    """Where a type's body opens."""
    f = File(source)
    n = next(t for t in f.all if t.kind == "TypeDeclaration" and t.data["name_start"] == type_name_start)
    last = max([type_name_start + len(n.name), *(k.end for k in (*n.data["type_params"], *n.data["components"], *n.data["extends"], *n.data["implements"], *n.data["permits"]))])
    return source.index("{", last)


def after_name(source: str, type_name_start: int) -> int:
    """Where an extends clause goes: behind the name and its type parameters."""
    f = File(source)
    n = next(t for t in f.all if t.kind == "TypeDeclaration" and t.data["name_start"] == type_name_start)
    end = type_name_start + len(n.name)
    return source.index(">", max(k.end for k in n.data["type_params"]) - 1) + 1 if n.data["type_params"] else end


def type_parameter_names(source: str, type_name_start: int) -> list[str]:
    f = File(source)
    return [p.name for p in next(t for t in f.all if t.kind == "TypeDeclaration" and t.data["name_start"] == type_name_start).data["type_params"]]


def signature(source: str, offset: int) -> dict:
    """Places of a method's return type, name and parameter list."""
    f = File(source)
    n = f.at(offset, "MethodDeclaration")
    if n is None:
        raise Refused("not a method")
    kind = n.of("Type")
    opens = source.index("(", n.data["name_start"] + len(n.name))
    last = n.data["params"][-1].end if n.data["params"] else opens + 1
    closes = source.index(")", last)
    return {
        "name": n.name, "name_start": n.data["name_start"], "type": (kind[0].start, kind[0].end) if kind else None, "opens": opens + 1, "closes": closes,
        "params": [(p.data["type"], p.name) for p in n.data["params"]], "body": n.data["body"], "node": n, "file": f,
    }


def call_arguments(source: str, starts: list[int]) -> list[tuple[int, int, int, list[str]]]:
    """(name start, list start, list length, argument texts) of the calls whose name starts at given places; method
    references have a list start of -1."""
    f = File(source)
    wanted, out = set(starts), []
    for n in f.all:
        at = n.data.get("name_start")
        if n.kind == "MethodInvocation" and at in wanted:
            opens = source.index("(", at + len(n.name)) + 1
            out.append((at, opens, n.end - 1 - opens, [f.text(a) for a in n.data["args"]]))
        elif n.kind == "MethodReference" and at in wanted:
            out.append((at, -1, 0, []))
    return out


def write_edits(source: str, starts: list[int], getter: str, setter: str) -> list[tuple[int, int, str, str]]:
    """(start, length, new text, warning) that make writes of a field, named at given places, calls of its setter.

    A write whose value is used goes unchanged, with a warning.
    """
    f = File(source)
    wanted, out = set(starts), []
    for n in f.all:
        at = n.data.get("name_start", n.start)
        if n.kind not in ("Name", "FieldAccess") or at not in wanted:
            continue
        wanted.discard(at)
        p = f.parent[id(n)]
        alone = f.parent[id(p)].kind == "ExpressionStatement"
        receiver = source[n.start : at]  # with its dot, if any
        if p.kind == "Assignment" and p.kids[0] is n and alone:
            value = f.text(p.kids[1])
            if p.name != "=":
                value = f"{receiver}{getter}() {p.name[:-1]} " + (value if p.kids[1].kind in ("Name", "Literal", "MethodInvocation", "FieldAccess") else f"({value})")
            out.append((at, p.end - at, f"{setter}({value})", "" if p.name == "=" or receiver.count("(") == 0 else "the receiver is evaluated twice"))
        elif p.kind in ("PostfixExpression", "PrefixExpression") and alone:
            out.append((p.start, p.end - p.start, f"{receiver}{setter}({receiver}{getter}() {(p.name or source[p.end - 2 : p.end])[0]} 1)", ""))
        else:
            out.append((at, 0, "", "the written value is used, not rewritten"))
    return out


def private_field(source: str, name_start: int) -> tuple[int, int, str] | None:
    """The edit that makes a field private; none if it is."""
    n = File(source).at(name_start, "FieldDeclaration")
    if n is None:
        raise Refused("not a field's declaration")
    start, head = n.start, source[n.start : name_start]
    found = re.search(r"\b(public|protected|private)\b", head)
    if found:
        return None if found[1] == "private" else (start + found.start(), len(found[1]), "private")
    notes = re.match(r"(?:\s*@[\w.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)*", head)
    return start + notes.end(), 0, "private "


def implements_edit(source: str, type_name_start: int, interface: str) -> tuple[int, int, str]:
    """The edit that adds an interface to a type's header."""
    f = File(source)
    n = next(t for t in f.all if t.kind == "TypeDeclaration" and t.data["name_start"] == type_name_start)
    if n.data["implements"]:
        return n.data["implements"][-1].end, 0, f", {interface}"
    ends = [k.end for k in n.data["extends"]]
    if n.data["components"] or n.data["form"] == "record":
        ends.append(source.index(")", max([type_name_start, *(k.end for k in n.data["components"])])) + 1)
    at = max([after_name(source, type_name_start), *ends])
    return at, 0, f" implements {interface}"


def inline_method(call_source: str, call_at: int, body_source: str, body_at: int) -> Rewrite:
    """Replace one call by the method's single expression, its parameters by the arguments."""
    s = signature(body_source, body_at)
    body, g = s["body"], s["file"]
    if body is None or len(body.kids) != 1 or body.kids[0].kind not in ("ReturnStatement", "ExpressionStatement") or not body.kids[0].kids:
        raise Refused("the method is not one expression")
    value = body.kids[0].kids[0]
    f = File(call_source)
    call = next((n for n in f.all if n.kind == "MethodInvocation" and n.data["name_start"] == call_at), None)
    if call is None:
        raise Refused("no call here")
    if len(call.data["args"]) != len(s["params"]):
        raise Refused("the call's arguments don't match the parameters")
    given = {p: a for (_, p), a in zip(s["params"], call.data["args"])}
    out = Rewrite()
    edits = []
    for x in value.walk():
        if x.kind in ("This", "Super"):
            out.warnings.append(f"the method uses {x.name}")
        if x.kind == "Name" and x.name in given:
            a = given[x.name]
            text = f.text(a)
            edits.append((x.start - value.start, x.end - x.start, f"({text})" if a.kind in _LOOSE else text))
    from codeseam.operators.edits import apply_edits

    text = apply_edits(g.text(value), edits)
    parent = f.parent[id(call)].kind
    loose = value.kind in _LOOSE and parent not in ("ExpressionStatement", "VariableDeclarationFragment", "ReturnStatement", "Parenthesized")
    out.edits = [(call.start, call.end - call.start, f"({text})" if loose else text)]
    return out


def add_throws(source: str, offset: int, exception: str) -> Rewrite:
    f = File(source)
    n = f.at(offset, "MethodDeclaration")
    if n is None:
        raise Refused("not in a method")
    throws = n.of("Throws")
    if throws:
        return Rewrite([(throws[-1].end, 0, f", {exception}")])
    s = signature(source, n.data["name_start"])
    return Rewrite([(s["closes"] + 1, 0, f" throws {exception}")])


def surround_try_catch(source: str, offset: int, exception: str) -> Rewrite:
    f = File(source)
    inside = [s for s in f.all if (s.kind.endswith("Statement") or s.kind == "VariableDeclaration") and s.start <= offset <= s.end and f.parent[id(s)].kind == "Block"]
    if not inside:
        raise Refused("no statement here")
    s = min(inside, key=lambda x: x.end - x.start)
    pad = f.indent(s.start)
    body = f.text(s).replace("\n", "\n    ")
    return Rewrite([(s.start, s.end - s.start, f"try {{\n{pad}    {body}\n{pad}}} catch ({exception} e) {{\n{pad}    throw new RuntimeException(e);\n{pad}}}")])
