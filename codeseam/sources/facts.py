"""Facts of one Java file: symbols, supertypes, references, imports, annotations, syntax nodes, problems.

Everything a file says by itself is decided here: keys, enclosing owners, declared types of variables, access kinds,
nesting.  What needs other files (which type a name means, which method a call reaches) is left as candidate names and
receiver types, and is settled by joins in ``codeseam.plans.resolve``.
"""

from __future__ import annotations

import bisect
import hashlib
import re

from codeseam.sources.java_lexer import SyntaxProblem
from codeseam.sources.java_parser import Node, parse

FLAG = {
    "public": 1, "private": 2, "protected": 4, "static": 8, "final": 16, "synchronized": 32, "volatile": 64, "transient": 128, "native": 256,
    "abstract": 1024, "strictfp": 2048, "default": 0x10000, "sealed": 0x10000000, "non-sealed": 0x4000000,
}
ALWAYS = ("if", "for", "while")

_POS = "start int, length int, line int, col int"
SCHEMA = {
    "symbols": f"key string, kind string, owner_key string, simple_name string, package string, form string, flags int, return_type string, "
    f"params array<struct<type:string,name:string>>, exceptions array<string>, type_params array<string>, constant_value string, {_POS}, name_start int, "
    "name_length int, javadoc string, is_node boolean, is_main boolean, top_level boolean, ordinal int, field_declarations int, methods int, lines int, return_candidates array<string>",
    "supers": "type_key string, name string, relation string, ordinal int, candidates array<string>",
    "type_refs": f"name string, candidates array<string>, fine_kind string, enclosing_key string, enclosing_type string, context string, {_POS}",
    "calls": f"call_id int, form string, name string, arity int, receiver string, receiver_candidates array<string>, receiver_call int, owners array<string>, "
    f"enclosing_key string, enclosing_type string, context string, arguments array<string>, anonymous boolean, {_POS}",
    "accesses": f"name string, access string, receiver string, receiver_candidates array<string>, owners array<string>, enclosing_key string, enclosing_type string, context string, {_POS}",
    "imports": f"name string, is_static boolean, is_on_demand boolean, is_module boolean, ordinal int, package string, used boolean, {_POS}",
    "annotations": f"target_key string, target_kind string, target_name string, target_type string, owner_key string, name string, simple_name string, candidates array<string>, values map<string,string>, {_POS}",
    "nodes": "node_id int, parent_id int, depth int, kind string, name string, method_key string, type_key string, nesting int, parent_kind string, " + _POS,
    "variables": f"method_key string, name string, form string, type string, initial string, {_POS}",
    "variable_uses": f"method_key string, name string, access string, {_POS}",
    "assigns": "method_key string, source string, target string, line int",
    "call_arguments": "method_key string, variable string, call_id int, position int, line int, direct boolean",
    "dereferences": "method_key string, variable string, text string, line int",
    "findings": f"code string, severity string, message string, type_name string, candidates array<string>, method_key string, {_POS}",
    "comments": "start int, length int, kind string",
    "problems": "message string, start int, line int, col int",
}


class Extractor:
    def __init__(self, path: str, source: str):
        self.path, self.source = path, source
        self.lines = [0] + [m.end() for m in re.finditer("\n", source)]
        self.out: dict[str, list[dict]] = {name: [] for name in SCHEMA}
        self.package, self.single, self.demand = "", {}, []
        self.calls_seen = 0

    # ---- positions

    def pos(self, start: int, end: int) -> dict:
        line = bisect.bisect_right(self.lines, start) - 1
        return {"start": start, "length": end - start, "line": line, "col": start - self.lines[line]}

    def context(self, start: int) -> str:
        line = bisect.bisect_right(self.lines, start) - 1
        stop = self.lines[line + 1] if line + 1 < len(self.lines) else len(self.source)
        return self.source[self.lines[line] : stop].rstrip("\r\n").strip()

    # ---- names

    def candidates(self, name: str, types: list[str]) -> list[str]:
        """Full names that a type name may mean, the likeliest first; the last is what it means if no source declares it."""
        head, _, rest = name.partition(".")
        tail = "." + rest if rest else ""
        out = [f"{t}.{name}" for t in reversed(types)] + [t for t in reversed(types) if t.rsplit(".", 1)[-1] == name]
        if head in self.single:
            out.append(self.single[head] + tail)
        out.append(f"{self.package}.{name}" if self.package else name)
        out += [f"{p}.{name}" for p in self.demand]
        outside = self.single[head] + tail if head in self.single else name if rest else f"java.lang.{name}"
        return [c for c in dict.fromkeys(out) if c != outside] + [outside] if head not in self.single else [*dict.fromkeys(out), outside]

    def run(self) -> dict[str, list[dict]]:
        try:
            unit, comments = parse(self.source)
        except (SyntaxProblem, RecursionError) as e:
            at = getattr(e, "at", 0)
            where = self.pos(at, at)
            self.out["problems"].append({"message": str(e) or "nested too deeply", "start": at, "line": where["line"], "col": where["col"]})
            return self.out
        self.javadocs = {b: (a, b) for a, b, k in comments if k == "javadoc"}
        self.doc_ends = sorted(self.javadocs)
        self.out["comments"] = [{"start": a, "length": b - a, "kind": k} for a, b, k in comments]
        for n in unit.kids:
            if n.kind == "PackageDeclaration":
                self.package = n.name
        for k, n in enumerate(x for x in unit.kids if x.kind == "ImportDeclaration"):
            d = n.data
            if d["is_on_demand"]:
                self.demand.append(n.name)
            else:
                self.single[n.name.rsplit(".", 1)[-1]] = n.name.rsplit(".", 1)[0] if d["is_static"] else n.name
            self.out["imports"].append({"name": n.name, **d, "ordinal": k, "package": self.package, "used": None, **self.pos(n.start, n.end)})
        self.declared: dict[tuple[str, str, int], str] = {}
        self.fields: dict[str, dict[str, str]] = {}
        self.known_types: dict[str, list[str]] = {}
        for k, n in enumerate(x for x in unit.kids if x.kind == "TypeDeclaration"):
            self.collect(n, f"{self.package}." if self.package else "")
        for k, n in enumerate(x for x in unit.kids if x.kind == "TypeDeclaration"):
            self.type_(n, [], k)
        self.nodes(unit)
        mentioned = {r["name"].split(".")[0] for r in self.out["type_refs"] if r["fine_kind"] != "IMPORT"}
        mentioned |= {r["receiver"].split(".")[0] for t in ("calls", "accesses") for r in self.out[t] if r["receiver"]}
        mentioned |= {r["name"] for t in ("calls", "accesses") for r in self.out[t]} | {a["name"].split(".")[0] for a in self.out["annotations"]}
        for i in self.out["imports"]:
            i["used"] = i["is_on_demand"] or i["is_module"] or i["name"].rsplit(".", 1)[-1] in mentioned
            i["package"] = self.package
        return self.out

    def collect(self, n: Node, prefix: str) -> None:
        key = prefix + n.name
        self.known_types[key] = []
        own = self.fields.setdefault(key, {})
        for m in n.kids:
            if m.kind == "FieldDeclaration":
                own.update({f.name: f.data["type"] for f in m.of("VariableDeclarationFragment")})
            elif m.kind == "EnumConstant":
                own[m.name] = n.name
            elif m.kind == "MethodDeclaration" and m.data["type"]:
                self.declared[(key, m.name, len(m.data["params"]))] = m.data["type"]
            elif m.kind == "TypeDeclaration":
                self.collect(m, key + ".")
        for c in n.data["components"]:
            own[c.name] = c.data["type"]

    # ---- declarations

    @staticmethod
    def simple(type_text: str) -> str:
        bare, dims = re.match(r"([^\[]*)(.*)", type_text).groups()
        return bare.rsplit(".", 1)[-1] + dims

    def doc(self, start: int) -> str | None:
        k = bisect.bisect_right(self.doc_ends, start) - 1
        if k < 0:
            return None
        a, b = self.javadocs[self.doc_ends[k]]
        return self.source[a:b] if not self.source[b:start].strip() else None

    def symbol(self, n: Node, key: str, kind: str, owner: str | None, form: str, words: list[str], ordinal: int, **more) -> None:
        row = {
            "key": key, "kind": kind, "owner_key": owner, "simple_name": n.name, "package": self.package, "form": form, "flags": sum(FLAG.get(w, 0) for w in set(words)),
            "return_type": None, "params": None, "exceptions": None, "type_params": None, "constant_value": None, "return_candidates": None, **self.pos(n.start, n.end), "name_start": n.data.get("name_start", n.start),
            "name_length": len(n.name), "javadoc": self.doc(n.start), "is_node": True, "is_main": False, "top_level": False, "ordinal": ordinal, "field_declarations": None, "methods": None,
            "lines": self.pos(n.end, n.end)["line"] - self.pos(n.start, n.start)["line"] + 1, **more,
        }
        if row["return_type"]:
            row["return_candidates"] = self.candidates(re.sub(r"[<\[].*", "", row["return_type"]), [owner] if owner else [])
        where = self.pos(row["name_start"], row["name_start"])
        row["line"], row["col"] = where["line"], where["col"]
        self.out["symbols"].append(row)

    def type_ref(self, name: str, start: int, end: int, fine: str, types: list[str], enclosing: str) -> None:
        if name in ("var", "?") or name in ("boolean", "byte", "char", "short", "int", "long", "float", "double", "void"):
            return
        self.out["type_refs"].append(
            {"name": name, "candidates": self.candidates(name, types), "fine_kind": fine, "enclosing_key": enclosing, "enclosing_type": types[-1] if types else None,
             "context": self.context(start), **self.pos(start, end)}
        )

    def type_use(self, t: Node, fine: str, types: list[str], enclosing: str) -> None:
        self.type_ref(t.name, t.start, min(t.end, t.start + len(t.name)), fine, types, enclosing)
        for k in t.kids:
            if k.kind == "Annotation":
                self.annotation(k, None, "TYPE_USE", "", "", None, types, enclosing)
            else:
                self.type_use(k, "TYPE_ARGUMENT" if k.kind == "TypeArgument" else fine, types, enclosing)

    def annotation(self, n: Node, key, kind: str, name: str, type_text: str, owner, types: list[str], enclosing: str) -> None:
        self.out["annotations"].append(
            {"target_key": key, "target_kind": kind, "target_name": name, "target_type": type_text, "owner_key": owner, "name": n.name, "simple_name": n.name.rsplit(".", 1)[-1],
             "candidates": self.candidates(n.name, types), "values": dict(n.data["values"]), **self.pos(n.start, n.end)}
        )
        self.type_ref(n.name, n.start + 1, n.start + 1 + len(n.name), "ANNOTATION", types, enclosing)
        for v in n.kids:
            self.expression(v, types, enclosing, [{}], None)

    def type_(self, n: Node, types: list[str], ordinal: int) -> None:
        d = n.data
        key = f"{types[-1]}.{n.name}" if types else f"{self.package}.{n.name}" if self.package else n.name
        inner = [*types, key]
        words = list(d["modifiers"])
        fields, methods = n.of("FieldDeclaration"), n.of("MethodDeclaration")
        self.symbol(
            n, key, "TYPE", types[-1] if types else None, d["form"], words, ordinal, type_params=[p.name for p in d["type_params"]], top_level=not types,
            is_node=d["form"] != "annotation", field_declarations=len(fields) + len(d["components"]), methods=len(methods),
        )
        for a in n.of("Annotation"):
            self.annotation(a, key, "TYPE", n.name, "", types[-1] if types else None, types, key)
        for relation, group in (("extends", d["extends"]), ("implements", d["implements"])):
            for k, t in enumerate(group):
                self.out["supers"].append({"type_key": key, "name": t.name, "relation": relation, "ordinal": k, "candidates": self.candidates(t.name, types or inner)})
                self.type_use(t, relation.upper(), inner, key)
        for p in d["type_params"]:
            for b in p.kids:
                self.type_use(b, "BOUND", inner, key)
        for k, c in enumerate(d["components"]):
            self.symbol(c, f"{key}#{c.name}", "FIELD", key, "recordComponent", ["private", "final"], k, return_type=c.data["type"], is_node=False)
            self.variable_types(c, "FIELD_TYPE", inner, key)
        for k, m in enumerate(n.kids):
            if m.kind == "FieldDeclaration":
                self.field(m, inner, k, d["form"] in ("interface", "annotation"))
            elif m.kind == "EnumConstant":
                self.symbol(m, f"{key}#{m.name}", "FIELD", key, "enumConstant", ["public", "static", "final"], k, return_type=n.name, is_node=False)
                for a in m.of("Annotation"):
                    self.annotation(a, f"{key}#{m.name}", "FIELD", m.name, n.name, key, inner, key)
                for x in m.kids:
                    if x.kind == "AnonymousClass":
                        self.anonymous(x, inner, key, [{}], None)
                    elif x.kind != "Annotation":
                        self.expression(x, inner, key, [{}], None)
            elif m.kind == "MethodDeclaration":
                self.method(m, inner, k, d["form"])
            elif m.kind == "Initializer":
                self.statement(m.kids[0], inner, key, [{}], None)
            elif m.kind == "TypeDeclaration":
                self.type_(m, inner, k)

    def variable_types(self, n: Node, fine: str, types: list[str], enclosing: str) -> None:
        for k in n.kids:
            if k.kind in ("Type", "TypeArgument"):
                self.type_use(k, fine, types, enclosing)
            elif k.kind == "Annotation":
                self.annotation(k, None, "VARIABLE", n.name, n.data.get("type") or "", None, types, enclosing)

    def field(self, n: Node, types: list[str], ordinal: int, constant_owner: bool) -> None:
        owner = types[-1]
        words = [*n.data["modifiers"], *(["public", "static", "final"] if constant_owner else [])]
        for f in n.of("VariableDeclarationFragment"):
            value = f.kids[0] if f.kids else None
            constant = self.source[value.start : value.end] if value is not None and value.kind == "Literal" and {"static", "final"} <= set(words) else None
            form = "constant" if {"static", "final"} <= set(words) else "field"
            self.symbol(f, f"{owner}#{f.name}", "FIELD", owner, form, words, ordinal, return_type=f.data["type"], constant_value=constant, javadoc=self.doc(n.start))
            for a in n.of("Annotation"):
                self.annotation(a, f"{owner}#{f.name}", "FIELD", f.name, self.source[n.of("Type")[0].start : n.of("Type")[0].end], owner, types, owner)
            if value is not None:
                self.expression(value, types, owner, [{}], None)
        for t in n.of("Type"):
            self.type_use(t, "FIELD_TYPE", types, owner)

    def method_key(self, owner: str, n: Node) -> str:
        return f"{owner}#{n.name}({','.join(self.simple(p.data['type']) for p in n.data['params'])})"

    def method(self, n: Node, types: list[str], ordinal: int, owner_form: str) -> None:
        d, owner = n.data, types[-1]
        key = self.method_key(owner, n)
        words = list(d["modifiers"])
        if owner_form in ("interface", "annotation") and not {"private", "protected"} & set(words):
            words.append("public")
            if d["body"] is None:
                words.append("abstract")
        main = n.name == "main" and d["type"] == "void" and {"public", "static"} <= set(words) and [p.data["type"] for p in d["params"]] == ["String[]"]
        self.symbol(
            n, key, "METHOD", owner, "constructor" if d["constructor"] else "method", words, ordinal, return_type=d["type"],
            params=[{"type": p.data["type"], "name": p.name} for p in d["params"]], exceptions=d["throws"], type_params=[p.name for p in d["type_params"]], is_main=main,
        )
        scope: dict[str, str] = {}
        for k in n.kids:
            if k.kind == "Annotation":
                self.annotation(k, key, "METHOD", n.name, d["type"] or "", owner, types, key)
            elif k.kind == "Type":
                self.type_use(k, "RETURN_TYPE", types, key)
            elif k.kind == "Throws":
                self.type_use(k.kids[0], "THROWS", types, key)
            elif k.kind == "TypeParameter":
                for b in k.kids:
                    self.type_use(b, "BOUND", types, key)
            elif k.kind == "Parameter":
                scope[k.name] = k.data["type"]
                self.variable_types(k, "PARAMETER_TYPE", types, key)
                self.variable(k, "parameter", k.data["type"], None, key)
        if d["body"] is not None:
            self.statement(d["body"], types, key, [scope], key)

    def variable(self, n: Node, form: str, type_text: str, initial: Node | None, method: str | None) -> None:
        if method:
            self.out["variables"].append(
                {"method_key": method, "name": n.name, "form": form, "type": type_text, "initial": initial and self.source[initial.start : initial.end], **self.pos(n.data.get("name_start", n.start), n.end)}
            )

    # ---- bodies

    def anonymous(self, n: Node, types, enclosing, scopes, method) -> None:
        for m in n.kids:
            inner = [*scopes, {}]
            if m.kind == "MethodDeclaration":
                inner[-1].update({p.name: p.data["type"] for p in m.data["params"]})
                for p in m.data["params"]:
                    self.variable_types(p, "PARAMETER_TYPE", types, enclosing)
                for t in m.of("Type"):
                    self.type_use(t, "RETURN_TYPE", types, enclosing)
                for a in m.of("Annotation"):
                    self.annotation(a, None, "METHOD", m.name, "", None, types, enclosing)
                if m.data["body"] is not None:
                    self.statement(m.data["body"], types, enclosing, inner, method)
            elif m.kind == "FieldDeclaration":
                for t in m.of("Type"):
                    self.type_use(t, "FIELD_TYPE", types, enclosing)
                for f in m.of("VariableDeclarationFragment"):
                    scopes[-1].setdefault(f.name, f.data["type"])
                    for v in f.kids:
                        self.expression(v, types, enclosing, inner, method)
            elif m.kind == "Initializer":
                self.statement(m.kids[0], types, enclosing, inner, method)

    def statement(self, n: Node, types, enclosing, scopes, method) -> None:
        kind = n.kind
        if kind in ("Block", "ForStatement", "EnhancedForStatement", "TryStatement", "CatchClause", "SwitchStatement", "SwitchExpression"):
            scopes = [*scopes, {}]
        if kind == "CatchClause" and not n.kids[-1].kids:
            self.finding("EMPTY_CATCH", "medium", "Exception swallowed by an empty catch block", n, method)
        if kind == "SynchronizedStatement" and self.type_of(n.kids[0], types, scopes)[0] in ("String", "java.lang.String"):
            self.finding("SYNC_ON_STRING", "high", "Lock held on a string, which may be shared", n, method)
        if kind == "TryStatement" and n.data["resources"]:
            self.guarded = getattr(self, "guarded", 0) + 1
            for k in n.kids:
                self.statement(k, types, enclosing, scopes, method)
            self.guarded -= 1
            return
        if kind == "VariableDeclaration":
            self.declare(n, types, enclosing, scopes, method)
            if not getattr(self, "guarded", 0):
                for f in n.of("VariableDeclarationFragment"):
                    if f.kids and f.kids[0].kind == "ClassInstanceCreation":
                        self.finding("RESOURCE_LEAK", "medium", "Resource may stay open", f, method, f.kids[0].data["type"], types)
        elif kind == "TypeDeclaration":
            for m in n.of("MethodDeclaration", "FieldDeclaration", "Initializer"):
                self.anonymous(Node("AnonymousClass", m.start, m.end, "", [m]), types, enclosing, scopes, method)
        elif kind == "Parameter":
            scopes[-1][n.name] = n.data["type"]
            fine = "CATCH" if n.data.get("caught") else "LOCAL_TYPE"
            self.variable_types(n, fine, types, enclosing)
            self.variable(n, "catch" if n.data.get("caught") else "foreach", n.data["type"], None, method)
        elif kind.endswith("Statement") or kind in ("Block", "CatchClause", "SwitchCase"):
            for k in n.kids:
                self.statement(k, types, enclosing, scopes, method)
        elif kind == "RecordPattern":
            for k in n.kids:
                self.type_use(k, "INSTANCEOF", types, enclosing) if k.kind == "Type" else self.statement(k, types, enclosing, scopes, method)
        else:
            self.expression(n, types, enclosing, scopes, method)

    def declare(self, n: Node, types, enclosing, scopes, method) -> None:
        for k in n.kids:
            if k.kind == "Type":
                self.type_use(k, "LOCAL_TYPE", types, enclosing)
            elif k.kind == "Annotation":
                self.annotation(k, None, "VARIABLE", "", "", None, types, enclosing)
            elif k.kind == "VariableDeclarationFragment":
                text = k.data["type"]
                if text == "var" and k.kids:
                    text = self.type_of(k.kids[0], types, scopes)[0] or "var"
                for v in k.kids:
                    self.expression(v, types, enclosing, scopes, method)
                    self.flows(v, k.name, method, k.start)
                scopes[-1][k.name] = text
                self.variable(k, "local", text, k.kids[0] if k.kids else None, method)

    def flows(self, value: Node, target: str, method: str | None, at: int) -> None:
        if method:
            line = self.pos(at, at)["line"]
            for x in value.walk():
                if x.kind == "Name":
                    self.out["assigns"].append({"method_key": method, "source": x.name, "target": target, "line": line})

    def lookup(self, name: str, types, scopes) -> str | None:
        for s in reversed(scopes):
            if name in s:
                return s[name]
        return None

    def field_type(self, name: str, types) -> str | None:
        for t in reversed(types):
            if name in self.fields.get(t, {}):
                return self.fields[t][name]
        return None

    def type_of(self, e: Node, types, scopes) -> tuple[str | None, int | None]:
        """Declared type of an expression as written, or the call whose result it is."""
        kind = e.kind
        if kind == "Parenthesized":
            return self.type_of(e.kids[0], types, scopes)
        if kind == "Name":
            local = self.lookup(e.name, types, scopes)
            if local is not None:
                return local or None, None
            field = self.field_type(e.name, types)
            if field is not None:
                return field, None
            return (e.name, None) if e.name[:1].isupper() else (None, None)
        if kind == "This":
            return (types[-1] if types else None), None
        if kind == "Super":
            return None, None
        if kind == "FieldAccess":
            receiver = e.data["receiver"]
            if receiver.kind == "This":
                return self.field_type(e.name, types), None
            text = self.source[e.start : e.end]
            if re.fullmatch(r"[\w$]+(\s*\.\s*[\w$]+)*", text) and e.name[:1].isupper() and not e.name.isupper():
                return re.sub(r"\s", "", text), None
            owner, _ = self.type_of(receiver, types, scopes)
            for key, own in self.fields.items():
                if owner and (key == owner or key.endswith("." + owner)) and e.name in own:
                    return own[e.name], None
            return None, None
        if kind == "ClassInstanceCreation":
            return e.data["type"], None
        if kind == "CastExpression":
            return e.kids[0].name + "[]" * e.kids[0].data["dims"], None
        if kind == "Literal":
            return {"string": "String", "text": "String"}.get(e.data["literal"]), None
        if kind == "TypeLiteral":
            return "Class", None
        if kind == "MethodInvocation":
            if e.data["receiver"] is None or e.data["receiver"].kind == "This":
                for t in reversed(types):
                    if (t, e.name, len(e.data["args"])) in self.declared:
                        return self.declared[(t, e.name, len(e.data["args"]))], None
            known = self.platform_result(e, types, scopes)
            return (known, None) if known else (None, e.data.get("call_id"))
        if kind == "ArrayAccess":
            inner, _ = self.type_of(e.kids[0], types, scopes)
            return (inner[:-2] if inner and inner.endswith("[]") else None), None
        if kind == "ConditionalExpression":
            return self.type_of(e.kids[1], types, scopes)
        if kind == "InfixExpression" and e.name == "+":
            kinds = [self.type_of(k, types, scopes)[0] for k in e.kids]
            return ("String" if "String" in kinds else None), None
        return None, None

    def platform_result(self, e: Node, types, scopes) -> str | None:
        """What some methods that every object, string and class has give back."""
        if not e.data["args"] and e.name in ("toString", "getClass"):
            return "String" if e.name == "toString" else "Class"
        if e.data["receiver"] is None:
            return None
        owner = self.type_of(e.data["receiver"], types, scopes)[0]
        if owner in ("Class", "java.lang.Class"):
            for suffix in ("Method", "Field", "Constructor"):
                if e.name in (f"get{suffix}", f"getDeclared{suffix}"):
                    return f"java.lang.reflect.{suffix}"
            return {"forName": "Class", "getName": "String", "getSimpleName": "String"}.get(e.name)
        if owner in ("String", "java.lang.String") and e.name in ("trim", "strip", "substring", "toLowerCase", "toUpperCase", "replace", "concat", "repeat", "formatted", "format", "valueOf", "join"):
            return "String"
        return None

    def add_call(self, n: Node, form: str, name: str, args: list[Node], receiver: str | None, receiver_call: int | None, owners: list[str], types, enclosing, scopes, start: int) -> None:
        self.calls_seen += 1
        n.data["call_id"] = self.calls_seen
        self.out["calls"].append(
            {"call_id": self.calls_seen, "form": form, "name": name, "arity": len(args), "receiver": receiver, "receiver_candidates": self.candidates(receiver, types) if receiver else None,
             "receiver_call": receiver_call, "owners": owners, "enclosing_key": enclosing, "enclosing_type": types[-1] if types else None, "context": self.context(start),
             "arguments": [self.type_of(a, types, scopes)[0] for a in args], "anonymous": bool(n.of("AnonymousClass")), **self.pos(start, start + len(name) if form != "CREATE" else n.end)}
        )

    def pass_arguments(self, n: Node, args: list[Node], method: str | None) -> None:
        if method:
            for k, a in enumerate(args):
                for x in a.walk():
                    if x.kind == "Name":
                        self.out["call_arguments"].append(
                            {"method_key": method, "variable": x.name, "call_id": n.data["call_id"], "position": k, "line": self.pos(n.start, n.start)["line"], "direct": x is a}
                        )

    def receiver(self, r: Node, types, scopes) -> tuple[str | None, int | None]:
        text, call = self.type_of(r, types, scopes)
        return (text.split("[")[0].split("<")[0] if text else None), call

    def expression(self, e: Node, types, enclosing, scopes, method) -> None:
        kind = e.kind
        each = lambda nodes: [self.expression(k, types, enclosing, scopes, method) for k in nodes]
        if kind == "Name":
            self.access(e, "READ", types, enclosing, scopes, method)
        elif kind == "FieldAccess":
            self.access(e, "READ", types, enclosing, scopes, method)
            self.dereference(e, e.data["receiver"], method)
        elif kind == "Assignment":
            target, value = e.kids
            self.expression(value, types, enclosing, scopes, method)
            self.target(target, "WRITE" if e.name == "=" else "READ_WRITE", types, enclosing, scopes, method)
            if target.kind == "Name":
                self.flows(value, target.name, method, e.start)
        elif kind == "PostfixExpression" or kind == "PrefixExpression" and e.name in ("++", "--"):
            self.target(e.kids[0], "READ_WRITE", types, enclosing, scopes, method)
        elif kind == "MethodInvocation":
            r = e.data["receiver"]
            if r is not None:
                self.expression(r, types, enclosing, scopes, method)
                self.dereference(e, r, method)
            each(e.data["args"])
            if r is None:
                self.add_call(e, "CALL", e.name, e.data["args"], None, None, list(reversed(types)), types, enclosing, scopes, e.data["name_start"])
            elif r.kind == "Super":
                self.add_call(e, "SUPER", e.name, e.data["args"], None, None, types[-1:], types, enclosing, scopes, e.data["name_start"])
            else:
                text, call = self.receiver(r, types, scopes)
                self.add_call(e, "CALL", e.name, e.data["args"], text, call, [], types, enclosing, scopes, e.data["name_start"])
            self.pass_arguments(e, e.data["args"], method)
        elif kind == "ClassInstanceCreation":
            if e.data["outer"] is not None:
                self.expression(e.data["outer"], types, enclosing, scopes, method)
            for k in e.kids:
                if k.kind == "Type":
                    self.type_use(k, "INSTANTIATION", types, enclosing)
            each(e.data["args"])
            self.add_call(e, "CREATE", e.data["type"].rsplit(".", 1)[-1], e.data["args"], e.data["type"], None, [], types, enclosing, scopes, e.start)
            self.pass_arguments(e, e.data["args"], method)
            for k in e.of("AnonymousClass"):
                self.anonymous(k, types, enclosing, [*scopes, {}], method)
        elif kind == "ConstructorInvocation":
            each(e.kids)
            self.add_call(e, "THIS_CONSTRUCTOR" if e.name == "this" else "SUPER_CONSTRUCTOR", e.name, e.kids[len(e.kids) - e.data["args"] :], None, None, types[-1:], types, enclosing, scopes, e.start)
        elif kind == "MethodReference":
            r = e.data["receiver"]
            if r.kind == "Type":
                self.type_use(r, "OTHER", types, enclosing)
                text, call = r.name, None
            else:
                self.expression(r, types, enclosing, scopes, method)
                text, call = self.receiver(r, types, scopes)
            owners = types[-1:] if r.kind in ("This", "Super") else []
            self.add_call(e, "REFERENCE", e.name, [], text, call, owners, types, enclosing, scopes, e.data["name_start"])
        elif kind == "CastExpression":
            self.type_use(e.kids[0], "CAST", types, enclosing)
            each(e.kids[1:])
        elif kind == "InstanceofExpression":
            self.expression(e.kids[0], types, enclosing, scopes, method)
            right = e.kids[1]
            if right.kind == "Type":
                self.type_use(right, "INSTANCEOF", types, enclosing)
            elif right.kind == "Parameter":
                scopes[-1][right.name] = right.data["type"]
                self.variable_types(right, "INSTANCEOF", types, enclosing)
                self.variable(right, "pattern", right.data["type"], None, method)
            else:
                self.statement(right, types, enclosing, scopes, method)
        elif kind == "Lambda":
            inner = [*scopes, {p.name: p.data["type"] for p in e.data["params"]}]
            for p in e.data["params"]:
                self.variable_types(p, "PARAMETER_TYPE", types, enclosing)
                self.variable(p, "lambda", p.data["type"], None, method)
            self.statement(e.kids[-1], types, enclosing, inner, method)
        elif kind in ("ArrayCreation", "TypeLiteral"):
            for k in e.kids:
                if k.kind in ("Type", "TypeArgument"):
                    self.type_use(k, "INSTANTIATION" if kind == "ArrayCreation" else "TYPE_LITERAL", types, enclosing)
                else:
                    self.expression(k, types, enclosing, scopes, method)
        elif kind == "SwitchExpression":
            self.statement(Node("SwitchStatement", e.start, e.end, "", e.kids), types, enclosing, scopes, method)
        elif kind == "Annotation":
            self.annotation(e, None, "VALUE", "", "", None, types, enclosing)
        elif kind == "Block":
            self.statement(e, types, enclosing, scopes, method)
        else:
            each(e.kids)
            if kind == "InfixExpression" and e.name in ("==", "!="):
                nulls = any(k.kind == "Literal" and k.name == "null" for k in e.kids)
                if not nulls and any(self.type_of(k, types, scopes)[0] in ("String", "java.lang.String") for k in e.kids):
                    self.finding("STRING_COMPARISON", "high", "Strings compared by identity", e, method)

    def finding(self, code: str, severity: str, message: str, n: Node, method: str | None, type_name: str | None = None, types=()) -> None:
        self.out["findings"].append(
            {"code": code, "severity": severity, "message": message, "type_name": type_name, "candidates": self.candidates(type_name, list(types)) if type_name else None,
             "method_key": method, **self.pos(n.start, n.end)}
        )

    def target(self, t: Node, how: str, types, enclosing, scopes, method) -> None:
        while t.kind == "Parenthesized":
            t = t.kids[0]
        if t.kind in ("Name", "FieldAccess"):
            self.access(t, how, types, enclosing, scopes, method)
        else:
            self.expression(t, types, enclosing, scopes, method)

    def access(self, n: Node, how: str, types, enclosing, scopes, method) -> None:
        start = n.data.get("name_start", n.start)
        where = self.pos(start, start + len(n.name))
        if n.kind == "Name" and self.lookup(n.name, types, scopes) is not None:
            if method:
                for a in ("READ", "WRITE") if how == "READ_WRITE" else (how,):
                    self.out["variable_uses"].append({"method_key": method, "name": n.name, "access": a, **where})
            return
        receiver, owners = None, list(reversed(types))
        if n.kind == "FieldAccess":
            r = n.data["receiver"]
            self.expression(r, types, enclosing, scopes, method)
            if r.kind == "This":
                owners = types[-1:]
            else:
                receiver, owners = self.receiver(r, types, scopes)[0], []
        elif n.name[:1].isupper() and self.field_type(n.name, types) is None:
            self.type_ref(n.name, start, start + len(n.name), "OTHER", types, enclosing)
        for a in ("READS", "WRITES") if how == "READ_WRITE" else (how + "S",):
            self.out["accesses"].append(
                {"name": n.name, "access": a, "receiver": receiver, "receiver_candidates": self.candidates(receiver, types) if receiver else None, "owners": owners,
                 "enclosing_key": enclosing, "enclosing_type": types[-1] if types else None, "context": self.context(start), **where}
            )

    def dereference(self, e: Node, r: Node, method: str | None) -> None:
        if method and r.kind == "Name":
            self.out["dereferences"].append({"method_key": method, "variable": r.name, "text": self.source[e.start : e.end], "line": self.pos(e.start, e.start)["line"]})

    # ---- syntax nodes

    NESTS = frozenset(("IfStatement", "ForStatement", "EnhancedForStatement", "WhileStatement", "DoStatement", "TryStatement"))
    KEPT = NESTS | frozenset(
        ("SwitchStatement", "SwitchExpression", "SwitchCase", "CatchClause", "ConditionalExpression", "InfixExpression", "ThrowStatement", "ReturnStatement", "BreakStatement",
         "ContinueStatement", "SynchronizedStatement", "MethodInvocation", "Lambda", "Block", "ClassInstanceCreation", "Assignment", "VariableDeclaration", "MethodDeclaration")
    )

    def nodes(self, unit: Node) -> None:
        """Statement and decision nodes with the method they stand in and how deep they nest there."""
        count = 0

        def visit(n: Node, parent: int, parent_kind: str, depth: int, method: str | None, type_key: str | None, nesting: int) -> None:
            nonlocal count
            here = parent
            if n.kind == "TypeDeclaration":
                type_key = f"{type_key}.{n.name}" if type_key else f"{self.package}.{n.name}" if self.package else n.name
            elif n.kind == "MethodDeclaration" and type_key and method is None:
                method, nesting = self.method_key(type_key, n), 0
            if n.kind in self.KEPT:
                count += 1
                here = count
                extra = n.name
                if n.kind == "SwitchCase":
                    extra = "default" if n.data["default"] else "case"
                elif n.kind == "TryStatement":
                    extra = ("finally " if n.data["has_finally"] else "") + f"resources={n.data['resources']}"
                elif n.kind == "CatchClause":
                    block = n.kids[-1]
                    extra = "|".join(t.name for t in n.data["caught"]) + (" empty" if not block.kids else "")
                self.out["nodes"].append(
                    {"node_id": here, "parent_id": parent, "depth": depth, "kind": n.kind, "name": extra, "method_key": method, "type_key": type_key, "nesting": nesting,
                     "parent_kind": parent_kind + (":" + n.data.get("chain", "") if "chain" in n.data else ""), **self.pos(n.start, n.end)}
                )
            inner = nesting + (n.kind in self.NESTS)
            for k in n.kids:
                if n.kind == "InfixExpression" and n.name in ("&&", "||") and k.kind == "InfixExpression" and k.name in ("&&", "||"):
                    k.data["chain"] = "inner"
                visit(k, here, n.kind, depth + 1, method, type_key, inner)

        visit(unit, 0, "", 0, None, None, 0)


def loc(source: str) -> dict[str, int]:
    """Physical, blank, comment and code lines; trailing empty lines don't count."""
    lines = source.split("\n")
    while len(lines) > 1 and lines[-1].rstrip("\r") == "":
        lines.pop()
    blank = comment = 0
    inside = False
    for line in lines:
        s = line.strip()
        if not s:
            blank += 1
        elif inside:
            comment += 1
            inside = "*/" not in s
        elif s.startswith("//"):
            comment += 1
        elif s.startswith("/*"):
            comment += 1
            inside = "*/" not in s
    return {"physical": len(lines), "blank": blank, "comment": comment, "code": len(lines) - blank - comment}


def extract(path: str, content: bytes) -> dict:
    source = content.decode("utf-8", "replace").removeprefix("﻿")
    e = Extractor(path, source)
    out = e.run()
    return {"path": path, "package": e.package, "size": len(content), "md5": hashlib.md5(content).hexdigest(), "content": source, **loc(source), **out}
