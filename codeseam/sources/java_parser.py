"""A recursive-descent parser of Java (declarations, statements, expressions) into labelled nodes with source ranges.

Pure Python, because executors have no JVM gateway.  It accepts some programs that a compiler refuses; what it cannot
read raises SyntaxProblem with a position.
"""

from __future__ import annotations

from codeseam.sources.java_lexer import PRIMITIVES, SyntaxProblem, Token, tokens

MODIFIERS = frozenset("public protected private static final abstract synchronized native strictfp transient volatile default sealed".split())
ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())
BINARY = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">=", "instanceof"], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]


class Node:
    __slots__ = ("kind", "start", "end", "name", "kids", "data")

    def __init__(self, kind: str, start: int, end: int, name: str = "", kids: list | None = None, **data):
        self.kind, self.start, self.end, self.name, self.kids, self.data = kind, start, end, name, kids or [], data

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def of(self, *kinds: str) -> list["Node"]:
        return [k for k in self.kids if k.kind in kinds]


class Parser:
    def __init__(self, source: str):
        self.source = source
        self.t, self.comments = tokens(source)
        self.i = 0

    # ---- tokens

    @property
    def tok(self) -> Token:
        return self.t[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def at(self, *texts: str) -> bool:
        t = self.t[self.i]
        return t.text in texts and t.kind in ("op", "keyword", "name")

    def take(self, *texts: str) -> Token | None:
        if self.at(*texts):
            self.i += 1
            return self.t[self.i - 1]
        return None

    def need(self, text: str) -> Token:
        got = self.take(text)
        if got is None:
            raise SyntaxProblem(f"expected {text!r}, found {self.tok.text or 'end of file'!r}", self.tok.start)
        return got

    def ident(self) -> Token:
        if self.tok.kind != "name":
            raise SyntaxProblem(f"expected a name, found {self.tok.text or 'end of file'!r}", self.tok.start)
        self.i += 1
        return self.t[self.i - 1]

    @property
    def last(self) -> int:
        return self.t[self.i - 1].end if self.i else 0

    def attempt(self, f):
        mark = self.i
        try:
            return f()
        except SyntaxProblem:
            self.i = mark
            return None

    # ---- compilation unit

    def unit(self) -> Node:
        out = Node("CompilationUnit", 0, len(self.source))
        mark = self.i
        mods = self.modifiers()
        if self.at("package"):
            start = self.need("package").start
            name = self.qualified()
            self.need(";")
            out.kids.append(Node("PackageDeclaration", start, self.last, name))
        elif self.at("open", "module") and self.peek().kind == "name":
            while self.tok.kind != "end":
                self.i += 1
            return out
        else:
            self.i = mark
            del mods
        while self.tok.kind != "end":
            if self.take(";"):
                continue
            if self.at("import"):
                out.kids.append(self.import_())
            else:
                out.kids.append(self.member("", False))
        return out

    def qualified(self) -> str:
        parts = [self.ident().text]
        while self.at(".") and self.peek().kind == "name":
            self.i += 1
            parts.append(self.ident().text)
        return ".".join(parts)

    def import_(self) -> Node:
        start = self.need("import").start
        static = bool(self.take("static"))
        module = self.at("module") and self.peek().kind == "name"
        if module:
            self.i += 1
        name = self.qualified()
        star = False
        if self.take("."):
            self.need("*")
            star = True
        self.need(";")
        return Node("ImportDeclaration", start, self.last, name, is_static=static, is_on_demand=star, is_module=module)

    def modifiers(self) -> tuple[list[str], list[Node]]:
        words, notes = [], []
        while True:
            if self.at("@") and self.peek().text != "interface":
                notes.append(self.annotation())
            elif self.at("default") and self.peek().text in (":", "->"):
                break
            elif self.at("sealed") and self.peek().kind not in ("name", "keyword"):
                break
            elif self.at(*MODIFIERS):
                words.append(self.tok.text)
                self.i += 1
            elif self.at("non") and self.peek().text == "-" and self.peek(2).text == "sealed":
                words.append("non-sealed")
                self.i += 3
            else:
                break
        return words, notes

    def annotation(self) -> Node:
        start = self.need("@").start
        name = self.qualified()
        values, kids = {}, []
        if self.take("("):
            while not self.at(")"):
                if self.tok.kind == "name" and self.peek().text == "=":
                    key = self.ident().text
                    self.i += 1
                else:
                    key = "value"
                value = self.annotation_value()
                values[key] = self.source[value.start : value.end]
                kids.append(value)
                if not self.take(","):
                    break
            self.need(")")
        return Node("Annotation", start, self.last, name, kids, values=values)

    def annotation_value(self) -> Node:
        if self.at("@"):
            return self.annotation()
        if self.at("{"):
            start = self.need("{").start
            kids = []
            while not self.at("}"):
                kids.append(self.annotation_value())
                if not self.take(","):
                    break
            self.need("}")
            return Node("ArrayInitializer", start, self.last, kids=kids)
        return self.ternary()

    # ---- types

    def type_(self) -> Node:
        start = self.tok.start
        notes = []
        while self.at("@"):
            notes.append(self.annotation())
        args: list[Node] = []
        if self.tok.text in PRIMITIVES:
            name = self.tok.text
            self.i += 1
        elif self.take("?"):
            name = "?"
            if self.take("extends", "super"):
                args.append(self.type_())
        else:
            name = self.ident().text
            args += self.type_args()
            while self.at(".") and (self.peek().kind == "name" or self.peek().text == "@"):
                self.i += 1
                while self.at("@"):
                    notes.append(self.annotation())
                name += "." + self.ident().text
                args += self.type_args()
        dims = self.dims()
        while self.at("&") and name not in PRIMITIVES and self.intersection:
            self.i += 1
            args.append(self.type_())
        return Node("Type", start, self.last, name, [*notes, *args], dims=dims)

    intersection = False

    def dims(self) -> int:
        n = 0
        while True:
            while self.at("@") and self.intersection is False and self.peek(2).text in ("[", "@"):
                self.annotation()
            if self.at("[") and self.peek().text == "]":
                self.i += 2
                n += 1
            else:
                return n

    def type_args(self) -> list[Node]:
        if not self.at("<"):
            return []
        self.i += 1
        out = []
        while not self.at(">"):
            out.append(self.type_())
            if not self.take(","):
                break
        self.need(">")
        for t in out:
            t.kind = "TypeArgument"
        return out

    def type_params(self) -> list[Node]:
        out = []
        if self.take("<"):
            while not self.at(">"):
                while self.at("@"):
                    self.annotation()
                start, name, bounds = self.tok.start, self.ident().text, []
                if self.take("extends"):
                    bounds.append(self.type_())
                    while self.take("&"):
                        bounds.append(self.type_())
                out.append(Node("TypeParameter", start, self.last, name, bounds))
                if not self.take(","):
                    break
            self.need(">")
        return out

    def type_text(self, n: Node) -> str:
        return n.name + "[]" * n.data.get("dims", 0)

    # ---- declarations

    def member(self, owner: str, in_interface: bool) -> Node:
        start = self.tok.start
        words, notes = self.modifiers()
        if self.at("class", "interface", "enum") or self.at("@") or (self.at("record") and self.peek().kind == "name" and self.peek(2).text in ("(", "<")):
            return self.type_decl(start, words, notes)
        if self.at("{"):
            return Node("Initializer", start, 0, kids=[self.block()], modifiers=words).closed(self)
        params = self.type_params()
        if self.tok.kind == "name" and self.tok.text == owner and self.peek().text in ("(", "{"):
            name = self.ident()
            return self.method(start, words, notes, params, None, name, True)
        kind = self.type_()
        name = self.ident()
        if self.at("("):
            return self.method(start, words, notes, params, kind, name, False)
        frags = [self.fragment(name, kind)]
        while self.take(","):
            frags.append(self.fragment(self.ident(), kind))
        self.need(";")
        return Node("FieldDeclaration", start, self.last, kids=[*notes, kind, *frags], modifiers=words, type=self.type_text(kind))

    def fragment(self, name: Token, kind: Node | None) -> Node:
        dims, kids = self.dims(), []
        if self.take("="):
            kids.append(self.initializer())
        text = (self.type_text(kind) if kind else "var") + "[]" * dims
        return Node("VariableDeclarationFragment", name.start, self.last, name.text, kids, type=text, name_end=name.end)

    def initializer(self) -> Node:
        return self.array_init() if self.at("{") else self.expr()

    def array_init(self) -> Node:
        start, kids = self.need("{").start, []
        while not self.at("}"):
            kids.append(self.initializer())
            if not self.take(","):
                break
        self.need("}")
        return Node("ArrayInitializer", start, self.last, kids=kids)

    def parameters(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.at(")"):
            start = self.tok.start
            words, notes = self.modifiers()
            kind = self.type_()
            many = bool(self.take("..."))
            if self.take("this") or (self.tok.kind == "name" and self.peek().text == "." and self.peek(2).text == "this"):
                while not self.at(",", ")"):
                    self.i += 1
            else:
                name = self.ident()
                dims = self.dims() + many
                out.append(
                    Node("Parameter", start, self.last, name.text, [*notes, kind], type=self.type_text(kind) + "[]" * dims, modifiers=words, name_start=name.start)
                )
            if not self.take(","):
                break
        self.need(")")
        return out

    def method(self, start, words, notes, type_params, kind, name, constructor) -> Node:
        compact = self.at("{")
        params = [] if compact else self.parameters()
        dims = self.dims()
        throws = []
        if self.take("throws"):
            throws.append(self.type_())
            while self.take(","):
                throws.append(self.type_())
        kids = [*notes, *type_params, *([kind] if kind else []), *params, *(Node("Throws", t.start, t.end, t.name, [t]) for t in throws)]
        if self.take("default"):
            kids.append(self.annotation_value())
        body = None
        if self.at("{"):
            body = self.block()
            kids.append(body)
        else:
            self.need(";")
        return Node(
            "MethodDeclaration", start, self.last, name.text, kids, modifiers=words, constructor=constructor, compact=compact, body=body, params=params,
            type=None if constructor else self.type_text(kind) + "[]" * dims, throws=[t.name for t in throws], type_params=type_params, name_start=name.start,
        )

    def type_decl(self, start, words, notes) -> Node:
        if self.take("@"):
            form = "annotation"
        else:
            form = self.tok.text
        self.i += 1
        name = self.ident()
        params = self.type_params()
        components = self.parameters() if form == "record" else []
        extends, implements, permits = [], [], []
        while self.at("extends", "implements", "permits"):
            word = self.tok.text
            self.i += 1
            into = {"extends": extends, "implements": implements, "permits": permits}[word]
            into.append(self.type_())
            while self.take(","):
                into.append(self.type_())
        self.need("{")
        kids: list[Node] = [*notes, *params, *components, *extends, *implements, *permits]
        if form == "enum":
            while self.tok.kind == "name" or self.at("@"):
                at = self.tok.start
                marks = self.modifiers()[1]
                const = self.ident()
                inner: list[Node] = self.arguments() if self.at("(") else []
                body = self.class_body(const.text, False) if self.at("{") else []
                anonymous = [Node("AnonymousClass", at, self.last, "", body)] if body else []
                kids.append(Node("EnumConstant", at, self.last, const.text, [*marks, *inner, *anonymous], name_start=const.start))
                if not self.take(","):
                    break
            self.take(";")
        while not self.at("}"):
            if self.take(";"):
                continue
            kids.append(self.member(name.text, form in ("interface", "annotation")))
        self.need("}")
        return Node(
            "TypeDeclaration", start, self.last, name.text, kids, form=form, modifiers=words, extends=extends, implements=implements, permits=permits,
            components=components, type_params=params, name_start=name.start,
        )

    def class_body(self, owner: str, interface: bool) -> list[Node]:
        self.need("{")
        kids = []
        while not self.at("}"):
            if self.take(";"):
                continue
            kids.append(self.member(owner, interface))
        self.need("}")
        return kids

    # ---- statements

    def block(self) -> Node:
        start, kids = self.need("{").start, []
        while not self.at("}"):
            kids.append(self.statement())
        self.need("}")
        return Node("Block", start, self.last, kids=kids)

    def local_type_ahead(self) -> bool:
        mark = self.i
        try:
            self.modifiers()
            return self.at("class", "interface", "enum") or (self.at("record") and self.peek().kind == "name" and self.peek(2).text in ("(", "<"))
        finally:
            self.i = mark

    def variable_ahead(self) -> bool:
        if self.at("@", "final"):
            return True
        mark = self.i
        try:
            self.type_()
            return self.tok.kind == "name" and self.peek().text in ("=", ";", ",", ":", "[", ")") and not self.at("instanceof")
        except SyntaxProblem:
            return False
        finally:
            self.i = mark

    def locals_(self) -> Node:
        start = self.tok.start
        words, notes = self.modifiers()
        kind = self.type_()
        frags = [self.fragment(self.ident(), kind)]
        while self.take(","):
            frags.append(self.fragment(self.ident(), kind))
        return Node("VariableDeclaration", start, self.last, kids=[*notes, kind, *frags], type=self.type_text(kind), modifiers=words)

    def paren(self) -> Node:
        self.need("(")
        out = self.expr()
        self.need(")")
        return out

    def statement(self) -> Node:
        start = self.tok.start
        done = lambda kind, kids, name="", **d: Node(kind, start, self.last, name, kids, **d)
        if self.at("{"):
            return self.block()
        if self.take(";"):
            return done("EmptyStatement", [])
        if self.tok.kind == "name" and self.peek().text == ":" and not self.at("default"):
            label = self.ident().text
            self.i += 1
            return done("LabeledStatement", [self.statement()], label)
        if self.take("if"):
            test = self.paren()
            then = self.statement()
            other = [self.statement()] if self.take("else") else []
            return done("IfStatement", [test, then, *other])
        if self.take("while"):
            test = self.paren()
            return done("WhileStatement", [test, self.statement()])
        if self.take("do"):
            body = self.statement()
            self.need("while")
            test = self.paren()
            self.need(";")
            return done("DoStatement", [body, test])
        if self.take("for"):
            return self.for_(start)
        if self.at("switch"):
            out = self.switch()
            if self.at(".", ";"):  # a switch expression used as a statement's start
                self.take(";")
            out.kind = "SwitchStatement"
            return out
        if self.take("try"):
            return self.try_(start)
        if self.take("return"):
            kids = [] if self.at(";") else [self.expr()]
            self.need(";")
            return done("ReturnStatement", kids)
        if self.take("throw"):
            kids = [self.expr()]
            self.need(";")
            return done("ThrowStatement", kids)
        if self.at("yield") and self.peek().text not in ("=", ".", "++", "--", "(", "["):
            self.i += 1
            kids = [self.expr()]
            self.need(";")
            return done("YieldStatement", kids)
        if self.at("break", "continue"):
            word = self.tok.text
            self.i += 1
            label = self.ident().text if self.tok.kind == "name" else ""
            self.need(";")
            return done(word.capitalize() + "Statement", [], label)
        if self.at("synchronized") and self.peek().text == "(":
            self.i += 1
            on = self.paren()
            return done("SynchronizedStatement", [on, self.block()])
        if self.take("assert"):
            kids = [self.expr()]
            if self.take(":"):
                kids.append(self.expr())
            self.need(";")
            return done("AssertStatement", kids)
        if self.local_type_ahead():
            words, notes = self.modifiers()
            out = self.type_decl(start, words, notes)
            out.data["local"] = True
            return out
        if self.variable_ahead():
            out = self.locals_()
            self.need(";")
            out.end = self.last
            return out
        kids = [self.expr()]
        self.need(";")
        return done("ExpressionStatement", kids)

    def for_(self, start: int) -> Node:
        self.need("(")
        if self.variable_ahead():
            mark = self.i
            words, notes = self.modifiers()
            kind, name = self.type_(), self.ident()
            if self.take(":"):
                over = self.expr()
                self.need(")")
                var = Node("Parameter", kind.start, name.end, name.text, [*notes, kind], type=self.type_text(kind), modifiers=words, name_start=name.start)
                return Node("EnhancedForStatement", start, 0, kids=[var, over, self.statement()]).closed(self)
            self.i = mark
            kids = [self.locals_()]
        else:
            kids = []
            while not self.at(";"):
                kids.append(self.expr())
                if not self.take(","):
                    break
        self.need(";")
        if not self.at(";"):
            kids.append(self.expr())
        self.need(";")
        while not self.at(")"):
            kids.append(self.expr())
            if not self.take(","):
                break
        self.need(")")
        kids.append(self.statement())
        return Node("ForStatement", start, self.last, kids=kids)

    def try_(self, start: int) -> Node:
        resources, kids = [], []
        if self.take("("):
            while not self.at(")"):
                resources.append(self.locals_() if self.variable_ahead() else self.expr())
                if not self.take(";"):
                    break
            self.need(")")
        body = self.block()
        kids = [*resources, body]
        while self.at("catch"):
            at = self.need("catch").start
            self.need("(")
            words, notes = self.modifiers()
            types = [self.type_()]
            while self.take("|"):
                types.append(self.type_())
            name = self.ident()
            self.need(")")
            var = Node("Parameter", types[0].start, name.end, name.text, types, type=types[0].name, modifiers=words, name_start=name.start, caught=[t.name for t in types])
            kids.append(Node("CatchClause", at, 0, kids=[var, self.block()], caught=types).closed(self))
        final = None
        if self.take("finally"):
            final = self.block()
            kids.append(final)
        return Node("TryStatement", start, self.last, kids=kids, resources=len(resources), has_finally=final is not None)

    def switch(self) -> Node:
        start = self.need("switch").start
        kids = [self.paren()]
        self.need("{")
        while not self.at("}"):
            at = self.tok.start
            if self.at("case", "default"):
                default = self.take("default") is not None
                labels = []
                if not default:
                    self.need("case")
                    while True:
                        if self.take("default"):
                            default = True
                        else:
                            labels.append(self.case_label())
                        if not self.take(","):
                            break
                    if self.take("when"):
                        labels.append(self.expr())
                arrow = self.take("->") is not None
                if not arrow:
                    self.need(":")
                kids.append(Node("SwitchCase", at, self.last, kids=labels, default=default, arrow=arrow))
                if arrow:
                    if self.at("{", "throw"):
                        kids.append(self.statement())
                    else:
                        e = self.expr()
                        self.need(";")
                        kids.append(Node("ExpressionStatement", e.start, self.last, kids=[e]))
            else:
                kids.append(self.statement())
        self.need("}")
        return Node("SwitchExpression", start, self.last, kids=kids)

    def case_label(self) -> Node:
        got = self.attempt(self.pattern)
        return got if got is not None else self.ternary()

    def pattern(self) -> Node:
        start = self.tok.start
        words, _ = self.modifiers()
        kind = self.type_()
        if self.at("("):
            self.i += 1
            kids = []
            while not self.at(")"):
                kids.append(self.pattern())
                if not self.take(","):
                    break
            self.need(")")
            if self.tok.kind == "name" and not self.at("when"):
                self.i += 1
            if not (self.at("->", ":", ",", ")", "&&", ";", "when", "?", "||") or self.tok.kind == "end"):
                raise SyntaxProblem("no pattern", start)
            return Node("RecordPattern", start, self.last, kind.name, [kind, *kids])
        name = self.ident()
        if name.text == "when":
            raise SyntaxProblem("no pattern", start)
        return Node("Parameter", start, self.last, name.text, [kind], type=self.type_text(kind), modifiers=words, name_start=name.start)

    # ---- expressions

    def expr(self) -> Node:
        lam = self.lambda_()
        if lam is not None:
            return lam
        left = self.ternary()
        op = self.operator(ASSIGN)
        if op:
            right = self.expr()
            return Node("Assignment", left.start, self.last, op, [left, right])
        return left

    def operator(self, among) -> str | None:
        """The operator here, with shifts glued from their single marks."""
        t = self.tok
        if t.kind not in ("op", "keyword"):
            return None
        text, n = t.text, 1
        if text == ">" or text == ">=":
            text = ""
            n = 0
            while self.peek(n).text in (">", ">=") and self.peek(n).start == t.start + n and n < 3:
                text += self.peek(n).text
                n += 1
                if text.endswith("="):
                    break
        while n and text not in among:
            if n == 1:
                return None
            n -= 1
            text = text[:n] if not text.endswith("=") or n else text
        if n == 0:
            return None
        self.i += n
        return text

    def lambda_(self) -> Node | None:
        start = self.tok.start
        if self.tok.kind == "name" and self.peek().text == "->":
            name = self.ident()
            self.i += 1
            return self.lambda_body(start, [Node("Parameter", name.start, name.end, name.text, type="", name_start=name.start)])
        if not self.at("("):
            return None
        depth, j = 0, self.i
        while j < len(self.t):
            x = self.t[j].text
            depth += (x == "(") - (x == ")")
            j += 1
            if depth == 0:
                break
        if j >= len(self.t) or self.t[j].text != "->":
            return None
        mark = self.i
        if self.peek().text == ")" or (self.peek().kind == "name" and self.peek(2).text in (",", ")")):
            self.i += 1
            params = []
            while not self.at(")"):
                name = self.ident()
                params.append(Node("Parameter", name.start, name.end, name.text, type="", name_start=name.start))
                self.take(",")
            self.need(")")
        else:
            self.i = mark
            params = self.parameters()
        self.need("->")
        return self.lambda_body(start, params)

    def lambda_body(self, start: int, params: list[Node]) -> Node:
        body = self.block() if self.at("{") else self.expr()
        return Node("Lambda", start, self.last, kids=[*params, body], params=params)

    def ternary(self) -> Node:
        test = self.binary(0)
        if not self.take("?"):
            return test
        a = self.expr_no_assign()
        self.need(":")
        b = self.expr_no_assign()
        return Node("ConditionalExpression", test.start, self.last, kids=[test, a, b])

    def expr_no_assign(self) -> Node:
        return self.lambda_() or self.ternary()

    def binary(self, level: int) -> Node:
        if level == len(BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            mark = self.i
            op = self.operator(BINARY[level])
            if op is None:
                return left
            glued = self.t[self.i : self.i + 1]
            if op in (">", ">>", ">>>") and glued and glued[0].text in (">", ">=", "=") and glued[0].start == self.last and glued[0].text != "=":
                self.i = mark
                return left
            if op == "instanceof":
                self.take("final")
                got = self.attempt(self.pattern)
                right = got if got is not None else self.type_()
                left = Node("InstanceofExpression", left.start, self.last, kids=[left, right])
                continue
            right = self.lambda_() or self.binary(level + 1)
            if left.kind == "InfixExpression" and left.name == op and not left.data.get("paren"):
                left.kids.append(right)
                left.end = self.last
            else:
                left = Node("InfixExpression", left.start, self.last, op, [left, right])

    def unary(self) -> Node:
        start = self.tok.start
        if self.at("+", "-", "!", "~", "++", "--"):
            op = self.tok.text
            self.i += 1
            return Node("PrefixExpression", start, 0, op, [self.unary()]).closed(self)
        if self.at("("):
            cast = self.attempt(self.cast)
            if cast is not None:
                return cast
        return self.postfix(self.primary())

    def cast(self) -> Node:
        start = self.need("(").start
        self.intersection = True
        try:
            kind = self.type_()
        finally:
            self.intersection = False
        self.need(")")
        primitive = kind.name in PRIMITIVES and not kind.data["dims"]
        t = self.tok
        if not primitive and not (t.kind in ("name", "string", "text", "char", "number") or t.text in ("(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or t.text in PRIMITIVES):
            raise SyntaxProblem("no cast", start)
        value = self.lambda_() or self.unary()
        return Node("CastExpression", start, self.last, kids=[kind, value])

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.at(")"):
            out.append(self.expr())
            if not self.take(","):
                break
        self.need(")")
        return out

    def primary(self) -> Node:
        t = self.tok
        if t.kind in ("string", "text", "char", "number"):
            self.i += 1
            return Node("Literal", t.start, t.end, t.text, literal=t.kind)
        if self.at("true", "false", "null"):
            self.i += 1
            return Node("Literal", t.start, t.end, t.text, literal=t.text if t.text == "null" else "boolean")
        if self.take("("):
            e = self.expr()
            self.need(")")
            e.data["paren"] = True
            return Node("Parenthesized", t.start, self.last, kids=[e])
        if self.at("switch"):
            return self.switch()
        if self.at("this", "super"):
            self.i += 1
            if self.at("("):
                args = self.arguments()
                return Node("ConstructorInvocation", t.start, self.last, t.text, args, args=len(args))
            return Node("This" if t.text == "this" else "Super", t.start, t.end, t.text)
        if self.at("new"):
            return self.creation(None)
        if t.text in PRIMITIVES:
            kind = self.type_()
            return self.after_type(kind)
        if t.kind == "name":
            generic = self.generic_reference()
            if generic is not None:
                return generic
            self.i += 1
            if self.at("("):
                args = self.arguments()
                return Node("MethodInvocation", t.start, self.last, t.text, args, receiver=None, args=args, name_start=t.start)
            return Node("Name", t.start, t.end, t.text)
        if self.at("@"):
            self.annotation()
            return self.primary()
        raise SyntaxProblem(f"unexpected {t.text or 'end of file'!r}", t.start)

    def generic_reference(self) -> Node | None:
        """``Type<Args>::name``, ``Type[]::new`` and ``Type[].class``."""
        j, depth = self.i + 1, 0
        while j < len(self.t) and self.t[j].text == "." and self.t[j + 1].kind == "name":
            j += 2
        if self.t[j].text not in ("<", "[") or (self.t[j].text == "[" and self.t[j + 1].text != "]"):
            return None
        mark = self.i
        kind = self.attempt(self.type_)
        if kind is not None and (self.at("::") or (self.at(".") and self.peek().text == "class")):
            return self.after_type(kind)
        self.i = mark
        return None

    def after_type(self, kind: Node) -> Node:
        if self.take("::"):
            name = self.tok
            self.i += 1
            return Node("MethodReference", kind.start, self.last, name.text, [kind], receiver=kind, name_start=name.start)
        self.need(".")
        self.need("class")
        return Node("TypeLiteral", kind.start, self.last, kids=[kind])

    def creation(self, outer: Node | None) -> Node:
        start = outer.start if outer else self.tok.start
        self.need("new")
        while self.at("@"):
            self.annotation()
        if self.at("<"):
            self.type_args()
        at = self.tok.start
        if self.tok.text in PRIMITIVES:
            name, args = self.tok.text, []
            self.i += 1
        else:
            name, args = self.ident().text, self.type_args()
            while self.take("."):
                name += "." + self.ident().text
                args += self.type_args()
        kind = Node("Type", at, self.last, name, args, dims=0)
        if self.at("["):
            kids = [kind]
            while self.at("["):
                self.i += 1
                if not self.at("]"):
                    kids.append(self.expr())
                self.need("]")
                kind.data["dims"] += 1
            if self.at("{"):
                kids.append(self.array_init())
            return Node("ArrayCreation", start, self.last, name, kids)
        given = self.arguments()
        body = [Node("AnonymousClass", self.tok.start, 0, name, self.class_body("", False)).closed(self)] if self.at("{") else []
        return Node(
            "ClassInstanceCreation", start, self.last, name, [*([outer] if outer else []), kind, *given, *body], args=given, type=name, anonymous=bool(body), outer=outer
        )

    def postfix(self, e: Node) -> Node:
        while True:
            if self.take("."):
                if self.at("new"):
                    e = self.creation(e)
                    continue
                if self.at("<"):
                    self.type_args()
                if self.at("this", "class", "super"):
                    word = self.tok.text
                    self.i += 1
                    if word == "super" and self.at("("):
                        args = self.arguments()
                        e = Node("ConstructorInvocation", e.start, self.last, "super", [e, *args], args=len(args))
                    else:
                        e = Node({"this": "This", "class": "TypeLiteral", "super": "Super"}[word], e.start, self.last, word, [e])
                    continue
                name = self.ident()
                if self.at("("):
                    args = self.arguments()
                    e = Node("MethodInvocation", e.start, self.last, name.text, [e, *args], receiver=e, args=args, name_start=name.start)
                else:
                    e = Node("FieldAccess", e.start, self.last, name.text, [e], receiver=e, name_start=name.start)
            elif self.at("["):
                self.i += 1
                index = self.expr()
                self.need("]")
                e = Node("ArrayAccess", e.start, self.last, kids=[e, index])
            elif self.at("++", "--"):
                op = self.tok.text
                self.i += 1
                e = Node("PostfixExpression", e.start, self.last, op, [e])
            elif self.take("::"):
                if self.at("<"):
                    self.type_args()
                name = self.tok
                self.i += 1
                e = Node("MethodReference", e.start, self.last, name.text, [e], receiver=e, name_start=name.start)
            else:
                return e


def _closed(self: Node, parser: Parser) -> Node:
    self.end = parser.last
    return self


Node.closed = _closed


def parse(source: str) -> tuple[Node, list[tuple[int, int, str]]]:
    parser = Parser(source)
    return parser.unit(), parser.comments
