"""Queries over a project's facts, one builder for each, by name.

Every builder takes the resolved facts and keyword arguments and returns a lazy DataFrame of a fixed schema.  Positions
are zero-based; ``file, line, column`` name a place in a file.  Lists are ordered and cut by ``max_results``; the number
of all is in ``total``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codeseam.functions import fixed, text as T
from codeseam.operators import cycles, graph, search
from codeseam.operators.interval import innermost, longest_prefix
from codeseam.operators.metrics import RISK, bucket
from codeseam.operators.search import InvalidParameter, checked_limit
from codeseam.operators.shared import settled
from codeseam.plans.resolve import Resolved

TOOLS: dict[str, Callable[..., DataFrame]] = {}


class SymbolNotFound(LookupError):
    code = "SYMBOL_NOT_FOUND"


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__] = f
    return f


def query(r: Resolved, name: str, /, **arguments) -> DataFrame:
    """Run a query by name after checking what all have in common."""
    if name not in TOOLS:
        raise InvalidParameter(f"no query named {name}")
    for key in ("line", "column", "offset", "max_depth"):
        if isinstance(arguments.get(key), int) and arguments[key] < 0:
            raise InvalidParameter(f"{key} may not be negative")
    if "max_results" in arguments:
        checked_limit(arguments["max_results"])
    return TOOLS[name](r, **arguments)


def cut(df: DataFrame, k: int, cap: int | None, *order: str | Column) -> DataFrame:
    return search.top_with_total(df, [F.col(o) if isinstance(o, str) else o for o in order], checked_limit(k, cap))


# ---------------------------------------------------------------- places


def offset_of(r: Resolved, file: str, line: int, column: int) -> int:
    row = r.file(file).select("content").first()
    if row is None:
        raise SymbolNotFound(f"no file {file}")
    lines = row["content"].split("\n")
    if line >= len(lines):
        raise InvalidParameter(f"{file} has {len(lines)} lines")
    return sum(len(x) + 1 for x in lines[:line]) + column


def symbol_at(r: Resolved, file: str, line: int, column: int) -> str:
    """Key of what the token at a place means: the reference there, else the declaration named there, else the innermost
    declaration around it; nothing inside comments and literals."""
    at = offset_of(r, file, line, column)
    here = lambda df: df.filter((F.col("file") == file) & (F.col("start") <= at) & (F.col("start") + F.col("length") > at))
    if not here(r.raw("comments", file)).isEmpty():
        raise SymbolNotFound("inside a comment")
    named = r.raw("symbols", file).filter((F.col("file") == file) & (F.col("name_start") <= at) & (F.col("name_start") + F.col("name_length") >= at))
    found = named.orderBy("name_length").select("key").first()
    if found is None:
        rank = F.when(F.col("match_kind") == "TYPE", 1).otherwise(0)
        found = here(r.places).orderBy("length", rank, "target_key").select(F.col("target_key").alias("key")).first()
    if found is None:
        found = here(r.raw("symbols", file)).orderBy("length").select("key").first()
    if found is None:
        raise SymbolNotFound(f"nothing at {file}:{line}:{column}")
    return found["key"]


#: Syntax nodes whose declarations are not seen outside of them.
BLOCKS = (
    "Block", "ForStatement", "EnhancedForStatement", "TryStatement", "CatchClause", "SwitchStatement", "SwitchExpression", "Lambda",
)
#: Cells by which intervals of one file meet.
CELL = 4096


def bindings(r: Resolved, file: str, method: str, name: str) -> DataFrame:
    """(bound, start, length, line, col, access) of a local name in a method: each use is bound to the innermost declaration
    of its name that holds there, and a declaration to itself (access null).

    A declaration holds from its place to the end of the innermost block, loop, lambda or the like around it, a parameter's
    to the end; so names of blocks beside each other are told apart.
    """
    here = (F.col("file") == file) & (F.col("method_key") == method)
    v = r.raw("variables", file).filter(here & (F.col("name") == name)).select("start", F.length("name").alias("length"), "line", "col")
    u = r.raw("variable_uses", file).filter(here & (F.col("name") == name)).select("start", "length", "line", "col", "access")
    blocks = r.raw("nodes", file).filter(here & F.col("kind").isin(*BLOCKS)).select(F.lit(0).alias("k"), F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("end"))
    inside = innermost(v.select(F.lit(0).alias("k"), "start"), blocks, "k", "start", "from", "end", CELL, ["start"], ["end"])
    last = u.agg(F.coalesce(F.max("start") + 1, F.lit(0)).alias("last"))  # one row
    held = v.join(inside, "start", "left").crossJoin(F.broadcast(last)).select(F.lit(0).alias("k"), F.col("start").alias("bound"), F.coalesce("end", "last").alias("until"))
    uses = innermost(u.withColumn("k", F.lit(0)), held, "k", "start", "bound", "until", CELL, u.columns, ["bound"])
    own = v.select(F.col("start").alias("bound"), *v.columns, F.lit(None).cast("string").alias("access"))
    return own.unionByName(uses.select(*own.columns))


def local_at(r: Resolved, file: str, line: int, column: int) -> dict | None:
    """The local variable or parameter that is declared or used at a place: method_key, name and where it is declared."""
    at = offset_of(r, file, line, column)
    here = lambda size: (F.col("file") == file) & (F.col("start") <= at) & (F.col("start") + size > at) & F.col("method_key").isNotNull()
    v = r.raw("variables", file).filter(here(F.length("name"))).select("method_key", "name")
    u = r.raw("variable_uses", file).filter(here(F.col("length"))).select("method_key", "name")
    row = v.union(u).first()
    if row is None:
        return None
    place = bindings(r, file, row["method_key"], row["name"]).filter((F.col("start") <= at) & (F.col("start") + F.col("length") > at)).first()
    return row.asDict() | {"bound": place["bound"]} if place else None


def type_named(r: Resolved, name: str) -> str:
    """A type by full name, by nested name, or by its simple name among top-level types in source order."""
    types = r.symbols.filter("kind = 'TYPE'")
    dotted = name.replace("$", ".")
    rank = F.when(F.col("key") == dotted, 0).when(F.endswith("key", F.lit("." + dotted)) & F.lit("." in dotted), 1).when(F.col("simple_name") == dotted, F.when(F.col("top_level"), 2).otherwise(3))
    row = types.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "file", "start").select("key").first()
    return row["key"] if row else dotted


def details(df: DataFrame) -> DataFrame:
    """Symbol rows with words for their modifiers and a written signature."""
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    signature = F.when(F.col("kind") == "METHOD", F.concat("simple_name", F.lit("("), params, F.lit(")"), F.coalesce(F.concat(F.lit(": "), "return_type"), F.lit("")))).when(
        F.col("kind") == "FIELD", F.concat_ws(": ", "simple_name", "return_type")
    ).otherwise(F.concat_ws(" ", "form", "key"))
    return df.select(
        "key", "kind", "form", "simple_name", "owner_key", "package", T.modifiers(F.col("flags")).alias("modifiers"), signature.alias("signature"), "return_type", "params", "exceptions",
        "type_params", "constant_value", "javadoc", "is_main", "file", "line", "col",
    )


# ---------------------------------------------------------------- projections and filters


@tool
def search_symbols(r: Resolved, query: str, kind: str | None = None, max_results: int = 50, offset: int = 0) -> DataFrame:
    """Declared names that match a case-sensitive glob; types unless a kind is named."""
    wanted = (kind or "type").lower()
    of = {"type": F.col("kind") == "TYPE", "method": (F.col("form") == "method"), "constructor": F.col("form") == "constructor", "field": F.col("kind") == "FIELD"}
    test = of.get(wanted, F.lower("form") == wanted)
    found = r.symbols.filter(T.glob_match(F.col("simple_name"), query) & test).select("key", "simple_name", "kind", "form", "package", "file", "line", "col")
    return search.with_total(search.page(found, [F.col("simple_name"), F.col("key"), F.col("file")], offset, checked_limit(max_results, 1000)), found)


@tool
def find_naming_violations(r: Resolved, file: str | None = None) -> DataFrame:
    """Types not in PascalCase, methods, fields and parameters not in camelCase, constants not in UPPER_SNAKE."""
    s = r.symbols.filter("form <> 'constructor' and form not in ('enumConstant', 'recordComponent')")
    rule = F.when(F.col("kind") == "TYPE", "PascalCase").when(F.col("form") == "constant", "UPPER_SNAKE_CASE").otherwise("camelCase")
    names = s.select("file", "line", "col", F.col("simple_name").alias("name"), F.col("form").alias("element"), rule.alias("expected"))
    v = r.raw("variables").filter("form = 'parameter'").select("file", "line", "col", "name", F.col("form").alias("element"), F.lit("camelCase").alias("expected"))
    every = names.union(v)
    if file:
        every = every.filter(F.col("file") == file)
    fits = F.when(F.col("expected") == "PascalCase", F.col("name").rlike(T.PASCAL)).when(F.col("expected") == "camelCase", F.col("name").rlike(T.CAMEL)).otherwise(F.col("name").rlike(T.UPPER_SNAKE))
    return every.filter(~fits).orderBy("file", "line", "col")


@tool
def find_large_classes(r: Resolved, max_methods: int = 20, max_fields: int = 10, max_lines: int = 300) -> DataFrame:
    """Top-level types over at least one limit, with the messages of those exceeded."""
    from codeseam.operators.metrics import violations

    limits = [(F.col("methods"), max_methods, f"methods > {max_methods}"), (F.col("field_declarations"), max_fields, f"fields > {max_fields}"), (F.col("lines"), max_lines, f"lines > {max_lines}")]
    return violations(r.symbols.filter("kind = 'TYPE' and top_level"), limits).select("key", "file", "line", "methods", "field_declarations", "lines", "messages").orderBy("key")


# ---------------------------------------------------------------- lookups by place


@tool
def go_to_definition(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    return details(r.symbols.filter(F.col("key") == symbol_at(r, file, line, column))).select("key", "kind", "form", "owner_key", "package", "file", "line", "col")


@tool
def get_symbol_info(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """What the symbol at a place is; locals and parameters too, under the key of their method and their name."""
    local = local_at(r, file, line, column)
    if local is None:
        return details(r.symbols.filter(F.col("key") == symbol_at(r, file, line, column)))
    v = r.raw("variables", file).filter((F.col("file") == file) & (F.col("method_key") == local["method_key"]) & (F.col("start") == local["bound"]))
    known = {
        "key": F.concat_ws("/", "method_key", "name"), "kind": F.lit("VARIABLE"), "form": F.col("form"), "simple_name": F.col("name"), "owner_key": F.col("method_key"),
        "signature": F.concat_ws(" ", "type", "name"), "return_type": F.col("type"), "file": F.col("file"), "line": F.col("line"), "col": F.col("col"),
    }
    fields = details(r.symbols).schema
    return v.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def _around(r: Resolved, file: str, line: int, column: int, kind: str) -> DataFrame:
    """The declaration of a kind that a place means or stands in: its own, else the innermost around it."""
    at = offset_of(r, file, line, column)
    try:
        named = symbol_at(r, file, line, column)
    except SymbolNotFound:
        named = ""
    own = r.symbols.filter((F.col("key") == named) & (F.col("kind") == kind)).withColumn("rank", F.lit(0))
    inside = (F.col("file") == file) & (F.col("start") <= at) & (F.col("start") + F.col("length") > at)
    outer = r.raw("symbols", file).filter(inside & (F.col("kind") == kind)).withColumn("rank", F.lit(1))
    return own.union(outer).orderBy("rank", "length").limit(1).drop("rank")


@tool
def get_type_at_position(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """The type, with its direct members counted by kind."""
    t = _around(r, file, line, column, "TYPE")
    members = r.symbols.groupBy(F.col("owner_key").alias("key")).agg(
        F.count_if(F.col("kind") == "METHOD").alias("method_count"), F.count_if(F.col("kind") == "FIELD").alias("field_count"), F.count_if(F.col("kind") == "TYPE").alias("type_count")
    )
    return details(t).join(members, "key", "left").withColumn("is_nested", F.col("owner_key").isNotNull())


@tool
def get_method_at_position(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    return details(_around(r, file, line, column, "METHOD"))


@tool
def get_field_at_position(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    return details(_around(r, file, line, column, "FIELD"))


def _clean_doc(doc: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(doc, r"^/\*\*|\*/$", ""), r"(?m)^\s*(?:\*|///) ?", "")
    return F.regexp_replace(F.regexp_replace(inner, r"\{@(?:code|link|linkplain|literal)\s+([^}]*)\}", "$1"), r"^\s+|\s+$", "")


@tool
def get_hover_info(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    found = details(r.symbols.filter(F.col("key") == symbol_at(r, file, line, column)))
    return found.select("key", "signature", "modifiers", _clean_doc(F.col("javadoc")).alias("documentation"))


@tool
def get_javadoc(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """Summary and tags of a symbol's documentation."""
    doc = _clean_doc(F.col("javadoc"))
    found = r.symbols.filter(F.col("key") == symbol_at(r, file, line, column)).select("key", doc.alias("doc"))
    one = lambda tag: F.regexp_extract("doc", rf"(?s)@{tag}\s+(.*?)(?=\n\s*@|\z)", 1)
    pair = lambda tag: F.transform(
        F.regexp_extract_all("doc", F.lit(rf"(?s)@(?:{tag})\s+(.*?)(?=\n\s*@|\z)"), F.lit(1)),
        lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_replace(x, r"^\S+\s*", "")).alias("text")),
    )
    summary = F.trim(F.regexp_extract("doc", r"(?s)^(.*?)(?=\n\s*@|\z)", 1))
    return found.select(
        "key", summary.alias("summary"), pair("param").alias("params"), pair("throws|exception").alias("throws"), one("return").alias("returns"), one("since").alias("since"),
        one("deprecated").alias("deprecated"), one("author").alias("author"), one("version").alias("version"),
        F.regexp_extract_all("doc", F.lit(r"@see\s+([^\n]+)"), F.lit(1)).alias("see"),
    )


@tool
def get_signature_help(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """All overloads beside the method at a place."""
    key = symbol_at(r, file, line, column)
    one = r.symbols.filter((F.col("key") == key) & (F.col("kind") == "METHOD")).select("owner_key", "simple_name").distinct()
    found = details(r.symbols.filter("kind = 'METHOD'").join(one, ["owner_key", "simple_name"]))
    return found.select("key", "signature", "params", F.lit(0).alias("active_signature"), F.lit(0).alias("active_parameter")).orderBy("key")


@tool
def get_enclosing_element(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """Innermost method and type around a place, the outermost type, and the package."""
    at = offset_of(r, file, line, column)
    inside = r.raw("symbols", file).filter((F.col("file") == file) & (F.col("start") <= at) & (F.col("start") + F.col("length") > at))
    pick = lambda kind, how: how(F.when(F.col("kind") == kind, F.struct("length", "key")))["key"]
    return inside.agg(pick("METHOD", F.min).alias("method"), pick("TYPE", F.min).alias("type"), pick("TYPE", F.max).alias("outer_type"), F.max("package").alias("package"))


@tool
def get_super_method(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """The nearest method that the one at a place overrides: classes before interfaces."""
    key = symbol_at(r, file, line, column)
    up = r.overrides.filter(F.col("key") == key).select(F.col("overridden_key").alias("key"))
    owner = key.split("#")[0]
    depth = r.ancestors.filter(F.col("type_key") == owner).select(F.col("ancestor").alias("owner_key"), "depth")
    form = r.symbols.filter("kind = 'TYPE'").select(F.col("key").alias("owner_key"), (F.col("form") == "interface").alias("is_interface"))
    found = r.symbols.join(up, "key").join(depth, "owner_key").join(form, "owner_key").orderBy("is_interface", "depth", "key").limit(1)
    return details(found)


@tool
def get_document_symbols(r: Resolved, file: str, include_private: bool = True, max_results: int = 500) -> DataFrame:
    """The symbols of a file as rows of a tree (owner_key, ordinal), in source order."""
    s = r.raw("symbols", file)
    if not include_private:
        s = s.filter("(flags & 2) = 0")
    return cut(s.select("key", "owner_key", "simple_name", "kind", "form", "ordinal", "start", "line", "col"), max_results, 2000, "start")


@tool
def get_type_members(r: Resolved, type_name: str, include_inherited: bool = False, member_kind: str | None = None) -> DataFrame:
    """Declared members and, on request, those of ancestors (of interfaces only methods)."""
    key = type_named(r, type_name)
    reach = r.lineage.filter(F.col("type_key") == key).select(F.col("ancestor").alias("owner_key"), "depth")
    if not include_inherited:
        reach = reach.filter("depth = 0")
    forms = r.symbols.filter("kind = 'TYPE'").select(F.col("key").alias("owner_key"), F.col("form").alias("owner_form"))
    found = r.symbols.join(reach, "owner_key").join(forms, "owner_key").filter("depth = 0 or owner_form <> 'interface' or kind = 'METHOD'")
    if member_kind:
        found = found.filter(F.lower("kind") == member_kind.lower())
    return details(found).join(found.select("key", "depth").distinct(), "key").withColumn("inherited", F.col("depth") > 0).drop("depth").orderBy("inherited", "key")


# ---------------------------------------------------------------- references


def _site() -> list[str]:
    return ["file", "line", "col", "start", "length", "context", "enclosing_key"]


@tool
def find_references(r: Resolved, file: str, line: int, column: int, max_results: int = 100) -> DataFrame:
    """All references to the symbol at a place."""
    found = r.refs.filter(F.col("target_key") == symbol_at(r, file, line, column))
    return cut(found.select(*_site(), "match_kind", F.coalesce("access", "fine_kind").alias("reference_kind")).distinct(), max_results, 1000, "file", "start", "reference_kind")


def _fine(r: Resolved, kind: str, type_name: str, max_results: int) -> DataFrame:
    key = type_named(r, type_name)
    names = [key] if "." in key else [key, f"java.lang.{key}"]
    found = r.type_refs.filter((F.col("fine_kind") == kind) & (F.col("target_key").isin(*names) | (F.lit("." not in key) & F.endswith("target_key", F.lit("." + key)))))
    return cut(found.select(*_site()), max_results, 1000, "file", "start")


def _fine_tool(name: str, kind: str) -> None:
    def run(r: Resolved, type_name: str, max_results: int = 100) -> DataFrame:
        return _fine(r, kind, type_name, max_results)

    run.__name__ = name
    run.__doc__ = f"References to a type as {kind.lower().replace('_', ' ')}."
    TOOLS[name] = run


for _name, _kind in (
    ("find_annotation_usages", "ANNOTATION"), ("find_type_instantiations", "INSTANTIATION"), ("find_casts", "CAST"), ("find_instanceof_checks", "INSTANCEOF"),
    ("find_throws_declarations", "THROWS"), ("find_catch_blocks", "CATCH"), ("find_type_arguments", "TYPE_ARGUMENT"),
):
    _fine_tool(_name, _kind)


@tool
def find_method_references(r: Resolved, file: str, line: int, column: int, max_results: int = 100) -> DataFrame:
    """``Type::method`` references only."""
    found = r.calls.filter((F.col("form") == "REFERENCE") & (F.col("target_key") == symbol_at(r, file, line, column)))
    return cut(found.select(*_site()), max_results, 1000, "file", "start")


@tool
def find_field_writes(r: Resolved, file: str, line: int, column: int, max_results: int = 100) -> DataFrame:
    key = symbol_at(r, file, line, column)
    if r.symbols.filter((F.col("key") == key) & (F.col("kind") == "FIELD")).isEmpty():
        raise InvalidParameter(f"not a field: {key}")
    return cut(r.accesses.filter((F.col("target_key") == key) & (F.col("access") == "WRITES")).select(*_site()), max_results, 1000, "file", "start")


@tool
def find_reflection_usage(r: Resolved, max_results: int = 100) -> DataFrame:
    """Calls of reflective methods, limited for each method, with each method's total."""
    spark = r.facts.sparkSession
    table = spark.createDataFrame([(f"{t}#{m}", f"{t.rsplit('.', 1)[-1]}.{m}") for t, m in fixed.REFLECTION_METHODS], "target_key string, label string")  # 18 rows
    found = r.calls.join(F.broadcast(table), "target_key").select("label", *_site())
    return search.top_per_group(found, ["label"], [F.col("file"), F.col("start")], checked_limit(max_results))


@tool
def find_implementations(r: Resolved, file: str, line: int, column: int, max_results: int = 100) -> DataFrame:
    """All subtypes of a type, or all methods that override a method."""
    key = symbol_at(r, file, line, column)
    if "#" in key:
        keys = r.overrides.filter(F.col("overridden_key") == key).select("key")
    else:
        keys = r.ancestors.filter(F.col("ancestor") == key).select(F.col("type_key").alias("key")).distinct()
    return cut(r.symbols.join(keys, "key").select("key", "kind", "form", "file", "line", "col"), max_results, 1000, "key")


@tool
def get_type_hierarchy(r: Resolved, type_name: str | None = None, file: str | None = None, line: int = 0, column: int = 0, max_depth: int = 10) -> DataFrame:
    """Ancestors and descendants with their distance; each list holds at most ``max_depth`` (1 to 50) entries."""
    key = type_named(r, type_name) if type_name else symbol_at(r, file, line, column)
    k = max(1, min(50, max_depth))
    own = r.supers.select(F.col("super_key").alias("key"), "relation").groupBy("key").agg(F.max((F.col("relation") == "implements").cast("int")).alias("i"))
    up = r.ancestors.filter(F.col("type_key") == key).select(F.col("ancestor").alias("key"), "depth").join(own, "key", "left")
    up = up.select(F.when(F.col("i") == 1, "interface").otherwise("superclass").alias("list"), "key", "depth")
    down = r.ancestors.filter(F.col("ancestor") == key).select(F.lit("subtype").alias("list"), F.col("type_key").alias("key"), "depth")
    return search.top_per_group(up.union(down), ["list"], [F.col("depth"), F.col("key")], k)


@tool
def get_call_hierarchy_incoming(r: Resolved, file: str, line: int, column: int, max_results: int = 50) -> DataFrame:
    """Call sites of a method and the method around each; several sites of one caller stay."""
    found = r.calls.filter(F.col("target_key") == symbol_at(r, file, line, column)).select(*_site())
    caller = F.when(F.contains("enclosing_key", F.lit("#")), F.col("enclosing_key")).otherwise(F.concat("enclosing_key", F.lit("#<initializer>")))
    return cut(found.withColumn("caller", caller), max_results, 500, "file", "start")


@tool
def get_call_hierarchy_outgoing(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """What a method calls, each once, at its first site."""
    key = symbol_at(r, file, line, column)
    found = r.calls.filter((F.col("enclosing_key") == key) & F.col("target_key").isNotNull())
    return search.first_per_key(found.select("target_key", "form", *_site()), ["target_key"], [F.col("start")]).orderBy("start")


@tool
def find_unused_code(r: Resolved, file: str | None = None, include_fields: bool = True, include_methods: bool = True) -> DataFrame:
    """Private fields and methods that their own file never uses."""
    kinds = [k for k, on in (("FIELD", include_fields), ("METHOD", include_methods)) if on]
    own = r.symbols.filter((F.col("flags").bitwiseAND(2) != 0) & F.col("kind").isin(*kinds) & ~F.col("form").isin("constructor", "recordComponent"))
    if file:
        own = own.filter(F.col("file") == file)
    used = r.calls.select("file", F.col("target_key").alias("key")).union(r.accesses.select("file", F.col("target_key").alias("key"))).distinct()
    return own.join(used, ["file", "key"], "left_anti").select("file", "line", "col", "key", F.col("kind"), "simple_name").orderBy("file", "line")


def _roots(r: Resolved, tests: bool) -> DataFrame:
    main = r.symbols.filter("is_main").select(F.col("key").alias("node"))
    return main.union(r.tests.select("key")) if tests else main


@tool
def find_unreachable_code(r: Resolved, include_test_roots: bool = True, max_results: int = 100) -> DataFrame:
    """Declarations that no main method (and no test) reaches."""
    dead = graph.unreachable(r.edges, r.overrides, r.nodes, _roots(r, include_test_roots))
    return cut(dead.select("key", "kind", "file", "line"), max_results, None, "file", "line", "key")


@tool
def find_affected_tests(r: Resolved, file: str, line: int, column: int, max_results: int = 100) -> DataFrame:
    """Tests that reach the symbol at a place, itself included; disabled ones are kept and told."""
    key = symbol_at(r, file, line, column)
    callers = _callers(r, key).union(r.facts.sparkSession.range(1).select(F.lit(key).alias("key")))
    found = r.tests.join(callers, "key", "left_semi").join(r.symbols.select("key", "file", "line"), "key")
    return cut(found.select("key", "disabled", "file", "line"), max_results, None, "file", "line", "key")


def _callers(r: Resolved, key: str) -> DataFrame:
    if "#" in key:
        return graph.transitive_callers(r.edges, r.overrides, r.nodes, key)
    return graph.type_callers(r.edges, r.overrides, r.nodes, key)


@tool
def get_http_endpoints(r: Resolved, max_results: int = 200) -> DataFrame:
    """Routes: verb, path (the class's prefix and the method's), handler, framework."""
    spark = r.facts.sparkSession
    verbs = [(f"{fixed.SPRING_PACKAGE}{v.capitalize()}Mapping", v, "spring") for v in fixed.SPRING_VERBS]
    verbs += [(p + v, v, "jaxrs") for p in fixed.JAXRS_PACKAGES for v in fixed.JAXRS_VERBS]
    table = spark.createDataFrame(verbs, "fqn string, http string, framework string")  # 19 rows
    value = F.regexp_extract(F.coalesce(F.col("values")["value"], F.col("values")["path"], F.lit("")), '"([^"]*)"', 1)
    a = r.annotations
    prefix = a.filter(F.col("fqn").isin(f"{fixed.SPRING_PACKAGE}RequestMapping", *(p + "Path" for p in fixed.JAXRS_PACKAGES)))
    on_type = prefix.filter("target_kind = 'TYPE'").groupBy(F.col("target_key").alias("owner_key")).agg(F.min(value).alias("prefix"))
    on_method = prefix.filter(F.endswith("fqn", F.lit(".Path")) & (F.col("target_kind") == "METHOD")).groupBy("target_key").agg(F.min(value).alias("own"))
    m = a.filter("target_kind = 'METHOD'").join(F.broadcast(table), "fqn").join(on_type, "owner_key", "left").join(on_method, "target_key", "left")
    own = F.when(F.col("framework") == "spring", value).otherwise(F.coalesce("own", F.lit("")))
    lines = r.symbols.select(F.col("key").alias("target_key"), F.col("line").alias("at"))
    out = m.select("target_key", "http", T.join_path(F.col("prefix"), own).alias("path"), "framework", "file").join(lines, "target_key")
    return cut(out.select("http", "path", F.col("target_key").alias("handler"), "framework", "file", F.col("at").alias("line")), max_results, None, "path", "http")


@tool
def get_jpa_model(r: Resolved, max_results: int = 100) -> DataFrame:
    """Entities with table, id and relations (field, kind, target, mappedBy)."""
    a = r.annotations
    names = lambda *s: [p + x for p in fixed.JPA_PACKAGES for x in s]
    quoted = lambda k: F.nullif(F.regexp_extract(F.coalesce(F.col("values")[k], F.lit("")), '"([^"]*)"', 1), F.lit(""))
    entity = a.filter(F.col("fqn").isin(*names("Entity")) & (F.col("target_kind") == "TYPE")).select(F.col("target_key").alias("entity"), "file").distinct()
    tables = a.filter(F.col("fqn").isin(*names("Table"))).groupBy(F.col("target_key").alias("entity")).agg(F.min(quoted("name")).alias("table"))
    ids = a.filter(F.col("fqn").isin(*names("Id"))).groupBy(F.col("owner_key").alias("entity")).agg(F.min_by("target_name", "start").alias("id"))
    rel = a.filter(F.col("fqn").isin(*names(*fixed.JPA_RELATIONS)) & (F.col("target_kind") == "FIELD"))
    inner = F.coalesce(F.nullif(F.regexp_extract("target_type", r"<\s*([\w.$]+)\s*>", 1), F.lit("")), F.col("target_type"))
    types = r.symbols.filter("kind = 'TYPE'").select(F.col("key").alias("target"), F.col("simple_name").alias("inner"), F.col("package").alias("target_package"))
    rel = rel.select(F.col("owner_key").alias("entity"), F.col("target_name").alias("field"), F.col("simple_name").alias("kind"), inner.alias("inner"), quoted("mappedBy").alias("mapped_by"), "start")
    same = F.when(F.col("target_package") == F.regexp_replace("entity", r"\.[^.]*$", ""), 0).otherwise(1)
    rel = rel.join(types, "inner", "left").groupBy("entity", "field", "kind", "inner", "mapped_by", "start").agg(F.min_by("target", F.struct(same, "target")).alias("target"))
    each = F.struct("start", "field", "kind", F.coalesce("target", "inner").alias("target"), "mapped_by")
    lists = rel.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x.dropFields("start")).alias("relations"))
    return cut(entity.join(tables, "entity", "left").join(ids, "entity", "left").join(lists, "entity", "left"), max_results, None, "entity")


@tool
def get_di_registrations(r: Resolved, max_results: int = 200) -> DataFrame:
    """Annotated components, configurations, beans and injection points; the limit holds for each annotation."""
    table = r.facts.sparkSession.createDataFrame(fixed.DI_ANNOTATIONS, "category string, fqn string")  # 10 rows
    found = r.annotations.join(F.broadcast(table), "fqn").select("category", "fqn", F.coalesce("target_key", "owner_key").alias("target"), "target_name", "target_type", "file", "line", "start")
    return search.top_per_group(found, ["fqn"], [F.col("file"), F.col("start")], checked_limit(max_results))


@tool
def suggest_imports(r: Resolved, type_name: str, max_results: int = 20) -> DataFrame:
    """Full names that a simple name may be imported as: declared types and names that other files import."""
    declared = r.symbols.filter(F.col("kind") == "TYPE").select(F.col("key").alias("fqn"))
    imported = r.raw("imports").filter("not is_static and not is_on_demand and not is_module").select(F.col("name").alias("fqn"))
    known = declared.union(imported).distinct().filter(T.simple_name(F.col("fqn")) == type_name)
    internal = F.contains("fqn", F.lit(".internal.")) | F.contains("fqn", F.lit(".impl.")) | F.startswith("fqn", F.lit("sun.")) | F.startswith("fqn", F.lit("com.sun."))
    found = known.filter(~internal).withColumn("package", T.package_of(F.col("fqn"))).withColumn("relevance", T.import_relevance(F.col("package")))
    return cut(found, max_results, None, F.desc("relevance"), "fqn")


@tool
def analyze_change_impact(r: Resolved, file: str, line: int, column: int, depth: int = 1, transitive: bool = False, max_results: int = 200) -> DataFrame:
    """Methods that a change reaches, by level up to 3, or all of them; and how many stand in each file."""
    key = symbol_at(r, file, line, column)
    if transitive:
        found = _callers(r, key).withColumn("level", F.lit(None).cast("int"))
    else:
        back = r.refs.filter("target_key is not null and enclosing_key is not null").select(F.col("enclosing_key").alias("src"), F.col("target_key").alias("dst"))
        start = r.facts.sparkSession.range(1).select(F.lit(key).alias("node"))
        found = graph.reaches(back, start, max(1, min(3, depth))).filter("depth > 0").select(F.col("node").alias("key"), F.col("depth").alias("level"))
    rows = found.join(r.symbols.select("key", "file", "line"), "key")
    return cut(rows.withColumn("in_file", F.count("*").over(Window.partitionBy("file"))), max_results, None, "level", "file", "line", "key")


@tool
def find_circular_dependencies(r: Resolved, package_filter: str | None = None, max_cycle_length: int = 10) -> DataFrame:
    """Packages that import each other: (component, size, members, path, length, severity), by component.

    ``path`` is a shortest cycle through the least package, which it names at both ends.  Only components of at most
    ``max_cycle_length`` packages are shown, and only those are gathered.
    """
    e = package_edges(r)
    if package_filter:
        e = e.filter(F.startswith("src", F.lit(package_filter)) & F.startswith("dst", F.lit(package_filter)))
    found = graph.strong_components(e.select("src", "dst"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") <= max_cycle_length)
    found = settled(found.join(sizes.select("component"), "component", "left_semi"))
    steps = settled(cycles.shortest_cycles(e, found))
    paths = cycles.listed(steps, "component", "node", "position", max_cycle_length, "path", " -> ")
    members = cycles.listed(found, "component", "node", "node", max_cycle_length, "members")
    lengths = steps.filter("position = 0").select("component", "length")
    rows = sizes.join(members, "component").join(paths, "component").join(lengths, "component")
    rows = rows.withColumn("path", F.concat_ws(" -> ", "path", "component"))
    return rows.withColumn("severity", F.when(F.col("size") <= 2, "medium").otherwise("high")).select("component", "size", "members", "path", "length", "severity").orderBy("component")


def package_edges(r: Resolved) -> DataFrame:
    """(src, dst, weight): imports between the project's packages; an import belongs to its longest known package."""
    packages = r.facts.select("package").filter("package <> ''").distinct()
    i = r.raw("imports").filter("not is_module").select(F.col("package").alias("src"), "name")
    found = longest_prefix(i, "name", packages, "package").filter("match is not null and match <> src")
    return graph.weighted(found.select("src", F.col("match").alias("dst")))


# ---------------------------------------------------------------- aggregates


@tool
def get_complexity_metrics(r: Resolved, file: str, include_details: bool = True) -> DataFrame:
    """Per method: cyclomatic and cognitive complexity and risk."""
    n = r.raw("nodes", file).filter((F.col("file") == file) & F.col("method_key").isNotNull())
    return complexity(n).orderBy("method_key")


def complexity(n: DataFrame) -> DataFrame:
    """(method_key, cyclomatic, cognitive, risk) from syntax nodes.

    A chain of one logical operator is one node.  Cognitive: 1 + nesting for branches, loops, try, catch and ternary, 1
    for each outermost logical chain, 1 for each call of a method of the same name.
    """
    branch = ("IfStatement", "ForStatement", "EnhancedForStatement", "WhileStatement", "DoStatement", "CatchClause", "ConditionalExpression", "ThrowStatement")
    logical = (F.col("kind") == "InfixExpression") & F.col("name").isin("&&", "||")
    cc = F.col("kind").isin(*branch) | logical | ((F.col("kind") == "SwitchCase") & (F.col("name") == "case"))
    deep = F.col("kind").isin("IfStatement", "ForStatement", "EnhancedForStatement", "WhileStatement", "DoStatement", "TryStatement", "CatchClause", "ConditionalExpression")
    chain = logical & ~F.endswith("parent_kind", F.lit(":inner"))
    own = F.regexp_extract("method_key", r"#([^(]*)\(", 1)
    again = (F.col("kind") == "MethodInvocation") & (F.col("name") == own)
    cyclomatic = (1 + F.count_if(cc)).alias("cyclomatic")
    cognitive = F.sum(F.when(deep, 1 + F.col("nesting")).when(chain, 1).when(again, 1).otherwise(0)).alias("cognitive")
    return n.groupBy("file", "method_key").agg(cyclomatic, cognitive).withColumn("risk", bucket(F.col("cyclomatic"), RISK, "high"))


@tool
def get_file_metrics(r: Resolved, file: str) -> DataFrame:
    """Lines of a file by kind and the sum, mean (2 places) and largest cyclomatic complexity."""
    c = complexity(r.raw("nodes", file).filter((F.col("file") == file) & F.col("method_key").isNotNull()))
    cc = c.agg(F.count("*").alias("methods"), F.sum("cyclomatic").alias("total"), F.round(F.avg("cyclomatic"), 2).alias("average"), F.max("cyclomatic").alias("most"))
    return r.file(file).select("path", "physical", "blank", "comment", "code").join(F.broadcast(cc))


@tool
def get_type_usage_summary(r: Resolved, type_name: str, max_per_category: int = 10) -> DataFrame:
    """How a type is used, by kind: the true count, the shown count (clipped), and examples."""
    k = max(1, min(50, max_per_category))
    shown = search.top_per_group(r.type_refs.filter(F.col("target_key") == type_named(r, type_name)), ["fine_kind"], [F.col("file"), F.col("start")], k)
    place = F.concat_ws(":", "file", "line", "col")
    return shown.groupBy("fine_kind").agg(F.max("total").alias("total"), F.count("*").alias("shown"), F.array_sort(F.collect_list(place)).alias("examples")).orderBy("fine_kind")


@tool
def get_dependency_graph(r: Resolved, scope: str, name: str, depth: int = 1, include_external: bool = False) -> DataFrame:
    """Weighted edges from a type (its imports, supertypes, field, return and parameter types) or from a package."""
    if scope == "package":
        e = package_edges(r) if not include_external else graph.weighted(r.raw("imports").select(F.col("package").alias("src"), T.package_of(F.col("name")).alias("dst")))
        start = (F.col("src") == name) | F.startswith("src", F.lit(name + "."))
    elif scope == "type":
        kinds = ("EXTENDS", "IMPLEMENTS", "FIELD_TYPE", "RETURN_TYPE", "PARAMETER_TYPE")
        uses = r.type_refs.filter(F.col("fine_kind").isin(*kinds)).select(F.col("enclosing_type").alias("src"), F.col("target_key").alias("dst"))
        tops = r.symbols.filter("kind = 'TYPE' and top_level").select("file", F.col("key").alias("src"))
        imports = r.raw("imports").filter("not is_on_demand and not is_static and not is_module").join(tops, "file").select("src", F.col("name").alias("dst"))
        e = uses.union(imports).filter("src <> dst")
        if not include_external:
            known = r.symbols.filter("kind = 'TYPE'").select(F.col("key").alias("dst"))
            e = e.join(known, "dst", "left_semi").select("src", "dst")
        e = graph.weighted(e.filter(~T.is_external(F.col("dst"))) if not include_external else e)
        start = F.col("src") == type_named(r, name)
    else:
        raise InvalidParameter(f"scope is type or package: {scope}")
    e = settled(e)
    roots = e.filter(start).select(F.col("src").alias("node")).distinct()
    reach = graph.reachable(e.select("src", "dst"), roots, max(0, depth - 1)).select(F.col("node").alias("src")) if depth > 1 else roots.withColumnRenamed("node", "src")
    return e.join(reach, "src", "left_semi").orderBy("src", "dst")


@tool
def get_project_structure(r: Resolved, include_files: bool = False, max_depth: int = 10) -> DataFrame:
    """Packages of each source root with their files, down to a number of name parts (1 to 20)."""
    from codeseam.sources.tree import source_root

    f = r.facts.select(source_root(F.col("path")).alias("root"), "package", "path").filter(F.size(F.split("package", "[.]")) <= max(1, min(20, max_depth)))
    files = F.array_sort(F.collect_list(F.substring_index("path", "/", -1))) if include_files else F.lit(None).cast("array<string>")
    return f.groupBy("root", "package").agg(F.count("*").alias("files"), files.alias("names")).orderBy("root", "package")


@tool
def get_classpath_info(r: Resolved, include_libraries: bool = True, include_source: bool = True) -> DataFrame:
    """Source roots, and the packages outside the project that its files import; either kind can be left out."""
    from codeseam.sources.tree import source_root

    own = r.facts.groupBy(source_root(F.col("path")).alias("path")).agg(F.count("*").alias("uses")).select(F.lit("source").alias("kind"), "path", "uses", F.lit(True).alias("exists"))
    packages = r.facts.select("package").distinct()
    outside = r.raw("imports").select(T.package_of(F.col("name")).alias("path")).join(packages, F.col("path") == F.col("package"), "left_anti")
    every = own.union(outside.groupBy("path").agg(F.count("*").alias("uses")).select(F.lit("library"), "path", "uses", F.lit(None).cast("boolean")))
    kinds = [k for k, on in (("library", include_libraries), ("source", include_source)) if on]
    return every.filter(F.col("kind").isin(*kinds)).orderBy("kind", "path")


@tool
def find_tests(r: Resolved, pattern: str | None = None, include_disabled: bool = False) -> DataFrame:
    """Test classes with their framework and tests; a class whose tests are all left out stays, with none."""
    kind = F.when(F.contains("fqn", F.lit("jupiter")) | F.contains("fqn", F.lit("junit5")), "JUnit5").when(F.contains("fqn", F.lit("testng")), "TestNG").when(F.contains("fqn", F.lit("junit")), "JUnit4")
    t = r.tests.withColumn("framework", kind)
    if pattern:
        t = t.filter(T.simple_name(F.col("owner_key")).rlike(T.loose_glob_regex(pattern)))
    shown = F.when(F.lit(include_disabled) | ~F.col("disabled"), F.regexp_extract("key", "#([^(]*)", 1))
    return t.groupBy(F.col("owner_key").alias("test_class")).agg(F.min("framework").alias("framework"), F.array_sort(F.collect_list(shown)).alias("tests"), F.count_if("disabled").alias("disabled")).orderBy("test_class")


def _first(df: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """One row: the first ``k`` values of a column of distinct rows, sorted, and under ``<name>_total`` how many there are.

    The cut comes before the list, so however many there are, at most ``k`` come together.
    """
    top = df.orderBy(column).limit(k).agg(F.array_sort(F.collect_list(column)).alias(name))
    return top.join(F.broadcast(df.agg(F.count("*").alias(f"{name}_total"))))  # one row and one row


@tool
def analyze_file(r: Resolved, file: str) -> DataFrame:
    """One row: lines, imports, types with their member counts, problems."""
    f = r.file(file)
    types = F.transform(F.filter("symbols", lambda s: s["kind"] == "TYPE"), lambda s: F.struct(s["key"].alias("key"), s["form"].alias("form"), s["methods"].alias("methods"), s["field_declarations"].alias("fields")))
    return f.select("path", "package", "physical", "blank", "comment", "code", F.col("imports.name").alias("imports"), types.alias("types"), "problems")


@tool
def analyze_type(r: Resolved, type_name: str, max_subtypes: int = 20) -> DataFrame:
    """One row: declaration, members, hierarchy and true usage totals; the first subtypes and how many there are."""
    key = type_named(r, type_name)
    own = details(r.symbols.filter(F.col("key") == key))
    m = r.symbols.filter(F.col("owner_key") == key).agg(F.array_sort(F.collect_list("key")).alias("members"))  # one type's
    up = r.ancestors.filter(F.col("type_key") == key).agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("ancestors"))
    below = r.ancestors.filter(F.col("ancestor") == key).select("type_key").distinct()
    down = _first(below, "type_key", checked_limit(max_subtypes), "subtypes")
    used = r.type_refs.filter(F.col("target_key") == key).groupBy("fine_kind").count().agg(F.map_from_entries(F.collect_list(F.struct("fine_kind", "count"))).alias("usages"))
    return own.join(F.broadcast(m)).join(F.broadcast(up)).join(F.broadcast(down)).join(F.broadcast(used))


@tool
def analyze_method(r: Resolved, file: str, line: int, column: int, max_callers: int = 20, max_callees: int = 50, max_overrides: int = 100) -> DataFrame:
    """One row: declaration, distinct callers and callees, what it overrides and is overridden by: the first and how many."""
    key = symbol_at(r, file, line, column)
    own = details(r.symbols.filter(F.col("key") == key))
    first = lambda df, c, k, n: _first(df.select(c).filter(F.col(c).isNotNull()).distinct(), c, k, n)
    k = checked_limit(max_overrides)
    parts = (
        first(r.calls.filter(F.col("target_key") == key), "enclosing_key", checked_limit(max_callers), "callers"),
        first(r.calls.filter(F.col("enclosing_key") == key), "target_key", checked_limit(max_callees), "callees"),
        first(r.overrides.filter(F.col("key") == key), "overridden_key", k, "overrides"),
        first(r.overrides.filter(F.col("overridden_key") == key), "key", k, "overridden_by"),
    )
    for p in parts:
        own = own.join(F.broadcast(p))
    return own


# ---------------------------------------------------------------- flow, bugs, problems


@tool
def analyze_control_flow(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """One row of counts over a method's statements, and the deepest nesting."""
    key = _around(r, file, line, column, "METHOD").select("key").first()
    n = r.raw("nodes").filter(F.col("method_key") == (key["key"] if key else ""))
    count = lambda name, *kinds: F.count_if(F.col("kind").isin(*kinds)).alias(name)
    loops = ("ForStatement", "EnhancedForStatement", "WhileStatement", "DoStatement")
    return n.agg(
        F.max("method_key").alias("method"), (F.count_if(F.col("kind").isin("IfStatement", "ConditionalExpression")) + F.count_if((F.col("kind") == "SwitchCase") & (F.col("name") == "case"))).alias("branches"),
        count("loops", *loops), count("for_loops", "ForStatement"), count("foreach_loops", "EnhancedForStatement"), count("while_loops", "WhileStatement"), count("do_loops", "DoStatement"),
        count("returns", "ReturnStatement"), count("throws", "ThrowStatement"), count("tries", "TryStatement"), F.count_if((F.col("kind") == "TryStatement") & F.startswith("name", F.lit("finally"))).alias("finallies"),
        count("catches", "CatchClause"), count("breaks", "BreakStatement"), count("continues", "ContinueStatement"),
        F.coalesce(F.max(F.when(F.col("kind").isin("IfStatement", "TryStatement", *loops), F.col("nesting") + 1)), F.lit(0)).alias("max_nesting"),
    )


@tool
def analyze_data_flow(r: Resolved, file: str, line: int, column: int, follow_calls: bool = False, max_call_depth: int = 2) -> DataFrame:
    """Variables of a method by name: form, type, reads and writes (an initial value is a write); with ``follow_calls``
    those of the source methods it calls too, up to a depth."""
    row = _around(r, file, line, column, "METHOD").select("key").first()
    key = row["key"] if row else ""
    start = r.facts.sparkSession.range(1).select(F.lit(key).alias("node"))
    if follow_calls:
        calls = r.edges.filter("kind = 'CALLS'").select(F.col("from_key").alias("src"), F.col("to_key").alias("dst"))
        methods = graph.reachable(calls, start, checked_limit(max_call_depth)).select(F.col("node").alias("method_key"), "depth")
    else:
        methods = start.select(F.col("node").alias("method_key"), F.lit(0).alias("depth"))
    by = ["method_key", "depth", "name"]
    v = r.raw("variables").join(methods, "method_key").groupBy(*by).agg(F.min("form").alias("form"), F.min("type").alias("type"), F.count_if(F.col("initial").isNotNull()).alias("initial"))
    u = r.raw("variable_uses").join(methods, "method_key").groupBy(*by).agg(F.count_if(F.col("access") == "READ").alias("reads"), F.count_if(F.col("access") == "WRITE").alias("writes"))
    return v.join(u, by, "left").select(
        F.col("method_key").alias("method"), "depth", "name", "form", "type", F.coalesce("reads", F.lit(0)).alias("reads"), (F.coalesce("writes", F.lit(0)) + F.col("initial")).alias("writes")
    ).orderBy("depth", "method", "name")


@tool
def find_flows(r: Resolved, kind: str = "null", max_call_depth: int = 2) -> DataFrame:
    """Nulls that reach a dereference, or parameters (taint) that reach a call outside the source."""
    from codeseam.operators.flow import interprocedural

    v = r.raw("variables").withColumnRenamed("method_key", "method").withColumnRenamed("name", "variable")
    seeds = v.filter("initial = 'null'") if kind == "null" else v.filter("form = 'parameter'")
    assigns = r.raw("assigns").withColumnRenamed("method_key", "method")
    calls = r.calls.select("file", "call_id", F.col("target_key").alias("callee"), "is_source", "name", F.col("line").alias("at"))
    a = r.raw("call_arguments").withColumnRenamed("method_key", "method").join(calls, ["file", "call_id"])
    if kind == "null":
        a = a.filter("direct")
        sinks = r.raw("dereferences").select(F.col("method_key").alias("method"), "variable", F.col("text").alias("what"), "line")
    else:
        sinks = a.filter("not is_source").select("method", "variable", F.coalesce("callee", "name").alias("what"), "line")
    params = r.symbols.filter("kind = 'METHOD'").select(F.col("key").alias("method"), F.posexplode("params").alias("position", "p")).select("method", "position", F.col("p.name").alias("name"))
    passed = a.filter("is_source").select("method", "variable", "callee", "position", "line")
    return interprocedural(seeds.select("method", "variable", "line"), assigns.select("method", "source", "target", "line"), passed, params, sinks, max_call_depth, kind)


@tool
def find_possible_bugs(r: Resolved, file: str | None = None, severity: str = "all") -> DataFrame:
    """Empty catches, strings compared by identity or locked on, resources left open, nulls dereferenced."""
    f = r.raw("findings")
    plain = f.filter("code <> 'RESOURCE_LEAK'").select("code", "severity", "message", "file", "line", "col")
    spark = r.facts.sparkSession
    closeable = spark.createDataFrame([(c,) for c in fixed.CLOSEABLE], "type_key string")  # a fixed list
    own = r.ancestors.join(F.broadcast(closeable.withColumnRenamed("type_key", "ancestor")), "ancestor").select("type_key")
    names = r.names.select("candidates", "type_key")
    leaks = f.filter("code = 'RESOURCE_LEAK'").join(names, "candidates").join(closeable.union(own).distinct(), "type_key", "left_semi").select("code", "severity", "message", "file", "line", "col")
    null = r.raw("variables").filter("form = 'local' and initial = 'null'").select("file", "method_key", F.col("name").alias("variable"))
    written = r.raw("variable_uses").filter("access = 'WRITE'").select("file", "method_key", F.col("name").alias("variable"))
    d = r.raw("dereferences").join(null.join(written, ["file", "method_key", "variable"], "left_anti").distinct(), ["file", "method_key", "variable"])
    nulls = d.select(F.lit("NULL_DEREFERENCE").alias("code"), F.lit("high").alias("severity"), F.concat(F.lit("Null from its declaration on: "), "variable").alias("message"), "file", "line", F.lit(0).alias("col"))
    every = plain.union(leaks).union(nulls)
    if severity != "all":
        every = every.filter(F.col("severity") == severity)
    if file:
        every = every.filter(F.col("file") == file)
    return every.orderBy("file", "line", "code")


@tool
def get_diagnostics(r: Resolved, file: str | None = None, severity: str = "all", max_results: int = 100) -> DataFrame:
    """Problems that facts show without a compiler, in eighteen categories (see ``diagnostics``)."""
    from codeseam.plans.diagnostics import problems

    every = problems(r)
    if severity != "all":
        every = every.filter(F.col("severity") == severity)
    if file:
        every = every.filter(F.col("file") == file)
    return cut(every, max_results, None, "file", "line", "col", "category", "message")


@tool
def validate_syntax(r: Resolved, file: str | None = None, content: str | None = None) -> DataFrame:
    """Syntax errors of a file of the project, or of a given text."""
    if content is None:
        return r.raw("problems", file).select("file", "line", "col", "message")
    from codeseam.sources.facts import extract

    rows = [("<content>", p["line"], p["col"], p["message"]) for p in extract("<content>", content.encode())["problems"]]
    return r.facts.sparkSession.createDataFrame(rows, "file string, line int, col int, message string")


@tool
def health_check(r: Resolved) -> DataFrame:
    """One row: status, files, how long the session has run, whether facts are kept in a store, versions and queries."""
    import time

    spark: SparkSession = r.facts.sparkSession
    uptime = time.time() - spark.sparkContext.startTime / 1000
    return r.facts.agg(F.count("*").alias("files")).select(
        F.lit("ready").alias("status"), "files", F.lit(int(uptime)).cast("bigint").alias("uptime_seconds"), F.lit("store" if r.folder else "memory").alias("facts_kept_in"), F.lit(spark.version).alias("spark"), F.lit(len(TOOLS)).alias("queries"), F.current_timestamp().cast("string").alias("checked_at")
    )


# ---------------------------------------------------------------- edits


def _family(r: Resolved, key: str) -> DataFrame:
    """A member and, for a method, all it overrides and is overridden by, transitively."""
    both = r.overrides.select(F.col("key").alias("src"), F.col("overridden_key").alias("dst"))
    both = both.union(both.select("dst", "src"))
    return graph.reachable(both, r.facts.sparkSession.range(1).select(F.lit(key).alias("node"))).select(F.col("node").alias("key"))


@tool
def rename_symbol(r: Resolved, file: str, line: int, column: int, new_name: str) -> DataFrame:
    """Edits that rename a member or type everywhere, overridden and overriding methods included, safest order first; a
    local variable or parameter within its method."""
    from codeseam.operators.edits import bottom_up

    if not new_name.isidentifier() or new_name in fixed.RESERVED_WORDS:
        raise InvalidParameter(f"not a name: {new_name}")
    local = local_at(r, file, line, column)
    if local is not None:
        own = bindings(r, file, local["method_key"], local["name"]).filter(F.col("bound") == local["bound"])
        named = r.raw("variables", file).filter((F.col("file") == file) & (F.col("method_key") == local["method_key"]) & (F.col("name") == new_name))
        if not named.isEmpty():
            raise InvalidParameter(f"the method has a variable {new_name}")
        edits = own.dropDuplicates(["start"]).select(F.lit(file).alias("file"), "start", "length", "line", "col", F.lit(local["name"]).alias("old_text"), F.lit(new_name).alias("new_text"))
        return bottom_up(edits).orderBy("file", "position")
    key = symbol_at(r, file, line, column)
    family = settled(_family(r, key))
    old = key.split("#")[-1].split("(")[0] if "#" in key else key.rsplit(".", 1)[-1]
    own = r.symbols.join(family, "key").select("file", F.col("name_start").alias("start"), F.col("line"), F.col("col"))
    if "#" not in key:
        made = r.symbols.filter((F.col("owner_key") == key) & (F.col("form") == "constructor")).select("file", F.col("name_start").alias("start"), "line", "col")
        uses = r.type_refs.filter(F.col("target_key") == key).select("file", (F.col("start") + F.col("length") - len(old)).alias("start"), "line", (F.col("col") + F.col("length") - len(old)).alias("col"))
        imports = r.raw("imports").filter(F.col("name") == key).select("file", (F.col("start") + F.col("length") - 1 - len(old)).alias("start"), "line", (F.col("col") + F.col("length") - 1 - len(old)).alias("col"))
        sites = own.union(made).union(uses).union(imports)
    else:
        uses = r.refs.filter("match_kind in ('METHOD', 'FIELD') and fine_kind not in ('CREATE', 'THIS_CONSTRUCTOR', 'SUPER_CONSTRUCTOR')").join(family.withColumnRenamed("key", "target_key"), "target_key")
        sites = own.union(uses.select("file", "start", "line", "col"))
    edits = sites.dropDuplicates(["file", "start"]).select("file", "start", F.lit(len(old)).alias("length"), "line", "col", F.lit(old).alias("old_text"), F.lit(new_name).alias("new_text"))
    return bottom_up(edits).orderBy("file", "position")


@tool
def organize_imports(r: Resolved, file: str) -> DataFrame:
    """One edit: the used imports in groups (module, java, javax, others by first part, static last), unused dropped."""
    i = r.raw("imports", file).filter((F.col("file") == file) & F.col("used"))
    written = F.concat(
        F.lit("import "), F.when(F.col("is_module"), "module ").when(F.col("is_static"), "static ").otherwise(""), "name", F.when(F.col("is_on_demand"), ".*").otherwise(""), F.lit(";")
    )
    head = F.substring_index("name", ".", 1)
    group = F.when(F.col("is_module"), F.lit("0")).when(F.col("is_static"), F.lit("9")).when(head == "java", "1").when(head == "javax", "2").otherwise(F.concat(F.lit("3"), head))
    each = i.select(group.alias("group"), written.alias("line")).distinct().groupBy("group").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    text = each.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group", "lines"))), lambda x: x["lines"]), "\n\n").alias("new_text"))
    span = r.raw("imports", file).agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"))
    return span.join(F.broadcast(text)).filter("start is not null").select(F.lit(file).alias("file"), "start", "length", "new_text")


@tool
def extract_interface(r: Resolved, file: str, line: int, column: int, interface_name: str, method_names: list[str] | None = None) -> DataFrame:
    """An interface with a class's public instance methods (of Object's only those named), its type parameters carried
    over, and the edit that makes the class implement it."""
    from codeseam.sources import rewrite

    row = _around(r, file, line, column, "TYPE").select("key", "form", "package", "name_start", "simple_name").first()
    if row is None or row["form"] in ("interface", "enum", "annotation"):
        raise InvalidParameter("an interface can be taken from a class or record only")
    if not interface_name.isidentifier():
        raise InvalidParameter(f"not a name: {interface_name}")
    m = r.symbols.filter((F.col("owner_key") == row["key"]) & (F.col("form") == "method") & (F.col("flags").bitwiseAND(1) != 0) & (F.col("flags").bitwiseAND(8) == 0))
    m = m.filter(F.col("simple_name").isin(*method_names)) if method_names else m.filter(~F.col("simple_name").isin("equals", "hashCode", "toString"))
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    throws = F.when(F.size("exceptions") > 0, F.concat(F.lit(" throws "), F.array_join("exceptions", ", "))).otherwise("")
    each = F.concat(F.lit("    "), "return_type", F.lit(" "), "simple_name", F.lit("("), params, F.lit(")"), throws, F.lit(";"))
    source = _content(r, file)
    params_at = source[row["name_start"] + len(row["simple_name"]) : rewrite.after_name(source, row["name_start"])].strip()
    arguments = f"<{', '.join(rewrite.type_parameter_names(source, row['name_start']))}>" if params_at else ""
    head = (f"package {row['package']};\n\n" if row["package"] else "") + f"public interface {interface_name}{params_at} {{\n"
    body = m.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", each.alias("t")))), lambda x: x["t"]), "\n").alias("b"))
    created = file.rsplit("/", 1)[0] + f"/{interface_name}.java" if "/" in file else f"{interface_name}.java"
    made = body.select(F.lit(created).alias("file"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.concat(F.lit(head), "b", F.lit("\n}\n")).alias("new_text"), F.lit("").alias("warnings"))
    return _rows(r, [(file, *rewrite.implements_edit(source, row["name_start"], interface_name + arguments))]).unionByName(made)


@tool
def encapsulate_field(r: Resolved, file: str, line: int, column: int, getter_name: str | None = None, setter_name: str | None = None) -> DataFrame:
    """Edits that make a field private, give its class public accessors and lead all outside through them.

    Accesses inside the declaring class stay direct.  Each file with writes is parsed once, where its content is.
    """
    import pyarrow as pa

    from codeseam.sources import rewrite

    key = symbol_at(r, file, line, column)
    own = r.symbols.filter((F.col("key") == key) & (F.col("kind") == "FIELD")).select("file", "start", "name_start", "simple_name", "return_type", "owner_key", "flags").first()
    if own is None:
        raise InvalidParameter(f"not a field: {key}")
    name, kind = own["simple_name"], own["return_type"]
    cap = name[:1].upper() + name[1:]
    getter, setter = getter_name or ("is" if kind == "boolean" else "get") + cap, setter_name or f"set{cap}"
    for n in (getter, setter):
        if not n.isidentifier() or n in fixed.RESERVED_WORDS:
            raise InvalidParameter(f"not a name: {n}")
    static, final = own["flags"] & 8, own["flags"] & 16
    lead = "public static " if static else "public "
    to, at = _owner(r, own["owner_key"]), to_this(own["owner_key"], static)
    text = f"{lead}{kind} {getter}() {{\n    return {name};\n}}"
    if not final:
        text += f"\n\n{lead}void {setter}({kind} {name}) {{\n    {at}.{name} = {name};\n}}"
    source = _content(r, own["file"])
    edits = [(own["file"], *rewrite.insert_member(source, to["start"], to["start"] + to["length"], text))]
    if (closed := rewrite.private_field(source, own["name_start"])) is not None:
        edits.append((own["file"], *closed))
    inside = (F.col("enclosing_type") == own["owner_key"]) | F.startswith("enclosing_type", F.lit(own["owner_key"] + "."))
    sites = r.accesses.filter((F.col("target_key") == key) & ~inside)
    writes = sites.filter("access = 'WRITES'").groupBy("file").agg(F.collect_set("start").alias("starts"))  # of one file
    reads = sites.join(sites.filter("access = 'WRITES'").select("file", "start"), ["file", "start"], "left_anti").dropDuplicates(["file", "start"])
    reads = reads.select("file", "start", "length", F.lit(f"{getter}()").alias("new_text"), F.lit("").alias("warnings"))
    schema = pa.schema([("file", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("new_text", pa.string()), ("warnings", pa.string())])

    def run(batches):
        from codeseam.sources.rewrite import write_edits

        for batch in batches:
            rows = [(f, *e) for f, content, starts in zip(*(c.to_pylist() for c in batch.columns)) for e in write_edits(content, starts, getter, setter)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    files = r.facts.select(F.col("path").alias("file"), "content").join(writes, "file")
    wrote = files.mapInArrow(run, "file string, start int, length int, new_text string, warnings string")
    return _rows(r, edits).unionByName(reads).unionByName(wrote).orderBy("file", F.desc("start"))


def to_this(owner: str, static: int) -> str:
    """What a field is named through inside its class."""
    return owner.rsplit(".", 1)[-1] if static else "this"


@tool
def get_quick_fixes(r: Resolved, file: str, line: int | None = None) -> DataFrame:
    """Fixes for the problems of a file, ten at most a line: remove an unused import, import a name that nothing declares,
    declare or catch a checked exception that nothing takes."""
    from codeseam.plans.diagnostics import unhandled

    unused = r.raw("imports", file).filter((F.col("file") == file) & ~F.col("used")).select("line", F.concat(F.lit("remove_import:"), "name").alias("fix_id"), F.lit(100).alias("relevance"))
    u = r.type_refs.filter((F.col("file") == file) & ~F.col("is_source") & F.startswith("target_key", F.lit("java.lang.")) & ~F.contains("name", F.lit(".")))
    known = r.symbols.filter("kind = 'TYPE'").select(F.col("key").alias("fqn")).union(r.raw("imports").filter("not is_static and not is_on_demand and not is_module").select("name")).distinct()
    known = known.withColumn("name", T.simple_name(F.col("fqn")))
    add = u.select("line", "name").distinct().join(known, "name").select("line", F.concat(F.lit("add_import:"), "fqn").alias("fix_id"), T.import_relevance(T.package_of(F.col("fqn")), fixed.FIX_RELEVANCE).alias("relevance"))
    loose = unhandled(r).filter(F.col("file") == file).select("line", "written").distinct()
    throw = loose.select("line", F.concat(F.lit("add_throws:"), "written").alias("fix_id"), F.lit(80).alias("relevance"))
    catch = loose.select("line", F.concat(F.lit("surround_try_catch:"), "written").alias("fix_id"), F.lit(75).alias("relevance"))
    every = unused.union(add).union(throw).union(catch)
    if line is not None:
        every = every.filter(F.col("line") == line)
    return search.top_per_group(every, ["line"], [F.desc("relevance"), F.col("fix_id")], 10).orderBy("line", "rank")


@tool
def apply_quick_fix(r: Resolved, file: str, fix_id: str, line: int | None = None) -> DataFrame:
    """The edit of a fix: ``add_import:``, ``remove_import:``, ``add_throws:`` or ``surround_try_catch:`` and a name."""
    kind, _, name = fix_id.partition(":")
    i = r.raw("imports", file)
    if kind == "remove_import":
        return i.filter(F.col("name") == name).select("file", "start", (F.col("length") + 1).alias("length"), F.lit("").alias("new_text"))
    if kind in ("add_throws", "surround_try_catch"):
        from codeseam.sources import rewrite

        if line is None:
            raise InvalidParameter(f"{kind} needs a line")
        text = _content(r, file).split("\n")[line]
        make = rewrite.add_throws if kind == "add_throws" else rewrite.surround_try_catch
        made = make(_content(r, file), offset_of(r, file, line, len(text) - len(text.lstrip())), name)
        return _edit_rows(r, file, made).select("file", "start", "length", "new_text")
    if kind != "add_import":
        raise InvalidParameter(f"no such fix: {fix_id}")
    at = i.agg(F.max(F.col("start") + F.col("length")).alias("at"))
    head = r.file(file).select(F.when(F.col("package") != "", F.instr("content", ";")).otherwise(0).alias("head"))
    return head.join(F.broadcast(at)).select(F.lit(file).alias("file"), F.coalesce("at", "head").alias("start"), F.lit(0).alias("length"), F.lit(f"\nimport {name};").alias("new_text"))


@tool
def diagnose_and_fix(r: Resolved, file: str) -> DataFrame:
    """The best fix of each line."""
    return get_quick_fixes(r, file).filter("rank = 1").select("line", "fix_id", "relevance").orderBy("line")


# ---------------------------------------------------------------- rewrites of one file


def _content(r: Resolved, file: str) -> str:
    row = r.file(file).select("content").first()
    if row is None:
        raise SymbolNotFound(f"no file {file}")
    return row["content"]


def _edit_rows(r: Resolved, file: str, made) -> DataFrame:
    """The few edits of one rewrite as rows; created files have a start of null and their content as new_text."""
    rows = [(file, a, n, t, "; ".join(made.warnings)) for a, n, t in made.edits] + [(f, None, None, t, "") for f, t in made.created.items()]
    return r.facts.sparkSession.createDataFrame(rows, "file string, start int, length int, new_text string, warnings string")


def _range(r: Resolved, file: str, start_line: int, start_column: int, end_line: int, end_column: int) -> tuple[str, int, int]:
    return _content(r, file), offset_of(r, file, start_line, start_column), offset_of(r, file, end_line, end_column)


@tool
def extract_variable(r: Resolved, file: str, start_line: int, start_column: int, end_line: int, end_column: int, variable_name: str | None = None) -> DataFrame:
    from codeseam.sources import rewrite

    return _edit_rows(r, file, rewrite.extract_variable(*_range(r, file, start_line, start_column, end_line, end_column), variable_name))


@tool
def extract_constant(r: Resolved, file: str, start_line: int, start_column: int, end_line: int, end_column: int, constant_name: str) -> DataFrame:
    from codeseam.sources import rewrite

    return _edit_rows(r, file, rewrite.extract_constant(*_range(r, file, start_line, start_column, end_line, end_column), constant_name))


@tool
def extract_method(r: Resolved, file: str, start_line: int, start_column: int, end_line: int, end_column: int, method_name: str) -> DataFrame:
    from codeseam.sources import rewrite

    return _edit_rows(r, file, rewrite.extract_method(*_range(r, file, start_line, start_column, end_line, end_column), method_name))


@tool
def inline_variable(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    from codeseam.sources import rewrite

    return _edit_rows(r, file, rewrite.inline_variable(_content(r, file), offset_of(r, file, line, column)))


@tool
def convert_anonymous_to_lambda(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """An anonymous class of a platform's or the project's own functional interface as a lambda."""
    from codeseam.sources import rewrite

    own = r.symbols.filter("kind = 'METHOD' and form = 'method' and (flags & 1024) <> 0").groupBy(F.col("owner_key").alias("key")).count().filter("count = 1")
    single = r.symbols.filter("form = 'interface'").join(own, "key").join(r.supers.filter("relation = 'extends'").select(F.col("type_key").alias("key")), "key", "left_anti")
    type_name = r.calls.filter((F.col("file") == file) & (F.col("form") == "CREATE")).select(F.col("receiver_type").alias("key")).distinct()
    names = {x["simple_name"] for x in single.join(type_name, "key", "left_semi").select("simple_name").collect()}  # types that one file creates
    return _edit_rows(r, file, rewrite.convert_anonymous_to_lambda(_content(r, file), offset_of(r, file, line, column), rewrite.FUNCTIONAL | names))


@tool
def move_type_to_new_file(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    from codeseam.sources import rewrite

    folder = file.rsplit("/", 1)[0] if "/" in file else ""
    return _edit_rows(r, file, rewrite.move_type_to_new_file(_content(r, file), offset_of(r, file, line, column), folder))


@tool
def apply_cleanup(r: Resolved, file: str, cleanup_id: str) -> DataFrame:
    """(file, content, changed): the whole file after one clean-up."""
    from codeseam.sources import rewrite

    old = _content(r, file)
    new = rewrite.apply_cleanup(old, cleanup_id)
    return r.facts.sparkSession.createDataFrame([(file, new, new != old)], "file string, content string, changed boolean")


# ---------------------------------------------------------------- rewrites across files


def _owner(r: Resolved, key: str) -> dict:
    row = r.symbols.filter((F.col("key") == key) & (F.col("kind") == "TYPE")).select("file", "start", "length", "name_start", "simple_name", "package", "form").first()
    if row is None:
        raise SymbolNotFound(f"no source type {key}")
    return row.asDict()


def _rows(r: Resolved, edits: list[tuple[str, int | None, int | None, str]], warnings: str = "") -> DataFrame:
    return r.facts.sparkSession.createDataFrame([(*e, warnings) for e in edits], "file string, start int, length int, new_text string, warnings string")


def _moved(r: Resolved, file: str, line: int, column: int) -> tuple[str, str, tuple[int, int, str]]:
    """Key of the member at a place, its text, and the edit that takes it out."""
    from codeseam.sources import rewrite

    key = symbol_at(r, file, line, column)
    if "#" not in key:
        raise InvalidParameter("not a member")
    text, edit = rewrite.member_text(_content(r, file), offset_of(r, file, line, column))
    return key, text, edit


@tool
def pull_up(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """Move a member into the superclass, which has to be in the source."""
    from codeseam.sources import rewrite

    key, text, out = _moved(r, file, line, column)
    up = r.supers.filter((F.col("type_key") == key.split("#")[0]) & (F.col("relation") == "extends") & F.col("is_source")).select("super_key").first()
    if up is None:
        raise InvalidParameter("no superclass in the source")
    to = _owner(r, up["super_key"])
    text = text.replace("private ", "protected ", 1)
    return _rows(r, [(file, *out), (to["file"], *rewrite.insert_member(_content(r, to["file"]), to["start"], to["start"] + to["length"], text))])


@tool
def push_down(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """Move a member into every direct subclass."""
    from codeseam.sources import rewrite

    key, text, out = _moved(r, file, line, column)
    subs = [x["type_key"] for x in r.supers.filter((F.col("super_key") == key.split("#")[0]) & (F.col("relation") == "extends")).select("type_key").distinct().orderBy("type_key").collect()]
    if not subs:
        raise InvalidParameter("no direct subclass")
    edits = [(file, *out)]
    for sub in subs:  # the direct subclasses of one class
        to = _owner(r, sub)
        edits.append((to["file"], *rewrite.insert_member(_content(r, to["file"]), to["start"], to["start"] + to["length"], text)))
    return _rows(r, edits)


@tool
def extract_superclass(r: Resolved, file: str, line: int, column: int, superclass_name: str) -> DataFrame:
    """Move a member into a new superclass of its class."""
    from codeseam.sources import rewrite

    if not superclass_name.isidentifier() or superclass_name in fixed.RESERVED_WORDS:
        raise InvalidParameter(f"not a name: {superclass_name}")
    key, text, out = _moved(r, file, line, column)
    own = _owner(r, key.split("#")[0])
    if own["form"] != "class" or not r.supers.filter((F.col("type_key") == key.split("#")[0]) & (F.col("relation") == "extends")).isEmpty():
        raise InvalidParameter("the type has a superclass or cannot have one")
    body = "\n".join("    " + x if x.strip() else x for x in text.replace("private ", "protected ", 1).split("\n"))
    head = f"package {own['package']};\n\n" if own["package"] else ""
    created = (file.rsplit("/", 1)[0] + "/" if "/" in file else "") + f"{superclass_name}.java"
    at = rewrite.after_name(_content(r, file), own["name_start"])
    return _rows(r, [(file, at, 0, f" extends {superclass_name}"), (file, *out), (created, None, None, f"{head}public class {superclass_name} {{\n{body}\n}}\n")])


@tool
def inline_method(r: Resolved, file: str, line: int, column: int) -> DataFrame:
    """Replace the call at a place by the method's body, which has to be one expression of the source."""
    from codeseam.sources import rewrite

    at = offset_of(r, file, line, column)
    call = r.calls.filter((F.col("file") == file) & (F.col("start") <= at) & (F.col("start") + F.col("length") > at) & F.col("is_source") & F.col("form").isin("CALL", "SUPER")).first()
    if call is None:
        raise InvalidParameter("no call of a source method here")
    to = r.symbols.filter(F.col("key") == call["target_key"]).select("file", "name_start").first()
    made = rewrite.inline_method(_content(r, file), call["start"], _content(r, to["file"]), to["name_start"])
    return _edit_rows(r, file, made)


SITES = "file string, site int, list_start int, list_length int, arguments array<string>"


def call_sites(r: Resolved, key: str) -> DataFrame:
    """(file, site, list_start, list_length, arguments) of every call of a method; each file with calls is parsed once,
    where its content is."""
    import json

    import pyarrow as pa

    sites = r.calls.filter((F.col("target_key") == key) & F.col("form").isin("CALL", "SUPER", "REFERENCE")).groupBy("file").agg(F.collect_list("start").alias("starts"))
    files = r.facts.select(F.col("path").alias("file"), "content").join(sites, "file")
    schema = pa.schema([("rows", pa.string())])

    def run(batches):
        from codeseam.sources.rewrite import call_arguments

        for batch in batches:
            out = []
            for file, content, starts in zip(*(c.to_pylist() for c in batch.columns)):
                out += [json.dumps({"file": file, "site": a, "list_start": b, "list_length": n, "arguments": args}) for a, b, n, args in call_arguments(content, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], schema=schema)

    return files.mapInArrow(run, "rows string").select(F.from_json("rows", SITES).alias("r")).select("r.*")


@tool
def change_method_signature(
    r: Resolved, file: str, line: int, column: int, new_name: str | None = None, new_return_type: str | None = None, new_parameters: list[dict] | None = None
) -> DataFrame:
    """One edit at the declaration and one or two at each call; references to the method are warnings.

    ``new_parameters``: dicts with type, name and, for new ones, default.  Arguments follow their parameter's name; a new
    parameter takes its default or a mark to be filled in.
    """
    from codeseam.sources import rewrite

    if new_name is not None and (not new_name.isidentifier() or new_name in fixed.RESERVED_WORDS):
        raise InvalidParameter(f"not a name: {new_name}")
    key = symbol_at(r, file, line, column)
    own = r.symbols.filter(F.col("key") == key).select("file", "name_start", "kind").first()
    if own is None or own["kind"] != "METHOD":
        raise InvalidParameter("not a source method")
    s = rewrite.signature(_content(r, own["file"]), own["name_start"])
    edits = []
    if new_return_type and s["type"]:
        edits.append((own["file"], s["type"][0], s["type"][1] - s["type"][0], new_return_type))
    if new_name:
        edits.append((own["file"], s["name_start"], len(s["name"]), new_name))
    if new_parameters is not None:
        edits.append((own["file"], s["opens"], s["closes"] - s["opens"], ", ".join(f"{p['type']} {p['name']}" for p in new_parameters)))
    made = _rows(r, edits) if edits else _rows(r, []).limit(0)
    sites = call_sites(r, key)
    real = F.col("list_start") >= 0
    out = sites.filter(~real).select("file", F.col("site").alias("start"), F.lit(0).alias("length"), F.lit("").alias("new_text"), F.lit("method reference, not rewritten").alias("warnings"))
    if new_name:
        out = out.union(sites.filter(real).select("file", "site", F.lit(len(s["name"])), F.lit(new_name), F.lit("")))
    if new_parameters is not None:
        at = {name: k for k, (_, name) in enumerate(s["params"])}
        each = [F.get("arguments", F.lit(at[p["name"]])) if p["name"] in at else F.lit(p.get("default") or f"/* TODO {p['name']} */") for p in new_parameters]
        out = out.union(sites.filter(real).select("file", "list_start", "list_length", F.concat_ws(", ", *each), F.lit("")))
    return made.union(out).orderBy("file", F.desc("start"))


@tool
def introduce_parameter_object(r: Resolved, file: str, line: int, column: int, class_name: str | None = None, parameter_name: str = "parameterObject") -> DataFrame:
    """A nested class that carries a method's parameters; the declaration, the body's uses and all calls follow."""
    from codeseam.sources import rewrite

    key = symbol_at(r, file, line, column)
    own = r.symbols.filter(F.col("key") == key).select("file", "name_start", "kind", "owner_key", "simple_name").first()
    if own is None or own["kind"] != "METHOD":
        raise InvalidParameter("not a source method")
    source = _content(r, own["file"])
    s = rewrite.signature(source, own["name_start"])
    if not s["params"]:
        raise InvalidParameter("the method has no parameter")
    cls = class_name or own["simple_name"][0].upper() + own["simple_name"][1:] + "Parameters"
    cap = lambda n: n[0].upper() + n[1:]
    edits = [(own["file"], s["opens"], s["closes"] - s["opens"], f"{cls} {parameter_name}")]
    names = {n for _, n in s["params"]}
    f = s["file"]
    for x in s["body"].walk() if s["body"] else ():
        if x.kind == "Name" and x.name in names:
            p = f.parent[id(x)]
            if p.kind == "Assignment" and p.kids[0] is x or p.kind == "PostfixExpression":
                raise InvalidParameter(f"the method assigns {x.name}")
            edits.append((own["file"], x.start, x.end - x.start, f"{parameter_name}.get{cap(x.name)}()"))
    fields = "\n".join(f"    private final {t} {n};" for t, n in s["params"])
    sets = " ".join(f"this.{n} = {n};" for _, n in s["params"])
    gets = "\n".join(f"    public {t} get{cap(n)}() {{ return {n}; }}" for t, n in s["params"])
    text = f"public static class {cls} {{\n{fields}\n\n    public {cls}({', '.join(f'{t} {n}' for t, n in s['params'])}) {{ {sets} }}\n\n{gets}\n}}"
    to = _owner(r, own["owner_key"])
    edits.append((own["file"], *rewrite.insert_member(source, to["start"], to["start"] + to["length"], text)))
    sites = call_sites(r, key)
    name = F.when(F.col("file") == own["file"], cls).otherwise(f"{to['simple_name']}.{cls}")
    calls = sites.filter("list_start >= 0").select("file", "list_start", "list_length", F.concat(F.lit("new "), name, F.lit("("), F.array_join("arguments", ", "), F.lit(")")), F.lit(""))
    notes = sites.filter("list_start < 0").select("file", "site", F.lit(0), F.lit(""), F.lit("method reference, not rewritten"))
    return _rows(r, edits).union(calls).union(notes).orderBy("file", F.desc("start"))
