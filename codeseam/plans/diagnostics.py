"""Problems that facts show without a compiler, each rule a join: (file, line, col, severity, category, message).

Rules about members look only at types whose whole ancestry is in the source, so a library class never makes a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeseam.functions import fixed, text as T
from codeseam.plans.resolve import Resolved

STATIC, PRIVATE, FINAL, ABSTRACT = 8, 2, 16, 1024


def _has(flag: int, column: str = "flags") -> Column:
    return F.col(column).bitwiseAND(flag) != 0


def _told(df: DataFrame, severity: str, category: str, message: Column) -> DataFrame:
    return df.select("file", "line", "col", F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"))


def _said(*parts) -> Column:
    return F.concat(*(F.lit(p) if p.endswith(" ") or p.startswith(" ") else F.col(p) for p in parts))


def closed_types(r: Resolved) -> DataFrame:
    """(type_key) of source types all of whose ancestors are source types too."""
    source = r.symbols.filter("kind = 'TYPE'").select(F.col("key").alias("ancestor")).distinct()
    open_ = r.ancestors.join(source, "ancestor", "left_anti").select("type_key").distinct()
    return source.withColumnRenamed("ancestor", "type_key").join(open_, "type_key", "left_anti")


def _methods(r: Resolved) -> DataFrame:
    """Methods with their owner's form, what makes one equal to another, and whether they lack a body by declaration."""
    owner = r.symbols.filter("kind = 'TYPE'").select(F.col("key").alias("owner_key"), F.col("form").alias("owner_form"), F.col("flags").alias("owner_flags"), F.size(F.coalesce("type_params", F.array().cast("array<string>"))).alias("generic"))
    m = r.symbols.filter("kind = 'METHOD' and form = 'method'").join(owner, "owner_key")
    bare = _has(ABSTRACT) | ((F.col("owner_form") == "interface") & ~_has(0x10000) & ~_has(STATIC) & ~_has(PRIVATE))
    return m.withColumn("types", F.array_join("params.type", ",")).withColumn("bare", bare)


def imports(r: Resolved) -> DataFrame:
    unused = r.raw("imports").filter("not used")
    packages = r.facts.select(F.col("package").alias("p")).filter("p <> ''").distinct()
    single = r.raw("imports").filter("not is_static and not is_on_demand and not is_module").join(packages, T.package_of(F.col("name")) == F.col("p"))
    missing = single.join(r.symbols.filter("kind = 'TYPE'").select(F.col("key").alias("name")), "name", "left_anti")
    same = Window.partitionBy("file", "name", "is_static", "is_on_demand").orderBy("start")
    again = r.raw("imports").withColumn("n", F.row_number().over(same)).filter("n > 1")
    return (
        _told(unused, "warning", "unused_import", _said("unused import ", "name"))
        .union(_told(missing, "error", "unresolved_import", _said("no type ", "name")))
        .union(_told(again, "warning", "duplicate_import", _said("imported before: ", "name")))
    )


def unused(r: Resolved) -> DataFrame:
    from codeseam.plans.tools import find_unused_code

    reads = r.raw("variable_uses").filter("access = 'READ'").select("file", "method_key", "name").distinct()
    local = r.raw("variables").filter("form = 'local' and method_key is not null").join(reads, ["file", "method_key", "name"], "left_anti")
    return _told(find_unused_code(r), "warning", "unused_private", _said("never used: ", "key")).union(_told(local, "warning", "unused_variable", _said("never read: ", "name")))


def declarations(r: Resolved) -> DataFrame:
    from codeseam.sources.tree import source_root

    place = F.when(F.col("kind") == "TYPE", source_root(F.col("file"))).otherwise(F.col("file"))
    again = r.symbols.filter("form not in ('package')").withColumn("n", F.row_number().over(Window.partitionBy("key", "kind", place).orderBy("file", "start"))).filter("n > 1")
    ring = r.symbols.filter("kind = 'TYPE'").join(r.ancestors.filter("type_key = ancestor").select(F.col("type_key").alias("key")).distinct(), "key", "left_semi")
    finals = r.symbols.filter("kind = 'TYPE'").filter(_has(FINAL)).select(F.col("key").alias("super_key"))
    below = r.supers.filter("relation = 'extends'").join(finals, "super_key").select(F.col("type_key").alias("key"), "super_key")
    sub = r.symbols.filter("kind = 'TYPE'").join(below, "key")
    m = r.symbols.filter("kind = 'METHOD'")
    shut = r.overrides.join(m.filter(_has(FINAL)).select(F.col("key").alias("overridden_key")), "overridden_key", "left_semi")
    over = m.join(shut, "key")
    return (
        _told(again, "error", "duplicate_declaration", _said("declared before: ", "key"))
        .union(_told(ring, "error", "cyclic_hierarchy", _said("its own ancestor: ", "key")))
        .union(_told(sub, "error", "final_type", _said("extends a final type: ", "super_key")))
        .union(_told(over, "error", "final_method", _said("overrides a final method: ", "overridden_key")))
    )


def implementations(r: Resolved) -> DataFrame:
    closed = closed_types(r)
    m = _methods(r).select(F.col("owner_key").alias("ancestor"), "simple_name", "types", "bare", "generic", F.col("key").alias("method"))
    reach = r.lineage.join(closed, "type_key", "left_semi").join(m, "ancestor")
    owed = reach.filter("bare and generic = 0").select("type_key", "simple_name", "types", "method")
    done = reach.filter("not bare").select("type_key", "simple_name", "types").distinct()
    concrete = r.symbols.filter("kind = 'TYPE' and form in ('class', 'record')").filter(~_has(ABSTRACT)).withColumn("type_key", F.col("key"))
    lacking = owed.join(done, ["type_key", "simple_name", "types"], "left_anti").groupBy("type_key").agg(F.min("method").alias("method"))
    made = r.calls.filter("form = 'CREATE' and not anonymous")
    idle = r.symbols.filter("kind = 'TYPE'").filter(_has(ABSTRACT) | (F.col("form") == "interface")).select(F.col("key").alias("receiver_type"))
    marked = r.annotations.filter("fqn = 'java.lang.Override' and target_kind = 'METHOD'").select(F.col("target_key").alias("key")).distinct()
    own = r.symbols.filter("kind = 'METHOD'").join(marked, "key", "left_semi").join(closed.withColumnRenamed("type_key", "owner_key"), "owner_key", "left_semi")
    astray = own.filter(~F.col("simple_name").isin(*fixed.OBJECT_METHODS)).join(r.overrides.select("key"), "key", "left_anti")
    astray = astray.join(r.symbols.filter("form = 'record'").select(F.col("key").alias("owner_key")), "owner_key", "left_anti")
    return (
        _told(concrete.join(lacking, "type_key"), "error", "missing_implementation", _said("does not implement ", "method"))
        .union(_told(made.join(idle, "receiver_type", "left_semi"), "error", "abstract_creation", _said("cannot be created: ", "receiver_type")))
        .union(_told(astray, "error", "must_override", _said("overrides nothing: ", "key")))
    )


def uses(r: Resolved) -> DataFrame:
    closed = closed_types(r)
    member = r.symbols.filter("kind in ('METHOD', 'FIELD')").select(F.col("key").alias("target_key"), F.col("file").alias("own_file"), "flags", "owner_key", "kind")
    sites = r.refs.filter("match_kind in ('METHOD', 'FIELD')").join(member, "target_key")
    hidden = sites.filter(_has(PRIVATE) & (F.col("file") != F.col("own_file")))
    old = r.annotations.filter("fqn = 'java.lang.Deprecated'").select("target_key").filter("target_key is not null").distinct()
    aged = r.refs.join(old, "target_key", "left_semi").join(r.symbols.select(F.col("key").alias("target_key"), F.col("file").alias("own_file")), "target_key").filter("file <> own_file")
    making = F.startswith("enclosing_key", F.concat("owner_key", F.lit("#"), F.substring_index("owner_key", ".", -1), F.lit("(")))
    fixed_ = sites.filter((F.col("kind") == "FIELD") & _has(FINAL) & (F.col("access") == "WRITES") & F.contains("enclosing_key", F.lit("#")) & ~making)
    plain = r.symbols.filter("kind = 'TYPE' and form in ('class', 'interface')").select(F.col("key").alias("receiver_type")).join(closed.withColumnRenamed("type_key", "receiver_type"), "receiver_type", "left_semi")
    lost = r.calls.filter((F.col("form") == "CALL") & F.col("target_key").isNull() & ~F.col("name").isin(*fixed.OBJECT_METHODS)).join(plain, "receiver_type", "left_semi")
    return (
        _told(hidden, "error", "not_visible", _said("private: ", "target_key"))
        .union(_told(aged, "warning", "deprecated_use", _said("deprecated: ", "target_key")))
        .union(_told(fixed_, "error", "final_assignment", _said("final: ", "target_key")))
        .union(_told(lost, "error", "undefined_method", _said("no method ", "name", " in ", "receiver_type")))
    )


def unhandled(r: Resolved) -> DataFrame:
    """(file, line, col, start, enclosing_key, exception, written) of calls whose checked exceptions nothing takes.

    Checked: named in a fixed list, or a source type below java.lang.Exception but not below an unchecked one.
    """
    simple = lambda c: F.substring_index(c, ".", -1)
    thrown = r.symbols.filter("kind = 'METHOD'").select(F.col("key").alias("target_key"), F.explode("exceptions").alias("written"))
    thrown = thrown.withColumn("exception", simple(F.col("written")))
    lines = r.ancestors.groupBy("type_key").agg(F.max(F.col("ancestor") == "java.lang.Exception").alias("is"), F.max(F.col("ancestor") == "java.lang.RuntimeException").alias("free"))
    own = lines.filter("is and not free").select(simple(F.col("type_key")).alias("exception")).distinct()
    checked = thrown.filter(F.col("exception").isin(*fixed.CHECKED_EXCEPTIONS)).union(thrown.join(own, "exception", "left_semi").select(*thrown.columns)).distinct()
    sites = r.calls.filter("enclosing_key is not null").select("file", "line", "col", "start", "enclosing_key", "target_key").join(checked, "target_key")
    broad = ("Exception", "Throwable")
    passes = r.symbols.filter("kind = 'METHOD'").select(F.col("key").alias("enclosing_key"), F.explode("exceptions").alias("e")).withColumn("e", simple(F.col("e")))
    passed = sites.join(passes, "enclosing_key").filter((F.col("e") == F.col("exception")) | F.col("e").isin(*broad)).select("file", "start", "exception")
    n = r.raw("nodes")
    tries = n.filter("kind = 'TryStatement'").select("file", F.col("node_id").alias("parent_id"), F.col("method_key").alias("enclosing_key"), F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"))
    catches = n.filter("kind = 'CatchClause'").select("file", "parent_id", F.col("start").alias("c"), F.explode(F.split(F.regexp_replace("name", " empty$", ""), "[|]")).alias("e"))
    taken = tries.join(catches.withColumn("e", simple(F.col("e"))), ["file", "parent_id"])
    caught = sites.join(taken, ["file", "enclosing_key"]).filter("a <= start and start < c").filter((F.col("e") == F.col("exception")) | F.col("e").isin(*broad)).select("file", "start", "exception")
    inside = r.symbols.filter("kind = 'METHOD'").select(F.col("key").alias("enclosing_key"))
    return sites.join(passed.union(caught).distinct(), ["file", "start", "exception"], "left_anti").join(inside, "enclosing_key", "left_semi").distinct()


def problems(r: Resolved) -> DataFrame:
    syntax = r.raw("problems").select("file", "line", "col", F.lit("error").alias("severity"), F.lit("syntax").alias("category"), "message")
    loose = _told(unhandled(r), "error", "unhandled_exception", _said("nothing takes ", "exception"))
    return syntax.union(imports(r)).union(unused(r)).union(declarations(r)).union(implementations(r)).union(uses(r)).union(loose)
