"""Digests of JSON payloads that don't hang on the order of keys and array elements.

A payload is a VARIANT.  One of few levels is digested in its row, from nested transforms.  A deeper one is taken apart level
by level: each level is a table of nodes with their parents, whatever the payloads' shapes.  Volatile keys and keys whose value is null are dropped.  Digests are then put together from the
leaves up: an object is its sorted keys with their digests, an array its sorted digests.  So no payload is walked in
Python, and a level is two joins whatever its depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from codeseam.operators.shared import settled, stem

#: Keys that differ between two calls of one content.
VOLATILE = ("uptime", "startedAt", "startTime", "loadedAt")  # fixed values
#: Objects and arrays inside one another that are digested in a row; deeper payloads are taken apart into tables.
LEVELS = 3


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _leaf(v: Column, kind: Column) -> Column:
    """A scalar with its kind, so that a number and its text differ; whole numbers and decimals are numbers alike."""
    text = F.to_json(v)
    return F.sha2(F.when(kind == "VOID", "null").when(kind == "STRING", F.concat(F.lit("s"), v.cast("string"))).when(kind == "BOOLEAN", F.concat(F.lit("b"), text)).otherwise(F.concat(F.lit("n"), text)), 256)


def _in_row(v: Column, levels: int, volatile: tuple[str, ...]) -> Column:
    """The digest of a payload of at most so many levels of objects and arrays; null for a deeper one."""
    none, item = F.lit(None).cast("string"), "array<struct<key:string,value:variant>>"

    def of(node: Column) -> Column:
        inner, v, is_object = node["inner"], node["v"], node["object"]
        leaf = _leaf(v, _kind(v))
        if not levels:
            return F.when(inner.isNull(), leaf).otherwise(none)
        named = lambda e: F.concat(F.when(is_object, F.concat(F.sha2(e["key"], 256), F.lit(":"))).otherwise(""), _in_row(e["value"], levels - 1, volatile))
        whole = lambda parts: F.when(F.exists(parts, lambda p: p.isNull()), none).otherwise(F.sha2(F.concat(F.when(is_object, "{").otherwise("["), F.array_join(F.array_sort(parts), ",")), 256))
        return F.when(inner.isNull(), leaf).otherwise(_bound(F.transform(inner, named), whole))

    held = lambda e: ~(e["key"].isin(*volatile) | e["value"].isNull() | F.is_variant_null(e["value"]))
    fields = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), held)
    elements = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return _bound(F.struct(v.alias("v"), fields.cast(item).alias("fields")), lambda n: _bound(F.struct(n["v"].alias("v"), F.coalesce(n["fields"], elements.cast(item)).alias("inner"), n["fields"].isNotNull().alias("object")), of))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def canonical_digests(df: DataFrame, payload: str, volatile: tuple[str, ...] = VOLATILE, out: str = "digest") -> DataFrame:
    """``df`` with ``out``: the digest of the JSON text in ``payload``; null for null and for what is no JSON.

    Equal payloads up to the order of keys and elements, volatile keys and null values have equal digests.  A key that an
    object holds twice counts with its last value.  Repeated rows are digested one by one.
    """
    x = stem(df, "_p")
    parsed = F.try_parse_json(payload)
    flat = df.withColumn(f"{x}id", F.monotonically_increasing_id()).withColumn(f"{x}v", parsed).withColumn(f"{x}flat", F.when(F.col(f"{x}v").isNotNull(), _in_row(F.col(f"{x}v"), LEVELS, volatile)))
    flat = settled(flat.withColumn(f"{x}deep", F.col(f"{x}v").isNotNull() & F.col(f"{x}flat").isNull()).drop(f"{x}v"))
    columns = [c for c in df.columns if c != out]
    done = flat.filter(~F.col(f"{x}deep")).select(*columns, F.col(f"{x}flat").alias(out))
    rows = flat.filter(f"{x}deep").drop(f"{x}flat", f"{x}deep")
    if rows.isEmpty():
        return done
    top = rows.select(F.col(f"{x}id").alias("root"), F.lit("").alias("path"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("string").alias("key"), F.try_parse_json(payload).alias("v"))
    level, levels = top.filter("v is not null"), []
    while True:
        level = settled(level.withColumn("kind", _kind(F.col("v"))))
        levels.append(level)
        inner = level.filter(F.col("kind").isin("OBJECT", "ARRAY"))
        if inner.isEmpty():
            break
        view = f"codeseam_payload_{x}"
        inner.createOrReplaceTempView(view)
        parts = df.sparkSession.sql(f"SELECT t.root, t.path AS up, t.kind AS of, e.pos, e.key, e.value AS v FROM {view} t, LATERAL variant_explode(t.v) e")
        held = (F.col("of") == "ARRAY") | ~(F.col("key").isin(*volatile) | F.is_variant_null("v"))
        level = parts.filter(held).select("root", F.concat_ws("/", "up", F.col("pos").cast("string")).alias("path"), "up", "key", "v")
    below = None
    for level in reversed(levels):
        own = level.select("root", "path", "up", "key", "kind", F.when(~F.col("kind").isin("OBJECT", "ARRAY"), _leaf(F.col("v"), F.col("kind"))).alias("leaf"))
        if below is None:
            made = own.withColumn("inside", F.lit(None).cast("array<string>"))
        else:
            # what one object or array holds, as one payload does: gathered by its own node
            named = F.concat(F.coalesce(F.concat(F.sha2(F.col("key"), 256), F.lit(":")), F.lit("")), "digest")
            inside = below.groupBy("root", F.col("up").alias("path")).agg(F.array_sort(F.collect_list(named)).alias("inside"))
            made = own.join(inside, ["root", "path"], "left")
        joined = F.array_join(F.coalesce("inside", F.array().cast("array<string>")), ",")
        digest = F.coalesce("leaf", F.sha2(F.concat(F.when(F.col("kind") == "OBJECT", "{").otherwise("["), joined), 256))
        below = settled(made.select("root", "path", "up", "key", digest.alias("digest")))
    found = below.select(F.col("root").alias(f"{x}id"), F.col("digest").alias(f"{x}digest"))
    return done.union(rows.join(found, f"{x}id", "left").select(*columns, F.col(f"{x}digest").alias(out)))
