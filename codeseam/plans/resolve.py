"""What names mean: types, hierarchy, calls, accesses, edges and overrides, settled by joins over the facts.

Candidates are tried in their order by a minimum over structs, so nothing is sorted and nothing is gathered.  A call's
method is looked up in its receiver's type and then in that type's ancestors, the nearest first; among overloads the one
with fewest contradicted argument types wins, then the smaller key, and ``ambiguous`` says when several were left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeseam.operators.shared import settled


def bucket_of(path: str | F.Column, buckets: int) -> F.Column:
    """The folder of a path: by its hash, so that a path given as text prunes all other folders."""
    return F.pmod(F.xxhash64(F.lit(path) if isinstance(path, str) else path), F.lit(buckets)).cast("int")


def table(facts: DataFrame, name: str) -> DataFrame:
    """Rows of one fact array, with the file they come from."""
    return facts.select(F.col("path").alias("file"), F.explode(name).alias("x")).select("file", "x.*")


def type_names(symbols: DataFrame, *candidates: DataFrame) -> DataFrame:
    """(candidates, type_key, is_source) for each distinct candidate list of one-column frames."""
    lists = candidates[0]
    for c in candidates[1:]:
        lists = lists.union(c)
    lists = lists.toDF("candidates").filter("candidates is not null").distinct()
    types = symbols.filter("kind = 'TYPE'").select(F.col("key").alias("candidate")).distinct()
    tried = lists.select("candidates", F.posexplode("candidates").alias("place", "candidate")).join(types, "candidate")
    best = tried.groupBy("candidates").agg(F.min(F.struct("place", "candidate")).alias("b"))
    return lists.join(best, "candidates", "left").select(
        "candidates", F.coalesce("b.candidate", F.element_at("candidates", -1)).alias("type_key"), F.col("b").isNotNull().alias("is_source")
    )


def hierarchy(supers: DataFrame) -> DataFrame:
    """(type_key, ancestor, depth) over supertypes, each type its own ancestor at depth 0 by the caller's choice."""
    step = settled(supers.select("type_key", "super_key").distinct())
    out = frontier = step.select("type_key", F.col("super_key").alias("ancestor"), F.lit(1).alias("depth"))
    depth = 1
    while True:
        depth += 1
        up = step.select(F.col("type_key").alias("ancestor"), F.col("super_key").alias("next"))
        new = frontier.join(up, "ancestor").select("type_key", F.col("next").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        frontier = settled(new.join(out, ["type_key", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            return out
        out = settled(out.union(frontier))


#: How kept tables lie: the column of their folders, and the column that their rows are dealt and sorted by, so that a
#: question about one key reads one folder and skips row groups by their bounds.
LAYOUT = {
    "refs": ("match_kind", "target_key"), "type_refs": ("fine_kind", "target_key"), "calls": (None, "target_key"), "accesses": (None, "target_key"),
    "edges": ("kind", "to_key"), "symbols": ("kind", "key"), "annotations": (None, "fqn"), "places": (None, "file"),
}


class Resolved:
    """Lazily resolved tables over one facts frame.

    With a folder, each table is written there once and read by every later session; without one it is checkpointed.
    """

    def __init__(self, facts: DataFrame, folder: str | None = None, buckets: int | None = None):
        self.facts, self.folder, self.buckets = facts, folder, buckets
        self._made: dict[str, DataFrame] = {}

    def _kept(self, name: str) -> DataFrame:
        made = getattr(self, f"_{name}")()
        if self.folder is None:
            return settled(made)
        spark, path = made.sparkSession, f"{self.folder}/{name}"
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            split, key = LAYOUT.get(name, (None, None))
            if key:
                made = made.repartitionByRange(key).sortWithinPartitions(key)
            writer = made.write.mode("overwrite")
            (writer.partitionBy(split) if split else writer).parquet(path)
        return spark.read.schema(made.schema).parquet(path).select(*made.columns)

    def file(self, path: str) -> DataFrame:
        """The facts of one file; of a store, from the one folder that may hold it."""
        found = self.facts.filter(F.col("path") == path)
        return found.filter(F.col("bucket") == bucket_of(path, self.buckets)) if self.buckets else found

    def raw(self, name: str, path: str | None = None) -> DataFrame:
        """Rows of one fact array, of all files or of one."""
        return table(self.facts if path is None else self.file(path), name)

    def get(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._kept(name)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def _symbols(self) -> DataFrame:
        return self.raw("symbols")

    def _names(self) -> DataFrame:
        every = [self.raw(t).select(c) for t, c in (
            ("type_refs", "candidates"), ("supers", "candidates"), ("annotations", "candidates"), ("calls", "receiver_candidates"),
            ("accesses", "receiver_candidates"), ("symbols", "return_candidates"), ("findings", "candidates"),
        )]
        return type_names(self.symbols, *every)

    def _supers(self) -> DataFrame:
        own = self.raw("supers").withColumnRenamed("type_key", "sub")
        return own.join(self.names, "candidates").select("file", F.col("sub").alias("type_key"), F.col("type_key").alias("super_key"), "relation", "ordinal", "is_source")

    def _ancestors(self) -> DataFrame:
        return hierarchy(self.supers)

    def _lineage(self) -> DataFrame:
        """(type_key, ancestor, depth) with each source type itself at depth 0."""
        own = self.symbols.filter("kind = 'TYPE'").select(F.col("key").alias("type_key"), F.col("key").alias("ancestor"), F.lit(0).alias("depth"))
        return own.union(self.ancestors)

    def _type_refs(self) -> DataFrame:
        return self.raw("type_refs").join(self.names, "candidates").withColumnRenamed("type_key", "target_key").drop("candidates")

    def _annotations(self) -> DataFrame:
        return self.raw("annotations").join(self.names, "candidates").withColumnRenamed("type_key", "fqn").drop("candidates", "is_source")

    def _methods(self) -> DataFrame:
        return self.symbols.filter("kind = 'METHOD'").select(
            F.col("key").alias("target_key"), F.col("owner_key").alias("ancestor"), "simple_name", F.size("params").alias("n_params"), F.col("params.type").alias("types"),
            (F.col("form") == "constructor").alias("is_constructor"), "return_candidates",
        )

    def _calls(self) -> DataFrame:
        """Calls with target_key (null: unknown), target_type, is_source, ambiguous."""
        calls = self.raw("calls")
        names = self.names.select(F.col("candidates").alias("receiver_candidates"), "type_key", "is_source")
        named = calls.filter("receiver_candidates is not null").join(names, "receiver_candidates")
        named = named.select("file", "call_id", F.lit(0).alias("place"), F.col("type_key").alias("at"), "is_source")
        owners = calls.filter("size(owners) > 0").select("file", "call_id", "form", F.posexplode("owners").alias("place", "at"))
        plain = owners.filter("form not in ('SUPER', 'SUPER_CONSTRUCTOR')").select("file", "call_id", "place", "at", F.lit(True).alias("is_source"))
        up = owners.filter("form in ('SUPER', 'SUPER_CONSTRUCTOR')").join(
            self.supers.select(F.col("type_key").alias("at"), "super_key", "ordinal", "relation", F.col("is_source").alias("s")), "at"
        ).filter("form <> 'SUPER_CONSTRUCTOR' or relation = 'extends'").select("file", "call_id", (F.col("ordinal") + F.when(F.col("relation") == "extends", 0).otherwise(100)).alias("place"), F.col("super_key").alias("at"), F.col("s").alias("is_source"))
        starts = settled(named.union(plain).union(up))
        done = self._targets(calls, starts)
        while True:  # receivers that are results of calls settled before; each round settles new calls or is the last
            open_ = calls.filter("receiver_call is not null").join(done.select("file", "call_id"), ["file", "call_id"], "left_anti")
            before = done.filter("return_candidates is not null").select("file", F.col("call_id").alias("receiver_call"), "return_candidates")
            known = settled(open_.join(before, ["file", "receiver_call"]).join(
                self.names.select(F.col("candidates").alias("return_candidates"), "type_key", "is_source"), "return_candidates"
            ).select("file", "call_id", F.lit(0).alias("place"), F.col("type_key").alias("at"), "is_source"))
            more = settled(self._targets(calls, known))
            if more.isEmpty():
                break
            done = settled(done.union(more))
            starts = starts.union(known)
        first = starts.groupBy("file", "call_id").agg(F.min(F.struct("place", "at", "is_source")).alias("r"))
        out = calls.join(done.drop("return_candidates"), ["file", "call_id"], "left").join(first, ["file", "call_id"], "left")
        outside = F.when(F.col("r").isNotNull() & ~F.col("r.is_source"), F.concat("r.at", F.lit("#"), "name"))
        made = F.when((F.col("form") == "CREATE") & F.col("r.is_source"), F.col("r.at"))  # an implicit constructor
        return out.select(
            *[c for c in calls.columns if c not in ("receiver_candidates", "owners")], F.coalesce("target_key", made, outside).alias("target_key"),
            F.col("r.at").alias("receiver_type"), F.coalesce(F.col("target_key").isNotNull() | made.isNotNull(), F.lit(False)).alias("is_source"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
        )

    def _targets(self, calls: DataFrame, starts: DataFrame) -> DataFrame:
        wide = calls.join(starts.filter("is_source").drop("is_source"), ["file", "call_id"])
        making = F.col("form").isin("CREATE", "THIS_CONSTRUCTOR", "SUPER_CONSTRUCTOR") | ((F.col("form") == "REFERENCE") & (F.col("name") == "new"))
        wide = wide.withColumn("making", making).withColumn("sought", F.when(making, F.substring_index("at", ".", -1)).otherwise(F.col("name")))
        lineage = self.lineage.withColumnRenamed("type_key", "at")
        tried = wide.join(lineage, "at").filter("not making or depth = 0")
        found = tried.join(self.methods.withColumnRenamed("simple_name", "sought"), ["ancestor", "sought"]).filter(
            "is_constructor = making and (n_params = arity or form = 'REFERENCE')"
        )
        simple = lambda x: F.substring_index(F.regexp_replace(x, "<.*>", ""), ".", -1)
        wrong = F.size(F.filter(F.zip_with("arguments", "types", lambda a, b: a.isNotNull() & (a != "var") & (simple(a) != simple(b))), lambda x: x))
        found = found.withColumn("rank", F.struct("place", "depth", F.coalesce(wrong, F.lit(0)).alias("wrong")))
        best = found.groupBy("file", "call_id").agg(
            F.min(F.struct("rank", "target_key", "return_candidates")).alias("b"), F.min("rank").alias("least"),
        )
        ties = found.join(best.select("file", "call_id", "least"), ["file", "call_id"]).filter("rank = least").groupBy("file", "call_id").agg((F.countDistinct("target_key") > 1).alias("ambiguous"))
        return best.join(ties, ["file", "call_id"]).select("file", "call_id", "b.target_key", "b.return_candidates", "ambiguous")

    def _accesses(self) -> DataFrame:
        """Field accesses with target_key: the field in the receiver's type or an enclosing one, or the nearest ancestor."""
        rows = self.raw("accesses").withColumn("uid", F.xxhash64("file", "start", "access"))
        names = self.names.select(F.col("candidates").alias("receiver_candidates"), "type_key")
        a = rows.filter("receiver_candidates is not null").join(names, "receiver_candidates").select("uid", "name", F.lit(0).alias("place"), F.col("type_key").alias("at"))
        b = rows.filter("size(owners) > 0").select("uid", "name", F.posexplode("owners").alias("place", "at"))
        fields = self.symbols.filter("kind = 'FIELD'").select(F.col("key").alias("target_key"), F.col("owner_key").alias("ancestor"), F.col("simple_name").alias("name"))
        found = a.union(b).join(self.lineage.withColumnRenamed("type_key", "at"), "at").join(fields, ["ancestor", "name"])
        best = found.groupBy("uid").agg(F.min(F.struct("place", "depth", "target_key")).alias("b")).select("uid", F.col("b.target_key").alias("target_key"))
        return rows.join(best, "uid").drop("uid", "receiver_candidates", "owners")

    def _refs(self) -> DataFrame:
        """Every reference to a type, method or field."""
        pos = ["file", "start", "length", "line", "col", "context", "enclosing_key", "enclosing_type"]
        t = self.type_refs.select(*pos, "target_key", F.lit("TYPE").alias("match_kind"), "fine_kind", F.lit(None).cast("string").alias("access"))
        c = self.calls.filter("target_key is not null").select(*pos, "target_key", F.lit("METHOD").alias("match_kind"), F.col("form").alias("fine_kind"), F.lit(None).cast("string").alias("access"))
        f = self.accesses.select(*pos, "target_key", F.lit("FIELD").alias("match_kind"), F.lit("FIELD_ACCESS").alias("fine_kind"), "access")
        return t.union(c).union(f)

    def _places(self) -> DataFrame:
        """What stands where, laid out by file: (file, start, length, target_key, match_kind) of resolved references."""
        return self.refs.filter("target_key is not null").select("file", "start", "length", "target_key", "match_kind")

    def _edges(self) -> DataFrame:
        """(from_key, to_key, kind), distinct, between source nodes."""
        making = F.col("form").isin("CREATE", "THIS_CONSTRUCTOR", "SUPER_CONSTRUCTOR") | ((F.col("form") == "REFERENCE") & (F.col("name") == "new"))
        c = self.calls.filter("is_source").select(F.col("enclosing_key").alias("from_key"), F.col("target_key").alias("to_key"), F.when(making, "CREATES").otherwise("CALLS").alias("kind"))
        nodes = self.symbols.filter("is_node").select(F.col("key").alias("to_key"))
        f = self.accesses.select(F.col("enclosing_key").alias("from_key"), F.col("target_key").alias("to_key"), F.col("access").alias("kind"))
        return c.union(f).filter("from_key <> to_key or kind = 'CALLS'").join(nodes, "to_key", "left_semi").select("from_key", "to_key", "kind").distinct()

    def _overrides(self) -> DataFrame:
        """(key, overridden_key): a method and each method of an ancestor with its name and parameter types."""
        m = self.symbols.filter("kind = 'METHOD' and form = 'method' and (flags & 8) = 0").select("key", "owner_key", "simple_name", F.array_join("params.type", ",").alias("types"), "flags")
        up = self.ancestors.select(F.col("type_key").alias("owner_key"), "ancestor")
        over = m.filter("(flags & 2) = 0").select(F.col("key").alias("overridden_key"), F.col("owner_key").alias("ancestor"), "simple_name", "types")
        return m.join(up, "owner_key").join(over, ["ancestor", "simple_name", "types"]).select("key", "overridden_key").distinct()

    def _nodes(self) -> DataFrame:
        return self.symbols.filter("is_node").select("key", "kind", "owner_key", "simple_name", "flags", "file", "line")

    def _tests(self) -> DataFrame:
        """Test methods, with whether they are disabled."""
        from codeseam.functions.fixed import DISABLED_ANNOTATIONS, TEST_ANNOTATIONS

        a = self.annotations
        tests = a.filter(F.col("simple_name").isin(*TEST_ANNOTATIONS) & (F.col("target_kind") == "METHOD")).groupBy(F.col("target_key").alias("key"), "owner_key").agg(F.min("fqn").alias("fqn"))
        off = a.filter(F.col("simple_name").isin(*DISABLED_ANNOTATIONS)).select(F.col("target_key").alias("off")).distinct()
        own = tests.join(off, tests["key"] == off["off"], "left").withColumnRenamed("off", "a")
        return own.join(off, own["owner_key"] == off["off"], "left").select("key", "owner_key", "fqn", (F.col("a").isNotNull() | F.col("off").isNotNull()).alias("disabled"))
