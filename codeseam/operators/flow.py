"""Depth-bounded flow: paths from seeds, and facts that pass from argument to parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeseam.operators.shared import settled


def bounded_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, steps, depth): every simple path of at most ``depth`` edges from the seeds.

    Unrolled joins; a node already on the path is not taken again.
    """
    once = edges.select("src", "dst").distinct()
    now = seeds.select(F.col("node").alias("seed"), "node", F.array("node").alias("steps"), F.lit(0).alias("depth"))
    out = None
    for d in range(1, depth + 1):
        step = now.join(once, now["node"] == once["src"]).filter(~F.array_contains("steps", F.col("dst")))
        now = step.select("seed", F.col("dst").alias("node"), F.concat("steps", F.array("dst")).alias("steps"), F.lit(d).alias("depth"))
        out = now if out is None else out.union(now)
    return out if out is not None else now.limit(0)


def interprocedural(
    seeds: DataFrame, assigns: DataFrame, arguments: DataFrame, parameters: DataFrame, sinks: DataFrame, depth: int, kind: str
) -> DataFrame:
    """(kind, method, variable, steps, sink): flows of a fact from its seeds to sinks, over at most ``depth`` calls.

    ``seeds`` method, variable, line; ``assigns`` method, source, target, line (aliases within a method); ``arguments``
    method, variable, callee, position, line; ``parameters`` method, position, name; ``sinks`` method, variable, what,
    line.  May-analysis: nothing is killed.  Paths grow by one step a round; a (fact, method, variable) is entered at its
    shortest path and again whenever a longer one has fewer calls behind it, since that one may still go where the
    shorter may not.  A flow is told once, by its shortest path (ties: fewest calls, then the steps' text).
    """
    step = lambda how, name, line: F.concat_ws(" ", F.lit(how), name, F.concat(F.lit("@"), line.cast("string")))
    now = seeds.select(
        F.col("method").alias("origin"), F.col("variable").alias("fact"), F.col("line").alias("seed_line"), "method", "variable",
        F.array().cast("array<string>").alias("steps"), F.lit(0).alias("calls"),
    )
    key = ["origin", "fact", "seed_line", "method", "variable"]
    seen = now
    while True:
        alias = now.join(assigns.select("method", F.col("source").alias("variable"), F.col("target"), F.col("line").alias("at")), ["method", "variable"]).select(
            "origin", "fact", "seed_line", "method", F.col("target").alias("variable"), F.concat("steps", F.array(step("alias", F.col("target"), F.col("at")))).alias("steps"), "calls"
        )
        call = now.filter(F.col("calls") < depth).join(
            arguments.select("method", "variable", "callee", "position", F.col("line").alias("at")), ["method", "variable"]
        ).join(parameters.select(F.col("method").alias("callee"), "position", "name"), ["callee", "position"]).select(
            "origin", "fact", "seed_line", F.col("callee").alias("method"), F.col("name").alias("variable"),
            F.concat("steps", F.array(step("argument", F.concat_ws(" ", F.col("position").cast("string"), "name"), F.col("at")))).alias("steps"), (F.col("calls") + 1).alias("calls"),
        )
        new = alias.union(call).groupBy(*key).agg(F.min(F.struct(F.size("steps"), "calls", "steps")).alias("best"))
        new = new.select(*key, "best.steps", "best.calls")
        older = seen.groupBy(*key).agg(F.min("calls").alias("least"))
        now = settled(new.join(older, key, "left").filter("least is null or calls < least").select(*now.columns))
        if now.isEmpty():
            break
        seen = settled(seen.union(now))
    hit = seen.join(sinks.select("method", "variable", "what", F.col("line").alias("sink_line")), ["method", "variable"])
    told = ["origin", "fact", "seed_line", "what", "method", "sink_line"]
    best = hit.groupBy(*told).agg(F.min(F.struct(F.size("steps"), "calls", "steps"))["steps"].alias("steps"))
    return best.select(
        F.lit(kind).alias("kind"), F.col("origin").alias("method"), F.col("fact").alias("variable"), "seed_line", F.array_join("steps", "; ").alias("steps"),
        F.col("what").alias("sink"), F.col("method").alias("sink_method"), "sink_line",
    )
