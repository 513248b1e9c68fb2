"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.

    ``edges`` has two bigint columns a, b.  Rounds keep the edge count within the number of nodes plus edges, halve
    the depth, and are written in the shared folder.  Links never reach the driver: only a count and a checksum do.
    """
    now = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now = written(spark, now, "components")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), mark).first()
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        now = written(spark, _star(_star(now, True), False), "components")
        after = now.agg(F.count("*"), mark).first()
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
