"""Containment joins: the innermost interval that holds a point.

Both sides share an equality key.  Intervals are cut into cells of a fixed width and points look only into their own
cell, so the join is an equi-join with a residual test and long files or busy keys are spread over many cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeseam.operators.shared import fresh, stem


def containing(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, cell: int) -> DataFrame:
    """Every (point, interval) with start <= at < end under one key."""
    own = stem(intervals, stem(points, "cell"))
    cut = intervals.filter(F.col(start) < F.col(end)).withColumn(own, F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))
    return points.withColumn(own, F.floor(F.col(at) / cell)).join(cut, [key, own]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop(own)


def innermost(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, cell: int, point_id: list[str], keep: list[str]) -> DataFrame:
    """For each point the shortest interval that holds it (ties: the later start, then the least of ``keep``); points in none are left out.

    A minimum over a struct: partial aggregation before the shuffle, no sort of the matches.
    """
    found = containing(points, intervals, key, at, start, end, cell)
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("width"), (-F.col(start)).alias("later"), *keep)).alias("best")
    return found.groupBy(*point_id).agg(best).select(*point_id, *(F.col(f"best.{c}").alias(c) for c in keep))


def longest_prefix(df: DataFrame, name: str, names: DataFrame, known: str, separator: str = ".") -> DataFrame:
    """``df`` with ``match`` (``match_`` where that is taken): the longest of ``names``' values that is the name or a leading run of its parts; null: none.

    Each name gives its prefixes, which meet the known values by equality.
    """
    own, match = stem(df, "of"), fresh(df, "match")
    whole, prefix = F.col(f"{own}name"), f"{own}prefix"
    parts = F.split(whole, f"[{separator}]", -1)
    distinct = df.select(F.col(name).alias(f"{own}name")).filter(whole.isNotNull()).distinct()
    prefixes = distinct.select(
        whole, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))).alias(prefix)
    )
    hits = prefixes.join(names.select(F.col(known).alias(prefix)).distinct(), prefix)
    best = hits.groupBy(f"{own}name").agg(F.max_by(prefix, F.length(prefix)).alias(match))
    return df.join(best, F.col(name) == whole, "left").drop(f"{own}name")
