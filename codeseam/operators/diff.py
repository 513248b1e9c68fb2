"""Snapshot differences by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def snapshot_diff(known: DataFrame, disk: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, change) with change added, deleted or edited, a row for each key; equal stamps are left out.

    A null key is one key like others, null stamps equal each other.  A key that a snapshot holds several times is compared
    by all its stamps there, in whatever order: by how many there are, how many are null and the sum of their hashes.
    """
    side = lambda df, of: df.select(F.col(key).alias("k"), F.struct(F.col(stamp).alias("s")).alias("s"), F.lit(of).alias("of"))
    # one exchange: both sides are summed together by key, map-side first, so no key is gathered
    both = side(known, "was").union(side(disk, "now"))
    sums = [
        f(F.when(F.col("of") == of, v)).alias(f"{of}{n}")
        for of in ("was", "now")
        for n, (f, v) in enumerate(((F.count, F.lit(1)), (F.min, F.col("s")), (F.max, F.col("s")), (F.sum, F.xxhash64("s.s").cast("decimal(20,0)")), (F.count, F.col("s.s"))))
    ]
    found = both.groupBy("k").agg(*sums)
    same = F.lit(True)
    for n in range(5):
        same = same & F.col(f"was{n}").eqNullSafe(F.col(f"now{n}"))
    change = F.when(F.col("was0") == 0, "added").when(F.col("now0") == 0, "deleted").when(~same, "edited")
    return found.select(F.col("k").alias(key), change.alias("change")).filter("change is not null")


class SourceMissing(RuntimeError):
    """A scanned root is gone: refused instead of reported as deletions of everything in it."""

    code = "PROJECT_LOAD_FAILED"
