"""The first rows of a large table from as few of its groups of files as their statistics allow.

A grouped table lies in a folder for each group, with a small table of how many rows a group has and between which values
its sort column lies.  A top-k reads groups in the order of their bounds, in batches that double, and stops once no group
that is left can hold a row that comes before the k-th found.  What was read is told with the answer, and so is whether
the number of rows seen is that of all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.operators.search import checked_limit
from codeseam.operators.shared import stem


@dataclass
class Found:
    """``rows``: the first k; ``seen``: rows of the groups read; ``total``: rows of all groups, from their statistics."""

    rows: DataFrame
    groups_read: int
    groups: int
    seen: int
    total: int


class Grouped:
    """A table in groups of about equal size by ranges of ``column``, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path, column

    def write(self, df: DataFrame, groups: int) -> "Grouped":
        x = stem(df, "group")
        dealt = df.repartitionByRange(groups, F.col(self.column)).withColumn(x, F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy(x).parquet(f"{self.path}/rows")
        rows = self.spark.read.parquet(f"{self.path}/rows")
        value = F.col(self.column)
        facts = rows.groupBy(F.col(x).alias("group")).agg(F.count("*").alias("n"), F.count_if(value.isNull()).alias("nulls"), F.min(value).alias("low"), F.max(value).alias("high"))
        facts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/facts")
        return self

    def first(self, k: int, descending: bool, ties: list[str], where: str | None = None) -> Found:
        """The first ``k`` rows by the column (nulls last), then by ``ties``, of those that ``where`` keeps."""
        k = checked_limit(k)
        rows = self.spark.read.parquet(f"{self.path}/rows")
        x = rows.columns[-1]  # the folders' column comes last
        facts = self.spark.read.parquet(f"{self.path}/facts")
        bound = F.col("high") if descending else F.col("low")
        order = [bound.desc_nulls_last() if descending else bound.asc_nulls_last(), F.col("group")]
        left = facts.orderBy(*order).select("group", "n", bound.alias("bound")).collect()  # a row for each group of files
        value = F.col(self.column)
        sorted_by = [value.desc_nulls_last() if descending else value.asc_nulls_last(), *(F.col(c) for c in ties)]
        best, read, step = None, 0, 1
        while read < len(left):
            part = rows.filter(F.col(x).isin([r["group"] for r in left[read : read + step]])).drop(x)
            part = part if where is None else part.filter(where)
            best = (part if best is None else part.union(best)).orderBy(*sorted_by).limit(k)
            held = best.collect()  # at most k rows
            best = self.spark.createDataFrame(held, part.schema)
            read, step = read + step, 2 * step
            if read >= len(left) or not k:
                break
            last, coming = held[-1][self.column] if len(held) == k else None, left[read]["bound"]
            # a tie may still come before the last row; where only nulls are left, nothing that isn't null does
            if last is not None and (coming is None or (coming < last if descending else coming > last)):
                break
        read = min(read, len(left))
        if best is None:
            best = rows.drop(x).limit(0)
        return Found(best, read, len(left), sum(r["n"] for r in left[:read]), sum(r["n"] for r in left))
