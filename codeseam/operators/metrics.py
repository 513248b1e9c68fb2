"""Conditional counts, thresholds and buckets per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def conditional_counts(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """One count per named condition and group, in one pass."""
    return df.groupBy(*keys).agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def violations(df: DataFrame, limits: list[tuple[Column, int | float, str]], column: str = "messages", separator: str = "; ") -> DataFrame:
    """Rows over at least one limit (strictly), with the messages of those exceeded."""
    over = F.array_compact(F.array(*(F.when(value > limit, F.lit(message)) for value, limit, message in limits)))
    return df.withColumn(column, F.array_join(over, separator)).filter(F.col(column) != "")


def bucket(value: Column, edges: list[tuple[int, str]], above: str) -> Column:
    """The name of the first edge that is not exceeded, else ``above``."""
    out = F.lit(above)
    for limit, name in reversed(edges):
        out = F.when(value <= limit, name).otherwise(out)
    return out


#: Cyclomatic complexity up to the number is the named risk.
RISK = [(5, "low"), (10, "medium")]
