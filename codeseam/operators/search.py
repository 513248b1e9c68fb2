"""Limits with exact totals, pages, and per-group limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeseam.operators.shared import fresh, stem


class InvalidParameter(ValueError):
    """A parameter outside what an operator accepts."""

    code = "INVALID_PARAMETER"


def checked_limit(k: int, cap: int | None = None) -> int:
    """A limit of zero or more, cut to its cap."""
    if isinstance(k, bool) or not isinstance(k, int):
        raise InvalidParameter(f"a limit is a whole number: {k!r}")
    if k < 0:
        raise InvalidParameter(f"a limit may not be negative: {k}")
    return k if cap is None else min(k, cap)


def with_total(shown: DataFrame, df: DataFrame) -> DataFrame:
    """``shown``, a few rows of ``df``, and in ``total`` (``total_`` where that is taken) the number of all.

    Where there are rows but none is shown, one row of nulls carries the total; no rows at all give no row.
    """
    mark, total = fresh(shown, "shown"), fresh(shown, "total")
    count = df.agg(F.count("*").alias(total))
    # one row against the at most k that are shown
    both = count.join(F.broadcast(shown.withColumn(mark, F.lit(True))), F.lit(True), "left").filter(F.col(mark) | (F.col(total) > 0))
    return both.select(*(F.col(c) for c in shown.columns), total)


def top_with_total(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows and in ``total`` the number of all: one aggregate row meets a top-k, nothing is sorted whole."""
    return with_total(df.orderBy(*order).limit(checked_limit(k)), df)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, total: str | None = "total", rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank, and each group's size; null keys are groups like others.

    The rank filter is pushed before the shuffle as a group limit; sizes are counted map-side, so no group is gathered.
    Where ``df`` has a column named like one of the new ones, the new one's name gets an underscore.
    """
    rank = fresh(df, rank)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= checked_limit(k))
    if not total:
        return ranked
    total, own = fresh(ranked, total), stem(ranked, "of")
    sizes = df.groupBy(*(F.col(c).alias(f"{own}{n}") for n, c in enumerate(keys))).agg(F.count("*").alias(total))
    met = F.lit(True)
    for n, c in enumerate(keys):
        met = met & F.col(c).eqNullSafe(F.col(f"{own}{n}"))
    return ranked.join(sizes, met).select(*keys, *(F.col(c) for c in ranked.columns if c not in keys), total)


def page(df: DataFrame, order: list[Column], offset: int, k: int) -> DataFrame:
    """``k`` rows from ``offset`` in a fixed order."""
    if offset < 0:
        raise InvalidParameter(f"an offset may not be negative: {offset}")
    return df.orderBy(*order).offset(offset).limit(checked_limit(k))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    place = fresh(df, "first")
    return top_per_group(df, keys, order, 1, total=None, rank=place).drop(place)


def capped_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, found, shown): group counts, and counts clipped to ``k``."""
    found = df.groupBy(key).agg(F.count("*").alias("found"))
    return found.withColumn("shown", F.least("found", F.lit(checked_limit(k)).cast("bigint")))
