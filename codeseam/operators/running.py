"""Running values over ordered groups of any size: prefix sums, carried last values.

A window over one key is one task, however large the key.  Here rows are dealt into ranges of (keys, order), each range
knows what it adds, and a carry is handed from range to range: a table of a row for each range at most, since only a group
that crosses a border needs one.  So a key that holds a third of all rows is spread over a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeseam.operators.shared import stem, written

HOW = ("sum", "last", "max", "min", "lag")


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with, for each name of ``values``, a running value within its group, in ascending ``order`` (nulls first).

    ``values`` maps a new column to (column, how).  ``sum``: of this row and those before it, nulls count nothing, null
    before the first value.  ``last``: the last value that isn't null, of this row or those before it.  ``max``: the
    largest so far, ``min``: the least.  ``lag``: that of the row before, for columns without nulls.  Rows that tie in ``order`` come in an arbitrary order.  No keys: one group of all rows.  Null keys
    are one group.  Empty tables stay empty; a new column takes the place of an old one of its name.
    """
    x = stem(df, "_r")
    part, tie = f"{x}part", f"{x}tie"
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*(F.col(c) for c in [*keys, *order]), F.col(tie))
    dealt = written(df.sparkSession, dealt.withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(part, *keys).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, 0)
    added, carried, local, made = [], [F.count(part).over(before).alias(f"{x}earlier")], {}, {}
    for k, (name, (column, how)) in enumerate(values.items()):
        value, own, carry = F.col(column), F.col(f"{x}own{k}"), F.col(f"{x}carry{k}")
        if how not in HOW:
            raise ValueError(f"one of {HOW}, not {how}")
        if how == "last":
            in_range = F.max_by(value, F.when(value.isNotNull(), F.struct(*order, tie)))
            before_range, here = F.last(own, ignorenulls=True).over(before), F.last(value, ignorenulls=True).over(inside)
            made[name] = F.coalesce(f"{x}here{k}", carry)
        elif how == "lag":
            in_range = F.max_by(value, F.struct(*order, tie))
            before_range, here = F.last(own).over(before), F.lag(value).over(Window.partitionBy(part, *keys).orderBy(*order, tie))
            made[name] = F.coalesce(f"{x}here{k}", carry)
        elif how in ("max", "min"):
            most, one = (F.max, F.greatest) if how == "max" else (F.min, F.least)
            in_range, before_range, here = most(value), most(own).over(before), most(value).over(inside)
            made[name] = one(f"{x}here{k}", carry)
        else:
            in_range, before_range, here = F.sum(value), F.sum(own).over(before), F.sum(value).over(inside)
            made[name] = F.coalesce(F.col(f"{x}here{k}") + carry, carry, f"{x}here{k}")
        added.append(in_range.alias(f"{x}own{k}"))
        carried.append(before_range.alias(f"{x}carry{k}"))
        local[f"{x}here{k}"] = here
    sums = dealt.groupBy(part, *keys).agg(*added)
    heads = [F.col(c).alias(f"{x}key{k}") for k, c in enumerate(keys)]
    # ranges in which a group goes on: fewer than there are ranges
    carries = sums.select(F.col(part).alias(f"{x}at"), *heads, *carried).filter(F.col(f"{x}earlier") > 0)
    met = F.col(part) == F.col(f"{x}at")
    for k, c in enumerate(keys):
        met = met & F.col(c).eqNullSafe(F.col(f"{x}key{k}"))
    out = dealt.withColumns(local).join(F.broadcast(carries), met, "left")
    return out.select(*(c for c in df.columns if c not in made), *(v.alias(n) for n, v in made.items()))
