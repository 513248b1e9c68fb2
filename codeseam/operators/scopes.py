"""As-of joins and scopes by a sorted union: what came last, and what is still open.

Neither joins by an inequality.  Both sides are sorted together once and the last value is carried along; where a key's
rows cross ranges the carry is handed over, so a hot key is many tasks (see ``running``).  A scope is what an opening row
begins and its closing row ends.  How many are open is a running sum, and of those open the innermost is the last row that
opened at the present depth, which is an as-of lookup by key and depth: a stack without a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeseam.operators.running import running
from codeseam.operators.shared import stem


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: list[str], take: list[str], strict: bool = False) -> DataFrame:
    """``left`` with ``take`` of the last row of ``right`` at or before it (``strict``: before it) under its key, else nulls.

    Both have ``keys`` and ``at``, whose order is ascending with nulls first.  Null keys are one key.  Which of several
    right rows at one place counts is arbitrary: make ``at`` tell them apart.  A column of ``take`` that left has already
    is replaced.
    """
    x = stem(left, stem(right, "_a"))
    mine = [c for c in left.columns if c not in take]
    place = [*keys, *at]
    heads = lambda df, of: [F.col(c).alias(f"{x}{n}") for n, c in enumerate(place)] + [F.lit(of).alias(f"{x}side")]
    taken, own = F.struct(*take), F.struct(*mine)
    none = lambda df, columns: F.lit(None).cast(df.select(F.struct(*columns).alias("s")).schema["s"].dataType)
    # right rows come first at an equal place, or last where they have to lie before
    both = right.select(*heads(right, 1 if strict else 0), taken.alias(f"{x}taken"), none(left, mine).alias(f"{x}own"))
    both = both.union(left.select(*heads(left, 0 if strict else 1), none(right, take).alias(f"{x}taken"), own.alias(f"{x}own")))
    names = [f"{x}{n}" for n in range(len(place))]
    found = running(both, names[: len(keys)], [*names[len(keys) :], f"{x}side"], {f"{x}taken": (f"{x}taken", "last")})
    found = found.filter(F.col(f"{x}own").isNotNull())
    return found.select(*(F.col(f"{x}own.`{c}`") for c in mine), *(F.col(f"{x}taken.`{c}`") for c in take))


def nested(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, depth: str = "depth") -> DataFrame:
    """``df`` with ``depth``: how many scopes are open under its key after each row.  A closing row without an open scope
    closes nothing; a row that opens and closes only opens."""
    x = stem(df, "_n")
    step = F.when(opens, 1).when(closes, -1).otherwise(0).cast("bigint")
    summed = running(df.withColumn(f"{x}step", step), keys, order, {f"{x}sum": (f"{x}step", "sum")})
    lowest = running(summed, keys, order, {f"{x}low": (f"{x}sum", "min")})
    out = lowest.withColumn(depth, F.col(f"{x}sum") - F.least(F.lit(0).cast("bigint"), F.col(f"{x}low")))
    return out.drop(f"{x}step", f"{x}sum", f"{x}low")


def bound(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, value: str, depth: str = "depth", scope: str = "scope") -> DataFrame:
    """``df`` with ``depth`` and ``scope``: ``value`` of the row that opened the innermost scope open after each row, null
    outside of all.  An opening row is in its own scope, a closing one in what is around the scope it ends.  ``order`` has
    to tell the rows of a key apart."""
    x = stem(df, "_b")
    mark = F.coalesce(opens, F.lit(False))
    levels = nested(df.withColumn(f"{x}opens", mark), keys, order, F.col(f"{x}opens"), closes, f"{x}depth")
    opened = levels.withColumn(f"{x}value", F.when(F.col(f"{x}opens"), F.struct(F.col(value).alias("v"))))
    found = running(opened, [*keys, f"{x}depth"], order, {f"{x}scope": (f"{x}value", "last")})
    made = {depth: F.col(f"{x}depth"), scope: F.when(F.col(f"{x}depth") > 0, F.col(f"{x}scope.v"))}
    return found.select(*(c for c in df.columns if c not in made), *(v.alias(n) for n, v in made.items()))


def resolved(names: DataFrame, keys: list[str], order: list[str], name: str, kind: str, value: str, out: str = "bound") -> DataFrame:
    """The use rows of ``names``, each with ``out``: ``value`` of the declaration that its name means there, else null.

    ``kind`` is ``open`` and ``close`` of a block, ``declare`` or ``use`` of ``name``.  A declaration holds from its place to the
    end of the block it stands in; an inner one hides an outer one while it holds.  Blocks beside each other don't share
    names.  A declaration outside of all blocks holds to the end.

    Declarations of one name are scopes of their own: each opens at its place and closes with its block.  So the ends are
    looked up first, by block, and the innermost open declaration by name.
    """
    x = stem(names, "_d")
    blocks = names.withColumn(f"{x}id", F.monotonically_increasing_id())
    blocks = bound(blocks, keys, order, F.col(kind) == "open", F.col(kind) == "close", f"{x}id", f"{x}depth", f"{x}block")
    # a block's end: the first close after it at the depth around it, which is the next row that leaves its depth
    ends = blocks.filter(F.col(kind).isin("open", "close"))
    ends = ends.withColumn(f"{x}level", F.when(F.col(kind) == "open", F.col(f"{x}depth")).otherwise(F.col(f"{x}depth") + 1))
    ends = ends.withColumn(f"{x}opened", F.when(F.col(kind) == "open", F.struct(F.col(f"{x}id").alias("v"))))
    closing = running(ends, [*keys, f"{x}level"], order, {f"{x}ended": (f"{x}opened", "last")}).filter(F.col(kind) == "close")
    ended = closing.select(F.col(f"{x}ended.v").alias(f"{x}block"), *(F.col(c).alias(f"{x}end_{c}") for c in order)).dropna()
    ended = ended.groupBy(f"{x}block").agg(*(F.min(c).alias(c) for c in ended.columns[1:]))
    declared = blocks.filter(F.col(kind) == "declare")
    starts = declared.select(*names.columns, F.lit(1).alias(f"{x}side"))
    stops = declared.join(ended, f"{x}block").select(*(F.col(f"{x}end_{c}").alias(c) if c in order else F.lit("undeclare").alias(c) if c == kind else F.col(c) for c in names.columns), F.lit(0).alias(f"{x}side"))
    uses = blocks.filter(F.col(kind) == "use").select(*names.columns, F.lit(2).alias(f"{x}side"))
    every = starts.union(stops).union(uses)
    found = bound(every, [*keys, name], [*order, f"{x}side"], F.col(kind) == "declare", F.col(kind) == "undeclare", value, f"{x}d", out)
    return found.filter(F.col(kind) == "use").select(*(c for c in names.columns if c != out), out)
