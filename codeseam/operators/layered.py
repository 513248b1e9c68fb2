"""Keyed tables that take small changes without being rewritten, and edges kept in buckets by one end.

A layered table is a base and a small table of changes, which is what a batch writes; the base is written again only when
the changes have grown to a part of it.  Both may be bucketed: a join on the bucketing key then exchanges the other side
alone, in every round of a loop.  Joins on more keys than that one would exchange the whole base, so they come after it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codeseam.operators.shared import bucketed, settled

#: Changes beyond this part of the base's rows are merged into it.
PART = 8


@dataclass
class Layered:
    """Rows with distinct ``keys``: those of ``base`` but for what ``changes`` says of their keys (``gone``: no row)."""

    base: DataFrame
    keys: list[str]
    changes: DataFrame | None = None
    by: str | None = None
    rows_in_base: int | None = None

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], by: str | None = None) -> "Layered":
        base = bucketed(df.sparkSession, df, by) if by else settled(df)
        return cls(base, keys, None, by, base.count())

    @property
    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)

    @property
    def parts(self) -> list[DataFrame]:
        """The rows as tables that share no key; in buckets still where ``by`` is the only key."""
        if self.changes is None:
            return [self.base]
        kept = self.base.join(self.changes.select(*self.keys), self.keys, "left_anti")
        return [kept.select(*self.base.columns), self.changes.filter("not gone").select(*self.base.columns)]

    def met(self, some: DataFrame) -> DataFrame:
        """``some`` joined with the rows on ``by``: what is exchanged is ``some`` and what it finds."""
        found = some.join(self.base, self.by)
        if self.changes is None:
            return found
        mine = some.join(self.changes, self.by)
        kept = found.join(mine.select(*self.keys), self.keys, "left_anti").select(*found.columns)
        return kept.union(mine.filter("not gone").select(*found.columns))

    def changed(self, upserts: DataFrame) -> "Layered":
        """With ``upserts`` (all columns and ``gone``), whose keys are distinct; null keys can't be changed."""
        columns = [*self.base.columns, "gone"]
        new = upserts.select(*columns)
        if self.changes is not None:
            new = new.union(self.changes.join(upserts.select(*self.keys), self.keys, "left_anti").select(*columns))
        new = bucketed(new.sparkSession, new, self.by) if self.by else settled(new)
        out = Layered(self.base, self.keys, new, self.by, self.rows_in_base)
        return out if new.count() * PART <= (self.rows_in_base or 0) else Layered.of(out.rows, self.keys, self.by)

    def after(self, came: DataFrame, went: DataFrame) -> "Layered":
        """With the rows ``came`` and without the rows ``went``, which share no key."""
        return self.changed(went.withColumn("gone", F.lit(True)).union(came.withColumn("gone", F.lit(False))))


@dataclass
class Edges:
    """Distinct edges in two layered tables, in buckets by their source and by their target."""

    out: Layered
    back: Layered

    @classmethod
    def of(cls, edges: DataFrame) -> "Edges":
        out = Layered.of(edges.select("src", "dst").filter("src <> dst").distinct(), ["src", "dst"], "src")
        return cls(out, Layered.of(out.base, ["src", "dst"], "dst"))


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows without nulls in ``columns``, of those columns."""
    return df.select(*columns).dropna().distinct()
