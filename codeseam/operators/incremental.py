"""Reachability kept up to date under batches of inserted and deleted edges and roots.

Every reached node has a rank, and at least one support: being a root, or an edge from a reached node of smaller rank.  Along
supports ranks only grow, so they hold no cycle, and a node is lost exactly when its last support is: losses go along
deleted edges and the edges of lost nodes only.  Then what is lost but still entered from a living node is derived again,
together with what inserted edges and roots newly reach.  Supports are counted again only where an edge or a rank beside
them changed.  A batch reads the rows of the nodes it touches, by joins with edges kept in buckets, and writes changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codeseam.operators.graph import reachable
from codeseam.operators.layered import Edges, Layered, clean
from codeseam.operators.shared import bucketed, discard, settled


@dataclass
class Reach:
    """The reached nodes: ``state.rows`` has node, rank and support."""

    edges: Edges
    roots: Layered
    state: Layered
    #: Tables that the last batch wrote, round by round.
    touched: list[DataFrame] = field(default_factory=list)

    @property
    def nodes(self) -> DataFrame:
        return self.state.rows.select("node")

    def rows_touched(self) -> int:
        return sum(t.count() for t in self.touched)


def build(edges: DataFrame, roots: DataFrame) -> Reach:
    """Everything reachable over ``edges`` (src, dst) from ``roots`` (node), from scratch; nulls are no nodes."""
    kept = Edges.of(clean(edges, ["src", "dst"]))
    start = Layered.of(clean(roots, ["node"]), ["node"], "node")
    found = reachable(kept.out.base, start.base, steps=kept.out.base)
    ranks = bucketed(edges.sparkSession, found.select("node", F.col("depth").alias("rank")), "node", "ranks")
    given = kept.out.base.join(ranks.select(F.col("node").alias("src"), F.col("rank").alias("from")), "src").select(F.col("dst").alias("node"), "from")
    counted = given.join(ranks, "node").filter(F.col("from") < F.col("rank")).groupBy("node").agg(F.count("*").alias("n"))
    state = Layered.of(_supported(ranks, counted, start.base), ["node"], "node")
    discard(ranks)
    return Reach(kept, start, state)


def _supported(ranks: DataFrame, counted: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, rank, support) from edges of smaller rank, counted, and roots."""
    both = ranks.join(counted, "node", "left").join(roots.select("node", F.lit(1).alias("root")), "node", "left")
    return both.select("node", "rank", (F.coalesce("n", F.lit(0)) + F.coalesce("root", F.lit(0))).cast("bigint").alias("support"))


def maintain(
    reach: Reach, inserted: DataFrame, deleted: DataFrame, new_roots: DataFrame | None = None, lost_roots: DataFrame | None = None,
    exact: bool = False,
) -> Reach:
    """``reach`` after a batch.  Inserting what is there and deleting what isn't changes nothing; an edge or root in both
    is there afterwards.  ``exact``: the caller knows that rows are distinct and without nulls or loops, that none of the
    inserted is there and all of the deleted are; then they are not held against all edges and roots.
    """
    none = reach.roots.base.limit(0).select("node")
    ends = ["src", "dst"]
    state = reach.state
    touched: list[DataFrame] = []

    def note(df: DataFrame, by: str | None = None) -> DataFrame:
        touched.append(bucketed(df.sparkSession, df, by) if by else settled(df))
        return touched[-1]

    came, went = none if new_roots is None else new_roots.select("node"), none if lost_roots is None else lost_roots.select("node")
    if exact:
        inserted, deleted, came, went = note(inserted.select(*ends)), note(deleted.select(*ends)), note(came), note(went)
    else:
        have, rooted = reach.edges.out.rows, reach.roots.rows
        inserted = clean(inserted, ends).filter("src <> dst")
        deleted = note(clean(deleted, ends).join(inserted, ends, "left_anti").join(have, ends, "left_semi"))
        inserted = note(inserted.join(have, ends, "left_anti"))
        came = clean(came, ["node"])
        went = note(clean(went, ["node"]).join(came, "node", "left_anti").join(rooted, "node", "left_semi"))
        came = note(came.join(rooted, "node", "left_anti"))
    left = reach.edges.out.changed(deleted.withColumn("gone", F.lit(True)))

    # what loses its last support: every support falls once, so a lost node is not met again
    def falls(edges: DataFrame) -> DataFrame:
        """(node, n): supports that go with these edges."""
        into = state.met(edges.select(F.col("src").alias("node"), "dst")).select(F.col("dst").alias("node"), F.col("rank").alias("from"))
        return state.met(into).filter(F.col("from") < F.col("rank")).groupBy("node").agg(F.count("*").alias("n"))

    fallen, lost = falls(deleted).union(state.met(went).select("node", F.lit(1).cast("bigint"))), none
    while True:
        total = note(state.met(fallen.groupBy("node").agg(F.sum("n").alias("n"))).select("node", "n", "support"))
        newly = total.filter("n >= support").select("node")
        if newly.isEmpty():
            break
        lost = lost.union(newly)
        onward = left.met(newly.select(F.col("node").alias("src"))).select(*ends)
        fallen = total.filter("n < support").select("node", "n").union(falls(onward))
    lost = note(lost, "node")

    # what is entered from a living node, and what follows from it
    edges = Edges(left.changed(inserted.withColumn("gone", F.lit(False))), reach.edges.back.after(inserted, deleted))
    roots = reach.roots.after(came, went)
    living = [p.join(lost, "node", "left_anti").select("node", "rank") for p in state.parts]
    rated = lambda some, tables: reduce(DataFrame.union, [some.join(t, "node") for t in tables])
    entering = edges.back.met(lost.select(F.col("node").alias("dst"))).select(*ends).union(inserted)
    entering = rated(entering.select(F.col("src").alias("node"), "dst"), living).select(F.col("dst").alias("node"), (F.col("rank") + 1).alias("rank"))
    again = roots.met(lost.union(came)).select("node", F.lit(0).alias("rank"))

    def reached(new: DataFrame) -> DataFrame:
        """The least rank of each node that isn't living."""
        new = new.groupBy("node").agg(F.min("rank").alias("rank"))
        return reduce(lambda some, t: some.join(t.select("node"), "node", "left_anti"), living, new)

    frontier = derived = note(reached(entering.union(again)))
    while not frontier.isEmpty():
        onward = edges.out.met(frontier.select(F.col("node").alias("src"), "rank"))
        new = reached(onward.select(F.col("dst").alias("node"), (F.col("rank") + 1).alias("rank")))
        frontier = note(new.join(derived, "node", "left_anti"))
        derived = derived.union(frontier)

    # supports beside what changed
    moved = lost.union(derived.select("node")).distinct()
    beside = edges.out.met(moved.select(F.col("node").alias("src"))).select(F.col("dst").alias("node"))
    affected = moved.union(beside).union(inserted.select("dst")).union(deleted.select("dst")).union(came).union(went)
    own = note(rated(affected.distinct(), [*living, derived]))
    entered = edges.back.met(own.select(F.col("node").alias("dst"), F.col("rank").alias("own"))).select(F.col("src").alias("node"), "dst", "own")
    counted = rated(entered, [*living, derived]).filter("rank < own").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    upserts = _supported(own, counted, roots.met(own.select("node"))).withColumn("gone", F.lit(False))
    dead = lost.join(derived, "node", "left_anti").select("node", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("support"), F.lit(True).alias("gone"))
    upserts = note(upserts.select("node", "rank", "support", "gone").union(dead))
    return Reach(edges, roots, state.changed(upserts), touched)
