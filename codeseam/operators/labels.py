"""Interval labels of a forest, so that ancestors and descendants are range joins and no pair of them is stored.

Leaves are taken off round by round, each with its place among the leaves of its parent, for as long as a round takes off a
quarter of what is left: all rounds together meet each node a few times, and a node moves only to meet its parent.  What then
is left, as of long chains, is labelled by a walk that enters and leaves each of its nodes once: a linked list whose links
come from neighbours alone (the first child, the next sibling, the parent).  How far each step lies from the end of its
list is found by pointer jumping, which doubles the span of every pointer each round.  Then the leaves get their labels from
their parents, last round first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeseam.operators.interval import containing
from codeseam.operators.running import running
from codeseam.operators.shared import bucketed, discard, settled

#: A parent with more leaves in a round than this has them placed over ranges, others in one task each.
CHILDREN = 1 << 18


def interval_labels(nodes: DataFrame, value: str | None = None) -> DataFrame:
    """(node, parent, root, low, high, depth, size) of a forest given as rows (node, parent), a row for each node.

    ``a`` is an ancestor of ``d``, or ``d`` itself, exactly where their roots are equal and ``a.low <= d.low < a.high``; the
    places of a tree are 0 to its size.  A parent that is null, no node or the node itself makes a root.  Rows without a node
    are left out, of several rows of a node the least parent counts.  Nodes that hang on a cycle of parents have no root:
    their labels are null.  With ``value``, a column of ``nodes``, ``total`` comes too: its sum over all rows of a node's
    whole subtree, nulls left out (null where there are no others).  Leaves bring it to their parents as they bring their
    sizes, so no row moves for it.

    A row moves to its node, and once more to its parent when it is a leaf; the labels of the leaves taken first, mostly the
    bulk of them, are made where they are read.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    worth = [] if value is None else ["total"]
    summed = [F.sum(value).alias(c) for c in worth]
    once = nodes.filter("node is not null").groupBy("node").agg(F.min("parent").alias("parent"), *summed)
    once = once.select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), F.lit(1).cast("bigint").alias("size"), *worth)
    rest = bucketed(spark, once, "node", "forest")
    kind = {c: rest.schema[c].dataType for c in worth}
    count, taken = rest.count(), []
    while count:
        held = rest.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
        inner = bucketed(spark, held, "node", "inner")
        upper = bucketed(spark, rest.join(inner, "node", "left_semi"), "node", "upper")
        alone, hung = _placed(rest.join(inner, "node", "left_anti"), upper, inner)
        more = None
        for part in hung:
            sums = part.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("more"), *(F.sum(c).cast(kind[c]).alias(f"more_{c}") for c in worth))
            more = sums if more is None else more.union(sums)  # a parent's leaves are all in one of them
        kept = upper.join(more, "node", "left")
        both = [F.coalesce((F.col(c) + F.col(f"more_{c}")).cast(kind[c]), c, f"more_{c}").alias(c) for c in worth]
        kept = bucketed(spark, kept.select("node", "parent", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), *both), "node", "forest")
        discard(rest, inner, upper)
        taken.append((alone, hung))
        rest, before = kept, count
        count = rest.count()
        if 4 * count > 3 * before:
            break
    made = _walked(rest, worth) if count else rest.select("node", "parent", F.lit(None).cast(rest.schema["node"].dataType).alias("root"), *(F.lit(None).cast(t).alias(c) for c, t in _PLACES), *worth)
    labelled = made
    while taken:
        alone, hung = taken.pop()
        tops = alone.select("node", F.lit(None).cast(alone.schema["parent"].dataType).alias("parent"), F.col("node").alias("root"), F.lit(0).cast("bigint").alias("low"), F.col("size").alias("high"), F.lit(0).alias("depth"), "size", *worth)
        above = labelled.select(F.col("node").alias("parent"), F.col("root").alias("top"), F.col("low").alias("from"), F.col("depth").alias("over"))
        level = tops
        for part in hung:
            low = F.col("from") + F.col("place")
            own = [F.when(F.col("top").isNotNull(), F.col(c)).alias(c) for c in ("size", *worth)]
            met = part.join(above, "parent").select("node", "parent", F.col("top").alias("root"), low.alias("low"), (low + F.col("size")).alias("high"), (F.col("over") + 1).alias("depth"), *own)
            level = level.union(met)
        labelled = labelled.union(settled(level) if taken else level)
    return labelled


_PLACES = (("low", "bigint"), ("high", "bigint"), ("depth", "int"), ("size", "bigint"))


def _placed(leaves: DataFrame, upper: DataFrame, inner: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves that are roots, and tables of the others with their places (``place``) below their parents: after the parent
    itself, what was taken from it before and the leaves before them.  ``upper`` are the nodes that hold others (``inner``: how many)."""
    spark, columns = leaves.sparkSession, leaves.columns
    own = upper.select(F.col("node").alias("parent"), F.col("size").alias("from"))
    dealt = leaves.filter("parent is not null")
    hot = settled(inner.filter(F.col("children") > CHILDREN).select(F.col("node").alias("parent")))
    some = not hot.isEmpty()
    before = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    few = dealt.join(hot, "parent", "left_anti") if some else dealt
    hung = [few.withColumn("upto", F.coalesce(F.sum("size").over(before), F.lit(0)))]
    if some:
        hung.append(running(dealt.join(hot, "parent", "left_semi"), ["parent"], ["node"], {"sum": ("size", "sum")}).withColumn("upto", F.col("sum") - F.col("size")))
    placed = [part.join(own, "parent", "left").select(*columns, (F.col("from") + F.col("upto")).alias("place")) for part in hung]
    tables = [bucketed(spark, placed[0], "parent", "placed"), *(settled(part) for part in placed[1:])]
    none = F.col("place").isNull()  # the parent is no node
    alone = leaves.filter("parent is null")
    for table in tables:
        alone = alone.union(table.filter(none).select(*columns))
    return settled(alone), [table.filter(~none) for table in tables]


def _walked(nodes: DataFrame, worth: list[str]) -> DataFrame:
    """Labels of rows (node, parent, size) by a walk, where ``size`` is what a node holds besides the nodes here, itself included.
    The columns ``worth`` are held in the same way, and summed over subtrees."""
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    parents = settled(nodes.join(known, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("parent"), "size", *worth))
    # siblings in order: a hot parent's children are spread over ranges
    children = running(parents.filter("parent is not null").select("node", "parent"), ["parent"], ["node"], {"before": ("node", "lag")})
    children = settled(children)
    first = children.filter("before is null").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    following = children.filter("before is not null").select(F.col("before").alias("node"), F.col("node").alias("sibling"))
    links = parents.join(first, "node", "left").join(following, "node", "left")
    # what a node brings where it is left: places and values to the end of the walk, and how many values aren't null
    brings = {"far": F.col("size")}
    for c in worth:
        brings |= {f"sum_{c}": F.coalesce(c, F.lit(0).cast(nodes.schema[c].dataType)), f"some_{c}": F.col(c).isNotNull().cast("bigint")}
    types = {c: links.select(v.alias(c)).schema[c].dataType for c, v in brings.items()}
    enter = links.select("node", F.lit(False).alias("leaves"), F.coalesce("child", "node").alias("to"), F.col("child").isNull().alias("to_leaves"), *(F.lit(0).cast(types[c]).alias(c) for c in brings))
    leave = links.select("node", F.lit(True), F.coalesce("sibling", "parent"), F.col("sibling").isNull(), *brings.values())
    # and how many more nodes are left than entered
    steps = settled(enter.union(leave).withColumn("net", F.when(F.col("leaves"), 1).otherwise(-1).cast("bigint")))
    types["net"] = steps.schema["net"].dataType
    done = steps.filter("to is null").withColumn("root", F.col("node")).select("node", "leaves", "root", *types)
    going = steps.filter("to is not null")
    rounds = max(1, (2 * parents.count()).bit_length()) + 1
    kind = going.schema["to"].dataType
    for _ in range(rounds):
        if going.isEmpty():
            break
        # a step whose target has reached the end is done with it
        here, more = ["to", "to_leaves"], [F.col(c).alias(f"more_{c}") for c in types]
        at_end = done.select(F.col("node").alias("to"), F.col("leaves").alias("to_leaves"), "root", *more, F.lit(None).cast(kind).alias("next"), F.lit(False).alias("next_leaves"))
        on_way = going.select(F.col("node").alias("to"), F.col("leaves").alias("to_leaves"), F.lit(None).cast(kind).alias("root"), *more, F.col("to").alias("next"), F.col("to_leaves").alias("next_leaves"))
        added = [(F.col(c) + F.col(f"more_{c}")).cast(t).alias(c) for c, t in types.items()]
        met = settled(going.join(at_end.union(on_way), here).select("node", "leaves", F.col("next").alias("to"), F.col("next_leaves").alias("to_leaves"), *added, "root"))
        done = done.union(met.filter("to is null").select("node", "leaves", "root", *types))
        going = met.filter("to is not null").drop("root")
    pick = lambda leaves, c: F.max(F.when(F.col("leaves") == leaves, F.col(c)))
    ends = [pick(at, c).alias(f"{name}_{c}") for c in brings for at, name in ((True, "end"), (False, "high"))]
    found = done.groupBy("node").agg(F.min("root").alias("root"), pick(False, "net").cast("int").alias("depth"), *ends)
    low, high = F.col("end_far") - F.col("size"), F.col("high_far")
    # from a node's beginning to its end, with itself
    within = {c: F.col(f"high_{c}") - F.col(f"end_{c}") + v for c, v in brings.items()}
    totals = [F.when(within[f"some_{c}"] > 0, within[f"sum_{c}"].cast(nodes.schema[c].dataType)).alias(c) for c in worth]
    out = parents.join(found, "node", "left")
    return settled(out.select("node", "parent", "root", low.alias("low"), high.alias("high"), "depth", within["far"].alias("size"), *totals))


def _those(labels: DataFrame, of: DataFrame | Column) -> DataFrame:
    return labels.filter(of) if isinstance(of, Column) else labels.join(of.select("node"), "node", "left_semi")


def ancestors(labels: DataFrame, of: DataFrame | Column, cell: int = 4096) -> DataFrame:
    """(node, ancestor, distance) for each row (node) of ``of``, or label for which it holds: a join of its place with the intervals of its tree."""
    places = _those(labels, of).select("node", "root", F.col("low").alias("at"), F.col("depth").alias("own"))
    spans = labels.filter("size > 1").select(F.col("node").alias("ancestor"), "root", "low", "high", "depth")  # others hold nothing
    found = containing(places, spans, "root", "at", "low", "high", cell)
    return found.filter("node <> ancestor").select("node", "ancestor", (F.col("own") - F.col("depth")).alias("distance"))


def descendants(labels: DataFrame, of: DataFrame | Column, cell: int = 4096) -> DataFrame:
    """(ancestor, node, distance) for each row (node) of ``of``, or label for which it holds: everything below it."""
    tops = _those(labels.filter("size > 1"), of).select(F.col("node").alias("ancestor"), "root", "low", "high", F.col("depth").alias("own"))
    places = labels.filter("depth > 0").select("node", "root", F.col("low").alias("at"), "depth")
    found = containing(places, tops, "root", "at", "low", "high", cell)
    return found.filter("node <> ancestor").select("ancestor", "node", (F.col("depth") - F.col("own")).alias("distance"))


def subtree_sums(labels: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(node, total): ``value`` of ``values`` (node, value; distinct nodes) summed over each node's whole subtree.

    One running sum over the places of a tree: a subtree's total is what it grows by from the node to the end of its
    interval.  Only nodes that hold others are met twice; no pair of nodes is made.
    """
    own = labels.filter("root is not null").join(values.select("node", F.col(value).alias("v")), "node", "left")
    own = settled(own.select("node", "root", "low", "high", "size", F.coalesce("v", F.lit(0)).alias("v")))
    holds = F.col("size") > 1
    # the end of an interval comes before the node that has its place
    walk = own.select(F.when(holds, F.col("node")).alias("node"), "root", F.col("low").alias("at"), F.lit(1).alias("step"), "v", F.col("v").alias("own"))
    walk = walk.union(own.filter(holds).select("node", "root", F.col("high"), F.lit(0), F.lit(0), F.lit(0)))
    summed = running(walk, ["root"], ["at", "step"], {"upto": ("v", "sum")}).filter("node is not null")
    inner = summed.groupBy("node").agg((F.max_by("upto", "at") - F.min_by("upto", "at") + F.sum("own")).alias("total"))
    return own.filter(~holds).select("node", F.col("v").cast(inner.schema["total"].dataType).alias("total")).union(inner)
