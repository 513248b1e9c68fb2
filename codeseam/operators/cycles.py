"""The shortest cycle through the least node of each strongly connected component, as rows.

One breadth-first search runs in all components at once, each from its own least node and over its own edges; a component
leaves the search in the round in which a node with an edge back to the start is found.  Every node keeps its parent, and
the path is rebuilt by pointer jumping: each round doubles how many steps a pointer spans and how many nodes of the path
are known, so a cycle of n nodes takes about log n rounds, and no path is ever held in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeseam.operators.shared import settled


def shortest_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, length, position, node): for each component of ``strong_components`` a shortest cycle through its own node,
    which comes at position 0.

    Ties, looking back from the end: the least last node, and before each node the least that reaches it one step sooner.
    Edges between components, loops, repeats and nulls don't matter; no components give no rows.
    """
    once = edges.select("src", "dst").filter("src <> dst").distinct()
    ends = components.select(F.col("node").alias("src"), "component").join(once, "src")
    inner = ends.join(components.select(F.col("node").alias("dst"), F.col("component").alias("into")), "dst").filter("component = into")
    inner = settled(inner.select("component", "src", "dst"))
    back = settled(inner.filter("dst = component").select(F.col("src").alias("node")))
    onward = inner.filter("dst <> component")
    start = components.filter("node = component").select("node", "component", F.lit(0).alias("depth"), F.col("node").alias("parent"))
    seen = frontier = settled(start)
    ended, depth = None, 0
    while True:
        closing = frontier.filter("depth > 0").join(back, "node", "left_semi").groupBy("component").agg(F.min("node").alias("node"), F.min("depth").alias("depth"))
        closing = settled(closing)
        ended = closing if ended is None else ended.union(closing)
        going = frontier.join(closing.select("component"), "component", "left_anti")
        depth += 1
        new = going.select(F.col("node").alias("src"), "component").join(onward, ["component", "src"]).groupBy(F.col("dst").alias("node"), "component")
        new = new.agg(F.min("src").alias("parent")).join(seen.select("node"), "node", "left_anti")
        frontier = settled(new.select("node", "component", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if depth % 8 == 0:
            seen = settled(seen)
    return _paths(seen, settled(ended))


def _paths(seen: DataFrame, last: DataFrame) -> DataFrame:
    """(component, length, position, node) of the paths that end in ``last``, by parents."""
    length = last.select("component", (F.col("depth") + 1).alias("length"))
    known = last.select("component", "node")
    # only components with a path, and only nodes that a jump may start from
    jumps = settled(seen.filter("depth > 0").join(last.select("component"), "component", "left_semi").select("node", F.col("parent").alias("to")))
    while not jumps.isEmpty():
        step = known.join(jumps, "node").select("component", F.col("to").alias("node"))
        known = settled(known.union(step))
        jumps = settled(jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to")))
    placed = known.join(seen.select("node", "depth"), "node").join(length, "component")
    return placed.select("component", "length", F.col("depth").alias("position"), "node")


def listed(rows: DataFrame, group: str, value: str, order: str, most: int, name: str, separator: str = ",") -> DataFrame:
    """(group, name): the group's values in order as one text, for groups of at most ``most`` rows; others aren't gathered."""
    few = rows.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") <= most).select(group)
    inner = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return rows.join(few, group, "left_semi").groupBy(group).agg(F.array_join(F.transform(inner, lambda x: x["v"]), separator).alias(name))
