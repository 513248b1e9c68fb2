"""Reachability, strongly connected components and bounded impact on any edge table.

Edges have two columns of one type, ``src`` and ``dst``.  Each loop joins only the newest frontier with the edges, drops
what was seen by an anti-join, and is settled in the shared checkpoint folder; which side is broadcast is left to the
optimizer, which knows the sizes.  Only a row's existence reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeseam.operators.shared import bucketed, discard, settled

#: Trimming goes on while a round takes off more than this part of the edges; what it leaves is no cycle and falls to the colours.
TRIM = 16


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, steps: DataFrame | None = None) -> DataFrame:
    """(node, depth) of everything reachable from ``roots`` (one column ``node``), roots included at depth 0.

    The depth is the least number of edges.  Cycles end because a node joins the frontier once.  Edges are written once in
    buckets by source: a round exchanges its frontier alone, or broadcasts it while it is small.  In rounds 4, 8, 16 and so on
    edges into what was seen are left out, so a later round reads only what is still unseen and is held only against what
    came since, as is the next leaving out.  ``steps`` are the distinct edges in such buckets, where the caller has them
    already; they stay.
    """
    given = steps
    if steps is None:
        steps = bucketed(edges.sparkSession, edges.select("src", "dst").filter("src <> dst").distinct(), "src", "edges")
    seen = settled(roots.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))
    frontier, recent, depth = seen, seen.select("node"), 0
    last = recent.limit(0)  # the frontier when edges were left out last: only from there do edges still start in what was seen then
    while max_depth is None or depth < max_depth:
        depth += 1
        new = onward(frontier, steps)
        frontier = settled(new.join(recent, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen, recent = seen.union(frontier), recent.union(frontier.select("node"))
        if depth >= 4 and depth & (depth - 1) == 0:
            seen = settled(seen)
            old, steps = steps, _unseen(steps, recent.union(last), frontier)
            if old is not given:
                discard(old)
            last = frontier.select("node")
            recent = last.limit(0)
    return seen


def _unseen(steps: DataFrame, came: DataFrame, frontier: DataFrame) -> DataFrame:
    """The edges that may still lead on, in buckets: from the frontier or no seen node, and into no seen node.

    ``came`` are the seen nodes that edges still start or end in.  Sources come first: ``steps`` lie in buckets by them, so
    only the edges that are left are exchanged by their targets.
    """
    past = came.select(F.col("node").alias("src")).join(frontier.select(F.col("node").alias("src")), "src", "left_anti")
    left = steps.join(past, "src", "left_anti").join(came.select(F.col("node").alias("dst")), "dst", "left_anti")
    return bucketed(steps.sparkSession, left.select("src", "dst"), "src", "edges")


def onward(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """(node): where one step leads from ``frontier``."""
    return frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()


def reaches(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of everything from which some target is reachable, targets included."""
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets, max_depth)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle; the component's name is its least node.

    Nodes are numbered in their order, so rounds move numbers and not names.  Colouring: nodes that no cycle can hold are
    trimmed for as long as that takes off a part of the edges; the least label that reaches a node is its colour (found in
    rounds that double how far labels come, and in which only what changed is passed on); within a colour, what reaches the
    colour's own node is one component.  Found components and edges between colours leave the graph and the rest goes on.
    Rows stay within nodes plus edges, unlike a closure of pairs.
    """
    named = settled(edges.select("src", "dst").filter("src <> dst").distinct())
    names = named.select(F.col("src").alias("name")).union(named.select("dst")).distinct()
    names = _numbered(names)  # in order: the least number is the least name
    left = named.join(names.select(F.col("name").alias("src"), F.col("node").alias("a")), "src").select("a", "dst")
    left = settled(left.join(names.select(F.col("name").alias("dst"), F.col("node").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    discard(named)
    found, size = None, left.count()
    while size:
        while True:  # trim what has no way in or no way out
            kept = left.join(left.select(F.col("dst").alias("src")), "src", "left_semi")
            kept = settled(kept.join(left.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
            discard(left)
            left, before, size = kept, size, kept.count()
            if (before - size) * TRIM <= before:
                break
        if not size:
            break
        colour = _coloured(left)
        within = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src")
        within = settled(within.join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").filter("a = b").select("src", "dst"))
        discard(left)
        ring = reaches(within, colour.filter("node = colour").select("node")).select("node")
        part = settled(colour.join(ring, "node", "left_semi").select("node", F.col("colour").alias("component")))
        found = part if found is None else found.union(part)
        left = within.join(part.select(F.col("node").alias("src")), "src", "left_anti")
        left = settled(left.join(part.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        discard(within, colour)
        size = left.count()
    if found is None:
        kind = edges.schema["src"].dataType
        return edges.limit(0).select(F.col("src").cast(kind).alias("node"), F.col("src").cast(kind).alias("component"))
    # a component of one node is no cycle
    more = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    more = more.join(names.select(F.col("node").alias("component"), F.col("name").alias("label")), "component")
    found = found.join(more, "component").join(names, "node")
    return settled(found.select(F.col("name").alias("node"), F.col("label").alias("component")))


def _numbered(names: DataFrame) -> DataFrame:
    """(name, node): numbers that rise with the names, from ranges of them."""
    ranged = names.repartitionByRange("name").sortWithinPartitions("name")
    return settled(ranged.withColumn("node", F.monotonically_increasing_id()))


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node from which each is reached, itself included."""
    steps = bucketed(edges.sparkSession, edges, "src", "colours")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colour = settled(nodes.withColumn("colour", F.col("node")).withColumn("moved", F.lit(True)))
    while True:  # what reaches a node's colour reaches the node: colours jump along colours, not only along edges
        moved = colour.filter("moved").select(F.col("node").alias("src"), "colour")
        passed = moved.join(steps, "src").select(F.col("dst").alias("node"), "colour")
        jumped = colour.filter("node <> colour").select("node", F.col("colour").alias("via"))
        jumped = jumped.join(colour.filter("node <> colour").select(F.col("node").alias("via"), "colour"), "via").select("node", "colour")
        own = colour.select("node", "colour", F.col("colour").alias("was"))
        gone = F.lit(None).cast(colour.schema["colour"].dataType)
        least = own.union(passed.union(jumped).select("node", "colour", gone)).groupBy("node").agg(F.min("colour").alias("colour"), F.min("was").alias("was"))
        new = settled(least.select("node", "colour", (F.col("colour") < F.col("was")).alias("moved")))
        discard(colour)
        colour = new
        if new.filter("moved").isEmpty():
            discard(steps)
            return colour


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) over distinct edges."""
    once = edges.select("src", "dst").distinct()
    ends = once.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(
        once.select("dst", F.lit(1), F.lit(0))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): how often each edge occurs."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def program_edges(edges: DataFrame, overrides: DataFrame, nodes: DataFrame) -> DataFrame:
    """Plain edges whose reachability is that of the program graph.

    ``edges`` from_key, to_key, kind; ``overrides`` key, overridden_key; ``nodes`` key, kind, owner_key.  Creating
    through a constructor also reaches the type; a method reaches what overrides it.
    """
    target = nodes.select(F.col("key").alias("to_key"), F.col("kind").alias("to_kind"), F.col("owner_key").alias("to_owner"))
    known = edges.join(target, "to_key")
    plain = known.select(F.col("from_key").alias("src"), F.col("to_key").alias("dst"))
    owner = known.filter("kind = 'CREATES' and to_kind = 'METHOD'").select(F.col("from_key").alias("src"), F.col("to_owner").alias("dst"))
    down = overrides.select(F.col("overridden_key").alias("src"), F.col("key").alias("dst"))
    return plain.union(owner).union(down).filter("dst is not null").distinct()


def program_reachable(edges: DataFrame, overrides: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reachable from root keys (column ``node``); a root method's owner counts as a root too."""
    at = roots.join(nodes.select(F.col("key").alias("node"), "kind", "owner_key"), "node")
    start = at.select("node").union(at.filter("kind = 'METHOD' and owner_key is not null").select("owner_key")).distinct()
    return reachable(program_edges(edges, overrides, nodes), start)


def unreachable(edges: DataFrame, overrides: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``nodes`` rows not reached; a type counts as reached when some member of it is."""
    reach = settled(program_reachable(edges, overrides, nodes, roots).select(F.col("node").alias("key")))
    owners = nodes.join(reach, "key", "left_semi").filter("owner_key is not null").select(F.col("owner_key").alias("key"), F.lit("TYPE").alias("kind"))
    return nodes.join(reach, "key", "left_anti").join(owners.distinct(), ["key", "kind"], "left_anti")


def callers(edges: DataFrame, overrides: DataFrame, targets: DataFrame) -> DataFrame:
    """(key): what reaches any of ``targets`` (column ``key``) by a call, climbing to what it overrides.

    A state is a key with or without a call behind it: reversed edges set the mark, climbing clears it.  A key counts
    when some state of it is marked, whatever the order of the walk; one walk serves all targets.
    """
    back = edges.select(F.col("to_key").alias("key"), F.col("from_key").alias("to"), F.lit(1).alias("via"))
    up = overrides.select("key", F.col("overridden_key").alias("to"), F.lit(0).alias("via"))
    moves = settled(back.union(up).distinct())
    start = targets.select("key").distinct()
    seen = frontier = settled(
        moves.join(start, "key", "left_semi").select(F.col("to").alias("key"), "via").union(start.select("key", F.lit(0).alias("via"))).distinct()
    )
    while not frontier.isEmpty():
        new = frontier.select("key").distinct().join(moves, "key").select(F.col("to").alias("key"), "via").distinct()
        frontier = settled(new.join(seen, ["key", "via"], "left_anti"))
        seen = settled(seen.union(frontier))
    return seen.filter("via = 1").select("key").distinct()


def transitive_callers(edges: DataFrame, overrides: DataFrame, nodes: DataFrame, target: str) -> DataFrame:
    """(key): methods that reach ``target`` by a call, without itself."""
    start = edges.sparkSession.range(1).select(F.lit(target).alias("key"))
    found = callers(edges, overrides, start).filter(F.col("key") != target)
    return found.join(nodes.filter("kind = 'METHOD'").select("key"), "key", "left_semi")


def type_callers(edges: DataFrame, overrides: DataFrame, nodes: DataFrame, type_key: str) -> DataFrame:
    """(key): methods that reach a type or any of its members, without the type's own members."""
    own = nodes.filter(F.col("owner_key") == type_key).select("key")
    start = nodes.filter(F.col("key") == type_key).select("key").union(own)
    found = callers(edges, overrides, start).join(own, "key", "left_anti")
    return found.join(nodes.filter("kind = 'METHOD'").select("key"), "key", "left_semi")
