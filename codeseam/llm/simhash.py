"""SimHash near-duplicates: 64-bit fingerprints linked by generalised pigeonhole search.

Fingerprints are grouped to distinct values first.  The 64 bits are dealt into partitions of correlated bits; each
partition i gets its own threshold t_i with sum(t_i) = radius - m + 1, so any two fingerprints within ``radius`` agree
within t_i on some partition i (t_i = -1: the partition is not probed).  The thresholds come from dynamic programming
on estimated candidate counts, m from the cheapest plan.  Only the plan's cost depends on the estimate (a bounded
sample); the links found are the same for every plan.

Rows of a bucket are verified together.  Within a bucket members gather round pivots, and two gatherings already
connected are not compared again, so a bucket emits at most one link for each member and gathering pair instead of all
pairs, and no connection is lost.  Buckets above ``block`` members are cut into blocks and every pair of blocks is a
task group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.llm.common import fresh, hashed_sample, record_batch, release, slices, text_bytes, written
from codeseam.llm.components import components

BITS = 64
RADIUS = 3
WIDTH = 3
SEED = 42
SAMPLE = 3000
BLOCK = 8192
#: A fingerprint with more than this part of all rows is joined by broadcast.
HOT = 1000
#: Estimated cost of a shuffled probe row against that of one verified candidate pair.
PROBE_COST, PAIR_COST = 1.0, 0.1


def fingerprint(data: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Unsigned fingerprint of lower-cased words; no words: zero; fewer than ``width``: the whole sequence."""
    words = data.lower().split()
    n = len(words)
    if n == 0:
        return 0
    digest = xxhash.xxh64_intdigest
    text = b" ".join(words)
    if n < width:
        hashes = [digest(text, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        start = end - size
        hashes = [digest(text[a:b], seed) for a, b in zip(start[: n - width + 1].tolist(), end[width - 1 :].tolist())]
    votes = np.zeros(BITS, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8)
    for at in range(0, len(raw), 1 << 19):  # bounded memory for very long texts
        votes += np.unpackbits(raw[at : at + (1 << 19)], bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, fp bigint) per row; the unsigned fingerprint kept as a signed 64-bit value."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            found = np.array([fingerprint(x, width, seed) for x in text_bytes(batch.column(1))], np.uint64)
            yield record_batch(schema, batch.column(0), found.view(np.int64))

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, "id bigint, fp bigint"
    )


# ---------------------------------------------------------------- planning


@dataclass(frozen=True)
class Plan:
    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def correlated_groups(corr: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into ``m`` near-equal groups, each grown round its most correlated bits."""
    strength = np.abs(np.nan_to_num(corr)).copy()
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        left = sorted(free)
        seed = max(left, key=lambda b: (strength[b, left].max() if len(left) > 1 else 0, -b))
        group = [seed]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (strength[b, group].sum(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def take_bits(values: np.ndarray, group: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for k, bit in enumerate(group):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def allocate(cost: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds (-1..radius per row of ``cost``, whose column e+1 is the cost of e) of the given sum, at least cost."""
    m, kinds = cost.shape
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, picked) in best.items():
            for e in range(-1, kinds - 1):
                new = (c + float(cost[i, e + 1]), [*picked, e])
                if used + e not in step or new < step[used + e]:
                    step[used + e] = new
        best = step
    return best[total]


def make_plan(sample: np.ndarray, corr: np.ndarray, count: int, radius: int = RADIUS) -> Plan:
    """The cheapest number of partitions with thresholds allocated by dynamic programming."""
    from math import comb

    best: tuple[float, Plan] | None = None
    n = max(2, len(sample))
    for m in range(2, radius + 3):
        groups = correlated_groups(corr, m)
        cost = np.zeros((m, radius + 2))
        for i, group in enumerate(groups):
            part = take_bits(sample, tuple(group))
            seen = np.zeros(radius + 1)
            for at in range(0, len(part), 256):
                apart = np.bitwise_count(part[at : at + 256, None] ^ part[None, :])
                for e in range(radius + 1):
                    seen[e] += (apart <= e).sum()
            for e in range(radius + 1):
                # Pairs expected over the corpus: the sample's share (itself taken out), or that of even bits if none was seen.
                share = max((seen[e] - len(part)) / (n * (n - 1)), sum(comb(len(group), k) for k in range(e + 1)) / 2.0 ** len(group))
                probes = sum(comb(len(group), k) for k in range(e + 1))
                cost[i, e + 1] = PROBE_COST * count * (probes + (e > 0)) + PAIR_COST * count * float(count) / 2 * share
        total, picked = allocate(cost, radius - m + 1)
        if best is None or total < best[0]:
            best = (total, Plan(tuple(map(tuple, groups)), tuple(picked)))
    assert best is not None
    return best[1]


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints and the 64 x 64 correlation of their bits, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fp.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            n += len(fp)
            both += bits.T @ bits
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(BITS * BITS), pa.int32()), pa.array(both.ravel()), pa.array([n] * BITS * BITS, pa.int64())],
                names=["cell", "both", "n"],
            )

    rows = classes.select("fp").mapInArrow(run, "cell int, both double, n bigint").groupBy("cell").agg(
        F.sum("both").alias("both"), F.sum("n").alias("n")
    ).collect()  # 4,096 rows at any size
    if not rows:
        return 0, np.zeros((BITS, BITS))
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["cell"]] = r["both"]
    n = rows[0]["n"]
    p = both.reshape(BITS, BITS) / n
    mean = np.diag(p)
    dev = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return n, (p - np.outer(mean, mean)) / np.outer(dev, dev)


# ---------------------------------------------------------------- probing and verifying


def _flips(width: int, upto: int) -> np.ndarray:
    """All masks of 1..upto set bits out of ``width``."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for e in range(1, upto + 1) for c in combinations(range(width), e)], np.uint64)


def probes(classes: DataFrame, plan: Plan) -> DataFrame:
    """(part, key, fp, own): the value of each probed partition, and for thresholds above zero the values near it."""
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("fp", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(whole), 2048):
                fp = whole[at : at + 2048]
                for i, (group, t) in enumerate(zip(plan.groups, plan.thresholds)):
                    if t < 0:
                        continue
                    part = take_bits(fp.view(np.uint64), group)
                    yield record_batch(schema, np.full(len(fp), i, np.int32), part.view(np.int64), fp, np.ones(len(fp), bool))
                    if t:
                        masks = _flips(len(group), t)
                        near = (part[:, None] ^ masks[None, :]).ravel()
                        yield record_batch(schema, np.full(len(near), i, np.int32), near.view(np.int64), np.repeat(fp, len(masks)), np.zeros(len(near), bool))

    return classes.select("fp").mapInArrow(run, "part int, key bigint, fp bigint, own boolean")


def bucket_links(fp: np.ndarray, own: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect the members of one bucket as all its pairs within ``radius`` would.

    At least one end of a link has ``own`` set (two probes are never compared).
    """
    n, links = len(fp), []
    if n < 2 or not own.any():
        return links
    first = np.unique(fp, return_index=True)[1]
    if len(first) < n:  # the same fingerprint as own row and as probe
        mine = set(fp[own].tolist())
        fp = fp[first]
        own = np.array([x in mine for x in fp.tolist()])
        n = len(fp)
    if n <= 64:
        near = np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, 1) & (own[:, None] | own[None, :])
        return [(int(fp[i]), int(fp[j])) for i, j in zip(*np.nonzero(near))] if near.sum() <= n else _forest(fp, near)
    group = np.full(n, -1)  # gathering of each member
    members: list[np.ndarray] = []
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    while True:  # gather round pivots taken from own rows: all of a gathering is linked to its pivot
        left = np.nonzero((group < 0) & own)[0]
        if not len(left):
            break
        pivot = left[0]
        open_ = np.nonzero(group < 0)[0]
        near = open_[np.bitwise_count(fp[open_] ^ fp[pivot]) <= radius]
        group[near] = len(members)
        links += [(int(fp[pivot]), int(fp[x])) for x in near if x != pivot]
        members.append(np.concatenate([[pivot], near[near != pivot]]))
        parent.append(len(parent))
    for x in np.nonzero(group < 0)[0]:  # probes far from every pivot
        members.append(np.array([x]))
        parent.append(len(parent))
    pivots = np.array([fp[m[0]] for m in members])
    reach = np.array([radius if len(m) > 1 else 0 for m in members])
    for i in range(len(members)):
        apart = np.bitwise_count(pivots[i + 1 :] ^ pivots[i])
        for j in (np.nonzero(apart <= radius + reach[i] + reach[i + 1 :])[0] + i + 1).tolist():
            if find(i) == find(j):
                continue
            a, b = members[i], members[j]
            if (hit := _any_link(fp, own, a, b, radius)) is not None:
                links.append((int(fp[hit[0]]), int(fp[hit[1]])))
                parent[find(i)] = find(j)
    return links


def _any_link(fp, own, a, b, radius):
    for at in range(0, len(a), 512):
        block = a[at : at + 512]
        near = (np.bitwise_count(fp[block][:, None] ^ fp[b][None, :]) <= radius) & (own[block][:, None] | own[b][None, :])
        if near.any():
            i, j = np.argwhere(near)[0]
            return block[i], b[j]
    return None


def _forest(fp: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    parent, out = list(range(len(fp))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(near)):
        if (a := find(int(i))) != (b := find(int(j))):
            parent[a] = b
            out.append((int(fp[i]), int(fp[j])))
    return out


def links(spark: SparkSession, classes: DataFrame, radius: int = RADIUS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(a, b) links whose components are those of all pairs of distinct fingerprints within ``radius``."""
    count, corr = bit_statistics(classes)
    if count < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    few = hashed_sample(classes.select("fp"), "fp", sample).collect()  # the plan's sample, bounded
    plan = make_plan(np.array([r["fp"] for r in few], np.int64).view(np.uint64), corr, count, radius)
    rows = probes(classes, plan)
    hot = rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    hot = hot.select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("cuts"))
    rows = rows.join(hot, ["part", "key"], "left") if not hot.isEmpty() else rows.withColumn("cuts", F.lit(None).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.least(k, mine) * F.col("cuts") + F.greatest(k, mine)
    )
    rows = rows.withColumn("cell", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(pairs)))
    dealt = rows.select("part", "key", "cell", "fp", "own").repartition("part", "key", "cell").sortWithinPartitions("part", "key", "cell")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if len(cols[0]) == 0:
                continue
            cut = np.nonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))[0] + 1
            if not len(cut):
                held = cols
                continue
            held = [c[cut[-1] :] for c in cols]
            yield from _verify(schema, cols[3][: cut[-1]], cols[4][: cut[-1]], cut[:-1], radius)
        if held is not None and len(held[0]):
            yield from _verify(schema, held[3], held[4], np.array([], np.int64), radius)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _verify(schema: pa.Schema, fp: np.ndarray, own: np.ndarray, cut: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    edge = np.concatenate([[0], cut, [len(fp)]])
    size = np.diff(edge)
    fp, own = fp.astype(np.int64).view(np.uint64), own.astype(bool)
    out: list[tuple[int, int]] = []
    pairs = edge[:-1][size == 2]
    near = (np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= radius) & (own[pairs] | own[pairs + 1]) & (fp[pairs] != fp[pairs + 1])
    out += zip(fp[pairs[near]].tolist(), fp[pairs[near] + 1].tolist())
    for k in np.nonzero(size > 2)[0].tolist():
        out += bucket_links(fp[edge[k] : edge[k + 1]], own[edge[k] : edge[k + 1]], radius)
    if out:
        both = np.array(out, np.uint64).view(np.int64)
        yield record_batch(schema, both[:, 0], both[:, 1])


def near_classes(spark: SparkSession, prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, root, component_id): for every distinct fingerprint its component and the smallest id that its links reach.

    ``prints`` has id, fp.  Null ids take part by their fingerprint but never name a component, unless no other id does.
    """
    classes = written(spark, prints.groupBy("fp").agg(F.min("id").alias("id")), "simhash-classes")
    roots = components(spark, links(spark, classes, radius, block))
    within = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root")
    )
    least = within.groupBy("root").agg(F.min("id").alias("component_id"))
    return within.join(least, "root").select("fp", "root", "component_id")


def placed(spark: SparkSession, prints: DataFrame, found: DataFrame, hot: int = HOT) -> DataFrame:
    """``prints`` joined with ``found`` by fp.

    A fingerprint of many rows (empty texts, copies) would be one task's work: the at most 1 / ``hot`` fingerprints that
    each hold more than that share of all rows are broadcast, and the others shuffled.
    """
    total = prints.count()
    many = prints.groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") * hot > total).select("fp")
    many = [r["fp"] for r in many.collect()]  # fewer than `hot`
    heavy = F.col("fp").isin(many) if many else F.lit(False)
    rest = prints.filter(~heavy).join(found, "fp")
    return prints.filter(heavy).join(F.broadcast(found.filter(heavy)), "fp").unionByName(rest) if many else rest


def near_duplicates(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``df``.

    Null and empty texts share fingerprint zero and link like any other.  Repeated rows give repeated rows.  Other
    columns, whatever their names, are not read.  An empty table gives an empty result.
    """
    prints = written(spark, fingerprints(df, id_col, text_col), "simhash-prints")
    found = written(spark, near_classes(spark, prints, radius, block), "simhash-components")
    return placed(spark, prints, found).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``df``, all columns, for each near-duplicate component: that of the smallest id (null ids last).

    Columns of any name stay as they are.  Null and empty texts are one component; of rows that repeat an id one stays.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    names, fp, uid = df.columns, fresh(df, "fp"), fresh(df, "uid")
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            found = np.array([fingerprint(x) for x in text_bytes(batch.column(where))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*names, fp])

    schema = StructType([*df.schema.fields, StructField(fp, LongType())])
    marked = written(spark, df.mapInArrow(run, schema).withColumn(uid, F.monotonically_increasing_id()), "simhash-docs")
    rows = marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(uid).alias("uid"))
    found = written(spark, near_classes(spark, rows.select("id", "fp"), radius).select("fp", "root"), "simhash-components")
    first = placed(spark, rows, found).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("best"))
    return marked.join(first.select(F.col("best.uid").alias(uid)), uid, "left_semi").select(*names)
