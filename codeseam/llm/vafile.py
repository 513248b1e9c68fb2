"""Hard negatives by a vector-approximation file: rows that score below an anchor's positive, but not far below.

Vectors of whole numbers lie in blocks.  A block cuts each dimension into cells at its own quantiles and keeps a byte for
each component and every cell's least and largest value; nothing is fitted to a sample.  For an anchor, two tables of
dimension times cell hold the least and the largest product, so a row's score lies between two sums of lookups.  Bounds are
whole numbers and hold for every row, so the search is exact: only rows whose bounds reach a bar, or may enter a window,
are scored on their components.

The index is scanned where it lies, twice for each batch of anchors (a bounded number of them travels): once for the
positives, among rows of the anchor's label, and once for the windows that the positives open, among the others.  Bounds
prune nearly all rows but leave some of every block, so components lie beside the codes.  A task hands on its best few
for each anchor and window; work is anchors x rows, memory and shuffle are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codeseam.llm.common import record_batch, release, shared_path, written

BLOCK, CELLS, CHUNK = 4096, 64, 128
#: Anchors travel in batches of at most so many and so many bytes.
BATCH, BATCH_BYTES = 8192, 16 << 20
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these shares of its positive's, in hundredths.
WINDOW = (50, 95, 100)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): rows with an id, a label and finite components, those as floor(scale * x)."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)
    rows = rows.withColumn("v", F.transform(v, lambda x: F.floor(x * float(scale)).cast("bigint")))
    return rows if label is None else rows.withColumn("label", label.cast("bigint"))


# ---- the approximation of a block


def approximate(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x dims) and each cell's least and largest component (dims x cells)."""
    n, dim = x.shape
    ordered = np.sort(x, axis=0)
    cuts = ordered[np.arange(1, cells) * n // cells]
    codes = np.empty((n, dim), np.uint8)
    low, high = np.zeros((dim, cells), np.int64), np.zeros((dim, cells), np.int64)
    for d in range(dim):
        codes[:, d] = np.searchsorted(cuts[:, d], x[:, d], side="right")
        ends = np.concatenate([[0], np.searchsorted(ordered[:, d], cuts[:, d], side="left"), [n]])
        full = ends[1:] > ends[:-1]  # ties leave some cells without rows
        low[d, full], high[d, full] = ordered[ends[:-1][full], d], ordered[ends[1:][full] - 1, d]
    return codes, low, high


def tables(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product, dims x cells x anchors; 32 bits wide where every sum of them fits."""
    most = int(np.abs(anchors).max(initial=0)) * max(int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0))) * max(1, len(low))
    if most >= 1 << 62:
        raise OverflowError("scores of these vectors don't fit into 64 bits")
    kind = np.int32 if most < 1 << 31 else np.int64
    a = anchors.T[:, None, :].astype(kind)
    one, two = low[:, :, None].astype(kind) * a, high[:, :, None].astype(kind) * a
    return np.minimum(one, two), np.maximum(one, two)


def sums(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Bounds (anchors x rows): each row's looked-up products, summed over the dimensions."""
    out = np.take(table[0], codes[:, 0], 0)
    for d in range(1, len(table)):
        out += np.take(table[d], codes[:, d], 0)
    return np.ascontiguousarray(out.T)


def exact(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Scores of rows with one anchor, exactly."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(anchor).max(initial=0)) * max(1, x.shape[1])
    if most < 1 << 53:
        return (x.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ anchor


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k: higher scores first, ties by smaller id."""
    return np.lexsort((ids, -score))[:k]


class Block:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.x, self.codes, self.low, self.high = ids, labels, x, codes, low, high
        self.shift = np.arange(codes.shape[1]) * low.shape[1]

    @classmethod
    def made(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, cells: int = CELLS) -> "Block":
        order = np.lexsort((ids, labels))
        x = x[order]
        return cls(ids[order], labels[order], x, *approximate(x, cells))

    def slice_of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())

    def packed(self) -> list[bytes]:
        fit = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.abs(self.x).max(initial=0) <= np.iinfo(k).max)
        return [a.tobytes() for a in (self.ids, self.labels, self.x.astype(fit), self.codes, self.low, self.high)]

    @classmethod
    def unpacked(cls, parts: list[bytes], dim: int) -> "Block":
        ids, labels = (np.frombuffer(p, np.int64) for p in parts[:2])
        wide = len(parts[2]) // max(1, len(ids) * dim)
        x = np.frombuffer(parts[2], np.dtype(f"i{wide}")).reshape(len(ids), dim)
        low, high = (np.frombuffer(p, np.int64).reshape(dim, -1) for p in parts[4:])
        return cls(ids, labels, x, np.frombuffer(parts[3], np.uint8).reshape(len(ids), dim), low, high)


# ---- the two scans


class Positives:
    """Each anchor's best rows of its own label over the blocks of one task."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.labels, self.x, self.k = ids, labels, x, k
        self.score = [np.empty(0, np.int64)] * len(ids)
        self.found = [np.empty(0, np.int64)] * len(ids)

    def block(self, b: Block) -> None:
        for label in np.unique(self.labels):
            rows = b.slice_of(int(label))
            if rows.start == rows.stop:
                continue
            own = np.nonzero(self.labels == label)[0]
            for at in range(0, len(own), CHUNK):
                chunk = own[at : at + CHUNK]
                low, high = tables(self.x[chunk], b.low, b.high)
                low, high = sums(low, b.codes[rows]), sums(high, b.codes[rows])
                for r, q in enumerate(chunk.tolist()):
                    self._anchor(q, b, rows, low[r], high[r])

    def _anchor(self, q: int, b: Block, rows: slice, low: np.ndarray, high: np.ndarray) -> None:
        other = np.nonzero(b.ids[rows] != self.ids[q])[0]
        if not len(other) or not self.k:
            return
        bar = self.score[q][self.k - 1] if len(self.score[q]) >= self.k else None
        if len(other) > self.k:
            sure = np.partition(low[other], len(other) - self.k)[len(other) - self.k]
            bar = sure if bar is None else max(bar, sure)
        pick = (other if bar is None else other[high[other] >= bar]) + rows.start
        score = np.concatenate([self.score[q], exact(b.x[pick], self.x[q])])
        found = np.concatenate([self.found[q], b.ids[pick]])
        top = best(score, found, self.k)
        self.score[q], self.found[q] = score[top], found[top]

    def rows(self) -> tuple:
        n = [len(f) for f in self.found]
        return np.repeat(self.ids, n), np.concatenate(self.found), np.concatenate(self.score)


class Windows:
    """Each window's best rows of other labels over the blocks of one task; windows are (anchor, lowest, highest score)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, spans: list[list[tuple[int, int]]], k: int):
        self.ids, self.labels, self.x, self.spans, self.k = ids, labels, x, spans, k
        none = np.empty(0, np.int64)
        self.held = [[(none, none)] * len(s) for s in spans]

    def block(self, b: Block) -> None:
        asked = [q for q, s in enumerate(self.spans) if any(lo <= hi for lo, hi in s)]
        for at in range(0, len(asked), CHUNK):
            chunk = asked[at : at + CHUNK]
            low, high = tables(self.x[chunk], b.low, b.high)
            upper = sums(high, b.codes)
            low = np.ascontiguousarray(low.transpose(2, 0, 1)).reshape(len(chunk), -1)
            for r, q in enumerate(chunk):
                own = b.slice_of(int(self.labels[q]))
                upper[r, own] = np.iinfo(upper.dtype).min
                self._anchor(q, b, upper[r], low[r])

    def _anchor(self, q: int, b: Block, upper: np.ndarray, table: np.ndarray) -> None:
        bars = [max(lo, int(held[0][-1])) if len(held[0]) >= self.k else lo for (lo, _), held in zip(self.spans[q], self.held[q], strict=True)]
        open_ = [w for w, (lo, hi) in enumerate(self.spans[q]) if lo <= hi]
        some = np.nonzero(upper >= max(min(bars[w] for w in open_), np.iinfo(upper.dtype).min + 1))[0]
        if not len(some) or not self.k:
            return
        upper, lower = upper[some], table[b.codes[some] + b.shift].sum(1)
        may = np.zeros(len(some), bool)
        for w in open_:
            lo, hi = self.spans[q][w]
            sure = lower[(lower >= lo) & (upper <= hi)]
            bar = max(bars[w], int(np.partition(sure, len(sure) - self.k)[len(sure) - self.k])) if len(sure) >= self.k else bars[w]
            may |= (upper >= bar) & (lower <= hi)
        pick = some[may]
        if not len(pick):
            return
        score, ids = exact(b.x[pick], self.x[q]), b.ids[pick]
        for w in open_:
            lo, hi = self.spans[q][w]
            into = (score >= lo) & (score <= hi)
            if into.any():
                s, i = (np.concatenate([old, new[into]]) for old, new in zip(self.held[q][w], (score, ids), strict=True))
                top = best(s, i, self.k)
                self.held[q][w] = s[top], i[top]


def window(score: int, share: tuple[int, int, int] = WINDOW) -> tuple[int, int]:
    """Least and largest whole number n with share[0] * score <= share[2] * n <= share[1] * score; empty where they cross."""
    return -(-share[0] * score // share[2]), share[1] * score // share[2]


def index_blocks(rows: DataFrame, dim: int, block: int, cells: int) -> DataFrame:
    names = ("ids", "labels", "x", "codes", "low", "high")
    schema = pa.schema([(n, pa.binary()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = None

        def made(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids, labels = (t.column(c).to_numpy() for c in (0, 1))
            v = t.column(2)
            x = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy().reshape(-1, dim)
            return record_batch(schema, *([p] for p in Block.made(ids, labels, x, cells).packed()))

        for batch in batches:  # whole blocks, however the rows arrive
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows >= block:
                yield made(held.slice(0, block))
                held = held.slice(block)
        if held is not None and held.num_rows:
            yield made(held)

    return rows.select("vec_id", "label", "v").mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def _scan(blocks: DataFrame, make, hand_on, out: str) -> DataFrame:
    """What ``hand_on`` gives of the scan that ``make`` starts, after all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scan, dim = make()
        for batch in batches:
            for r in range(batch.num_rows):
                scan.block(Block.unpacked([batch.column(c)[r].as_py() for c in range(6)], dim))
        yield from hand_on(scan)

    return blocks.mapInArrow(run, out)


def mine(
    spark: SparkSession, rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int, int] = WINDOW,
    block: int = BLOCK, cells: int = CELLS, batch: int = BATCH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each row whose id is divisible by ``every``.

    ``rows`` holds vec_id, label and v, whole numbers (see ``whole_vectors``).  Rows of another length than most take no
    part.  Rows that repeat an id take part as that many rows; none is a positive of its own id, and of several anchors of
    one id the least label and vector asks.  Zero vectors take part.  Ties go to smaller ids.  A positive below zero opens
    no window.  An empty table gives an empty result.
    """
    answer = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = written(spark, rows.select("vec_id", "label", "v"), "va-vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return spark.createDataFrame([], answer)
    dim = sizes[0]["d"]
    rows = rows.filter(F.size("v") == dim)
    # as many partitions as full blocks, so that blocks don't shrink where rows are dealt over many
    blocks = written(spark, index_blocks(rows.repartition(max(1, -(-sizes[0]["count"] // block))), dim, block, cells), "va-index")
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    anchors = written(spark, anchors, "va-anchors")
    batches = -(-anchors.count() // max(1, min(batch, BATCH_BYTES // (8 * dim))))
    path = shared_path(spark, "va-found")
    for n in range(batches):  # ids are distinct, so their hashes deal them evenly
        some = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == n).orderBy("vec_id").collect()
        if some:
            _batch(spark, blocks, some, dim, positives, negatives, share).write.mode("append").parquet(path)
    if not batches:
        return spark.createDataFrame([], answer)
    return spark.read.schema(answer).parquet(path)


def _batch(spark: SparkSession, blocks: DataFrame, some: list, dim: int, positives: int, negatives: int, share: tuple[int, int, int]) -> DataFrame:
    ids, labels = (np.array([r[c] for r in some], np.int64) for c in ("vec_id", "label"))
    sent = spark.sparkContext.broadcast((ids, labels, np.array([r["v"] for r in some], np.int64)))
    near_schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def near(scan: Positives) -> Iterator[pa.RecordBatch]:
        yield record_batch(near_schema, *scan.rows())

    found = _scan(blocks, lambda: (Positives(*sent.value, positives), dim), near, "anchor_id bigint, positive_id bigint, score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    opened: dict[int, list] = {int(i): [] for i in ids}
    for r in ranked.orderBy("anchor_id", "place").collect():  # a few rows for each anchor of a batch
        opened[r["anchor_id"]].append((r["positive_id"], r["score"]))
    asked = spark.sparkContext.broadcast([opened[int(i)] for i in ids])
    hard_schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")])

    def start() -> tuple[Windows, int]:
        return Windows(*sent.value, [[window(s, share) for _, s in each] for each in asked.value], negatives), dim

    def hard(scan: Windows) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(scan.ids), 4096):
            rows = [
                (int(scan.ids[q]), place, *asked.value[q][place], i, s)
                for q in range(at, min(at + 4096, len(scan.ids))) for place, (score, neg) in enumerate(scan.held[q]) for s, i in zip(score.tolist(), neg.tolist(), strict=True)
            ]
            if rows:
                yield record_batch(hard_schema, *zip(*rows, strict=True))

    found = _scan(blocks, start, hard, ", ".join(f"{n} bigint" for n in hard_schema.names))
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
