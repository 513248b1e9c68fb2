"""Approximate nearest neighbours by additive quantisation, for largest inner product.

A vector's direction is coded as the sum of one full-dimensional word from each of ``BOOKS`` codebooks.  Codebooks start
as residual k-means, then are refitted together by least squares on beam-search codes.  Every vector is encoded by beam
search over the codebooks, and its own norm over that of its code's sum is stored, so an estimate keeps the vector's length.

The index lies in blocks of codes, norms and their vectors, and is scanned where it lies: nothing of it is shuffled.
Queries travel to the executors in batches of a fixed size, one scan of the index for each batch.  A task scores its
blocks with lookup tables of query times codeword, keeps each query's ``SHORT`` best estimates over all its blocks as the
bar for the next, and reranks what passes it on the original vectors, which lie beside the codes, in double precision.
Only ``k`` answers a query and task are handed on.

Exact copies of a vector are coded once: of each only the ``k + 1`` smallest ids can be among anyone's k nearest, so
only those are kept beside it, and nothing that could be an answer is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codeseam.llm.common import hashed_sample, record_batch, shared_path, written

BOOKS, WORDS, BEAM = 16, 256, 4
#: Codebooks are fitted to at most so many vectors (the least hashes of their ids); every vector is indexed.
FIT_ROWS = 12_000
SHORT = 400
BLOCK = 8192
#: A batch of queries is what travels: at most about so many, and so many bytes.
QUERY_BATCH, QUERY_BYTES = 32_768, 16 << 20


@dataclass
class Books:
    words: np.ndarray  # books x words x dim, float32

    def __post_init__(self):
        flat = self.words.reshape(-1, self.words.shape[2])
        self.flat = flat
        self.gram = flat @ flat.T
        self.square = np.einsum("ij,ij->i", flat, flat)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = np.empty(len(x), np.int64)
        for s in range(0, len(x), 4096):
            at[s : s + 4096] = (((centre * centre).sum(1) - 2 * x[s : s + 4096] @ centre.T)).argmin(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centre[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centre


def beam_encode(books: Books, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) whose sums come near the rows, the ``beam`` best partial sums kept at every book."""
    M, K, _ = books.words.shape
    out = np.empty((len(x), M), np.int64)
    for s in range(0, len(x), 256):
        part = x[s : s + 256]
        n = len(part)
        dots = part @ books.flat.T
        codes = np.zeros((n, 1, 0), np.int64)
        cost = np.zeros((n, 1), np.float32)
        for m in range(M):
            own = slice(m * K, (m + 1) * K)
            new = books.square[own][None, None, :] - 2 * dots[:, None, own] + cost[:, :, None]
            for j in range(m):
                new += 2 * books.gram[codes[:, :, j] + j * K, own]
            flat = new.reshape(n, -1)
            b = min(beam, flat.shape[1])
            best = np.argpartition(flat, b - 1, 1)[:, :b] if b < flat.shape[1] else np.tile(np.arange(b), (n, 1))
            rows = np.arange(n)[:, None]
            cost = flat[rows, best]
            codes = np.concatenate([codes[rows, best // K], (best % K)[:, :, None]], 2)
        out[s : s + 256] = codes[np.arange(n), cost.argmin(1)]
    return out


def decode(books: Books, codes: np.ndarray) -> np.ndarray:
    return books.flat[codes + np.arange(codes.shape[1]) * books.words.shape[1]].sum(1)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, refits: int = 2, seed: int = 5) -> Books:
    """Residual k-means, then rounds of beam encoding and a least-squares refit of all codewords together."""
    rng = np.random.default_rng(seed)
    left, made = x.astype(np.float32).copy(), []
    for _ in range(books):
        c = _kmeans(left, words, rng)
        at = ((c * c).sum(1) - 2 * left @ c.T).argmin(1)
        left -= c[at]
        made.append(c)
    out = Books(np.array(made, np.float32))
    err = lambda b: float(((x[:3000] - decode(b, beam_encode(b, x[:3000]))) ** 2).sum())
    for _ in range(refits):
        codes = beam_encode(out, x)
        better = Books(refit(x, out.words, codes))
        if err(better) >= err(out):
            break
        out = better
    return out


def refit(x: np.ndarray, words: np.ndarray, codes: np.ndarray, sweeps: int = 6) -> np.ndarray:
    """All codewords by least squares for fixed codes: each book in turn takes the means of what the others leave.

    Block coordinate descent on the joint problem, so no matrix over all codewords is held.  A small weight on the
    present words keeps unused ones as they are.
    """
    words = words.astype(np.float64)
    left = x - words[np.arange(len(words))[:, None], codes.T].sum(0)
    for _ in range(sweeps):
        for m in range(len(words)):
            at = codes[:, m]
            left += words[m][at]
            sums = 0.5 * words[m]
            np.add.at(sums, at, left)
            words[m] = sums / (np.bincount(at, minlength=len(words[m])) + 0.5)[:, None]
            left -= words[m][at]
    return words.astype(np.float32)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and finite, not all zero components.  Floats stay floats, other numbers are doubles."""
    kind = df.schema[vector_col].dataType
    floats = kind.typeName() == "array" and kind.elementType.typeName() == "float"
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{'float' if floats else 'double'}>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _length(x: np.ndarray) -> np.ndarray:
    """Length of each row in double precision, without overflow."""
    most = np.abs(x).max(1).astype(np.float64)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows of length one as float32: what is coded, and what queries are estimated by."""
    return (x / _length(x)[:, None]).astype(np.float32)


def index_blocks(classes: DataFrame, books: Books, dim: int, block: int = BLOCK) -> DataFrame:
    """(ids, counts, vectors, codes, scale) blocks of at most ``block`` distinct vectors, packed."""
    sent = classes.sparkSession.sparkContext.broadcast(books.words)
    names = ("ids", "counts", "vectors", "codes", "scale")
    schema = pa.schema([(n, pa.binary()) for n in names])

    def pack(books: Books, part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        x = _matrix(part.column(0), dim)
        codes = beam_encode(books, _directions(x))
        made = decode(books, codes)
        stored = np.sqrt(np.einsum("ij,ij->i", made, made))
        scale = np.minimum(_length(x) / np.maximum(stored, 1e-20), 3e38).astype(np.float32)
        members = part.column(1).to_pylist()
        counts = np.array([len(m) for m in members], np.int32)
        ids = np.array([i for m in members for i in m], np.int64)
        return record_batch(schema, *([a.tobytes()] for a in (ids, counts, x, codes.astype(np.uint8), scale)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, held = Books(sent.value), None
        for batch in batches:  # whole blocks, however the rows arrive
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows >= block:
                yield pack(books, held.slice(0, block))
                held = held.slice(block)
        if held is not None and held.num_rows:
            yield pack(books, held)

    return classes.select("v", "ids").mapInArrow(run, ", ".join(f"{n} binary" for n in names))


class Scan:
    """The answers of one batch of queries over the blocks of one task."""

    def __init__(self, qids: np.ndarray, qx: np.ndarray, words: np.ndarray, k: int, short: int):
        self.qids, self.exact, self.words, self.k, self.short = qids, qx.astype(np.float64), words, k, short
        self.single = _directions(qx)  # a query's length changes no order of its own
        #: Each query's best estimates over the blocks seen; the least of them is its bar.
        self.best = np.full((len(qids), short), -np.inf, np.float32)
        self.found: list[tuple] = []

    def block(self, ids: np.ndarray, counts: np.ndarray, x: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> None:
        first = np.concatenate([[0], np.cumsum(counts)])
        for at in range(0, len(self.qids), 128):
            part = np.matmul(self.words, self.single[at : at + 128].T)  # books x words x queries: the lookup tables
            est = np.take(part[0], codes[:, 0], 0)
            for m in range(1, codes.shape[1]):
                est += np.take(part[m], codes[:, m], 0)
            with np.errstate(over="ignore"):  # beyond float32: infinite, and reranked or left out by its sign
                est *= scale[:, None]
            est = np.ascontiguousarray(est.T)
            if est.shape[1] > self.short:
                bars = -np.partition(-est, self.short - 1, 1)[:, self.short - 1]
                bars = np.maximum(bars, self.best[at : at + 128].min(1))
            else:
                bars = self.best[at : at + 128].min(1)
            for r in range(len(est)):
                pick = np.nonzero(est[r] >= bars[r])[0]
                if len(pick):
                    self._rerank(at + r, pick, est[r][pick], ids, first, x)
        if len(self.found) >= max(4096, len(self.qids)):
            self.found = [self.merged()]

    def _rerank(self, q: int, pick: np.ndarray, est: np.ndarray, ids: np.ndarray, first: np.ndarray, x: np.ndarray) -> None:
        both = np.concatenate([self.best[q], est])
        self.best[q] = np.partition(both, len(both) - self.short)[len(both) - self.short :]
        exact = x[pick].astype(np.float64) @ self.exact[q]
        order = np.argsort(-exact, kind="stable")
        if len(order) > self.k + 1:  # ties with the last one stay
            order = order[exact[order] >= exact[order[self.k]]]
        at = pick[order]
        each = first[at + 1] - first[at]
        vec = np.concatenate([ids[a:b] for a, b in zip(first[at].tolist(), first[at + 1].tolist())])
        score = np.repeat(exact[order], each)
        keep = vec != self.qids[q]
        vec, score = vec[keep], score[keep]
        if len(vec) > self.k:
            top = np.lexsort((vec, -score))[: self.k]
            vec, score = vec[top], score[top]
        self.found.append((np.full(len(vec), self.qids[q]), vec, score))

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's k nearest so far."""
        ask, vec, score = (np.concatenate([f[j] for f in self.found]) for j in range(3))
        order = np.lexsort((vec, -score, ask))
        ask, vec, score = ask[order], vec[order], score[order]
        keep = np.arange(len(ask)) - np.searchsorted(ask, ask) < self.k
        return ask[keep], vec[keep], score[keep]


def search(
    spark: SparkSession, df: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20,
    short: int = SHORT, block: int = BLOCK, query_batch: int = QUERY_BATCH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    rows without an id.  Rows that repeat an id take part as that many vectors; a query's own id is never its answer, and
    an id with several vectors asks with the least of them.  Fewer candidates than k give all of them; an empty table
    gives an empty result.  Other columns are not read.
    """
    answer = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], answer)
    dim = sizes[0]["d"]
    rows = written(spark, rows.filter(F.size("v") == dim), "aq-vectors")
    sample = hashed_sample(rows, "vec_id", FIT_ROWS).select("v").collect()
    books = fit(_directions(np.array([r["v"] for r in sample], np.float64)), words=min(WORDS, max(1, len(sample))))
    # of each distinct vector the k + 1 smallest ids; the limit is applied before the shuffle too
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    classes = written(spark, kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "aq-classes")
    # as many partitions as full blocks, so blocks don't shrink where a cluster deals rows over many partitions
    blocks = written(spark, index_blocks(classes.repartition(max(1, -(-classes.count() // block))), books, dim, block), "aq-index")
    asks = written(spark, rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "aq-asks")
    batches = -(-asks.count() // max(1, min(query_batch, QUERY_BYTES // (8 * dim))))
    path = shared_path(spark, "aq-found")
    for b in range(batches):  # ids are distinct, so their hashes deal them evenly
        batch = asks.filter(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == b).orderBy("vec_id").collect()
        if batch:
            _scanned(blocks, books, batch, k, short).write.mode("append").parquet(path)
    if not batches:
        return spark.createDataFrame([], answer)
    return spark.read.schema(answer).parquet(path)


def _scanned(blocks: DataFrame, books: Books, batch: list, k: int, short: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of a batch of queries: one scan of the index, then the best over its tasks."""
    spark = blocks.sparkSession
    qids = np.array([r["vec_id"] for r in batch], np.int64)
    qx = np.array([r["v"] for r in batch], np.float64)
    sent = spark.sparkContext.broadcast((qids, qx, books.words))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qx, words = sent.value
        scan = Scan(qids, qx, words, k, short)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, counts, x, codes, scale = (batch.column(c)[r].as_py() for c in range(5))
                counts = np.frombuffer(counts, np.int32)
                wide = len(x) == 8 * len(counts) * qx.shape[1]
                scan.block(
                    np.frombuffer(ids, np.int64), counts, np.frombuffer(x, np.float64 if wide else np.float32).reshape(len(counts), -1),
                    np.frombuffer(codes, np.uint8).reshape(len(counts), -1), np.frombuffer(scale, np.float32),
                )
        if scan.found:
            yield record_batch(schema, *scan.merged())

    found = blocks.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
