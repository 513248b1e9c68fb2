"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Every white-space word gives its own hash and that of its form (case, digits, marks), the pairs and form triples it
starts, and whether it repeats the word before.  A feature's value is its share of the words, so a score is the mean of
table entries: one sparse dot product.  Labels, language, source and ids are never features.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.llm.common import bernoulli_fold, record_batch, release, slices, text_bytes, written

BUCKETS_LOG2 = 20
#: At most so many labelled rows are learned from (the least hashes of their ids), whole texts of any length.
TRAIN_ROWS = 6000
EPOCHS = 3
#: Features are kept from epoch to epoch up to so many; beyond, they are made again.
KEPT_FEATURES = 10_000_000
FOLDS = 5
THRESHOLD = 0.3

_FORM = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"9")]
_KINDS = 5


class WordCodes(dict):
    """word -> 40 bits of its lower-case hash and 24 bits of its form's; bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        form = word
        for pattern, to in _FORM:
            form = pattern.sub(to, form)
        core = xxhash.xxh64_intdigest(word.lower()) >> 24
        code = (core << 24) | (xxhash.xxh64_intdigest(form, 7) >> 40)
        self[word] = code
        return code


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def features(data: bytes, codes: WordCodes) -> tuple[np.ndarray, int]:
    """Bucket numbers of all n-grams (repeats included) and the number of words."""
    words = data.split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.int64), 0
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, n)
    core, form = code >> np.uint64(24), code & np.uint64(0xFFFFFF)
    out = [_mix(core, 0), _mix(form, 1)]
    if n > 1:
        out.append(_mix(core[:-1] * np.uint64(31) + core[1:] * np.uint64(0xC2B2AE3D27D4EB4F), 2))
        out.append(_mix((core[:-1] == core[1:]).astype(np.uint64), 3))
    if n > 2:
        out.append(_mix((form[:-2] * np.uint64(1 << 20)) ^ (form[1:-1] * np.uint64(1 << 10)) ^ form[2:], 4))
    return np.concatenate(out), n


class Ftrl:
    """FTRL-proximal for logistic loss over hashed shares; the last weight is the bias."""

    def __init__(self, size: int, alpha=0.5, beta=0.05, l1=1e-4, l2=1e-4):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = weight * (_sigmoid(float(w @ value)) - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: Iterable[tuple[bytes, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the bias last) from (text, label) rows in their order, gone through once an epoch and once before to
    weigh the labels; no rows: a bias that scores 0.5.  One text is held at a time."""
    size = 1 << BUCKETS_LOG2
    model, codes = Ftrl(size), WordCodes()
    labels = [label for _, label in rows]
    ones = sum(labels)
    weight = {1: 1.0, 0: min(4.0, max(1.0, ones / max(1, len(labels) - ones)) ** 0.5)}
    kept: list[tuple] = []  # features of an epoch, as far as they are few
    size_kept = 0
    for epoch in range(epochs):
        for k, row in enumerate(rows if epoch == 0 or len(kept) < len(labels) else kept):
            if k < len(kept) and epoch:
                at, value, label = kept[k]
            else:
                data, label = row
                at, n = features(data, codes)
                at, times = np.unique(at, return_counts=True)
                at, value = np.append(at, size).astype(np.int32), np.append(times / max(1, n), 1.0).astype(np.float32)
                if epoch == 0 and k == len(kept) and size_kept + len(at) <= KEPT_FEATURES:
                    kept.append((at, value, label))
                    size_kept += len(at)
            model.learn(at, value, label, weight[label])
    return model.weights().astype(np.float32)


class Sample:
    """(text, label) rows of a written table, in the order of their ids' hashes, as often as they are gone through; the
    driver holds one partition of them at a time."""

    def __init__(self, table: DataFrame):
        self.table = table

    def __iter__(self) -> Iterator[tuple[bytes, int]]:
        for r in self.table.orderBy(F.xxhash64("id"), "id").select("t", "y").toLocalIterator():
            yield r["t"].encode(), r["y"]


def training_rows(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", rows=TRAIN_ROWS) -> Sample:
    """A bounded sample of labelled rows outside the held-out fold; an id with several labels takes the largest, one with
    several texts the least."""
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (bernoulli_fold("id", FOLDS) != 0))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min(F.struct("t", "y")).alias("r"))  # at most `rows` rows
    return Sample(written(docs.sparkSession, texts.select("id", "r.t", "r.y"), "quality-sample"))


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row: the probability of label 1."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        w, codes = sent.value, WordCodes()
        bias = float(w[-1])
        for batch in slices(batches):
            out = []
            for data in text_bytes(batch.column(1)):
                at, n = features(data, codes)
                out.append(_sigmoid(bias + (float(w[at].sum(dtype=np.float64)) / n if n else 0.0)))
            yield record_batch(schema, batch.column(0), out)

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id bigint, score double")


def keep_mask(df: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores at least ``threshold``."""
    sent, names = df.sparkSession.sparkContext.broadcast(weights), df.columns
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        w, codes = sent.value, WordCodes()
        bias = float(w[-1])
        for batch in slices(batches):
            ok = []
            for data in text_bytes(batch.column(where)):
                at, n = features(data, codes)
                ok.append(_sigmoid(bias + (float(w[at].sum(dtype=np.float64)) / n if n else 0.0)) >= threshold)
            yield batch.filter(pa.array(ok, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def quality_scores(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Null and empty texts score the bias.  Repeated rows give repeated rows.  A null id is scored like any other and its
    fold is that of the text 'null'.  No labels: every text scores 0.5.  Other columns are not read.
    """
    weights = train(training_rows(docs, labels, id_col, text_col, rows=rows))
    return score(docs, weights, id_col, text_col).select(
        F.col("id").alias("doc_id"),
        (bernoulli_fold("id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
