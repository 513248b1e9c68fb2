"""Benchmark decontamination by winnowing.

A window is 13 consecutive item words (an item of fewer, but not none, is one window).  Every window of an item has 9
word 5-grams; the least of their hashes is kept: its fingerprint.  Documents are winnowed the same way, so a shared span
of 13 words always shares a fingerprint.  Fingerprints of documents are joined with those of the items, and each hit is
extended to the windows that carry it, compared word by word, so nothing is missed and nothing is a hash accident.

Items of at most ``ITEM_BYTES`` bytes together (measured first) are joined by broadcast: one pass over the documents.
Beyond that all joins are shuffled: fingerprints of documents meet those of items, the documents they leave give their
windows, and these meet the windows of the items.  Nothing of the items reaches the driver then, and documents' rows are
salted, so a passage in a third of them is no one task's work.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.llm.common import ALNUM, fresh, record_batch, release, slices, text_bytes, written

WINDOW = 13
GRAM = 5
ITEM_BYTES = 4 << 20
SALTS = 16
CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(ALNUM).split()


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive ids (0, an unknown word, spoils a gram)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = ids.astype(np.uint64) * _MIX
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + mixed[j : j + n]
    out ^= out >> np.uint64(31)
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    out[unknown[k:] != unknown[:-k]] = _NONE
    return out


def window_prints(codes: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of every window of ``size`` words: the least hash of its 5-grams; a shorter window's own hash."""
    return _least(_grams(codes, GRAM), WINDOW - GRAM + 1) if size == WINDOW else _grams(codes, size)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


class ItemIndex:
    """Winnowed fingerprints and exact windows of some benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids: dict[bytes, int] = {}
        texts: dict[tuple[bytes, ...], list[int]] = defaultdict(list)  # copies of an item are indexed once
        for item, data in items:
            if item is not None and (w := tuple(words_of(data))):
                texts[w].append(item)
        self.items = [sorted(set(v)) for v in texts.values()]
        self.windows: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        kept: dict[int, set[int]] = defaultdict(set)
        for k, words in enumerate(texts):
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int32)
            size = min(WINDOW, len(ids))
            seen = self.windows[size]
            for p in range(len(ids) - size + 1):
                at = seen[ids[p : p + size].tobytes()]
                if not at or at[-1] != k:
                    at.append(k)
            kept[size].update(window_prints(ids, size).tolist())
        self.windows = {size: dict(v) for size, v in self.windows.items()}
        self.kept = {size: np.array(sorted(v), np.uint64) for size, v in kept.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, end) of hit words, merged, and the numbers of the items found."""
        get, n = self.ids.get, len(words)
        ids = np.fromiter((get(w, 0) for w in words), np.int32, n) if n else np.empty(0, np.int32)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not ids.any():
            return spans, found
        for size, kept in self.kept.items():
            windows = self.windows[size]
            for at in range(0, max(1, n - size + 1), CHUNK):
                part = ids[at : at + CHUNK + size - 1]
                if len(part) < size:
                    continue
                least = window_prints(part, size)
                near = np.nonzero(least != _NONE)[0]
                near = near[kept[np.minimum(np.searchsorted(kept, least[near]), len(kept) - 1)] == least[near]]
                for p in near.tolist():
                    got = windows.get(part[p : p + size].tobytes())
                    if got:
                        found.update(got)
                        spans.append((at + p, at + p + size))
        return merge_spans(spans), found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_ROWS = pa.schema(
    [("id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))]
)
_DDL = "n_words bigint, starts array<bigint>, ends array<bigint>, items array<bigint>"


def _digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def small_index(items: DataFrame, id_col: str, text_col: str, most: int) -> ItemIndex | None:
    """The index of all items, if their texts are at most ``most`` bytes together."""
    rows = items.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")) + 16 * F.count("*"), F.lit(0))).first()[0]
    return ItemIndex([(r["i"], r["t"].encode()) for r in rows.collect()]) if size <= most else None


def _scan(df: DataFrame, index: ItemIndex) -> DataFrame:
    """(id, n_words, starts, ends, items) per row of (id, t)."""
    sent = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        index = sent.value
        for batch in slices(batches):
            out = ([], [], [], [])
            for data in text_bytes(batch.column(1)):
                words = words_of(data)
                spans, found = index.hits(words)
                out[0].append(len(words))
                out[1].append([a for a, _ in spans])
                out[2].append([b for _, b in spans])
                out[3].append(sorted({i for k in found for i in index.items[k]}))
            yield record_batch(_ROWS, batch.column(0), *out)

    return df.mapInArrow(run, f"id bigint, {_DDL}")


class Codes(dict):
    """word -> 64-bit hash, never 0; bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word) or 1
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _prints(words: list[bytes], codes: Codes, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, start, fingerprints of the windows from there on), by stretches of a long text."""
    own = codes.of(words)
    for size in sizes:
        for at in range(0, max(1, len(own) - size + 1), CHUNK):
            part = own[at : at + CHUNK + size - 1]
            if len(part) >= size:
                yield size, at, window_prints(part, size)


def _signed(prints: np.ndarray) -> np.ndarray:
    return prints.view(np.int64)


def item_windows(items: DataFrame) -> DataFrame:
    """(item, size, print, words) of every window of (i, t), once an item."""
    schema = pa.schema([("item", pa.int64()), ("size", pa.int32()), ("print", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = words_of(data)
                if not words:
                    continue
                found = {
                    (size, int(p), b" ".join(words[at + k : at + k + size]))
                    for size, at, prints in _prints(words, codes, [min(WINDOW, len(words))])
                    for k, p in enumerate(_signed(prints))
                }
                sizes, prints, texts = zip(*found)
                yield record_batch(schema, [item] * len(found), sizes, prints, texts)

    return items.mapInArrow(run, "item bigint, size int, print bigint, words binary").distinct()


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _joined(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, n_words, starts, ends, items) per row of (id, t), ids distinct, every join by shuffle."""
    windows = written(spark, item_windows(items), "winnow-windows")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most 13
    schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("print", pa.int64())])

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = words_of(data)
                yield record_batch(schema, [i], [0], [len(words)])  # size 0: how many words there are
                kept: dict[int, np.ndarray] = {}
                for size, _, prints in _prints(words, codes, sizes):
                    kept[size] = np.union1d(kept.get(size, prints[:0]), prints)
                for size, prints in kept.items():
                    if len(prints):
                        yield record_batch(schema, [i] * len(prints), [size] * len(prints), _signed(prints))

    prints = written(spark, docs.mapInArrow(winnow, "id bigint, size int, print bigint"), "winnow-prints")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    near = prints.filter("size > 0").withColumn("salt", salt).join(_salted(windows.select("size", "print").distinct()), ["size", "print", "salt"], "left_semi")
    near = near.groupBy("id").agg(F.collect_set(F.struct("size", "print")).alias("near"))
    found_schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("start", pa.int64()), ("words", pa.binary())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for i, data, near in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words, by = words_of(data), defaultdict(list)
                for x in near:
                    by[x["size"]].append(x["print"])
                out: list[tuple[int, int, bytes]] = []
                for size, at, prints in _prints(words, codes, list(by)):
                    for k in np.nonzero(np.isin(_signed(prints), np.array(by[size])))[0].tolist():
                        out.append((size, at + k, b" ".join(words[at + k : at + k + size])))
                if out:
                    yield record_batch(found_schema, [i] * len(out), *zip(*out))

    held = docs.join(near, "id").mapInArrow(extend, "id bigint, size int, start bigint, words binary")
    held = written(spark, held.withColumn("salt", salt), "winnow-held")
    on = ["size", "words", "salt"]
    spans = held.join(_salted(windows.select("size", "words").distinct()), on, "left_semi").groupBy("id").agg(
        F.collect_list(F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"))).alias("spans")
    )
    named = held.select("id", *on).distinct().join(_salted(windows.select("size", "words", "item")), on).groupBy("id").agg(F.collect_set("item").alias("items"))
    counts = prints.filter("size = 0").select("id", F.col("print").alias("n_words"))
    none = F.array().cast("array<bigint>")
    return counts.join(spans, "id", "left").join(named, "id", "left").select(
        "id", "n_words", F.coalesce("spans.start", none).alias("starts"), F.coalesce("spans.end", none).alias("ends"), F.coalesce("items", none).alias("items")
    )


def contamination(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, starts, ends, items, items_sha256, contaminated) per row of ``docs``.

    Null texts have no words.  Null item ids and items without words are no items; an id that occurs with several texts
    is found when any of them is.  Repeated rows give repeated rows; an empty benchmark hits nothing.  Other columns
    are not read.
    """
    index = small_index(items, item_id_col, item_text_col, item_bytes)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    if index is not None:
        found = _scan(texts, index)
    else:
        rows = written(spark, texts.select(F.monotonically_increasing_id().alias("uid"), F.col("id").alias("doc"), "t"), "winnow-docs")
        every = items.select(F.col(item_id_col).cast("bigint").alias("i"), F.col(item_text_col).alias("t")).filter("i is not null and t is not null")
        hits = _joined(spark, rows.select(F.col("uid").alias("id"), "t"), every).withColumnRenamed("id", "uid")
        found = rows.select("uid", "doc").join(hits, "uid").select(F.col("doc").alias("id"), "n_words", "starts", "ends", "items")
    schema = pa.schema([*_ROWS, ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            spans = [merge_spans(list(zip(r["starts"], r["ends"]))) for r in rows]
            hit = [sum(b - a for a, b in s) for s in spans]
            yield record_batch(
                schema,
                [r["id"] for r in rows],
                [r["n_words"] for r in rows],
                [[a for a, _ in s] for s in spans],
                [[b for _, b in s] for s in spans],
                [sorted(r["items"]) for r in rows],
                hit,
                [len(r["items"]) for r in rows],
                [_digest(r["items"]) for r in rows],
                [n > 0 and 20 * n >= r["n_words"] for n, r in zip(hit, rows)],
            )

    return found.mapInArrow(
        finish, f"id bigint, {_DDL}, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    )


def clean_documents(
    spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that are not contaminated."""
    index, names = small_index(items, item_id_col, item_text_col, item_bytes), docs.columns
    if index is None:
        uid = fresh(docs, "uid")
        rows = written(spark, docs.withColumn(uid, F.monotonically_increasing_id()), "winnow-rows")
        dirty = contamination(spark, rows, items, uid, text_col, item_id_col, item_text_col, item_bytes).filter("contaminated")
        return rows.join(dirty.select(F.col("id").alias(uid)), uid, "left_anti").select(*names)
    where, sent = names.index(text_col), spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            keep = []
            for data in text_bytes(batch.column(where)):
                words = words_of(data)
                hit = sum(b - a for a, b in sent.value.hits(words)[0])
                keep.append(not (hit and 20 * hit >= len(words)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
