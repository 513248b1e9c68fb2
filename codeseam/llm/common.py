"""Shared pieces: the cluster's shared folder, table reading, word tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.operators.shared import shared_path, written  # noqa: F401

SLICE = 512


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hashes of ``key``.

    Rows are thinned by their hash before they are ordered, so what the tasks send together stays near ``most`` rows.
    """
    parts = 1 << 20
    count = df.count()
    if count > 2 * most:
        df = df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) < -(-parts * most * 5 // (4 * count)))
    return df.orderBy(F.xxhash64(key), *df.columns).limit(most)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, a few rows at a time; null counts as empty."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for at in range(0, len(column), SLICE):
        for x in column.slice(at, SLICE).to_pylist():
            yield b"" if x is None else x


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what is made of one is small however wide its rows are."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


#: What a worker process keeps from task to task: of one operator at a time.
_KEPT: dict[str, tuple] = {}


def kept(owner: str, key, make: Callable):
    """What ``make`` made for this owner and key, kept until a task of another owner runs in the process."""
    if _KEPT.get(owner, (None,))[0] != key:
        _KEPT.clear()
        _KEPT[owner] = (key, make())
    return _KEPT[owner][1]


def release() -> None:
    """Called where a task of an operator without anything to keep begins."""
    _KEPT.clear()


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _alnum_table() -> bytes:
    """Byte table: A-Z to a-z; digits, a-z and every byte of a non-ASCII character stay; the rest becomes a space."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(out)


#: Makes ``data.translate(ALNUM).split()`` the list of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = _alnum_table()


def bernoulli_fold(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as the text 'null')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % modulus
