"""What changes from snapshot to snapshot, as a stream that sees deletions.

Snapshots are published one after another as epochs: a row for each key, with a stamp of all that the key has there, then a
seal that says that nothing of the epoch is to come.  The stream joins what an epoch has with what the one before had, on
key and epoch: pairs with different stamps are edits, what stays alone once the seal has passed is added or deleted.  The
state is that of the join, one snapshot of stamps, and the watermark empties it; nothing of it is kept in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: State on disk, one store a partition for both sides of the join, saved as what a batch changed; no disk is taken ahead.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


class EpochOrder(ValueError):
    """An epoch that is published already, or before the one that it follows."""


def stamps(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """(key, stamp): a row for each key, ``key`` a struct of the key columns.

    The stamp covers all other columns.  Rows of one key are a bag: their digests are summed, map-side first, so that order
    does not matter, repetitions count and no key is gathered.  Nulls differ from empty texts; a null key is one like others.
    """
    rest = [F.col(c) for c in snapshot.columns if c not in keys]
    whole = F.to_json(F.struct(*rest), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}) if rest else F.lit("")
    rows = snapshot.select(F.struct(*keys).alias("key"), F.md5(whole).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("bigint")).cast("string") for at in (1, 9, 17, 25)]
    return rows.groupBy("key").agg(F.concat_ws("-", F.count("*").cast("string"), *parts).alias("stamp"))


class Epochs:
    """Snapshots of one table in a shared folder, and the stream of their changes."""

    def __init__(self, spark: SparkSession, folder: str, key: StructType):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = StructType().add("key", key).add("stamp", "string").add("epoch", "long").add("seal", "boolean")

    def publish(self, snapshot: DataFrame, epoch: int) -> None:
        """Write ``snapshot`` as ``epoch`` (from 0, in order) and seal it.

        Rows appear by one rename of their folder, the seal after them.  What a lost driver left is taken up again: rows that
        are in place are only sealed, half-written ones lie where no reader looks and are written anew.
        """
        if self._has(self._path(epoch, "seal")) or (epoch and not self._has(self._path(epoch - 1, "seal"))):
            raise EpochOrder(f"epoch {epoch}")
        if not self._has(self._path(epoch, "rows")):
            found = stamps(snapshot, self.schema["key"].dataType.names)
            self._place(found.select(F.col("key").cast(self.schema["key"].dataType).alias("key"), "stamp", F.lit(epoch).cast("bigint").alias("epoch"), F.lit(False).alias("seal")), epoch, "rows")
        mark = self.spark.range(1).select(F.lit(None).cast(self.schema["key"].dataType).alias("key"), F.lit(None).cast("string").alias("stamp"), F.lit(epoch + 1).cast("bigint").alias("epoch"), F.lit(True).alias("seal"))
        self._place(mark, epoch, "seal")

    def changes(self, files: int | None = None) -> DataFrame:
        """(key, epoch, change) as a stream: added, deleted or edited; at most ``files`` files a batch.

        Files are taken in the order of their times, so an epoch may span batches; it is told in full once its seal is read.
        """
        read = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True)
        rows = (read.option("maxFilesPerTrigger", files) if files else read).parquet(self.folder)
        # the seal of an epoch has the time of the next: the watermark, half a step behind, passes an epoch with its seal only;
        # times begin at 1, since the first watermark is 0 and would count an epoch of that time as told
        side = lambda name, ahead: rows.select(
            F.col("key").alias(f"{name}_key"), F.col("stamp").alias(f"{name}_stamp"), F.col("seal").alias(f"{name}_seal"),
            F.timestamp_seconds(F.col("epoch") + (1 + ahead)).alias(f"{name}_at"),
        ).withWatermark(f"{name}_at", "500 milliseconds")
        both = side("was", 1).join(side("now", 0), F.expr("was_at = now_at AND was_seal = now_seal AND was_key <=> now_key"), "full_outer")
        change = F.expr("CASE WHEN now_at IS NULL THEN 'deleted' WHEN was_at IS NULL THEN 'added' WHEN was_stamp <> now_stamp THEN 'edited' END")
        told = both.filter("NOT coalesce(was_seal, now_seal)").select(
            F.expr("CASE WHEN now_at IS NULL THEN was_key ELSE now_key END").alias("key"),
            (F.unix_seconds(F.coalesce("now_at", "was_at")) - 1).alias("epoch"), change.alias("change"),
        )
        return told.filter("change IS NOT NULL")

    def follow(self, out: str, checkpoint: str, files: int | None = None, once: bool = True) -> StreamingQuery:
        """Append changes to the Parquet folder ``out``, each once, from where ``checkpoint`` left off.

        ``once`` ends when all that is published is told.  State lies in RocksDB on the executors' disks and is saved with the
        checkpoint, so a query started again elsewhere, after whatever stopped it, goes on without reading old epochs.
        """
        before = {name: self.spark.conf.get(name, None) for name in _STATE}
        for name, value in _STATE.items():
            self.spark.conf.set(name, value)
        try:
            writer = self.changes(files).writeStream.format("parquet").option("checkpointLocation", checkpoint)
            return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start(out)
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value) if value is not None else self.spark.conf.unset(name)

    def _path(self, epoch: int, what: str) -> str:
        return f"{self.folder}/{epoch:09d}-{what}"

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _has(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _place(self, df: DataFrame, epoch: int, what: str) -> None:
        staged = f"{self.folder}/_staged/{epoch:09d}-{what}"
        df.write.mode("overwrite").parquet(staged)
        fs, at = self._fs(staged)
        if not fs.rename(at, self._fs(self._path(epoch, what))[1]):
            raise EpochOrder(f"epoch {epoch} was published by another")
