"""A stream of changed files kept current in a fact store.

The file source sees new and rewritten files but never deletions, so each micro-batch only says that something moved;
what changed is decided by the store's snapshot comparison, which sees deletions too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codeseam.plans.store import ChangeSet, FactStore, ReloadRequired


def watch(store: FactStore, checkpoint: str, on_change: Callable[[ChangeSet], None] | None = None, once: bool = False) -> StreamingQuery:
    """Refresh the store whenever a Java file below its root appears or is rewritten."""
    spark = store.spark
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.java")
        .load(store.root)
        .select("path", "modificationTime")
    )

    def refresh(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        try:
            changed = store.fresh()
        except ReloadRequired:
            store.load()
            changed = ChangeSet()
        if on_change:
            on_change(changed)

    writer = files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def strict(store: FactStore, name: str, /, **arguments) -> DataFrame:
    """Answer a query after the store was brought up to its tree; a changed build file stops it with ReloadRequired."""
    from codeseam.plans.tools import query

    store.fresh()
    return query(store.resolved, name, **arguments)
