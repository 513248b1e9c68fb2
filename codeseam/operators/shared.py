"""Tables in the cluster's shared folder: cutting lineage in loops, handing tables on."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_HELD: set[str] = set()
#: Where a table of the shared folder lies, for as long as it is held.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stem(df: DataFrame, start: str) -> str:
    """A beginning that no column name of ``df`` has, for names of an operator's own."""
    while any(c.lower().startswith(start.lower()) for c in df.columns):
        start += "_"
    return start


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from the session.

    Only where the setting is missing on a single machine (as in tests) is a folder of our own used; on a cluster that is
    an error, since a folder of one machine would lose what the others need.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(f"{CHECKPOINT_DIR} has to name a folder that the driver and all executors share")
        path = current.get() if current.isDefined() else f"{tempfile.gettempdir()}/codeseam-checkpoints"
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in a folder of this application, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/codeseam-{spark.sparkContext.applicationId}"
    if folder not in _HELD:
        _HELD.add(folder)
        sc = spark.sparkContext
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _remove(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the driver's JVM may be gone before us; a cluster's folder then has to be emptied by its owner
        pass


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return _at(spark.read.schema(df.schema).parquet(path), path)


def _at(df: DataFrame, path: str) -> DataFrame:
    _PATHS[df] = path
    return df


def discard(*tables: DataFrame) -> None:
    """Take tables that ``written``, ``settled`` or ``bucketed`` made out of the shared folder; nothing may read them any more."""
    for df in tables:
        if df in _PATHS:
            sc = df.sparkSession.sparkContext
            _remove(sc._jvm, sc._jsc.hadoopConfiguration(), _PATHS.pop(df))


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in the shared folder, computed once; what loops go on from."""
    return written(df.sparkSession, df, "settled")


def bucketed(spark: SparkSession, df: DataFrame, by: str, name: str = "bucketed") -> DataFrame:
    """``df`` in the shared folder, in as many buckets by ``by`` as a join has partitions, each sorted."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"codeseam_{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(n, by)  # one file a bucket
    path = shared_path(spark, name)
    dealt.write.format("parquet").option("path", path).bucketBy(n, by).sortBy(by).saveAsTable(table)
    return _at(spark.table(table), path)
