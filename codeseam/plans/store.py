"""The fact store: ingest a tree into Parquet, keep it fresh by content hashes.

Facts lie in folders by a hash of the path, about ``FILES_PER_BUCKET`` files to a folder, so both the tasks of a load and
the share that one edited file rewrites follow the tree's size.  A refresh compares stamps, re-reads only the changed
files and rewrites only the folders that hold one; what changed stays a table throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.operators import search
from codeseam.operators.diff import SourceMissing, snapshot_diff
from codeseam.operators.shared import settled
from codeseam.plans.resolve import Resolved, bucket_of
from codeseam.sources import tree

FILES_PER_BUCKET = 256
#: At most so many changed paths of each kind are named on the driver; the totals are exact.
NAMED = 1000


class ReloadRequired(RuntimeError):
    """A build file changed: the project's layout may differ, so it has to be ingested again."""

    code = "RELOAD_REQUIRED"


@dataclass
class ChangeSet:
    """The first changed paths of each kind, how many there are of it, and all of them as a table (path, change)."""

    edited: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)
    build_files: list[str] = field(default_factory=list)
    totals: dict[str, int] = field(default_factory=dict)
    rows: DataFrame | None = None

    def __bool__(self) -> bool:
        return bool(self.edited or self.added or self.deleted or self.build_files)


class FactStore:
    """Facts of the tree at ``root``, kept at ``path`` (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, root: str, path: str):
        self.spark, self.root, self.path = spark, root.rstrip("/"), path.rstrip("/")
        self._resolved: Resolved | None = None
        self._buckets: int | None = None

    # ---- ingest

    @property
    def buckets(self) -> int:
        """How many folders the facts were dealt over when they were loaded."""
        if self._buckets is None:
            self._buckets = self.spark.read.schema("buckets int").parquet(f"{self.path}/layout").first()["buckets"]
        return self._buckets

    def _scan(self) -> DataFrame:
        try:
            return tree.source_files(self.spark, self.root)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise SourceMissing(f"{self.root} is gone") from e
            raise

    def _build_stamps(self) -> DataFrame:
        return tree.build_files(self.spark, self.root).select("path", F.md5("content").alias("md5"))

    def load(self) -> dict:
        """Read the whole tree; a summary of it."""
        files = self._scan()
        buckets = -(-files.select("path").count() // FILES_PER_BUCKET) or 1
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{self.path}/layout")
        facts = tree.facts(files).withColumn("bucket", bucket_of(F.col("path"), buckets))
        facts.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/facts")
        self._buckets = buckets
        self._build_stamps().write.mode("overwrite").parquet(f"{self.path}/build")
        self._resolved = None
        return self.summary()

    def summary(self, packages: int = 20) -> dict:
        names = tree.build_files(self.spark, self.root).filter(~F.contains("path", F.lit("/"))).select("name")
        packs = self.facts.select("package").distinct()
        row = self.facts.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("symbols"), F.coalesce(F.sum(F.size("problems")), F.lit(0)).alias("problems")).first()
        return {
            "root": self.root, "buildSystem": tree.build_system(names).first()["system"], "files": row["files"], "symbols": row["symbols"], "problems": row["problems"],
            "packageCount": packs.count(), "packages": [r["package"] for r in packs.orderBy("package").limit(packages).collect()],
        }

    # ---- reading

    @property
    def facts(self) -> DataFrame:
        return self.spark.read.schema(f"{tree.FACTS}, bucket int").parquet(f"{self.path}/facts")

    @property
    def resolved(self) -> Resolved:
        if self._resolved is None:
            self._resolved = Resolved(self.facts, f"{self.path}/resolved/{self.version()}", self.buckets)
        return self._resolved

    def version(self) -> str:
        """Names the facts' content: equal trees, equal names, whatever way the facts came about."""
        row = self.facts.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("path", "md5")), F.lit(0)).alias("x")).first()
        return f"{row['n']}-{row['x'] & (1 << 64) - 1:016x}"

    # ---- freshness

    def changes(self) -> ChangeSet:
        """What differs between the tree and the facts; an emptied or missing root is an error, not a mass deletion."""
        files = self._scan()
        disk = tree.stamps(files).select("path", "md5")
        known = self.facts.select("path", "md5")
        if disk.isEmpty() and not known.isEmpty():
            raise SourceMissing(f"nothing is left below {self.root}")
        rows = settled(snapshot_diff(known, disk, "path", "md5"))
        first = search.top_per_group(rows, ["change"], [F.col("path")], NAMED).orderBy("change", "path").collect()  # at most NAMED of each kind
        found: dict[str, list[str]] = {"added": [], "deleted": [], "edited": []}
        for r in first:
            found[r["change"]].append(r["path"])
        build = snapshot_diff(self.spark.read.schema("path string, md5 string").parquet(f"{self.path}/build"), self._build_stamps(), "path", "md5")
        named = [r["path"] for r in build.orderBy("path").limit(NAMED).collect()]
        return ChangeSet(build_files=named, totals={r["change"]: r["total"] for r in first}, rows=rows, **found)

    def fresh(self) -> ChangeSet:
        """Bring the facts up to the tree: nothing, the changed folders, or ReloadRequired when a build file changed."""
        changed = self.changes()
        if changed.build_files:
            raise ReloadRequired(", ".join(changed.build_files))
        if changed:
            touched = changed.rows.select("path")
            folders = settled(touched.select(bucket_of(F.col("path"), self.buckets).alias("bucket")).distinct())
            old = self.facts.join(folders, "bucket", "left_semi").join(touched, "path", "left_anti")
            new = tree.facts(self._scan().join(touched, "path", "left_semi")).withColumn("bucket", bucket_of(F.col("path"), self.buckets))
            rows = settled(old.unionByName(new))
            count = max(1, min(self.buckets, folders.count()))
            rows.repartition(count, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/facts")
            for r in folders.join(rows.select("bucket").distinct(), "bucket", "left_anti").toLocalIterator():  # folders that lost all
                self._delete(f"{self.path}/facts/bucket={r['bucket']}")
            self._delete(f"{self.path}/resolved")  # of the content before
            self._resolved = None
        return changed

    def _delete(self, path: str) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
