"""Names found by globs through an index of three-letter grams instead of a scan.

Each name stands once under every gram it holds, its two ends marked.  Postings lie in a folder for each source, sorted by
gram over ranges of files, so a filter on one gram reads the files, row groups and pages whose bounds hold it and no
others.  A glob's literal runs give grams that every match must hold; the one with the fewest names is read, and the
glob itself decides among those.  A glob without such grams scans the names, which lie beside the postings, once each.  A
source is written again alone, by replacing its folders.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeseam.functions import text as T

BEGIN, END, GRAM = "\x02", "\x03", 3
#: Row groups of the sorted files; small ones let a rare gram read little.
GROUP_BYTES = 1 << 20


def grams_of(glob: str) -> set[str]:
    """Grams in lower case that every name matching ``glob`` holds; none where its literal runs are too short."""
    marked = BEGIN + glob + END
    out: set[str] = set()
    for run in re.split(r"[*?]+", marked):
        out |= {run[i : i + GRAM].lower() for i in range(len(run) - GRAM + 1)}
    return {g for g in out if g.isascii()}  # case folding outside ASCII differs between engines


def _grams(name: Column) -> Column:
    marked = F.lower(F.concat(F.lit(BEGIN), name, F.lit(END)))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - (GRAM - 1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(marked, i, F.lit(GRAM))))


class GlobIndex:
    """An index of distinct names by source in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def refresh(self, source: str, names: DataFrame, name: str = "name") -> None:
        """Replace what is indexed of ``source`` by the distinct ``name``s of ``names``; nulls are left out.

        Other sources' folders are neither read nor written.
        """
        distinct = names.select(F.col(name).cast("string").alias("name")).dropna().distinct()
        distinct.write.mode("overwrite").parquet(f"{self.path}/names/source={source}")
        spread = self.names().filter(F.col("source") == source).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "name")
        rows = spread.select(F.explode(_grams(F.col("name"))).alias("gram"), "name")
        sorted_ = rows.repartitionByRange("gram", "name").sortWithinPartitions("gram", "name")
        sorted_.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{self.path}/postings/source={source}")
        counted = self._read("postings", "gram string, name string").filter(F.col("source") == source).groupBy("gram").agg(F.count("*").alias("n"))
        counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/counts/source={source}")

    def _read(self, table: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"{columns}, source string").parquet(f"{self.path}/{table}")

    def names(self) -> DataFrame:
        return self._read("names", "name string")

    def postings(self) -> DataFrame:
        return self._read("postings", "gram string, name string")

    def rarest(self, glob: str) -> str | None:
        """The gram of ``glob`` with the fewest names, as far as its grams are indexed; null: it has none to look for.

        Only the counts of the glob's own grams are read; one row comes back.
        """
        grams = sorted(grams_of(glob))
        if not grams:
            return None
        found = self._read("counts", "gram string, n bigint").filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n"))
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")  # as many as a glob has letters
        return asked.join(found, "gram", "left").orderBy(F.coalesce("n", F.lit(0)), "gram").first()["gram"]

    def search(self, glob: str, sources: list[str] | None = None, ignore_case: bool = False) -> DataFrame:
        """(source, name) of the indexed names that match: those of a scan with the same glob."""
        gram = self.rarest(glob)
        rows = self.names() if gram is None else self.postings().filter(F.col("gram") == gram)
        if sources is not None:
            rows = rows.filter(F.col("source").isin(sources))
        return rows.filter(T.glob_match(F.col("name"), glob, ignore_case=ignore_case)).select("source", "name")
