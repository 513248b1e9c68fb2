"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's target over its size is the number of copies expected of each of its documents.  Within a source the expected
copies are summed along the documents in order of size, one offset is added, and a document is taken once for each whole
number that its step crosses.  The order by size makes every stretch of like documents give its share, so the words
taken differ from the target by about one of the source's longest documents at most.

The sums run over ranges of all rows and are handed on between them, so a source that holds a third of the rows is spread
over a third of the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeseam.llm.common import written
from codeseam.operators.running import running
from codeseam.operators.shared import stem

#: Weights of the sources in their order, again from the start where they end.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the documents, and the most copies that any document may be expected to give.
SHARE, MOST = (3, 2), 2
SEED = "mix-1"
#: Sources up to so many, of so many bytes together, travel to the tasks; more are joined by shuffle.
SENT_ROWS, SENT_BYTES = 100_000, 8 << 20
#: Expected copies are whole numbers of this part, so that sums are exact and no document steps over its bound.
UNIT = 10**12
_EXACT = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """How many runs of other than white space a text has; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def offset(source: Column, seed: str = SEED) -> Column:
    """A source's offset in units, above 0 and below one copy: a hash of its name and the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    bits = F.conv(F.substring(F.md5(name), 1, 5), 16, 10).cast("bigint")
    return F.floor((2 * bits + 1) * F.lit(UNIT >> 9) / F.lit(1 << 12)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, expected) of each source, the last in units; ``sizes`` holds source and size.

    All sources together get ``share`` of all sizes by weight.  A target stops at ``most`` times its source's size; what
    is over goes to the others by their weights, until none is above.  Each round of that is one aggregate row, compared
    in whole numbers.
    """
    spark = sizes.sparkSession
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = running(
        sources.withColumn("absent", F.col("source").isNull().cast("int")).withColumn("one", F.lit(1)), [], ["absent", "source"], {"place": ("one", "sum")}
    )
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = written(spark, place.select("source", "source_size", weight.cast("bigint").alias("weight")), "sources")
    exact = lambda c: F.col(c).cast(_EXACT)
    total = sources.agg(F.sum(exact("source_size")).alias("t")).first()["t"]
    # a target is weight * up / down; at first nothing is held at its bound
    up, down = int(total or 0) * share[0], None
    held = F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(held, exact("source_size"))).alias("stopped"), F.sum(F.when(~held, exact("weight"))).alias("weights"), F.count_if(held).alias("n")
        ).first()
        if down is not None and row["n"] == n:
            break
        n = row["n"]
        top = up - share[1] * most * int(row["stopped"] or 0)
        down = share[1] * int(row["weights"] or 0)
        if not down:
            break
        # weight * top / down above most * size
        held = F.lit(most).cast(_EXACT) * exact("source_size") * F.lit(str(down)).cast(_EXACT) < exact("weight") * F.lit(str(top)).cast(_EXACT)
    bound = (most * F.col("source_size")).cast("double")
    if not down:
        target = bound
    else:
        target = F.when(held, bound).otherwise(F.least(bound, F.col("weight").cast("double") * F.lit(top / share[1]) / F.lit(float(down // share[1]))))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("expected", F.floor(rate * F.lit(float(UNIT)) + 0.5).cast("bigint"))


def _known(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with each source's row of ``right``: by broadcast while all sources are few, else by shuffle."""
    right = right.select(F.col("source").alias("of"), "source_size", "target", "expected")
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("of")), F.lit(0)).alias("b")).first()
    few = size["n"] <= SENT_ROWS and size["b"] <= SENT_BYTES
    return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def systematic_copies(df: DataFrame, group: str, expected: str, order: list[str], offset: Column, copies: str = "copies") -> DataFrame:
    """``df`` with ``copies``: how many whole copies lie above each row's sum of ``expected`` before it plus ``offset``, up to its own.

    ``expected`` and ``offset`` are whole numbers of units, nulls count as 0; sums run within ``group`` in ``order``.
    """
    summed = running(df.withColumn(expected, F.coalesce(F.col(expected), F.lit(0)).cast(_EXACT)), [group], order, {copies: (expected, "sum")})
    names = stem(summed, "_m")
    ends = summed.withColumn(f"{names}end", F.col(copies) + offset).withColumn(f"{names}start", F.col(f"{names}end") - F.col(expected))
    return ends.withColumn(copies, F.expr(f"{names}end div {UNIT} - {names}start div {UNIT}")).drop(f"{names}end", f"{names}start")


def mix_counts(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row: ``taken`` is size times the copies that the mix takes of it.

    Null texts have size 0 and give nothing.  A null source is one source, the last.  Rows that repeat an id count one by
    one; which of several with equal id, source and size is taken more often isn't told apart.  An empty table gives an
    empty result.  The same rows and seed give the same mix in whatever layout.  Other columns are not read.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    sizes = written(spark, sizes, "mix-sizes")  # the texts are read once
    known = _known(sizes, targets(sizes, weights, share, most))
    taken = systematic_copies(known, "source", "expected", ["size", "doc_id"], offset(F.col("source"), seed))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``counts`` takes it; ids have to be distinct and not null."""
    copies = F.expr("taken div size")
    often = counts.filter("taken > 0").select(F.col("doc_id").alias(id_col), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy_of_mix"))
    return docs.join(often.drop("copy_of_mix"), id_col)
