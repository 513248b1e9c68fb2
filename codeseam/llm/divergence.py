"""Source divergence audit: how far the words of each source lie from those of its language's other sources and of the language.

The distance of two sources is a sum over all kept terms of their language, most of which neither or only one of them
has.  It is put together by inclusion and exclusion over their supports, without a row for a term that is missing:

* terms of g alone cost the same for equal counts, so the histogram of g's counts prices them against h's share of a
  missing term;
* terms of h alone likewise;
* terms of neither are one constant, times their number;
* terms of both were priced twice as if missing on the other side, so a join of the posting lists corrects them.

Tasks count whole texts before anything is shuffled.  Counts by language and term meet once; each term has at most one row
for each source there, and pairs are made from those rows only, in one direction, and summed before the shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codeseam.llm.common import record_batch, release, slices, text_bytes, written

LEAST_DOCS = 30
SCALE, PRIOR = 1_000_000_000, 5
TERM_RANKS = 50
#: A task hands on what it has counted when it holds so many (language, source, term).
HELD = 300_000
#: Sources (with their languages) up to so many, of so many bytes together, travel to the tasks; more are joined by shuffle.
SENT_ROWS, SENT_BYTES = 100_000, 8 << 20


def _letters() -> bytes:
    """Byte table: A-Z to a-z; a-z and every byte of a non-ASCII character stay; the rest becomes a space."""
    out = bytearray(range(256))
    for b in range(128):
        out[b] = ord(chr(b).lower()) if chr(b).isalpha() else 0x20
    return bytes(out)


#: Makes ``data.translate(LETTERS).split()`` the terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` of a text, A-Z lower-cased.
LETTERS = _letters()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, by task; ``docs`` holds lang, source and text.

    A task may hand on a term several times, when what it holds grows large.
    """
    out = "lang string, source string, term string, n bigint, d bigint"
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 65_536):
                    part = terms[at : at + 65_536]
                    words = pa.array(part, pa.binary()).cast(pa.string())
                    yield record_batch(schema, [lang] * len(part), [source] * len(part), words, [n[t] for t in part], [d[t] for t in part])
            held.clear()

        for batch in slices(batches):
            for lang, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                words = data.translate(LETTERS).split()
                if not words:
                    continue
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                once = Counter(words)
                n.update(once)
                d.update(once.keys())
                size += len(n) - before
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(run, out)


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, all_n, first): of each kept term its count by source, that in its language, and a mark on one
    row of each term.

    One exchange by language and term serves the sums by source and the sums by term.
    """
    by_term = Window.partitionBy("lang", "term")
    dealt = term_counts(docs).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    marked = summed.select(
        "lang", "term", "source", "n", F.sum("n").over(by_term).alias("all_n"), F.sum("d").over(by_term).alias("docs"), (F.min("source").over(by_term) == F.col("source")).alias("first")
    )
    return marked.filter(F.col("docs") >= least_docs).drop("docs")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly; null where there are no terms."""
    wide = lambda c: f"cast({c} as decimal(38,0))"
    top = f"cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0))"
    return F.when(F.expr(f"{terms} > 0"), F.expr(f"1 + ({top}) div ({wide(total)} + {PRIOR} * {wide(terms)})"))


def _few(spark: SparkSession, groups: DataFrame) -> bool:
    row = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("lang") + F.length("source")), F.lit(0)).alias("b")).first()
    return row["n"] <= SENT_ROWS and row["b"] <= SENT_BYTES


def audit(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS,
    term_ranks: int = TERM_RANKS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Part ``pair``: each other source of the language by distance, all of them.  Part ``term``: the terms that stand out
    against the language, the first ``term_ranks``.  Ties go to the lesser item in UTF-8.  Null text, lang and source are
    ''.  Rows count one by one, repeated or not.  A language without kept terms has distances of 0 and no terms; an empty
    table gives an empty result.  Other columns are not read.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    kept = written(spark, postings(docs, least_docs), "audit-postings")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"), F.count_if("first").alias("terms"))
    langs = sizes.groupBy("lang").agg(F.sum("total").alias("all_total"), F.sum("terms").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sizes.drop("terms"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "support", "all_total", "terms"])
    groups = written(spark, groups.withColumn("zero", share("0", "total", "terms")), "audit-groups")
    sent = F.broadcast if _few(spark, groups) else (lambda df: df)

    priced = kept.join(sent(groups), ["lang", "source"]).select(
        "lang", "term", "source", "zero", "terms", "all_n", "all_total", "n", share("n", "total", "terms").alias("p")
    )
    return pairs(priced, groups, sent).unionByName(terms(priced, term_ranks))


def terms(priced: DataFrame, ranks: int) -> DataFrame:
    """Part ``term``: of each source the terms with a share above the language's."""
    over = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - share("all_n", "all_total", "terms")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return over.filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)


def pairs(priced: DataFrame, groups: DataFrame, sent) -> DataFrame:
    """Part ``pair``: the distances of all sources of a language, from histograms, constants and corrections.

    All contributions are rows of an unordered pair, ``a`` before ``b``, and are summed together.
    """
    low, high = F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")
    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.col("support").alias("other_support"))
    met = lambda df: df.join(sent(others), "lang").filter("source <> other")
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    one_sided = met(histogram).select("lang", low, high, (F.col("times") * F.abs(F.col("p") - F.col("other_zero"))).alias("value"))
    neither = F.col("terms") - F.col("support") - F.col("other_support")
    constant = met(groups).filter("source < other").select("lang", low, high, F.coalesce(neither * F.abs(F.col("zero") - F.col("other_zero")), F.lit(0)).alias("value"))
    left = priced.select("lang", "term", "source", "zero", "p")
    right = priced.select("lang", "term", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.col("p").alias("other_p"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = left.join(right, ["lang", "term"]).filter("source < other")
    corrected = gap("p", "other_p") - gap("p", "other_zero") - gap("zero", "other_p") + gap("zero", "other_zero")
    overlap = both.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), corrected.alias("value"))
    overlap = overlap.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    summed = one_sided.union(constant).union(overlap).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    distances = summed.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return distances.withColumn("rank", F.row_number().over(order))
