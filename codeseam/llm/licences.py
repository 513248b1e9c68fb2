"""License scans: ordered signature rules, gated by keywords, overlaps resolved by priority and containment.

Everything runs as DataFrame expressions.  A text is searched only where one alternation over all keywords matches it;
each keyword found opens the rules of its own, and only those regexes run on that text.  A keyword is a word that the
rule's regex cannot match without, so the gates lose no detection.  Detections are spans of the
text.  A detection is suppressed when a better one (higher priority, then longer, then earlier rule) contains its span.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeseam.llm.common import written
from codeseam.llm.licence_rules import CREATIVE, IDENTIFIERS, LEAD, NAMES, NOTICES

#: A word of the contract, on text of any case (A-Z count as a-z).
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_EDGE_BEFORE = r"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
_EDGE_AFTER = r"(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
#: Phrases of the contract and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    rule_id: int
    label: str
    keyword: str  # lower case; the rule runs only on texts that hold it
    regex: str  # matched without regard to case
    priority: int  # 1 identifier, 2 full notice, 3 name and version, 4 name alone, 5 hint
    weight: float
    whole: bool = False  # the keyword stands as a word of the folded text, not just within it


def _phrase(pattern: str) -> str:
    """The regex of a pattern: its spaces are runs of marks and spaces, `` ~ `` up to 24 words, and it stands at word edges."""
    spaced = pattern.replace(" ?", "\0").replace(" ~ ", "\1").replace(" ", GAP).replace("\0", f"(?:{GAP})?")
    spaced = spaced.replace("\1", f"{GAP}(?:{WORD}{GAP}){{0,24}}?")
    return f"{_EDGE_BEFORE}(?:{spaced}){_EDGE_AFTER}"


def rules() -> list[Rule]:
    """The ordered rules: base phrases, identifiers, notices, names, Creative Commons."""
    out: list[Rule] = []

    def add(label: str, keyword: str, regex: str, priority: int, weight: float, whole: bool = True) -> None:
        out.append(Rule(len(out), label, keyword, regex, priority, weight, whole))

    for words, label in BASE:
        add(label, "cc" if label == "cc-by" else words.split()[-1], _phrase(words), 4, 0.5)
    for line in IDENTIFIERS.split("|"):
        name, label = line.split()
        add(label, "spdx", rf"spdx-license-identifier:\s*(?:\(\s*)?{re.escape(name)}\+?(?![A-Za-z0-9.+-])", 1, 1.0, whole=False)
    for label, keyword, priority, weight, pattern in (*NOTICES, *NAMES):
        add(label, keyword, _phrase(pattern), priority, weight)
    for label, parts, name in CREATIVE:
        short, tail = parts.replace("-", " "), rf"(?!{GAP}(?:sa|nc|nd)\b)"  # the shorter names are not read into the longer ones
        longer = rf"(?!{GAP}(?:share|non|no{GAP}?deriv))"
        add(label, "spdx", rf"spdx-license-identifier:\s*cc-{parts}-[0-9.]+", 1, 1.0, whole=False)
        add(label, "creativecommons", rf"creativecommons\.org/licenses/{parts}/[0-9.]+", 1, 1.0, whole=False)
        add(label, "cc", _phrase(f"{LEAD}cc {short}") + tail, 4, 0.7)
        add(label, "cc", _phrase(f"{LEAD}cc {short} [1-4] [0-9]"), 3, 0.9)
        add(label, "creative", _phrase(f"{LEAD}creative commons {name}") + longer, 3, 0.9)
        add(label, "creative", _phrase(f"{LEAD}creative commons {name} (?:[1-4] [0-9]|international|unported|licen[sc]e)"), 2, 0.95)
    return out


def _fold(keyword: str) -> str:
    return keyword.translate({ord(a): b for a, b in zip(_ASCII, _FOLDED)})


def _held(low: Column, table: list[Rule]) -> Column:
    """The keywords of the table that the folded text holds: one pass over its words, and a search for each part."""
    whole = sorted({r.keyword for r in table if r.whole})
    parts = sorted({r.keyword for r in table if not r.whole})
    words = F.array_intersect(F.array(*map(F.lit, whole)).cast("array<string>"), F.split(low, " +", -1))
    return F.array_distinct(F.concat(words, F.array_compact(F.array(*(F.when(F.contains(low, F.lit(_fold(k))), F.lit(k)) for k in parts)).cast("array<string>"))))


def gate(low: Column, table: list[Rule]) -> Column:
    """Whether any rule can match the folded text: one alternation over the table's keywords, so that the text is
    computed and walked once."""
    by: dict[str, list[str]] = {}
    for k in sorted({r.keyword for r in table if r.whole}):
        by.setdefault(k[0], []).append(re.escape(k[1:]))
    whole = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items())
    parts = sorted({re.escape(_fold(r.keyword)) for r in table if not r.whole})
    return low.rlike("|".join([*([rf"(?<![^ ])(?:{whole})(?![^ ])"] if whole else []), *parts]))


_ASCII = "".join(map(chr, range(128)))
#: What each ASCII character becomes: letters lower case, digits themselves, anything else a space.
_FOLDED = "".join(c.lower() if c.isalnum() else " " for c in _ASCII)


def folded(text: Column) -> Column:
    """The text with A-Z lowered and every ASCII mark a space: the contract's words are its runs without a space."""
    return F.translate(text, _ASCII, _FOLDED)


def _places(width: int, n_words: Column) -> Callable[[Column], Column]:
    """(n, first, last) of what separates the pieces of a text, ``width`` words each time."""

    def of(pieces: Column) -> Column:
        n, count = F.size(pieces) - 1, lambda k: F.regexp_count(F.element_at(pieces, F.lit(k)), F.lit("[^ ]+"))
        first, last = F.when(n > 0, count(1)), F.when(n > 0, n_words - count(-1) - width)
        return F.struct(n.cast("bigint").alias("n"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))

    return of


def _base_places(words: Column, n_words: Column) -> list[tuple[str, Column]]:
    """For each base phrase its label and (n, first, last): how often it stands in folded text, and its first and last word
    position (null: nowhere).

    The text is cut at the phrase.  What lies before the first cut and after the last one tells both positions, so the work
    is in proportion to the text however often the phrase stands there.
    """
    # two spaces between words, so that places beside each other don't share one
    spaced = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), " +", "  ")
    out = []
    for phrase, label in BASE:
        pieces = F.split(spaced, f" {phrase.replace(' ', '  ')} ", -1)
        # an array of one, so that the text is cut once
        out.append((label, F.element_at(F.transform(F.array(pieces), _places(len(phrase.split()), n_words)), 1)))
    return out


def detections(df: DataFrame, id_col: str, text_col: str, table: list[Rule] | None = None) -> DataFrame:
    """(id, label, rule_id, priority, weight, start, end, matched): the detections left after suppression."""
    table = table if table is not None else rules()
    rows = [(r.keyword, r.rule_id, r.label, "(?is)" + r.regex, r.priority, r.weight) for r in table]
    # as many rows as there are rules
    book = df.sparkSession.createDataFrame(rows, "keyword string, rule_id int, label string, regex string, priority int, weight double")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), folded(F.col(text_col)).alias("low"))
    texts = texts.filter(gate(F.col("low"), table))
    runs = texts.select("id", "t", F.explode(_held(F.col("low"), table)).alias("keyword")).join(F.broadcast(book), "keyword")
    runs = runs.withColumn("hits", F.expr("regexp_extract_all(t, regex, 0)")).filter("size(hits) > 0")
    runs = runs.withColumn("gaps", F.expr("split(t, regex, -1)"))
    # a hit starts behind all gaps up to its own and all hits before it: a running sum over the hits of a text and rule
    cut = runs.select("id", "label", "rule_id", "priority", "weight", F.posexplode(F.arrays_zip("gaps", "hits")).alias("k", "x")).filter("x.hits is not null")
    length = F.length("x.gaps") + F.length("x.hits")
    upto = F.sum(length).over(Window.partitionBy("id", "rule_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    found = cut.repartition("id").select("id", "label", "rule_id", "priority", "weight", (upto - F.length("x.hits")).alias("start"), upto.alias("end"), F.col("x.hits").alias("matched"))
    return suppress(found, sorted({r.priority for r in table}))


def suppress(found: DataFrame, priorities: list[int]) -> DataFrame:
    """Drop detections contained in the span of a better one of the same text.

    Better: smaller priority, then longer, then smaller rule_id.  With rows ordered by start, a row is contained when
    some row at or before its start ends at or after its end, so one running maximum for each priority decides.
    """
    upto = Window.partitionBy("id").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("id", "priority").orderBy("start", F.desc("end"), "rule_id").rowsBetween(Window.unboundedPreceding, -1)
    out = found
    for p in priorities:
        out = out.withColumn(f"_end{p}", F.max(F.when(F.col("priority") == p, F.col("end"))).over(upto))
    out = out.withColumn("_own", F.max("end").over(before))
    worse = F.coalesce(F.col("_own") >= F.col("end"), F.lit(False))
    for p in priorities:
        worse = worse | F.coalesce((F.col("priority") > p) & (F.col(f"_end{p}") >= F.col("end")), F.lit(False))
    return out.filter(~worse).drop("_own", *(f"_end{p}" for p in priorities))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) per row of ``df``.

    Null and empty texts have no words and no labels.  Repeated rows give repeated rows, null ids stay null.  The
    score is the surest detection's weight, raised by agreeing ones (1 - product of 1 - weight over labels), 0 without.
    """
    table = table if table is not None else rules()
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("low", folded(F.col("t")))
    rows = rows.select(
        "doc_id", "t", "low", F.regexp_count("low", F.lit("[^ ]+")).cast("bigint").alias("n_words"), gate(F.col("low"), table).alias("open")
    )
    base_gate = "|".join(f"(?<![^ ]){p.replace(' ', ' +')}(?![^ ])" for p, _ in BASE)
    near = F.col("open") & F.col("low").rlike(base_gate)
    places = [F.when(near, found).alias(label) for label, found in _base_places(F.col("low"), F.col("n_words"))]
    facts = written(
        spark,
        rows.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "n_words", F.struct(*places).alias("base"), F.when(F.col("open"), F.col("t")).alias("t")),
        "licence-facts",
    )
    labels = detections(facts.filter("t is not null"), "__row", "t", table).groupBy("id", "label").agg(
        F.max("weight").alias("weight"), F.count("*").alias("n")
    ).groupBy("id").agg(
        F.collect_set("label").alias("found"), F.sum("n").alias("n"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("weight"), F.lit(1e-6)))))).alias("sure")
    )
    of = {label: F.col(f"base.`{label}`") for _, label in BASE}
    base = F.array_sort(F.array_compact(F.array(*(F.when(x["n"] > 0, label) for label, x in of.items()))))
    return facts.join(labels, F.col("__row") == F.col("id"), "left").select(
        "doc_id",
        "n_words",
        sum((F.coalesce(x["n"], F.lit(0)) for x in of.values()), F.lit(0)).cast("bigint").alias("n_base"),
        F.least(*(x["first"] for x in of.values())).alias("first_word"),
        F.greatest(*(x["last"] for x in of.values())).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("sure", F.lit(0.0)))).alias("score"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_detections"),
    )
