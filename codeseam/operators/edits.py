"""Text edits as rows: merging neighbours, safe order, crossings, application, differences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeseam.operators.running import running
from codeseam.operators.shared import stem


def merge_adjacent(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Islands (keys, island_start, island_end, pieces) of spans that touch or overlap, by a running end within each key."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = stem(df, "of")
    opens, island = f"{own}opens", f"{own}island"
    numbered = df.withColumn(opens, (reach.isNull() | (F.col(start) > reach)).cast("int"))
    numbered = numbered.withColumn(island, F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, island).agg(F.min(start).alias("island_start"), F.max(end).alias("island_end"), F.count("*").alias("pieces")).drop(island)


def bottom_up(df: DataFrame, file: str = "file", line: str = "line", column: str = "col") -> DataFrame:
    """Edits with ``position``, the order in which they apply safely: last first within a file."""
    order = Window.partitionBy(file).orderBy(F.desc(line), F.desc(column))
    return df.withColumn("position", F.row_number().over(order))


class CrossingEdits(ValueError):
    code = "INVALID_PARAMETER"


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Apply (start, length, new text) from the end backwards; edits that cross are refused, insertions keep their order."""
    limit = len(text) + 1
    ordered = sorted(enumerate(edits), key=lambda e: (-e[1][0], -e[0]))
    for _, (start, length, new) in ordered:
        if start < 0 or start + length > len(text) or start + length > limit:
            raise CrossingEdits(f"edit at {start} crosses another or the text's end")
        text = text[:start] + new + text[start + length :]
        limit = start
    return text


def apply_all(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, content) with each file's edits (file, start, length, new_text) applied."""
    both = files.groupBy("file").cogroup(edits.groupBy("file"))

    def run(f: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.start, r.length, r.new_text) for r in e.itertuples()]
        return pd.DataFrame({"file": f["file"], "content": [apply_edits(t, rows) for t in f["content"]]})

    return both.applyInPandas(run, "file string, content string")


def minimal_replacement(old: str, new: str) -> tuple[int, int, str] | None:
    """The one replacement between the common head and tail of two texts; None when they are equal."""
    if old == new:
        return None
    head = 0
    most = min(len(old), len(new))
    while head < most and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < most - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    return head, len(old) - tail - head, new[head : len(new) - tail]


# ---------------------------------------------------------------- in DataFrame terms


def crossings(edits: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The rows of ``edits`` that begin inside an earlier one of their key, with ``reach``, how far those before go.

    Earlier: by start, then end.  An edit that begins where another ends doesn't cross it, nor do insertions at one place.
    One sweep with the largest end so far, which is carried over ranges of a long key.
    """
    x = stem(edits, "_e")
    swept = running(edits.withColumn(f"{x}id", F.monotonically_increasing_id()), keys, [start, end, f"{x}id"], {f"{x}most": (end, "max")})
    # the largest end before a row is that up to the row before it
    reach = running(swept, keys, [start, end, f"{x}id"], {f"{x}reach": (f"{x}most", "lag")})
    out = reach.withColumn("reach", F.col(f"{x}reach")).filter(F.col(start) < F.col("reach"))
    return out.select(*(c for c in edits.columns if c != "reach"), "reach")


def applied(texts: DataFrame, edits: DataFrame, key: str, text: str, start: str = "start", end: str = "end", new: str = "new_text") -> DataFrame:
    """``texts`` with its edits applied to ``text``, as a table of pieces: what stands between edits, and what they put there.

    ``start`` and ``end`` are places between characters; null new text deletes.  Insertions at one place keep the order of
    their texts.  Edits must not cross (see ``crossings``) nor leave the text; keys of ``texts`` are distinct, null texts and
    texts without edits stay as they are.  The text is cut as code units of one width, so each piece costs its own length.
    """
    x = stem(texts, "_t")
    pieces = edits.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{x}key"))
    pieces = pieces.agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"), F.coalesce(new, F.lit("")).alias("t")))).alias(f"{x}pieces"))
    wide, own = F.encode(text, "UTF-32"), F.col(f"{x}pieces")
    cut = lambda units, a, b: F.decode(F.substring(units, 4 * a + 1, 4 * (b - a)), "UTF-32")
    before = lambda i: F.when(i > 0, F.get(own, i - 1)["b"]).otherwise(0)

    def spliced(units: Column) -> Column:
        parts = F.transform(own, lambda e, i: F.concat(cut(units, before(i), e["a"]), e["t"]))
        last = F.element_at(own, -1)["b"]
        return F.concat(F.array_join(parts, ""), cut(units, last, F.length(text)))

    made = F.element_at(F.transform(F.array(wide), lambda u: spliced(u)), 1)
    joined = texts.join(pieces, F.col(key) == F.col(f"{x}key"), "left")
    return joined.withColumn(text, F.when(own.isNull() | F.col(text).isNull(), F.col(text)).otherwise(made)).select(*texts.columns)


def common_prefix(a: Column, b: Column, most: int = 28) -> Column:
    """How many characters two texts begin with alike: doubled steps from 2 ** ``most`` down, each taken where the texts agree."""
    pair = F.array(F.struct(F.encode(a, "UTF-32").alias("a"), F.encode(b, "UTF-32").alias("b")))
    alike = lambda p: _alike(p["a"], p["b"], lambda t, n, step: 4 * n + 1, F.least(_units(p["a"]), _units(p["b"])), most)
    return F.element_at(F.transform(pair, alike), 1)


def _units(wide: Column) -> Column:
    """How many characters a text of four bytes each has."""
    return F.shiftright(F.octet_length(wide), 2)


def _alike(a: Column, b: Column, at: Callable[[Column, Column, Column], Column], size: Column, most: int = 28) -> Column:
    """The longest run of at most ``size`` characters in which two wide texts agree; ``at``: where in one the next ``step``
    characters after ``n`` stand.  A step costs its own length, whatever lies before it."""
    steps = F.array(*(F.lit(1 << k) for k in range(most, -1, -1)))
    agree = lambda n, p: F.substring(a, at(a, n, p), 4 * p) == F.substring(b, at(b, n, p), 4 * p)
    taken = lambda n, p, size: F.when((p <= size - n) & agree(n, p), n + p).otherwise(n)
    return F.element_at(F.transform(F.array(size), lambda most: F.aggregate(steps, F.lit(0), lambda n, p: taken(n, p, most))), 1)


def replacement(old: Column, new: Column) -> Column:
    """(start, length, new_text) of the one replacement between the common beginning and end; null where the texts are equal or one is null.

    Both texts are made wide once; the common end is compared from behind, so nothing is reversed.
    """
    behind = lambda t, n, step: F.octet_length(t) - 4 * (n + step) + 1

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        size = F.least(_units(a), _units(b))

        def cut(head: Column, tail: Column) -> Column:
            text = F.decode(F.substring(b, 4 * head + 1, 4 * (_units(b) - tail - head)), "UTF-32")
            return F.struct(head.alias("start"), (_units(a) - head - tail).alias("length"), text.alias("new_text"))

        def tailed(head: Column) -> Column:
            return F.element_at(F.transform(F.array(_alike(a, b, behind, size - head)), lambda tail: cut(head, tail)), 1)

        return F.element_at(F.transform(F.array(_alike(a, b, lambda t, n, step: 4 * n + 1, size)), tailed), 1)

    pair = F.array(F.struct(F.encode(old, "UTF-32").alias("a"), F.encode(new, "UTF-32").alias("b")))  # arrays of one bind what is used twice
    return F.when(old != new, F.element_at(F.transform(pair, of), 1))
