"""String functions: globs, names, paths, positions, line metrics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeseam.functions.fixed import EXTERNAL_PREFIXES, IMPORT_RELEVANCE, MODIFIERS

PASCAL, CAMEL, UPPER_SNAKE = r"^[A-Z][a-zA-Z0-9]*$", r"^[a-z][a-zA-Z0-9]*$", r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in s)


def glob_regex(glob: str, ignore_case: bool = False) -> str:
    """``*`` any run, ``?`` any one character, everything else itself; the whole string must match."""
    body = "".join(".*" if c == "*" else "." if c == "?" else _quoted(c) for c in glob)
    return f"(?s{'i' if ignore_case else ''})^{body}$"


def loose_glob_regex(glob: str) -> str:
    """The test-class glob: case doesn't matter and other regex characters keep their meaning."""
    return "(?i)^" + glob.replace("*", ".*").replace("?", ".") + "$"


def glob_match(column: Column, glob: str, ignore_case: bool = False) -> Column:
    """Match a glob; plain, prefix, suffix and infix globs become predicates that a scan can push down."""
    inner = glob.strip("*")
    if not ignore_case and "?" not in glob and "*" not in inner:
        head, tail = glob.startswith("*"), glob.endswith("*")
        if glob and not inner:
            return column.isNotNull()
        if not head and not tail:
            return column == glob
        if tail and not head:
            return F.startswith(column, F.lit(inner))
        if head and not tail:
            return F.endswith(column, F.lit(inner))
        return F.contains(column, F.lit(inner))
    return column.rlike(glob_regex(glob, ignore_case))


def package_of(name: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.lit(""))


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def erased(name: Column) -> Column:
    """Without array brackets and type arguments."""
    return F.regexp_replace(F.regexp_replace(name, r"<.*>", ""), r"\[\]", "")


def is_external(package: Column) -> Column:
    out = F.lit(False)
    for prefix in EXTERNAL_PREFIXES:
        out = out | F.startswith(package, F.lit(prefix))
    return out


def import_relevance(package: Column, ladder=IMPORT_RELEVANCE) -> Column:
    """Score of an import candidate by the first rung of the ladder that its package fits."""
    out = F.lit(None).cast("int")
    for how, text, score in reversed(ladder):
        fits = package == text if how == "=" else F.startswith(package, F.lit(text))
        out = F.when(fits, score).otherwise(out)
    return out


def join_path(prefix: Column, path: Column) -> Column:
    """One leading slash for each non-empty part, none trailing; ``/`` where nothing is left."""

    def norm(p: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.trim(p), F.lit("")), "/+", "/"), "^/|/$", "")
        return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit("/"), bare))

    whole = F.concat(norm(prefix), norm(path))
    return F.when(whole == "", F.lit("/")).otherwise(whole)


def modifiers(flags: Column) -> Column:
    """Modifier words of a bit set, in their fixed order."""
    return F.array_compact(F.array(*(F.when(flags.bitwiseAND(bit) != 0, F.lit(word)) for bit, word in MODIFIERS)))


def line_of(text: Column, offset: Column) -> Column:
    """Zero-based line of a character offset (the newlines before it)."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("bigint")


def column_of(text: Column, offset: Column) -> Column:
    """Zero-based column: characters back to the last newline."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)).cast("bigint")


def physical_lines(text: Column) -> Column:
    """Lines after the trailing empty ones are dropped; an empty text has one."""
    cut = F.regexp_replace(text, "\n+$", "")
    return F.when(text == "", F.lit(1)).when(cut == "", F.lit(0)).otherwise(F.size(F.split(cut, "\n", -1))).cast("bigint")


def blank_lines(text: Column) -> Column:
    cut = F.regexp_replace(text, "\n+$", "")
    blank = F.size(F.filter(F.split(cut, "\n", -1), lambda x: F.trim(x) == ""))
    return F.when(text == "", F.lit(1)).when(cut == "", F.lit(0)).otherwise(blank).cast("bigint")


def clamp(column: Column, low, high) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))
