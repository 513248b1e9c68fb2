"""Surrogates for personal data and secrets.

Entities are found by patterns opened by cheap substring tests.  Each gets a keyed replacement of its own type, script,
gender and format: digits stay digits, card numbers keep their length, brand digit and check digit, addresses fall in
reserved ranges, names follow the letters' script and the gender that titles tell.  The same entity gets the same surrogate
everywhere (email domains and name parts have surrogates of their own, so partial mentions agree).  A name is one entity
under whatever title: its gender is the one that any mention in the corpus tells, and none where they tell both.
Persons are found after a title, and where the name comes again; names with an apostrophe after one letter aren't, nor are
IPv6 addresses.

*Collision checks.*  A first pass gathers, for every distinct entity, keyed digests of itself and of its first
``ATTEMPTS`` possible surrogates (no plain text leaves the task).  Where two entities would share a surrogate, or a
surrogate equals some entity of the corpus, all but one move on to their next attempt until none is left.  Later attempts
draw from ever wider spaces, and those beyond the gathered ones are made on demand, so there is no last attempt.  Only entities
beyond their first attempt are sent back to the second pass: by broadcast up to ``SENT`` of them, by a join above.
"""

from __future__ import annotations

import re
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codeseam.llm.common import fresh, record_batch, release, slices, written

ATTEMPTS = 8
SENT = 200_000
#: Names the secret key in the session; without it every call draws one of its own, so surrogates differ from run to run.
KEY_SETTING = "spark.codeseam.surrogate.key"
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

#: title -> gender; the names after it are a person's
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Sir": "m", "Herr": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
_NAME = r"[^\W\d_a-z][^\W\d_]+(?:[-'’][^\W\d_]+)?"
PERSON = re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ \t]+({_NAME}(?:[ \t]+{_NAME}){{0,2}})")
EMAIL = re.compile(r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
#: Tried in this order where a digit run or a plus stands; the first that fits wins.
NUMBERS: list[tuple[str, re.Pattern]] = [
    ("ip", re.compile(r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)")),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"[3-6]\d{3}(?:([ -])\d{4}\1\d{4}\1\d{4}|[ -]?\d{6}[ -]?\d{5}|\d{9,15})(?![\w-])")),
    ("phone", re.compile(r"\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\w|[.\-]\d)")),
    ("phone", re.compile(r"\+(?!1\D)\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w|[.\-]\d)")),
    ("phone", re.compile(r"\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?![\w])")),
    ("phone", re.compile(r"\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\w-])")),
]
_WORD = re.compile(r"\w+")
_NUMBER_START = re.compile(r"\+?\(?\d")
SECRETS: list[tuple[tuple[str, ...], re.Pattern]] = [
    (("AKIA", "ASIA"), re.compile(r"(?<![A-Za-z0-9])A(?:KIA|SIA)([0-9A-Z]{16})(?![A-Za-z0-9])")),
    (("ghp_", "gho_", "ghs_", "github_pat_"), re.compile(r"(?:gh[pos]_|github_pat_)([A-Za-z0-9_]{20,})")),
    (("xox",), re.compile(r"xox[abprs]-([A-Za-z0-9\-]{10,})")),
    (("sk-", "sk_"), re.compile(r"(?<![A-Za-z0-9])sk[-_](?:live[-_]|test[-_]|proj-)?([A-Za-z0-9_\-]{16,})")),
    (("AIza",), re.compile(r"AIza([0-9A-Za-z_\-]{35})")),
    (("eyJ",), re.compile(r"eyJ([A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+)")),
    (("PRIVATE KEY",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END [A-Z ]*PRIVATE KEY-----")),
    (
        ("token", "passw", "secret", "api_key", "apikey", "api-key", "access_key", "Token", "Passw", "Secret", "TOKEN", "PASSW", "SECRET", "API_KEY", "pwd"),
        re.compile(r"(?i)(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{6,})"),
    ),
]
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
HEX = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[0-9A-F]{32,64}(?![A-Za-z0-9])")


def session_key(spark: SparkSession) -> bytes:
    """The secret that surrogates hang on: from the session, else a new one.  No key stands in the source."""
    held = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    return blake2b(held.encode(), digest_size=32).digest() if held else secrets.token_bytes(32)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities as (start, end, type, detail), by start, without overlaps; earlier kinds win."""
    spans: list[tuple[int, int, str, str]] = []
    starts: list[int] = []  # of the spans taken, and their ends, by start
    ends: list[int] = []

    def take(a: int, b: int, kind: str, detail: str = "") -> bool:
        i = bisect_left(starts, a)
        if i and ends[i - 1] > a or i < len(starts) and starts[i] < b:
            return False
        starts.insert(i, a)
        ends.insert(i, b)
        spans.append((a, b, kind, detail))
        return True

    for signs, pattern in SECRETS:
        if any(s in text for s in signs):
            for m in pattern.finditer(text):
                take(*m.span(1), "secret")
    if "@" in text:
        for m in EMAIL.finditer(text):
            take(*m.span(), "email")
    if _has_digit(text):
        for m in IBAN.finditer(text):
            take(*m.span(1), "iban")
        for m in HEX.finditer(text):
            take(*m.span(), "secret")
        at = 0
        while m := _NUMBER_START.search(text, at):
            a = m.start()
            at = m.end()
            before = text[a - 1] if a else " "
            if before.isalnum() or before in "_.-" and text[a].isdigit():
                while at < len(text) and text[at].isdigit():  # the rest of a longer run is no start
                    at += 1
                continue
            for kind, pattern in NUMBERS:
                if (hit := pattern.match(text, a)) is not None:
                    take(a, hit.end(), kind)
                    at = hit.end()
                    break
            else:
                while at < len(text) and text[at].isdigit():
                    at += 1
    named: dict[str, str] = {}
    for title in TITLES:
        if title in text:
            for m in PERSON.finditer(text):
                gender = TITLES[m[1]]
                for part in re.finditer(r"\S+", m[2]):
                    if part[0][0].islower():  # the pattern knows lower case in ASCII only
                        break
                    if take(m.start(2) + part.start(), m.start(2) + part.end(), "name", gender):
                        named[part[0]] = gender
            break
    if named:  # later mentions without the title
        firsts: dict[str, list[str]] = {}
        for name in sorted(named, key=len, reverse=True):
            firsts.setdefault(_WORD.match(name)[0], []).append(name)
        for m in _WORD.finditer(text):
            for name in firsts.get(m[0], ()):
                if text.startswith(name, m.start()) and not _WORD.match(text, m.start() + len(name)):
                    take(m.start(), m.start() + len(name), "name", named[name])
                    break
    spans.sort()
    return spans


_DIGITS = re.compile(r"[0-9]")


def _has_digit(text: str) -> bool:
    return _DIGITS.search(text) is not None


def canonical(kind: str, raw: str) -> str:
    """What makes two mentions one entity."""
    if kind == "email":
        return raw.lower()
    if kind == "phone":  # with a plus, the first digits are a country's
        return "+" * raw.startswith("+") + re.sub(r"\D", "", raw)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", raw)
    if kind == "iban":
        return raw.replace(" ", "")
    return raw


class Stream:
    """Keyed pseudo-random choices for one entity and attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.turn, self.held = key, "\x1f".join(parts).encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 64:
            self.turn += 1
            self.held = int.from_bytes(blake2b(self.seed + self.turn.to_bytes(4, "big"), key=self.key[:64], digest_size=64).digest(), "big")
            self.left = 512
        self.held, out = divmod(self.held, n)
        self.left -= n.bit_length()
        return out

    def like(self, c: str, hexa: str = "") -> str:
        if hexa and c in hexa:
            return hexa[self.below(16)]
        if c in _DIGIT:
            return _DIGIT[self.below(10)]
        if c in _LOWER:
            return _LOWER[self.below(26)]
        if c in _UPPER:
            return _UPPER[self.below(26)]
        return c

    def more(self, n: int, c: str) -> str:
        """``n`` more characters like ``c``: what widens the space of a late attempt."""
        return "".join(self.like(c) for _ in range(n))


def script_of(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
        if c.isalpha() and c > "˿":
            return "other"
    return "latin"


#: script -> consonants, vowels, endings by gender ("" where the title tells none)
_SOUNDS = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"m": ("n", "r", "ro", "l"), "f": ("a", "ia", "ina", "elle"), "": ("n", "is", "ay")}),
    "cyrillic": ("бвгдклмнпрстз", "аеиоу", {"m": ("ов", "ин", "ий"), "f": ("ова", "ина", "ая"), "": ("ко", "ых")}),
    "greek": ("βγδκλμνπρστ", "αειο", {"m": ("ος", "ης", "ας"), "f": ("α", "η"), "": ("ου",)}),
}


#: Country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")


def _lead(number: str) -> int:
    """How many digits of a canonical phone number are a country code, which stays; none in very short numbers."""
    m = _COUNTRY.match(number)
    return min(len(m[1]), max(0, len(number) - 5)) if m else 0


def _name(s: Stream, raw: str, gender: str, attempt: int) -> str:
    """A name made of the folded original, so that it is the same but for its case for every writing of it."""
    upper, raw = raw.isupper(), raw.casefold()
    script = script_of(raw)
    if script == "other":  # letters moved within their own block
        out = "".join(chr((ord(c) & ~0x3F) + s.below(64)) if c.isalpha() and chr((ord(c) & ~0x3F)).isalpha() else s.like(c) for c in raw)
        out += s.more(attempt // 2, "a")
        return out.upper() if upper else out.capitalize()
    consonants, vowels, ends = _SOUNDS[script]
    end = ends[gender][s.below(len(ends[gender]))]
    count = max(2, min(4, len(raw) // 3)) + attempt // 2
    out = "".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))] for _ in range(count))
    if end[0] in vowels:
        out = out[:-1]
    out += end
    return out.upper() if upper else out.capitalize()


def surrogate(kind: str, raw: str, detail: str, attempt: int, key: bytes) -> str:
    """The replacement of one mention; mentions of one entity differ in writing only where their originals do."""
    name = canonical(kind, raw)
    wider, widest = attempt // 2, max(0, attempt - ATTEMPTS + 1)  # more characters where spaces are small or vast
    s = Stream(key, kind, name if kind != "name" else raw.casefold(), detail if kind == "name" else "", str(attempt))
    if kind == "email":
        local, domain = name.rsplit("@", 1)
        d = Stream(key, "domain", domain, str(attempt // 4))
        made = "".join(s.like(c) for c in local) + "".join(s.like("a") for _ in range(max(0, 5 - len(local)) + attempt // 2))
        host = "".join(d.like(c) for c in domain.rsplit(".", 1)[0].replace(".", "-"))
        return f"{made}@{host}.example"
    if kind == "ip":
        if widest:  # the reserved range may be full: the documentation range of IPv6
            return "2001:db8:" + ":".join(f"{s.below(65536):x}" for _ in range(6)) + s.more(widest // ATTEMPTS, "0")
        return f"{240 + s.below(16)}.{s.below(256)}.{s.below(256)}.{s.below(256)}"
    if kind == "card":
        made = name[0] + "".join(_DIGIT[s.below(10)] for _ in name[1:-1]) + s.more(widest, "0")
        valid = _luhn(name)
        tries = [d for d in _DIGIT if _luhn(made + d) == valid]
        return _laid(raw, made + tries[s.below(len(tries))])
    if kind == "ssn":
        return _laid(raw, f"9{s.below(100):02d}{s.below(100):02d}{s.below(10000):04d}" + s.more(widest, "0"))
    if kind == "phone":
        lead, digits = _lead(name), name.lstrip("+")
        rest = [str(2 + s.below(8)) if i == lead else _DIGIT[s.below(10)] for i in range(lead, len(digits))]
        return _laid(raw, digits[:lead] + "".join(rest) + s.more(wider, "0"))
    if kind == "iban":
        body = "".join(s.like(c) for c in name[4:]) + s.more(widest, "0")
        value = int("".join(str(int(c, 36)) for c in body + name[:2] + "00"))
        return _laid(raw, f"{name[:2]}{98 - value % 97:02d}{body}", keep=" ")
    if kind == "name":
        return _name(s, raw, detail, attempt)
    lower, upper = re.fullmatch(r"[0-9a-f]+", raw), re.fullmatch(r"[0-9A-F]+", raw)
    hexa = _DIGIT + "abcdef" if lower else _DIGIT + "ABCDEF" if upper else ""
    # marks stay at first only; letters of other alphabets would tell the secret
    kept = str.isspace if attempt else lambda c: c < "\x80" or c.isspace()
    made = "".join(s.like(c, hexa) if c.isascii() and c.isalnum() or kept(c) else s.like("a") for c in raw)
    return made + ("".join(s.like("0", hexa) for _ in range(wider)) if hexa else s.more(wider, "a"))


def _laid(raw: str, made: str, keep: str = "") -> str:
    """``made``'s characters in the places of ``raw``'s digits (or, with ``keep``, of all but those characters), then the rest."""
    at = iter(made)
    return "".join([c if (c in keep if keep else not c.isdigit()) else next(at) for c in raw] + list(at))


def digest(kind: str, name: str, key: bytes) -> bytes:
    return blake2b(f"{kind}\x1f{name}".encode(), key=key[:64], digest_size=16).digest()


def entity_key(kind: str, raw: str, key: bytes) -> bytes:
    """What readers take for one entity and what has one surrogate: for a name, the name under whatever title and case."""
    return digest(kind, raw.casefold() if kind == "name" else canonical(kind, raw), key)


def surrogate_key(kind: str, raw: str, detail: str, attempt: int, key: bytes) -> bytes:
    return entity_key(kind, surrogate(kind, raw, detail, attempt, key), key)


#: What a mention's title tells; a name's surrogates are made for each, since only all mentions tell which it is.
GENDERS = ("", "m", "f")


def settled_gender(told: set[str]) -> str:
    """One gender for all mentions of a name: the one that any of them tells, none where they tell both."""
    known = told - {""}
    return known.pop() if len(known) == 1 else ""


# ---------------------------------------------------------------- the corpus


def entities(df: DataFrame, text_col: str, key: bytes, start: int = 0) -> DataFrame:
    """(key, made, gender, mixed): digests of each distinct entity and of its ``ATTEMPTS`` possible surrogates from attempt
    ``start``; for names the place in ``GENDERS`` of the one that all mentions together tell, and whether some tell another."""
    schema = pa.schema([("key", pa.binary()), ("made", pa.list_(pa.binary())), ("told", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found: dict[bytes, list[bytes]] = {}
            told: dict[bytes, int] = {}
            for text in (t for part in slices([batch]) for t in part.column(0).to_pylist()):
                for a, b, kind, detail in find(text or ""):
                    raw = text[a:b]
                    k = entity_key(kind, raw, key)
                    told[k] = told.get(k, 0) | (1 << GENDERS.index(detail))
                    if k not in found:
                        kinds = GENDERS if kind == "name" else ("",)
                        found[k] = [surrogate_key(kind, raw, g, n, key) for g in kinds for n in range(start, start + ATTEMPTS)]
            yield record_batch(schema, list(found), list(found.values()), list(told.values()))

    rows = df.select(F.col(text_col).alias("t")).mapInArrow(run, "key binary, made array<binary>, told int")
    rows = rows.groupBy("key").agg(F.min("made").alias("made"), F.bit_or("told").alias("told"))
    known = F.col("told").bitwiseAND(F.lit(6))
    gender = F.when(known == 2, 1).when(known == 4, 2).otherwise(0)
    made = F.when(F.size("made") > ATTEMPTS, F.slice("made", gender * ATTEMPTS + 1, ATTEMPTS)).otherwise(F.col("made"))
    return rows.select("key", made.alias("made"), gender.alias("gender"), (~F.col("told").isin(1, 2, 4)).alias("mixed"))


def settle(spark: SparkSession, found: DataFrame, later: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """(key, attempt) of the entities whose first surrogate is taken; all surrogates are then distinct and new.

    ``later`` gives (key, made) from an attempt on; it is asked only where the attempts of ``found`` do not suffice.
    """
    now = written(spark, found.select("key", "made", F.lit(0).alias("attempt"), F.lit(0).alias("start")), "pii-attempts")
    keys = now.select(F.col("key").alias("now")).distinct()  # no surrogate may be what is written somewhere
    while True:
        now_at = now.withColumn("now", F.element_at("made", F.col("attempt") - F.col("start") + 1))
        order = Window.partitionBy("now").orderBy("attempt", "key")
        ranked = now_at.withColumn("place", F.row_number().over(order)).join(keys.withColumn("real", F.lit(True)), "now", "left")
        clash = (F.col("place") > 1) | F.col("real").isNotNull()
        moved = written(spark, ranked.select("key", "made", "start", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")), "pii-settled")
        if moved.filter("clash").isEmpty():
            break
        now = moved.drop("clash")
        done = F.col("attempt") - F.col("start") >= F.size("made")
        starts = [r["attempt"] for r in now.filter(done).select("attempt").distinct().collect()]  # one for each ATTEMPTS tried
        if starts and later is None:
            raise RuntimeError("an entity has no free surrogate left")
        for start in starts:
            out = done & (F.col("attempt") == start)
            fresh = now.filter(out).select("key", F.lit(start).alias("start"), "attempt").join(later(start), "key").select("key", "made", "start", "attempt")
            now = now.filter(~out).select("key", "made", "start", "attempt").union(fresh)
        if starts:
            now = written(spark, now, "pii-later")
    return moved.filter("attempt > 0").select("key", "attempt")


_ENTITY = pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _replacer(names: list[str], where: int, key: bytes, attempts: Callable[[], dict], moved_at: int | None, report: tuple[str, str] | None):
    """Rewrite column ``where``; under the names of ``report`` add how many surrogates there are and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sent, memo = attempts(), {}
        for batch in slices(batches):
            texts, told = [], []
            moved = batch.column(moved_at).to_pylist() if moved_at is not None else None
            for i, text in enumerate(batch.column(where).to_pylist()):
                spans = find(text or "")
                own = {k: (x["attempt"], x["gender"]) for k, x in moved[i] or ()} if moved else sent
                parts, at, size, places = [], 0, 0, []
                for a, b, kind, detail in spans:
                    raw = text[a:b]
                    made = memo.get((kind, raw, detail)) if not moved else None
                    if made is None:
                        attempt, gender = own.get(entity_key(kind, raw, key), (0, None))
                        made = surrogate(kind, raw, detail if gender is None else GENDERS[gender], attempt, key)
                        if len(memo) > 100_000:
                            memo.clear()
                        memo[(kind, raw, detail)] = made
                    parts += [text[at:a], made]
                    size += a - at
                    places.append({"type": kind, "start": size, "end": size + len(made)})
                    size += len(made)
                    at = b
                texts.append("".join([*parts, text[at:]]) if spans else text)
                told.append(places)
            out = [batch.column(i) for i in range(len(names))]
            out[where] = pa.array(texts, pa.string())
            if report:
                out += [pa.array([len(x) for x in told], pa.int64()), pa.array(told, pa.list_(_ENTITY))]
            yield pa.RecordBatch.from_arrays(out, names=[*names, *(report or ())])

    return run


def surrogates(
    spark: SparkSession, df: DataFrame, text_col: str = "text", key: bytes | None = None, report: tuple[str, str] | None = None, sent: int = SENT
) -> DataFrame:
    """``df`` with the text's entities replaced, and under the two names of ``report`` their number and places in the new text.

    ``key`` is the session's unless given.  All columns stay, whatever their names.  Null texts stay null, empty ones
    empty; texts without entities stay as they are to the byte.  Repeated rows and ids don't matter, and very long texts
    are read whole; an empty table gives an empty result.
    """
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    names, key = df.columns, key or session_key(spark)
    where = names.index(text_col)
    added = []
    if report:
        place = StructType([StructField("type", StringType()), StructField("start", LongType()), StructField("end", LongType())])
        added = [StructField(report[0], LongType()), StructField(report[1], ArrayType(place))]
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in df.schema.fields), *added])
    found = written(spark, entities(df, text_col, key), "pii-entities")
    moved = settle(spark, found, lambda start: entities(df, text_col, key, start))
    # where mentions tell different genders, the settled one travels too; elsewhere each mention tells it
    mixed = found.filter("mixed").select("key", "gender")
    moved = written(spark, moved.join(mixed, "key", "full").select("key", F.coalesce("attempt", F.lit(0)).alias("attempt"), "gender"), "pii-moved")
    few = moved.limit(sent + 1).collect()
    if len(few) <= sent:  # bounded: at most `sent` digests and numbers
        table = spark.sparkContext.broadcast({bytes(r["key"]): (r["attempt"], r["gender"]) for r in few})
        return df.mapInArrow(_replacer(names, where, key, lambda: table.value, None, report), schema)
    uid, moves = fresh(df, "uid"), fresh(df, "moves")
    rows = written(spark, df.withColumn(uid, F.monotonically_increasing_id()), "pii-docs")
    listing = pa.schema([("uid", pa.int64()), ("key", pa.binary())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {(u, entity_key(k, t[a:b], key)) for u, t in zip(*(c.to_pylist() for c in batch.columns)) for a, b, k, _ in find(t or "")}
            yield record_batch(listing, *(zip(*out) if out else ([], [])))

    own = rows.select(uid, F.col(text_col).alias("t")).mapInArrow(keys, "uid bigint, key binary").join(moved, "key")
    own = own.groupBy(F.col("uid").alias(uid)).agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("attempt", "gender")))).alias(moves))
    joined = rows.join(own, uid, "left").select(*names, moves)
    return joined.mapInArrow(_replacer(names, where, key, dict, len(names), report), schema)


def surrogate_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_entities, entities) of the rewritten documents; entities give types and places in the new text."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return surrogates(spark, texts, report=("n_entities", "entities"))
