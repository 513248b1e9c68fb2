"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

All of it is DataFrame expressions.  The template lists each role's opening and closing control strings and whether its
texts are learned from; roles it doesn't know are written out with their name.  A control string inside a text gets a
mark (U+2060) after its first character, and one mark more where it has some already, so texts come back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MARK = "⁠"


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("[SYS]", "[/SYS]"),
            "user": Role("[INST]", "[/INST]"),
            "assistant": Role("<s>", "</s>", loss=True),
        }
    )
    #: Around the name of a role that is not listed, and its text.
    other: tuple[str, str, str, str] = ("[ROLE]", "[/ROLE]", "[MSG]", "[/MSG]")
    #: state -> role -> next state; a turn without an entry is out of order.
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepts: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        out = [x for r in self.roles.values() for x in (r.opens, r.closes)] + list(self.other)
        for c in out:
            if len(c) < 2 or any(c[0] in o[1:] for o in out):
                raise ValueError(f"a control string's first character may stand only first: {c}")
        return sorted(set(out), key=lambda c: (-len(c), c))


def _literal(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in s)


def _patterns(template: Template) -> str:
    heads = sorted({c[0] for c in template.controls()})
    by_head = ["(?:" + "|".join(_literal(c[1:]) for c in template.controls() if c[0] == h) + ")" for h in heads]
    return [(_literal(h), tails) for h, tails in zip(heads, by_head)]


def escape(text: Column, template: Template) -> Column:
    for head, tails in _patterns(template):
        text = F.regexp_replace(text, f"({head})({MARK}*)(?={tails})", f"$1{MARK}$2")
    return text


def unescape(text: Column, template: Template) -> Column:
    for head, tails in _patterns(template):
        text = F.regexp_replace(text, f"({head}){MARK}({MARK}*)(?={tails})", "$1$2")
    return text


def _turn_segments(turn: Column, template: Template) -> Column:
    """Segments of one turn: what opens it, its text, what closes it."""
    text = escape(turn["text"], template)
    a, b, c, d = template.other
    piece = lambda t, loss: F.struct(t.alias("text"), F.lit(loss).alias("loss"))
    out = F.array(piece(F.concat(F.lit(a), escape(turn["role"], template), F.lit(b), F.lit(c)), False), piece(text, False), piece(F.lit(d), False))
    for name, role in template.roles.items():
        own = F.array(piece(F.lit(role.opens), False), piece(text, role.loss), piece(F.lit(role.closes), False))
        out = F.when(turn["role"] == name, own).otherwise(out)
    return out


def _walk(turns: Column, template: Template) -> Column:
    """The machine over the roles: its last state and the first turn out of order (-1: none)."""
    states = list(template.order) + [s for s in template.accepts if s not in template.order]

    def step(acc: Column, turn: Column) -> Column:
        to = F.lit(None).cast("string")
        for state, moves in template.order.items():
            for role, nxt in moves.items():
                to = F.when((acc["state"] == state) & (turn["role"] == role), F.lit(nxt)).otherwise(to)
        bad = (acc["bad"] < 0) & to.isNull()
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"), F.when(bad, acc["at"]).otherwise(acc["bad"]).alias("bad")
        )

    return F.aggregate(turns, F.struct(F.lit(states[0]).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad")), step)


def format_chats(df: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, segments, formatted, valid, bad_turn) for every conversation.

    ``df`` has conv_id, turn, role, text.  Rows go by turn, ties by role and text (nulls first); repeated rows are turns
    of their own.  Null texts and roles are empty; rows with a null conv_id are one conversation.  Conversations whose
    turns are out of order are formatted like any other and told apart by ``valid`` and ``bad_turn``.  Other columns are
    not read.
    """
    template = template or Template()
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    walked = _walk(F.col("turns"), template)
    rows = chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.flatten(F.transform("turns", lambda t: _turn_segments(t, template))).alias("segments"),
        walked.alias("walked"),
    )
    return rows.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join("segments.text", "").alias("formatted"),
        ((F.col("walked.bad") < 0) & F.col("walked.state").isin(*template.accepts)).alias("valid"),
        F.when(F.col("walked.bad") >= 0, F.col("walked.bad")).alias("bad_turn"),
    )


def parse_chats(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    template = template or Template()
    a, b, c, d = template.other
    opens = "|".join(_literal(x) for x in [*(r.opens for r in template.roles.values()), a])
    closes = "|".join(_literal(x) for x in [*(r.closes for r in template.roles.values()), d])
    turns = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{opens}).*?(?:{closes})"), F.lit(0))

    def read(turn: Column) -> Column:
        inner = F.substring(turn, F.lit(len(a) + 1), F.length(turn) - len(a) - len(d))
        at = F.instr(inner, b + c)
        role = F.substring(inner, F.lit(1), at - 1)
        text = F.substring(inner, at + len(b) + len(c), F.length(inner))
        out = F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))
        for name, r in template.roles.items():
            body = F.substring(turn, F.lit(len(r.opens) + 1), F.length(turn) - len(r.opens) - len(r.closes))
            own = F.struct(F.lit(name).alias("role"), unescape(body, template).alias("text"))
            out = F.when(F.startswith(turn, F.lit(r.opens)), own).otherwise(out)
        return out

    return F.transform(turns, read)


def chat_digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The contract's columns, read back from format_chats' output alone."""
    template = template or Template()
    rows = formatted.select(
        "conv_id",
        "formatted",
        "valid",
        "bad_turn",
        parse_chats(F.col("formatted"), template).alias("turns"),
        unescape_all(F.col("segments"), template).alias("learned"),
    )
    return rows.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


def unescape_all(segments: Column, template: Template) -> Column:
    """The text under the loss mask, segment after segment."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and the contract's conversation -7, whose texts are control strings themselves."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(probe)
