"""Tokens of Java source, with comments kept aside."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final "
    "finally float for goto if implements import instanceof int interface long native new package private protected public "
    "return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
PRIMITIVES = frozenset("boolean byte char short int long float double void".split())

_TOKEN = re.compile(
    r'''(?P<space>[ \t\f\r\n\x1a﻿]+)
      |(?P<comment>//[^\n]*|/\*.*?\*/)
      |(?P<text>"""[ \t\f]*\r?\n.*?(?<!\\)(?:\\\\)*""")
      |(?P<string>"(?:[^"\\\n]|\\.)*")
      |(?P<char>'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))+')
      |(?P<number>0[xX][0-9a-fA-F_.]*(?:[pP][+-]?[0-9_]+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[lLfFdD]?)
      |(?P<name>[^\W\d][\w$]*|\$[\w$]*)
      |(?P<op>->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<=|<<|\.\.\.|[(){}\[\];,.@=<>!~?:+\-*/&|^%])''',
    re.X | re.S,
)


class SyntaxProblem(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.message, self.at = message, at


@dataclass(slots=True)
class Token:
    kind: str  # name, keyword, op, string, text, char, number, end
    text: str
    start: int
    end: int


def tokens(source: str) -> tuple[list[Token], list[tuple[int, int, str]]]:
    """Tokens (an end token last) and comments (start, end, kind)."""
    out, comments, at = [], [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise SyntaxProblem(f"unexpected character {source[at]!r}", at)
        kind, text = m.lastgroup, m[0]
        if kind == "comment":
            what = "javadoc" if text.startswith("/**") and text != "/**/" or text.startswith("///") else "line" if text.startswith("//") else "block"
            comments.append((at, m.end(), what))
        elif kind != "space":
            if kind == "name" and text in KEYWORDS:
                kind = "keyword"
            out.append(Token(kind, text, at, m.end()))
        at = m.end()
    out.append(Token("end", "", at, at))
    return out, comments
