"""Text to tokens."""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""\s+
    | (?P<number>\d+\.\d+|\d+)
    | (?P<string>'[^']*'|"[^"]*")
    | `(?P<quoted>[^`]*)`
    | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
    | (?P<sign>->>|->|<=|>=|!=|<>|[-+*/=<>(),.?$])
    """,
    re.X,
)


class Token(NamedTuple):
    kind: str
    text: str
    at: int


class ParseError(SyntaxError):
    """The text isn't in the dialect."""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at} in {text!r}")
        if m.lastgroup:
            value = m[m.lastgroup]
            kind = "word" if m.lastgroup == "quoted" else m.lastgroup
            out.append(Token("name" if m.lastgroup == "quoted" else kind, value[1:-1] if kind == "string" else value, at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
