"""Tokens of the dialect: names keep their case, keywords are compared in upper case."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.errors import ParseError

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")
    |(?P<name>[^\W\d]\w*)|(?P<op><>|!=|<=|>=|\|\||::|->>|->|[-+*/%=<>(),.;\[\]])""",
    re.S | re.X,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text if self.kind == "op" else ""


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if m is None:
            raise ParseError(f"unexpected {sql[at : at + 10]!r}")
        at, kind, text = m.end(), m.lastgroup, m.group()
        if kind == "string":
            text = text[1:-1].replace("''", "'")
        elif kind == "quoted":
            text = text[1:-1].replace('""', '"')
        if kind != "space":
            out.append(Token(kind, text))
    return out
