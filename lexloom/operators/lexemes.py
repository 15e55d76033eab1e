"""Lexemes with positions, delimiter links and enclosing blocks."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from ..schema import MOST_DEPTH, cap

_OPENER = {")": "(", "}": "{", "]": "["}


@dataclass(slots=True)
class Lexeme:
    """A piece of a text, by character offsets."""

    start: int
    end: int
    text: str
    kind: str
    cls: str
    named: bool
    function: str = ""
    curly: int = 0
    round: int = 0
    bracket: int = 0


def links(kinds: list[str]) -> list[int | None]:
    """Partners of delimiters.  One stack serves all three; a closer that does
    not fit its top is ignored and removes nothing."""
    partner: list[int | None] = [None] * len(kinds)
    stack: list[int] = []
    for i, kind in enumerate(kinds):
        if kind in ("(", "{", "["):
            stack.append(i)
        elif kind in _OPENER and stack and kinds[stack[-1]] == _OPENER[kind]:
            j = stack.pop()
            partner[i], partner[j] = j, i
    return partner


def block_paths(kinds: list[str], partner: list[int | None]) -> list[list[int]]:
    """Openers of the matched braces around each token, below the root -1."""
    out, path = [], [-1]
    for i, kind in enumerate(kinds):
        if kind == "}" and partner[i] is not None:
            path = path[:-1]
        out.append(path)
        if kind == "{" and partner[i] is not None:
            path = [*path, i]
    return out


class Positions:
    """Byte offsets, lines and byte columns of character offsets."""

    def __init__(self, text: str):
        self.text = text
        self.plain = text.isascii()
        self.lines = [0]
        at = text.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = text.find("\n", at + 1)
        self.line_bytes = [0]
        if not self.plain:
            for a, b in zip(self.lines, self.lines[1:]):
                self.line_bytes.append(self.line_bytes[-1] + len(text[a:b].encode()))

    def of(self, at: int) -> tuple[int, int, int]:
        """(byte, line, column), lines and columns from 1."""
        line = bisect.bisect_right(self.lines, at) - 1
        if self.plain:
            return at, line + 1, at - self.lines[line] + 1
        into = len(self.text[self.lines[line] : at].encode())
        return self.line_bytes[line] + into, line + 1, into + 1


def token_rows(file: str, language: str, text: str, lexemes: list[Lexeme]) -> list[tuple]:
    """Rows of the tokens relation, in its column order."""
    kinds = [x.kind for x in lexemes]
    partner = links(kinds)
    paths = block_paths(kinds, partner)
    where = Positions(text)
    rows = []
    for i, x in enumerate(lexemes):
        start_byte, start_line, start_col = where.of(x.start)
        end_byte, end_line, end_col = where.of(x.end)
        depths = (min(d, MOST_DEPTH) for d in (x.curly, x.round, x.bracket))
        rows.append(
            (file, language, i, x.kind, x.cls, cap(x.text), x.function, x.named, start_byte, end_byte, start_line, start_col, end_line, end_col, *depths, partner[i], paths[i])
        )
    return rows
