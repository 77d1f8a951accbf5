"""JSON documents found in lines, in one pass.

A scanner reads a line at a time and keeps only what it must know to go on: the open
brackets and what may come next.  Strings, numbers and names end on their line, so
every line is read once, whatever the length of its document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    r'[ \t\r\n]*(?:(?P<string>"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")'
    r"|(?P<plain>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)"
    r"|(?P<mark>[{}\[\],:])|(?P<end>\Z))"
)
#: What may come next: a value, a value or ], a key or }, a key, a colon, a comma or the closing bracket.
VALUE, FIRST_VALUE, FIRST_KEY, KEY, COLON, COMMA = range(6)


class Open(NamedTuple):
    """An open bracket, and the line of the document that begins with it (-1: none does)."""

    bracket: str
    line: int


class Scanner:
    """Feeds on text line by line and tells (kind, chunk) of finished pieces.

    kind is json for a document over one or more lines, text for a line (or the rest of one) that is
    none.  The chunks of a text put together are the text.  A line that begins with a bracket and
    turns out to begin no document is text; what follows it is looked at anew.
    """

    def __init__(self, openings: str = "{["):
        self.openings = openings
        self.lines: list[str] = []
        self.stack: list[Open] = []
        self.expect = VALUE

    def feed(self, line: str) -> list[tuple[str, str]]:
        """Takes one line with its line feed."""
        return self._run([(False, line)])

    def finish(self) -> list[tuple[str, str]]:
        """What is left at the end: lines of a document that was never closed."""
        out: list[tuple[str, str]] = []
        while self.lines:
            out += self._run(self._given_back())
        return out

    def _given_back(self) -> list[tuple[bool, str]]:
        """The document's lines, the last first, each with whether it is known to be text.

        Brackets that are still open begin no document of their own either; documents that were closed are found again.
        """
        text = {o.line for o in self.stack} | {0}
        lines = [(i in text, x) for i, x in enumerate(self.lines)]
        self._clear()
        return lines[::-1]

    def _run(self, waiting: list[tuple[bool, str]]) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        while waiting:
            is_text, line = waiting.pop()
            if not self.stack:
                body = line.lstrip(" \t\r\n")
                if is_text or not body or body[0] not in self.openings:
                    out.append(("text", line))
                    continue
                if len(body) < len(line):
                    out.append(("text", line[: len(line) - len(body)]))
                    line = body
            self.lines.append(line)
            end = self._read(line)
            if end is None:
                continue
            if end < 0:
                waiting += self._given_back()
                continue
            out.append(("json", "".join(self.lines[:-1]) + line[:end]))
            self._clear()
            if end < len(line):
                waiting.append((False, line[end:]))
        return out

    def _clear(self) -> None:
        self.lines, self.stack, self.expect = [], [], VALUE

    def _read(self, line: str) -> int | None:
        """Where the document ends in this line; None: not in it; -1: it cannot be one."""
        at, number, first = 0, len(self.lines) - 1, True
        while True:
            found = _TOKEN.match(line, at)
            if found is None:
                return -1
            at, kind = found.end(), found.lastgroup
            if kind == "end":
                return None
            expect = self.expect
            if kind == "string":
                if expect in (FIRST_KEY, KEY):
                    self.expect = COLON
                elif expect in (VALUE, FIRST_VALUE):
                    self.expect = COMMA
                else:
                    return -1
            elif kind == "plain":
                if expect not in (VALUE, FIRST_VALUE):
                    return -1
                self.expect = COMMA
            else:
                mark = found["mark"]
                if mark in "{[":
                    if expect not in (VALUE, FIRST_VALUE):
                        return -1
                    self.stack.append(Open(mark, number if first else -1))
                    self.expect = FIRST_KEY if mark == "{" else FIRST_VALUE
                elif mark in "}]":
                    if self.stack[-1].bracket != ("{" if mark == "}" else "[") or expect not in (COMMA, FIRST_KEY if mark == "}" else FIRST_VALUE):
                        return -1
                    self.stack.pop()
                    self.expect = COMMA
                    if not self.stack:
                        return at
                elif mark == ":":
                    if expect != COLON:
                        return -1
                    self.expect = VALUE
                else:
                    if expect != COMMA:
                        return -1
                    self.expect = KEY if self.stack[-1].bracket == "{" else VALUE
            first = False

    def state(self) -> dict:
        """What another scanner needs to go on."""
        return {"lines": self.lines, "stack": [list(o) for o in self.stack], "expect": self.expect}

    @classmethod
    def resumed(cls, state: dict | None, openings: str = "{[") -> Scanner:
        own = cls(openings)
        if state:
            own.lines, own.stack, own.expect = list(state["lines"]), [Open(*o) for o in state["stack"]], state["expect"]
        return own


def split_lines(text: str) -> Iterator[str]:
    """The lines of a text, one at a time."""
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def walked(lines: Iterable[str], openings: str = "{[") -> Iterator[tuple[str, str]]:
    """(kind, chunk) of a text's lines as they are read, lines of text each for itself; put together they are the text."""
    scanner, held = Scanner(openings), None

    def read() -> Iterator[tuple[str, str]]:
        for line in lines:
            yield from scanner.feed(f"{line}\n")
        yield from scanner.finish()

    for piece in read():
        if held is not None:
            yield held
        held = piece
    # the text's end is no line feed
    yield held[0], held[1][:-1]


def pieces(text: str, openings: str = "{[") -> Iterator[tuple[str, str]]:
    """The same with text between documents in one piece."""
    between: list[str] = []
    for kind, chunk in walked(split_lines(text), openings):
        if kind == "text":
            between.append(chunk)
            continue
        if between:
            yield "text", "".join(between)
            between = []
        yield kind, chunk
    if between:
        yield "text", "".join(between)
