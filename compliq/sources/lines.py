"""Text and Markdown to blocks: an automaton over lines.

Every rule is a method that looks at the current line and, if it applies, consumes lines and emits a block. The order of
the rules is their precedence.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

#: The forms of lines that the format defines. A heading by signs, with closing signs dropped.
ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
#: The line under a heading of the other kind.
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
#: A line across the page.
RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
#: The beginning of code, and its language.
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([\w+#.-]*)")
#: An item of a list: its bullet or number, its text.
ITEM = re.compile(r"[ \t]*(?:([-*+•])|(\d{1,3}[.)]))[ \t]+(\S.*)$")
#: A quoted line.
QUOTE = re.compile(r" {0,3}>[ \t]?(.*)$")
#: The row under a table's head.
DELIMITERS = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
#: The number of a heading in plain text.
NUMBERED = re.compile(r"(\d+(?:\.\d+)*)[.)]?\s+\S")
#: Inline markup and what stays of it, in this order.
INLINE = [
    (re.compile(r"<!--.*?-->", re.S), ""), (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]+)\]\([^)]*\)"), r"\1"),
    (re.compile(r"<(https?://[^>\s]+)>"), r"\1"), (re.compile(r"(`+)(.+?)\1"), r"\2"), (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.S), r"\2"),
    (re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S), r"\1"), (re.compile(r"\*(?=\S)(.+?)(?<=\S)\*", re.S), r"\1"),
    (re.compile(r"(?<![\w])_(?=\S)(.+?)(?<=\S)_(?![\w])", re.S), r"\1"),
]
FRONT_MATTER_LINES = 200


def plain(text: str) -> str:
    for pattern, stays in INLINE:
        text = pattern.sub(stays, text)
    return text


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def heading_level(text: str) -> int | None:
    """Of a lone line of plain text that reads as a heading: by its numbering, or 1 for capitals."""
    short = text and len(text.split()) <= 10 and len(text) <= 80 and text[-1] not in ".,;!?:"
    if not short:
        return None
    if number := NUMBERED.match(text):
        return number[1].count(".") + 1
    return 1 if sum(map(str.isalpha, text)) >= 3 and text == text.upper() else None


class Parser:
    """``blocks``: dicts of position, index, kind, text, line, level, marker, style, candidate, language; tables have rows and row_lines."""

    def __init__(self, text: str, markdown: bool):
        self.lines, self.markdown, self.at = text.split("\n"), markdown, 0
        self.inline: Callable[[str], str] = plain if markdown else str
        self.blocks: list[dict[str, Any]] = []
        self.front_matter: str | None = None
        self.paragraphs = self.tables = 0

    def emit(self, kind: str, text: str, line: int, **more: Any) -> bool:
        self.paragraphs += 1
        base = {"level": None, "marker": None, "style": None, "candidate": False, "language": None, "rows": None, "row_lines": None}
        self.blocks.append(base | {"position": len(self.blocks) + 1, "index": self.paragraphs, "kind": kind, "text": text, "line": line + 1} | more)
        return True

    @property
    def line(self) -> str:
        return self.lines[self.at]

    def more(self) -> bool:
        return self.at < len(self.lines)

    def starts_block(self, line: str) -> bool:
        marks = (ATX, ITEM, RULE, FENCE, QUOTE) if self.markdown else (ATX, ITEM, RULE)
        return any(m.match(line) for m in marks)

    def take(self) -> str:
        self.at += 1
        return self.lines[self.at - 1]

    def continuation(self) -> list[str]:
        out = []
        while self.more() and self.line.strip() and not self.starts_block(self.line):
            out.append(self.take().strip())
        return out

    def run(self) -> Parser:
        if self.markdown and self.line.strip() == "---":
            ends = (k for k in range(1, min(len(self.lines), FRONT_MATTER_LINES)) if self.lines[k].strip() in ("---", "..."))
            if (end := next(ends, None)) is not None:
                self.front_matter, self.at = "\n".join(self.lines[1:end]), end + 1
        rules = (self.blank, self.fence, self.atx, self.rule, self.table, self.item, self.quote, self.paragraph)
        while self.more():
            next(r for r in rules if r())
        return self

    def blank(self) -> bool:
        if self.line.strip():
            return False
        self.at += 1
        return True

    def fence(self) -> bool:
        m = FENCE.match(self.line) if self.markdown else None
        if not m:
            return False
        start, body = self.at, []
        self.at += 1
        while self.more():
            mark = self.take().strip()
            if len(mark) >= len(m[1]) and set(mark) == {m[1][0]}:
                break
            body.append(self.lines[self.at - 1])
        return self.emit("code", "\n".join(body), start, language=m[2] or None)

    def atx(self) -> bool:
        m = ATX.match(self.line)
        return bool(m) and self.emit("heading", self.inline(m[2]), self.at, level=len(m[1])) and bool(self.take() or True)

    def rule(self) -> bool:
        return bool(RULE.match(self.line)) and bool(self.take() or True)

    def table(self) -> bool:
        if not (self.markdown and "|" in self.line and self.at + 1 < len(self.lines)):
            return False
        below = self.lines[self.at + 1]
        if not DELIMITERS.match(below) or len(cells(below)) != len(cells(self.line)):
            return False
        at = [self.at]
        self.at += 2
        while self.more() and self.line.strip() and "|" in self.line:
            at.append(self.at)
            self.at += 1
        self.tables += 1
        rows = [[self.inline(c) for c in cells(self.lines[k])] for k in at]
        base = {"level": None, "marker": None, "style": None, "candidate": False, "language": None}
        self.blocks.append(base | {"position": len(self.blocks) + 1, "index": self.tables, "kind": "table", "text": "", "line": at[0] + 1, "rows": rows, "row_lines": [k + 1 for k in at]})
        return True

    def item(self) -> bool:
        m = ITEM.match(self.line)
        if not m:
            return False
        start = self.at
        self.at += 1
        return self.emit("list_item", self.inline("\n".join([m[3], *self.continuation()])), start, marker="bullet" if m[1] else "numbered")

    def quote(self) -> bool:
        if not (self.markdown and QUOTE.match(self.line)):
            return False
        start, parts = self.at, []
        while self.more() and (m := QUOTE.match(self.line)):
            parts.append(m[1])
            self.at += 1
        return self.emit("quote", self.inline("\n".join(parts).strip()), start)

    def paragraph(self) -> bool:
        start, parts = self.at, [self.take().strip()]
        while self.more() and self.line.strip():
            if m := SETEXT.match(self.line):
                self.at += 1
                return self.emit("heading", self.inline("\n".join(parts)), start, level=1 if m[1][0] == "=" else 2)
            if self.starts_block(self.line):
                break
            parts.append(self.take().strip())
        text = self.inline("\n".join(parts))
        if self.markdown or len(parts) > 1:
            return self.emit("paragraph", text, start)
        if level := heading_level(text):
            return self.emit("heading", text, start, level=level)
        return self.emit("paragraph", text, start, candidate=len(text.split()) <= 10 and len(text) <= 80 and text[-1] not in ".,;!?")


def parse(text: str, file_type: str) -> Parser:
    return Parser(text, file_type == "md").run()
