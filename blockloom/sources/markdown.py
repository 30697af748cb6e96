"""Markdown to block nodes.

Lines are classified one by one; each construct takes its lines and says where it ends.
Precedence: fence, heading, pipe table, underlined heading, list, paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..ir import Node, locator, run, table_block, text_block, tidy_runs
from .html import only_markers

# The grammar of lines and of inline constructs.
ATX = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
UNDERLINE = re.compile(r"^(=+|-+)[ \t]*$")
ITEM = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$")
IMAGE = re.compile(r'!\[([^\]]*)\]\(\s*([^)\s]+)(?:\s+"[^"]*")?\s*\)')
RULE_CELL = re.compile(r":?-+:?")
FENCES = ("```", "~~~")
INLINE = re.compile(
    r"(\*\*\*|___)(?P<both>.+?)\1"
    r"|(\*\*|__)(?P<bold>.+?)\3"
    r"|\*(?P<italic>[^\s*](?:.*?[^\s*])?)\*"
    r"|~~(?P<strike>.+?)~~"
    r"|(?<!\!)\[(?P<link>[^\]]+)\]\(\s*(?P<to>[^)\s]+)(?:\s+\"[^\"]*\")?\s*\)",
    re.DOTALL,
)
INLINE_MARKS = {"both": ["bold", "italic"], "bold": ["bold"], "italic": ["italic"], "strike": ["strike"], "link": []}


def inline(text: str) -> tuple[str, list[Node]]:
    """Clean text and runs; constructs don't nest."""
    runs, done = [], 0
    for m in INLINE.finditer(text):
        runs.append(run(text[done : m.start()]))
        kind = next(k for k in INLINE_MARKS if m[k] is not None)
        runs.append(run(m[kind], INLINE_MARKS[kind], m["to"]))
        done = m.end()
    runs = tidy_runs([*runs, run(text[done:])])
    return "".join(r["text"] for r in runs), runs


def cells_of(line: str) -> list[str]:
    body = line.strip()
    body = body.removeprefix("|")
    body = body[:-1] if body.endswith("|") else body
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]


def is_rule(line: str) -> bool:
    """A table's second line."""
    body = line.strip()
    return "-" in body and all(RULE_CELL.fullmatch(c.strip()) for c in body.strip("|").split("|"))


class MarkdownFold:
    def __init__(self, content: bytes):
        self.lines: list[tuple[int, int, str]] = []
        at = 0
        for raw in content.split(b"\n"):
            self.lines.append((at, at + len(raw), raw.decode("utf-8", "replace").rstrip("\r")))
            at += len(raw) + 1
        self.out: list[Node] = []
        self.images = 0
        self.lists = 1
        i = 0
        while i < len(self.lines):
            i = self.construct(i)(i) if self.text(i).strip() else i + 1

    def text(self, i: int) -> str:
        return self.lines[i][2] if i < len(self.lines) else ""

    def span(self, i: int, j: int) -> Node:
        return {"byte_start": self.lines[i][0], "byte_end": self.lines[j][1]}

    def is_table(self, i: int) -> bool:
        return "|" in self.text(i) and i + 1 < len(self.lines) and is_rule(self.text(i + 1))

    def construct(self, i: int) -> Callable[[int], int]:
        text = self.text(i)
        below = self.text(i + 1).strip()
        if text.strip().startswith(FENCES):
            return self.fence
        if ATX.match(text):
            return self.atx
        if self.is_table(i):
            return self.table
        if below and UNDERLINE.match(below) and not ITEM.match(text):
            return self.underlined
        return self.items if ITEM.match(text) else self.paragraph

    def fence(self, i: int) -> int:
        """An unclosed fence runs to the end, but its span is that of its first line."""
        opening = self.text(i).strip()
        end = next((j for j in range(i + 1, len(self.lines)) if self.text(j).strip().startswith(opening[:3])), None)
        last = len(self.lines) if end is None else end
        self.out.append({"type": "code", "text": "\n".join(self.text(j) for j in range(i + 1, last)), "language": opening[3:].strip() or None, "span": self.span(i, i if end is None else end)})
        return last if end is None else end + 1

    def heading(self, text: str, level: int, span: Node) -> None:
        clean, runs = inline(text)
        self.out.append(text_block("heading", clean, runs, level=level, span=span))

    def atx(self, i: int) -> int:
        m = ATX.match(self.text(i))
        self.heading(m[2].strip(), len(m[1]), self.span(i, i))
        return i + 1

    def underlined(self, i: int) -> int:
        self.heading(self.text(i).strip(), 1 if self.text(i + 1).strip()[0] == "=" else 2, self.span(i, i + 1))
        return i + 2

    def table(self, i: int) -> int:
        rows, j = [(i, cells_of(self.text(i)))], i + 2
        while self.text(j).strip() and "|" in self.text(j):
            rows.append((j, cells_of(self.text(j))))
            j += 1
        width = max(len(cells) for _, cells in rows)
        grid = []
        for at, cells in rows:
            line = []
            for cell in cells + [""] * (width - len(cells)):
                clean, runs = inline(self.with_markers(cell, lambda m, at=at: self.span(at, at), self.out))
                line.append([text_block("paragraph", clean, runs)] if cell else [])
            grid.append(line)
        self.out.append(table_block(grid, width, span=self.span(i, max(j - 1, i + 1))))
        return j

    def items(self, i: int) -> int:
        """A run of item lines is one list; its number is taken only if a block came of it."""
        before, name = len(self.out), f"L{self.lists}"
        while i < len(self.lines) and (m := ITEM.match(self.text(i))):
            meta = {"list_id": name, "list_level": len(m[1].expandtabs(4)) // 2, "list_ordered": m[2][0].isdigit()}
            found: list[Node] = []
            text = self.with_markers(m[3], self.within(i, m.start(3)), found).strip()
            if not only_markers(text):
                clean, runs = inline(text)
                self.out.append(text_block("paragraph", clean, runs, span=self.span(i, i), **meta))
            self.out += [{**image, **meta} for image in found]
            i += 1
        self.lists += len(self.out) > before
        return i

    def paragraph(self, i: int) -> int:
        lines, found, j = [], [], i
        while self.text(j).strip() and (j == i or not self.ends_paragraph(j)):
            lines.append(self.with_markers(self.text(j), self.within(j, 0), found))
            j += 1
        text = "\n".join(lines).strip()
        if not only_markers(text):
            clean, runs = inline(text)
            self.out.append(text_block("paragraph", clean, runs, span=self.span(i, j - 1)))
        self.out += found
        return j

    def ends_paragraph(self, i: int) -> bool:
        text = self.text(i)
        return bool(ATX.match(text) or ITEM.match(text) or text.strip().startswith(FENCES) or self.is_table(i))

    def within(self, i: int, shift: int) -> Callable[[re.Match[str]], Node]:
        start, _, text = self.lines[i]
        byte = lambda at: start + len(text[: shift + at].encode())
        return lambda m: {"byte_start": byte(m.start()), "byte_end": byte(m.end())}

    def with_markers(self, text: str, span: Callable[[re.Match[str]], Node], to: list[Node]) -> str:
        """Images become markers, and nodes in to."""

        def marker(m: re.Match[str]) -> str:
            self.images += 1
            to.append({"type": "image", "image_index": self.images, "locator": locator(src=m[2]), "alt_text": m[1] or None, "span": span(m)})
            return f"<image{self.images}>"

        return IMAGE.sub(marker, text)


def decode(content: bytes) -> list[Node]:
    return MarkdownFold(content).out
