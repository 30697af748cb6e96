"""Workbooks to block nodes: a heading and a table for each sheet, then its pictures.

Values are those that were calculated last, as text: whole numbers without a fraction,
dates by the number format of their cell.
"""

from __future__ import annotations

import datetime
import posixpath
import re

from ..ir import Node, locator, table_block, text_block, text_cell
from .ooxml import MEDIA, Element, Package, element_range, number_in, q

MAIN = "xl/workbook.xml"
DRAWING = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/drawing"
ANCHORS = {q("xdr:oneCellAnchor"), q("xdr:twoCellAnchor"), q("xdr:absoluteAnchor")}
#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def column_of(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def place(ref: str) -> tuple[int, int]:
    """(row, column) of `B3`, from 1."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    return int(m[2]), column_of(m[1])


def shows_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0])
    return bool(re.search(r"[dmhysDMHYS]", bare))


class Xlsx:
    def __init__(self, content: bytes):
        self.package = Package(content)
        strings = self.package.tree("xl/sharedStrings.xml")
        self.strings = [self.rich(x) for x in strings.findall(q("s:si"))] if strings is not None else []
        styles = self.package.tree("xl/styles.xml")
        codes = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iter(q("s:numFmt"))} if styles is not None else {}
        formats = [int(x.get("numFmtId", 0)) for x in styles.findall(f"{q('s:cellXfs')}/{q('s:xf')}")] if styles is not None else []
        self.dates = [shows_date(codes[f]) if f in codes else f in DATE_FORMATS for f in formats]
        self.images = 0

    @staticmethod
    def rich(si: Element) -> str:
        """Plain and rich text, without phonetic hints."""
        return "".join(t.text or "" for x in si for t in ([x] if x.tag == q("s:t") else x.findall(q("s:t")) if x.tag == q("s:r") else []))

    def text(self, c: Element, epoch: datetime.datetime) -> str | None:
        kind, v = c.get("t", "n"), c.findtext(q("s:v"))
        if kind == "inlineStr":
            inline = c.find(q("s:is"))
            return self.rich(inline) if inline is not None else None
        if v is None:
            return None
        if kind == "s":
            return self.strings[int(v)]
        if kind == "b":
            return str(v not in ("0", "false"))
        if kind in ("str", "e"):
            return v
        if kind == "d":
            return str(datetime.datetime.fromisoformat(v))
        number = float(v) if re.search(r"[.eE]", v) else int(v)
        style = int(c.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return self.date(number, epoch)
        return str(number)

    @staticmethod
    def date(number: float, epoch: datetime.datetime) -> str:
        if 0 <= number < 1:
            ms = round(number * 86_400_000)
            return str((datetime.datetime.min + datetime.timedelta(milliseconds=ms)).time())
        if epoch.year == 1899 and number < 60:
            number += 1  # the day that 1900 didn't have
        day = epoch + datetime.timedelta(days=int(number))
        return str(day + datetime.timedelta(milliseconds=round((number - int(number)) * 86_400_000)))

    def pictures(self, part: str) -> list[Node]:
        drawing = next((to for kind, to in self.package.relations(part).values() if kind == DRAWING), None)
        root = self.package.tree(drawing) if drawing else None
        out = []
        rels = self.package.relations(drawing) if root is not None else {}
        for anchor in root if root is not None else ():
            pic = anchor.find(q("xdr:pic")) if anchor.tag in ANCHORS else None
            blip = next(pic.iter(q("a:blip")), None) if pic is not None else None
            embed = blip.get(q("r:embed")) if blip is not None else None
            if embed not in rels:
                continue
            media = rels[embed][1]
            at = {f"anchor_{k}": int(x) for k in ("row", "col") if (x := anchor.findtext(f"{q('xdr:from')}/{q(f'xdr:{k}')}"))}
            out.append({"locator": locator(part=media, **at), "mime": MEDIA.get(posixpath.splitext(media)[1].lower())})
        return out

    def sheet(self, root: Element, epoch: datetime.datetime) -> tuple[list[list[str | None]], list[tuple[int, int, int, int]]]:
        """The used range as text, and merges counted from its corner."""
        cells: dict[tuple[int, int], str | None] = {}
        row = 0
        for tr in root.findall(f"{q('s:sheetData')}/{q('s:row')}"):
            row = int(tr.get("r", row + 1))
            col = 0
            for c in tr.findall(q("s:c")):
                row, col = place(c.get("r")) if c.get("r") else (row, col + 1)
                cells[row, col] = self.text(c, epoch)
        ranges = [tuple(place(x) for x in (m.get("ref").split(":") * 2)[:2]) for m in root.findall(f"{q('s:mergeCells')}/{q('s:mergeCell')}")]
        for (r0, c0), (r1, c1) in ranges:  # merged places are used, but only their first has a value
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    cells[r, c] = cells.get((r, c)) if (r, c) == (r0, c0) else None
        if not cells:
            return [], []
        top, left = min(r for r, _ in cells), min(c for _, c in cells)
        bottom, right = max(r for r, _ in cells), max(c for _, c in cells)
        rows = [[cells.get((r, c)) for c in range(left, right + 1)] for r in range(top, bottom + 1)]
        return rows, [(r0 - top, c0 - left, r1 - r0 + 1, c1 - c0 + 1) for (r0, c0), (r1, c1) in ranges]

    def blocks(self) -> list[Node]:
        book, rels = self.package.tree(MAIN), self.package.relations(MAIN)
        flag = book.find(q("s:workbookPr"))
        epoch = datetime.datetime(1904, 1, 1) if flag is not None and flag.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
        sheets = [(x.get("name"), rels[x.get(q("r:id"))][1]) for x in book.findall(f"{q('s:sheets')}/{q('s:sheet')}") if x.get(q("r:id")) in rels]
        sheets = [(name, part) for name, part in sheets if "/worksheets/" in part]
        # byte ranges and pictures are matched by position, in the order of part numbers
        parts = sorted((n for n in self.package.names if re.match(r"xl/worksheets/sheet[^/]*\.xml$", n)), key=number_in)
        out: list[Node] = []
        for i, (name, part) in enumerate(sheets):
            matched = parts[i] if i < len(parts) else None
            xml = self.package.read(matched) if matched else b""
            pictures = self.pictures(matched) if matched else []
            rows, merges = self.sheet(self.package.tree(part), epoch)
            full = any(v is not None for r in rows for v in r)
            if not full and not pictures:
                continue
            out.append(text_block("heading", name, level=1))
            span = lambda tag: {"part": matched, **dict(zip(("byte_start", "byte_end"), element_range(xml, tag) or (None, None)))}  # noqa: E731, B023
            if full:
                out.append(table_block([[text_cell(v) for v in r] for r in rows], len(rows[0]), merges, span=span("sheetData")))
            for p in pictures:
                self.images += 1
                out.append({"type": "image", "image_index": self.images, "span": span("drawing"), **p})
        return out


def decode(content: bytes) -> list[Node]:
    return Xlsx(content).blocks()
