"""Slides to block nodes. Text boxes that may be titles carry `signals` for operators.headings.promote_slides."""

from __future__ import annotations

import json

from ..ir import Node, locator, run, table_block, text_block, text_cell, tidy_runs
from .ooxml import Element, Package, q

MAIN = "ppt/presentation.xml"
TITLES = {"title", "ctrTitle"}
OLE = "http://schemas.openxmlformats.org/presentationml/2006/ole"


def attribute(name: str, *places: Element | None) -> str | None:
    return next((p.get(name) for p in places if p is not None and p.get(name) is not None), None)


def marks_of(rpr: Element | None, default: Element | None) -> list[str]:
    """Each property from the run, else from the paragraph's default."""
    get = lambda name: attribute(name, rpr, default)
    try:
        shift = int(get("baseline") or 0)
    except ValueError:
        shift = 0
    found = {
        "bold": get("b") in ("1", "true"), "italic": get("i") in ("1", "true"), "underline": (get("u") or "none") != "none",
        "strike": (get("strike") or "noStrike") != "noStrike", "superscript": shift > 0, "subscript": shift < 0,
    }
    return [k for k, on in found.items() if on]


def paragraph_default(p: Element) -> Element | None:
    return p.find(f"{q('a:pPr')}/{q('a:defRPr')}")


def runs_of(p: Element) -> list[Node]:
    """Runs and fields; a line break is an unmarked space."""
    default, out = paragraph_default(p), []
    for x in p:
        if x.tag in (q("a:r"), q("a:fld")):
            t = x.find(q("a:t"))
            out.append(run((t.text if t is not None else "") or "", marks_of(x.find(q("a:rPr")), default)))
        elif x.tag == q("a:br"):
            out.append(run(" "))
    return tidy_runs(out)


def font_size(p: Element) -> float | None:
    """Points of the largest run with text; without runs those of the default."""
    default, runs = paragraph_default(p), p.findall(q("a:r"))
    sizes = [attribute("sz", r.find(q("a:rPr")), default) for r in runs if (r.findtext(q("a:t")) or "").strip()]
    sizes += [attribute("sz", default)] if not runs else []
    return max((int(s) / 100 for s in sizes if s is not None), default=None)


def flat_text(p: Element) -> str:
    return "".join("\v" if x.tag == q("a:br") else x.findtext(q("a:t")) or "" for x in p if x.tag in (q("a:r"), q("a:fld"), q("a:br"))).replace("\v", " ")


def bullet(p: Element) -> str | None:
    ppr = p.find(q("a:pPr"))
    kinds = (("a:buNone", "none"), ("a:buAutoNum", "ordered"), ("a:buChar", "bullet"))
    return next((kind for tag, kind in kinds if ppr is not None and ppr.find(q(tag)) is not None), None)


def table_of(tbl: Element) -> Node:
    rows = tbl.findall(q("a:tr"))
    width = len(tbl.findall(f"{q('a:tblGrid')}/{q('a:gridCol')}"))
    cells, merges = [], []
    for r, tr in enumerate(rows):
        line: list[list[Node] | None] = []
        for c, tc in enumerate(tr.findall(q("a:tc"))):
            if tc.get("hMerge") in ("1", "true") or tc.get("vMerge") in ("1", "true"):
                line.append(None)
                continue
            line.append(text_cell("\n".join(flat_text(p) for p in tc.findall(f"{q('a:txBody')}/{q('a:p')}"))))
            span = (int(tc.get("rowSpan", 1)), int(tc.get("gridSpan", 1)))
            if span != (1, 1):
                merges.append((r, c, *span))
        cells.append(line + [None] * (width - len(line)))
    return table_block(cells, width, merges)


class Pptx:
    def __init__(self, content: bytes):
        self.package = Package(content)
        self.images, self.paragraphs = 0, 0

    def slides(self) -> list[str]:
        rels = self.package.relations(MAIN)
        root = self.package.tree(MAIN)
        return [rels[x.get(q("r:id"))][1] for x in root.findall(f"{q('p:sldIdLst')}/{q('p:sldId')}") if x.get(q("r:id")) in rels]

    def shapes(self, tree: Element) -> list[Element]:
        """Depth first, groups opened."""
        out: list[Element] = []
        for x in tree:
            if x.tag == q("p:grpSp"):
                out += self.shapes(x)
            elif x.tag in (q("p:sp"), q("p:pic"), q("p:graphicFrame")):
                out.append(x)
        return out

    def blocks(self) -> list[Node]:
        out: list[Node] = []
        for number, part in enumerate(self.slides(), 1):
            span = {"part": f"ppt/slides/slide{number}.xml", "page": number}
            rels = self.package.relations(part)
            tree = self.package.tree(part).find(f"{q('p:cSld')}/{q('p:spTree')}")
            for shape in self.shapes(tree):
                out += [{**x, "span": span} for x in self.shape(shape, number, rels)]
            notes = next((to for kind, to in rels.values() if kind.endswith("/notesSlide")), None)
            text = self.notes(notes) if notes else ""
            if text:
                out.append(text_block("paragraph", text, span={"part": f"ppt/notesSlides/notesSlide{number}.xml", "page": number}))
        return out

    def notes(self, part: str) -> str:
        for sp in self.package.tree(part).iter(q("p:sp")):
            ph = sp.find(f"{q('p:nvSpPr')}/{q('p:nvPr')}/{q('p:ph')}")
            if ph is not None and ph.get("type") == "body":
                return "\n".join(flat_text(p) for p in sp.findall(f"{q('p:txBody')}/{q('a:p')}")).strip()
        return ""

    def shape(self, shape: Element, number: int, rels: dict[str, tuple[str, str]]) -> list[Node]:
        if shape.tag == q("p:graphicFrame"):
            data = shape.find(f"{q('a:graphic')}/{q('a:graphicData')}")
            tbl = data.find(q("a:tbl")) if data is not None else None
            if tbl is not None:
                return [table_of(tbl)]
            return self.preview(shape, data, rels) if data is not None and data.get("uri") == OLE else []
        if shape.tag == q("p:pic"):
            return [self.image(shape, rels, self.name(shape))]
        return self.texts(shape, number) if shape.find(q("p:txBody")) is not None else []

    @staticmethod
    def properties(shape: Element) -> Element | None:
        return next((x for x in shape.iter(q("p:cNvPr"))), None)

    def name(self, shape: Element) -> str | None:
        p = self.properties(shape)
        return (p.get("name") if p is not None else None) or None

    def image(self, shape: Element, rels: dict[str, tuple[str, str]], alt: str | None) -> Node:
        self.images += 1
        blip = next(shape.iter(q("a:blip")), None)
        part = rels.get(blip.get(q("r:embed")), (None, None))[1] if blip is not None else None
        return {"type": "image", "image_index": self.images, "locator": locator(**({"part": part} if part else {})), "mime": self.package.media_type(part) if part else None, "alt_text": alt}

    def preview(self, shape: Element, data: Element, rels: dict[str, tuple[str, str]]) -> list[Node]:
        """The picture that stands for an embedded object, if it has one."""
        blip = next(shape.iter(q("a:blip")), None)
        if blip is None or blip.get(q("r:embed")) not in rels:
            return []
        program = next((x.get("progId") for x in data.iter(q("p:oleObj")) if x.get("progId")), None)
        return [self.image(shape, rels, f"Embedded object ({program})" if program else self.name(shape))]

    def texts(self, shape: Element, number: int) -> list[Node]:
        ph = shape.find(f"{q('p:nvSpPr')}/{q('p:nvPr')}/{q('p:ph')}")
        title = ph is not None and ph.get("type") in TITLES
        p = self.properties(shape)
        list_id = f"s{number}_{p.get('id') if p is not None else 0}"
        paragraphs = shape.findall(f"{q('p:txBody')}/{q('a:p')}")
        runs = [runs_of(x) for x in paragraphs]
        texts = ["".join(r["text"] for r in x) for x in runs]
        out: list[Node] = []
        for i, x in enumerate(paragraphs):
            self.paragraphs += 1
            if not texts[i]:
                continue
            size = font_size(x)
            seen = {"slide": number, "size": size, "place": self.paragraphs}
            if title:
                out.append(text_block("heading", texts[i], runs[i], level=1, signals=json.dumps({**seen, "fixed": True})))
                continue
            ppr, kind = x.find(q("a:pPr")), bullet(x)
            level = int(ppr.get("lvl", 0)) if ppr is not None else 0
            if kind in ("ordered", "bullet") or (kind != "none" and (ph is not None or level > 0)):
                ordered = {"ordered": True, "bullet": False}.get(kind)
                out.append(text_block("paragraph", texts[i], runs[i], list_id=list_id, list_level=level, list_ordered=ordered, signals=json.dumps({**seen, "fixed": True})))
                continue
            worded = [r for r in runs[i] if r["text"].strip()]
            every = {k: bool(worded) and all(k in r["marks"] for r in worded) for k in ("bold", "italic", "underline")}
            free = {"center": ppr is not None and ppr.get("algn") == "ctr", "blank_before": i > 0 and not texts[i - 1], "blank_after": i < len(texts) - 1 and not texts[i + 1]}
            out.append(text_block("paragraph", texts[i], runs[i], signals=json.dumps({**seen, **every, **free, "fixed": ph is not None})))
        return out


def decode(content: bytes) -> list[Node]:
    return Pptx(content).blocks()


