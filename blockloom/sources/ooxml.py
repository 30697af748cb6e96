"""Office packages: parts, relationships, byte ranges."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree
from xml.parsers import expat

# Namespaces.
SPACES = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "m": "http://schemas.openxmlformats.org/officeDocument/2006/math",
    "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "xdr": "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing",
    "v": "urn:schemas-microsoft-com:vml",
    "mc": "http://schemas.openxmlformats.org/markup-compatibility/2006",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
    "ct": "http://schemas.openxmlformats.org/package/2006/content-types",
}
#: Media types by file ending.
MEDIA = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff",
    ".webp": "image/webp", ".svg": "image/svg+xml", ".emf": "image/x-emf", ".wmf": "image/x-wmf",
}

Element = ElementTree.Element


def q(name: str) -> str:
    """`w:p` as expat spells it."""
    space, _, local = name.partition(":")
    return f"{{{SPACES[space]}}}{local}"


def value(parent: Element | None, path: str, name: str = "w:val") -> str | None:
    """An attribute of a child, None without the child or the attribute."""
    child = parent.find("/".join(q(x) for x in path.split("/"))) if parent is not None else None
    return None if child is None else child.get(q(name) if ":" in name else name)


class Package:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self._types: tuple[dict[str, str], dict[str, str]] | None = None

    def read(self, part: str) -> bytes | None:
        return self.zip.read(part) if part in self.names else None

    def tree(self, part: str) -> Element | None:
        """The part's root; None if it is missing or broken."""
        raw = self.read(part)
        try:
            return None if raw is None else ElementTree.fromstring(raw)
        except ElementTree.ParseError:
            return None

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id to (type, part), without external ones."""
        folder = posixpath.dirname(part)
        root = self.tree(posixpath.join(folder, "_rels", f"{posixpath.basename(part)}.rels"))
        out = {}
        for r in root.findall(q("rel:Relationship")) if root is not None else ():
            if r.get("TargetMode") != "External":
                to = r.get("Target", "")
                out[r.get("Id")] = (r.get("Type", ""), posixpath.normpath(to.lstrip("/") if to.startswith("/") else posixpath.join(folder, to)))
        return out

    def media_type(self, part: str) -> str | None:
        if self._types is None:
            root = self.tree("[Content_Types].xml")
            listed = list(root) if root is not None else []
            self._types = (
                {x.get("PartName", "").lstrip("/"): x.get("ContentType") for x in listed if x.tag == q("ct:Override")},
                {x.get("Extension", "").lower(): x.get("ContentType") for x in listed if x.tag == q("ct:Default")},
            )
        end = posixpath.splitext(part)[1].lower()
        return self._types[0].get(part) or self._types[1].get(end[1:]) or MEDIA.get(end)


def byte_ranges(xml: bytes, wanted: Callable[[list[str]], bool]) -> list[tuple[str, int, int]]:
    """(name, start, start of the end tag) of elements whose path of names is wanted; [] if the XML is broken."""
    reader = expat.ParserCreate()
    path: list[str] = []
    open_at: list[int | None] = []
    out: list[tuple[str, int, int]] = []

    def start(name: str, _: dict) -> None:
        path.append(name)
        open_at.append(reader.CurrentByteIndex if wanted(path) else None)

    def end(name: str) -> None:
        at = open_at.pop()
        if at is not None:
            out.append((name, at, reader.CurrentByteIndex))
        path.pop()

    reader.StartElementHandler, reader.EndElementHandler = start, end
    try:
        reader.Parse(xml, True)
    except expat.ExpatError:
        return []
    return out


def element_range(xml: bytes, tag: str) -> tuple[int, int] | None:
    """Byte range of the first element with a local name."""
    found = byte_ranges(xml, lambda path: path[-1].rpartition(":")[2] == tag)
    first = min(found, key=lambda x: x[1], default=None)
    return first and first[1:]


def number_in(name: str) -> int:
    found = re.search(r"(\d+)\.xml$", name)
    return int(found[1]) if found else 0
