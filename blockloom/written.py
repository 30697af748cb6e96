"""Small documents written from rows, for queries that know what must come out of them.

Markup is text that column expressions build; only packing it into files is a Python call.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'


def text(*parts: str | Column) -> Column:
    """Literals and columns joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def package(parts: dict[str, str | Column]) -> Column:
    """A zip file of named parts."""
    return package_of(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in parts.items() for x in kv]))


def package_of(members: Column) -> Column:
    """A zip file of a map from names to parts."""

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        def one(found: dict[str, str]) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, body in sorted(dict(found).items()):
                    z.writestr(name, body)
            return out.getvalue()

        return column.map(one)

    return packed(members)


def rels(*targets: tuple[str, str, str]) -> str:
    """Relationships (id, type, target)."""
    return RELS + "".join(f'<Relationship Id="{i}" Type="{t}" Target="{to}"/>' for i, t, to in targets) + "</Relationships>"


def pdf(streams: Column) -> Column:
    """A PDF file whose pages have these content streams, with fonts F1 (plain) and F2 (bold) and a picture Im1."""

    @F.pandas_udf("binary")
    def printed(column: pd.Series) -> pd.Series:
        def one(pages: list[str]) -> bytes:
            fonts = "<< /F1 3 0 R /F2 4 0 R >>"
            kids = " ".join(f"{6 + 2 * i} 0 R" for i in range(len(pages)))
            objects = [
                "<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>",
                "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>",
                "<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8 /Length 1 >>\nstream\nx\nendstream",
            ]
            for i, body in enumerate(pages):
                objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents {7 + 2 * i} 0 R /Resources << /Font {fonts} /XObject << /Im1 5 0 R >> >> >>")
                objects.append(f"<< /Length {len(body)} >>\nstream\n{body}\nendstream")
            return ("%PDF-1.4\n" + "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1)) + "trailer\n<< /Root 1 0 R >>\n").encode("latin-1")

        return column.map(one)

    return printed(streams)
