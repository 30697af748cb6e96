"""The block table: one row for each block of a document, nested ones included.

A block inside a table cell points to its table by parent_uid, and to its place by
cell_row, cell_col and cell_pos; top-level blocks have no parent. uid is the block's id
at the top, and `<parent>/<row>.<col>.<pos>` below. A table's slots that carry no cell
(covered by a merge, or absent) are listed in null_slots; every other slot is a cell,
if only an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa

IR_VERSION = 4
BLOCK_TYPES = ("heading", "paragraph", "table", "image", "code")
MARKS = ("bold", "italic", "underline", "strike", "superscript", "subscript")

RUN = "struct<text:string,marks:array<string>,link:string>"
SPAN = "struct<byte_start:bigint,byte_end:bigint,part:string,page:int,page_start:int,page_end:int>"
#: Columns of a block and their Spark types.
COLUMNS: dict[str, str] = {
    "doc_id": "string", "ordinal": "int", "uid": "string", "parent_uid": "string", "cell_row": "int", "cell_col": "int", "cell_pos": "int",
    "id": "string", "type": "string", "text": "string", "level": "int", "runs": f"array<{RUN}>", "language": "string",
    "list_id": "string", "list_level": "int", "list_ordered": "boolean", "heading_path": "array<string>", "provenance": "string", "source_crop": "string",
    "span": SPAN, "n_rows": "int", "n_cols": "int", "merges": "array<struct<row:int,col:int,rowspan:int,colspan:int>>", "null_slots": "array<struct<row:int,col:int>>",
    "table_description": "string", "describe_status": "string", "describe_attempts": "int",
    "image_index": "int", "locator": "string", "alt_text": "string", "image_id": "string", "ocr_text": "string", "ocr_meaningful": "boolean", "mime": "string", "width": "int", "height": "int",
    "signals": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())

_RUN = pa.struct([("text", pa.string()), ("marks", pa.list_(pa.string())), ("link", pa.string())])
_SPAN = pa.struct([("byte_start", pa.int64()), ("byte_end", pa.int64()), ("part", pa.string()), ("page", pa.int32()), ("page_start", pa.int32()), ("page_end", pa.int32())])
_MERGE = pa.struct([(k, pa.int32()) for k in ("row", "col", "rowspan", "colspan")])
_SLOT = pa.struct([(k, pa.int32()) for k in ("row", "col")])
_ARROW: dict[str, pa.DataType] = {
    "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), f"array<{RUN}>": pa.list_(_RUN), "array<string>": pa.list_(pa.string()), SPAN: _SPAN,
    COLUMNS["merges"]: pa.list_(_MERGE), COLUMNS["null_slots"]: pa.list_(_SLOT),
}
ARROW_SCHEMA = pa.schema([(k, _ARROW[v]) for k, v in COLUMNS.items()])

Node = dict[str, Any]


def has_marks(runs: list[Node]) -> bool:
    return any(r["marks"] or r["link"] for r in runs)


def run(text: str, marks: list[str] | None = None, link: str | None = None) -> Node:
    return {"text": text, "marks": list(marks or ()), "link": link}


def locator(**parts: Any) -> str:
    """Where a picture's bytes are, as JSON in one spelling: keys in order, no white space."""
    return json.dumps(parts, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def tidy_runs(runs: list[Node]) -> list[Node]:
    """Without empty runs, equal neighbours joined, and the outer white space of the first and last run stripped."""
    out: list[Node] = []
    for r in runs:
        if not r["text"]:
            continue
        if out and out[-1]["marks"] == r["marks"] and out[-1]["link"] == r["link"]:
            out[-1] = {**out[-1], "text": out[-1]["text"] + r["text"]}
        else:
            out.append(r)
    if out:
        out[0] = {**out[0], "text": out[0]["text"].lstrip()}
        out[-1] = {**out[-1], "text": out[-1]["text"].rstrip()}
    return [r for r in out if r["text"]]


def text_block(kind: str, text: str, runs: list[Node] | None = None, **more: Any) -> Node:
    """A heading or paragraph node; runs stay only if one has a mark or link."""
    return {"type": kind, "text": text, "runs": runs if runs and has_marks(runs) else None, **more}


def table_block(cells: list[list[list[Node] | None]], n_cols: int, merges: list[tuple[int, int, int, int]] = (), **more: Any) -> Node:
    """cells: rows of slots, each None or the list of the cell's nodes."""
    return {"type": "table", "cells": cells, "n_rows": len(cells), "n_cols": n_cols, "merges": [dict(zip(("row", "col", "rowspan", "colspan"), m)) for m in merges], **more}


def text_cell(text: str | None) -> list[Node] | None:
    return None if text is None else [text_block("paragraph", text)] if text else []


def flatten(doc_id: str, blocks: Iterable[Node]) -> Iterator[Node]:
    """Rows of a document: top-level blocks get ids b0, b1, .. in order unless they have one; ordinals count all rows."""
    ordinal = 0
    for i, block in enumerate(blocks):
        # (uid, parent, place, id, node), taken from the end
        todo = [(f"b{i}", None, (None, None, None), block.get("id") or f"b{i}", block)]
        while todo:
            uid, parent, place, own, node = todo.pop()
            row = {k: v for k, v in node.items() if k != "cells"}
            row |= {"doc_id": doc_id, "ordinal": ordinal, "uid": uid, "parent_uid": parent, "cell_row": place[0], "cell_col": place[1], "cell_pos": place[2], "id": own}
            ordinal += 1
            if node["type"] == "table":
                slots = [(r, c, cell) for r, line in enumerate(node["cells"]) for c, cell in enumerate(line)]
                row["null_slots"] = [{"row": r, "col": c} for r, c, cell in slots if cell is None]
                inner = [(f"{uid}/{r}.{c}.{k}", uid, (r, c, k), "", b) for r, c, cell in slots if cell for k, b in enumerate(cell)]
                todo += reversed(inner)
            yield row


def batch(rows: list[Node]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW_SCHEMA], schema=ARROW_SCHEMA)
