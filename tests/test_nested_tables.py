"""Tables within tables at any depth, against a plain recursion; no job runs while the plan is made."""

from __future__ import annotations

import json
import random

from blockloom import ir
from blockloom.operators import blocks as B
from blockloom.operators import render


def made(rng, depth):
    rows, cols = rng.randint(1, 3), rng.randint(1, 3)
    cells = []
    for r in range(rows):
        line = []
        for c in range(cols):
            inner = [ir.text_block("paragraph", rng.choice(["a", "b|c", " x ", "two\nlines", "", "ü<"])) for _ in range(rng.randint(0, 2))]
            if depth and (r, c) == (rows - 1, 0) or depth and rng.random() < 0.2:
                inner.insert(rng.randint(0, len(inner)), made(rng, depth - 1))
            line.append(None if not inner and rng.random() < 0.3 else inner)
        cells.append(line)
    merges = [(0, 0, rows, 1)] if rng.random() < 0.3 and rows > 1 else []
    return ir.table_block(cells, cols, merges)


def html(t):
    spans = {(m["row"], m["col"]): "".join(f' {k}="{m[k]}"' for k in ("rowspan", "colspan") if m[k] > 1) for m in t["merges"]}
    text = lambda b: html(b) if b["type"] == "table" else b["text"].replace("<", "&lt;")
    cell = lambda r, c, x: "" if x is None else f"<td{spans.get((r, c), '')}>{'<br>'.join(filter(None, map(text, x)))}</td>"
    return "<table>" + "".join("<tr>" + "".join(cell(r, c, x) for c, x in enumerate(line)) + "</tr>" for r, line in enumerate(t["cells"])) + "</table>"


def plain(x):
    return "\n".join(filter(None, (text(b) if b["type"] == "table" else b["text"] for b in x or [])))


def text(t):
    one = lambda x: plain(x).replace("\n", " ").strip()
    if any(b["type"] == "table" for line in t["cells"] for x in line for b in x or []):
        names = [one(x) or f"col{c}" for c, x in enumerate(t["cells"][0])]
        return "\n\n".join("\n".join(f"{names[c]}: {plain(x)}" for c, x in enumerate(line)) for line in t["cells"][1:])
    lines = ["| " + " | ".join(one(x).replace("|", "\\|") for x in line) + " |" for line in t["cells"]]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * t["n_cols"]) + " |", *lines[1:]])


def grid(t):
    of = lambda b: grid(b) if b["type"] == "table" else b["text"]
    return [[None if x is None else [of(b) for b in x] for x in line] for line in t["cells"]]


def read(table):
    of = lambda b: read(b["table"]) if b["type"] == "table" else b["text"]
    return [[None if x is None else [of(b) for b in x["blocks"]] for x in line] for line in table["cells"]]


def rows_of(spark, docs):
    rows = [r for name, tables in docs.items() for r in ir.flatten(name, tables)]
    return spark.createDataFrame(ir.pa.Table.from_batches([ir.batch(rows)]), ir.SCHEMA)


def test_any_depth(spark):
    rng = random.Random(5)
    docs = {str(i): [made(rng, depth) for depth in (0, 1, i % 4)] for i in range(12)} | {"deep": [made(rng, 12), ir.text_block("paragraph", "end")]}
    blocks = rows_of(spark, docs)
    spark.sparkContext.setJobGroup("while planning", "")
    views, bodies = render.with_tables(blocks), B.blocks_json(blocks)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("while planning")) == 0
    spark.sparkContext.setJobGroup("", "")
    assert views.count() == blocks.count() and views.columns[: len(ir.COLUMNS)] == list(ir.COLUMNS)
    got = {(r.doc_id, r.uid): r for r in views.where("parent_uid is null and type = 'table'").collect()}
    want = {(name, f"b{i}"): t for name, tables in docs.items() for i, t in enumerate(tables) if t["type"] == "table"}
    assert got.keys() == want.keys()
    for key, t in want.items():
        assert got[key].table_html == html(t) and got[key].table_text == text(t)
    saved = {(r.doc_id, r.ordinal): json.loads(r.json) for r in bodies.collect()}
    first = lambda name: [saved[k] for k in sorted(k for k in saved if k[0] == name)]
    for name, tables in docs.items():
        assert [read(b["table"]) if b["type"] == "table" else b["text"] for b in first(name)] == [grid(t) if t["type"] == "table" else t["text"] for t in tables]


def test_many_nested_tables_and_empty_ones(spark):
    """A table of 600 slots with a table in each; tables without rows or columns; no table at all; blocks outside of the grid."""
    wide = ir.table_block([[[ir.table_block([[ir.text_cell(f"{r}.{c}")]], 1)] for c in range(20)] for r in range(30)], 20)
    blocks = rows_of(spark, {"w": [wide], "e": [ir.table_block([], 0), ir.table_block([[], []], 0)], "n": [ir.text_block("paragraph", "p")]})
    got = {(r.doc_id, r.uid): r for r in render.with_tables(blocks).where("parent_uid is null").collect()}
    assert got["w", "b0"].table_html == html(wide) and got["w", "b0"].table_text == text(wide)
    assert [(got["e", u].table_html, got["e", u].table_md, got["e", u].table_text) for u in ("b0", "b1")] == [("<table></table>", "", ""), ("<table><tr></tr><tr></tr></table>", "", "|  |\n|  |\n|  |")]
    assert got["n", "b0"].table_html is None and render.with_tables(blocks.limit(0)).count() == 0
    small = rows_of(spark, {"o": [ir.table_block([[ir.text_cell("in"), ir.text_cell("out")]], 1)]})
    assert render.cell_text(small).first().table_plain == "in"
