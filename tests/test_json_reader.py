"""Documents read back from JSON inside the JVM."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from blockloom import ir
from blockloom.operators import blocks as B
from blockloom.sources import blocks_json, decode

HEAD = {"doc_id": "d", "source_path": "p", "fmt": "html"}


def frame(spark, *bodies):
    texts = [b if isinstance(b, str) or b is None else json.dumps(b) for b in bodies]
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, json string")


def nested(depth):
    block = {"type": "paragraph", "text": f"level {depth}"}
    for level in range(depth - 1, -1, -1):
        block = {"type": "table", "table": {"n_rows": 1, "n_cols": 2, "cells": [[{"blocks": [block, {"type": "paragraph", "text": f"after {level}"}]}, None]]}}
    return {**block, "id": "top"}


def test_tables_in_tables_to_any_depth(spark):
    """Twelve levels: rows in the order of the document, each block under its table, covered slots known."""
    docs = frame(spark, {**HEAD, "blocks": [nested(12), {"type": "paragraph", "id": "last", "text": "[[[ end"}]})
    rows = blocks_json.blocks(docs).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(26)) and [r.type for r in rows[:13]] == ["table"] * 12 + ["paragraph"]
    assert [r.uid for r in rows[:3]] == ["b0", "b0/0.0.0", "b0/0.0.0/0.0.0"] and rows[2].parent_uid == "b0/0.0.0" and rows[12].text == "level 12"
    assert [r.text for r in rows[13:]] == [f"after {i}" for i in range(11, -1, -1)] + ["[[[ end"]
    assert [(s.row, s.col) for s in rows[0].null_slots] == [(0, 1)] and (rows[0].id, rows[1].id, rows[25].id, rows[25].uid) == ("top", "", "last", "b1")
    assert (rows[14].cell_row, rows[14].cell_col, rows[14].cell_pos) == (0, 0, 1) and rows[0].cell_row is None


def test_all_columns_come_back(spark):
    """What decoders say of blocks is the same after JSON, column by column; the plan has no Python and needs no job before it runs."""
    page = '<h2>H <b>b</b></h2><ol><li>a<ul><li>c</li></ul></li></ol><pre>x  "[</pre><img src="a b.png" alt="é"><table><tr><td rowspan=2>x</td><td>y</td></tr><tr><td>n<table><tr><td>i</td></tr></table></td></tr></table>'
    docs = spark.createDataFrame([("0", "s", "html", page), ("1", "s", "markdown", "# t\n\n![a](b.png)\n\n| a | b |\n|-|-|\n| **1** | |\n"), ("2", "s", "html", "")], "doc_id string, source_path string, fmt string, content string")
    before = decode.blocks(docs)
    made = B.documents_json(docs.drop("content"), before)
    kept = spark.createDataFrame(made.collect(), made.schema)
    after = blocks_json.blocks(kept)
    columns = [c for c in ir.COLUMNS if c != "signals"]
    whole = lambda rows: sorted(json.dumps([r[c] for c in columns], default=lambda x: x.asDict(True)) for r in rows.collect())
    assert whole(after) == whole(before) and after.count() > 8
    plan = after._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Exchange" not in plan


def test_first_version_and_gaps(spark):
    """Cells that are strings or null, absent lists, JSON null for any field, other fields, rows without text, nothing at all."""
    table = {"type": "table", "id": "t", "level": None, "extra": [1], "table": {"n_rows": 2, "n_cols": 2, "cells": [[None, "a \"q\""], ["", {"blocks": []}]], "merges": [{"row": 1, "col": 0, "colspan": 2}]}}
    bare = {"type": "table", "id": "", "runs": [], "span": None, "table": {"n_rows": 0, "n_cols": 0}}
    rows = blocks_json.blocks(frame(spark, {**HEAD, "blocks": [table, bare]}, {**HEAD}, {**HEAD, "blocks": None}, None)).orderBy("ordinal").collect()
    assert [(r.type, r.text, r.cell_row, r.cell_col) for r in rows] == [("table", None, None, None), ("paragraph", 'a "q"', 0, 1), ("table", None, None, None)]
    assert [m.asDict() for m in rows[0].merges] == [{"row": 1, "col": 0, "rowspan": 1, "colspan": 2}] and rows[2].merges == [] and rows[2].null_slots == [] and rows[2].id == "b1" and rows[2].runs is None
    assert blocks_json.blocks(frame(spark, None).limit(0)).count() == 0


def test_a_fault_has_its_path(spark):
    """The first fault in the order of the document, however deep; other documents aren't hurt."""
    table = lambda cells, **more: {"type": "table", "id": "t", "table": {"n_rows": 1, "n_cols": 1, "cells": cells, **more}}
    deep = nested(3)
    deep["table"]["cells"][0][0]["blocks"][0]["table"]["cells"][0][0]["blocks"][1]["type"] = "odd"
    cases = [
        ("{", "<root>: expected an object"),
        ({"doc_id": "d", "source_path": None, "fmt": "x"}, "<root>: required field 'source_path' missing"),
        ({**HEAD, "ir_version": 99}, f"ir_version: file is IR v99, this reader supports up to v{ir.IR_VERSION}"),
        ({**HEAD, "blocks": {}}, "blocks: expected a list"),
        ({**HEAD, "blocks": [{"type": "code", "id": "a"}, 3]}, "blocks[1]: expected an object"),
        ({**HEAD, "blocks": [{"type": "heading", "id": "a", "level": "one"}]}, "blocks[0].level: expected int"),
        ({**HEAD, "blocks": [{"type": "heading", "id": "a", "runs": [{"marks": []}]}]}, "blocks[0].runs: required field 'text' missing"),
        ({**HEAD, "blocks": [table([[3]])]}, "blocks[0].table.cells[0][0]: expected an object"),
        ({**HEAD, "blocks": [table([[{"a": 1}]])]}, "blocks[0].table.cells[0][0]: required field 'blocks' missing"),
        ({**HEAD, "blocks": [table([[]], n_cols=None)]}, "blocks[0]: required field 'n_cols' missing"),
        ({**HEAD, "blocks": [{"type": "paragraph", "id": "p"}, deep]}, "blocks[1].table.cells[0][0].blocks[0].table.cells[0][0].blocks[1].type: unknown block type 'odd'"),
        ({**HEAD, "blocks": [{"type": "paragraph", "id": "p", "text": "fine"}]}, None),
    ]
    rows = blocks_json.blocks(frame(spark, *(c for c, _ in cases)), with_errors=True).collect()
    assert {r.doc_id: r.error for r in rows} == {str(i): e for i, (_, e) in enumerate(cases)} and len(rows) == len(cases)
    with pytest.raises(Exception, match=r"document '0': blocks\[0\]: required field 'type' missing"):
        blocks_json.blocks(frame(spark, {**HEAD, "blocks": [{"id": "x"}]})).collect()


def test_many_tables_cost_in_proportion(spark):
    """A document of 3,000 tables, and one of texts full of brackets: every block comes once."""
    cells = {"n_rows": 1, "n_cols": 1, "cells": [[{"blocks": [{"type": "paragraph", "text": "[" * 20}]}]]}
    docs = frame(spark, {**HEAD, "blocks": [{"type": "table", "id": f"t{i}", "table": cells} for i in range(3000)]})
    got = blocks_json.blocks(docs).agg(F.count("*").alias("n"), F.countDistinct("uid").alias("u"), F.max("ordinal").alias("m")).first()
    assert tuple(got) == (6000, 6000, 5999)


def test_documents_are_parsed_once(spark, tmp_path):
    """Nothing that Spark infers of the blocks makes it parse or check a document a second time, or read runs that nobody asks for."""
    path = str(tmp_path / "docs.parquet")
    frame(spark, {**HEAD, "blocks": [{"type": "paragraph", "id": "p", "text": "t"}]}, {**HEAD}).write.parquet(path)
    rows = B.top_level(blocks_json.blocks(spark.read.parquet(path)), "paragraph").select("doc_id", "ordinal", "text")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "(link," not in plan
    assert [tuple(r) for r in rows.collect()] == [("0", 0, "t")]


def test_levels_without_brackets(spark):
    """Levels are told by keys of cells, also of keys that are spelled with escapes."""
    body = json.dumps({**HEAD, "blocks": [nested(9)]})
    for spelled in ("cells", r"\u0063ells", r"cel\u006Cs", r"cell\u0073"):
        rows = blocks_json.blocks(frame(spark, body.replace('"cells"', f'"{spelled}"'))).collect()
        assert len(rows) == 19 and {r.text for r in rows} >= {"level 9", "after 8"}


def test_texts_of_runs(spark):
    """Null is no text; any other value is one, as it is written."""
    cases = [("a", None), (7, None), (True, None), (1.5, None), ("", None), ([1], None), ({"a": 1}, None), (None, 1)]
    rows = blocks_json.blocks(frame(spark, *({**HEAD, "blocks": [{"type": "paragraph", "id": "p", "text": "t", "runs": [{"text": "x"}, {"text": t}]}]} for t, _ in cases)), with_errors=True)
    assert {r.doc_id: r.error for r in rows.collect()} == {str(i): e and "blocks[0].runs: required field 'text' missing" for i, (_, e) in enumerate(cases)}
