"""Slides at size: decks are written and decoded once, by all cores; titles by their looks."""

from __future__ import annotations

import json

import pytest

from blockloom import ir, queries, queries_written
from blockloom.operators import headings


@pytest.mark.parametrize("name", ["pptx_blocks", "pptx_tables"])
def test_decks_are_decoded_once(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_decks_are_dealt_out(spark, sf_dir):
    """Small partitions aren't joined into one task, that then writes and decodes every deck."""
    tasks = queries_written._deck(spark, sf_dir).rdd.getNumPartitions()
    assert tasks == spark.sparkContext.defaultParallelism > 1


def test_titles_by_looks(spark):
    """A baseline of two equally frequent sizes is the first seen; the first of equals is the title; slides with a title, fixed text and other documents stay."""
    look = {"bold": True, "italic": False, "underline": False, "center": False, "blank_before": False, "blank_after": False, "fixed": False}
    rows = []

    def put(doc, slide, text, size, kind="paragraph", **more):
        n = sum(r["doc_id"] == doc for r in rows)
        signals = json.dumps({**look, **more, "slide": slide, "size": size, "place": n + 1})
        rows.append({"doc_id": doc, "ordinal": n, "uid": f"b{n}", "id": f"b{n}", "type": kind, "text": text, "level": 1 if kind == "heading" else None, "span": {"page": slide}, "signals": signals})

    put("a", 1, "First words", 10.0), put("a", 1, "Same words", 10.0)  # equal scores
    put("a", 2, "Big words", 20.0, bold=False), put("a", 2, "   ", 30.0), put("a", 2, "plain words that go on and on to the very end.", 20.0, bold=False)
    put("a", 3, "Titled", None, "heading", fixed=True), put("a", 3, "Other Words", 20.0)
    put("a", 4, "Fixed Words", 20.0, fixed=True)
    put("b", 1, "Big words", 20.0, bold=False)
    rows.append({"doc_id": "a", "ordinal": len(rows), "uid": "x", "id": "x", "type": "image", "span": {"page": 5}})
    blocks = spark.createDataFrame([tuple({**r, "span": (None, None, None, r["span"]["page"], None, None)}.get(c) for c in ir.COLUMNS) for r in rows], ir.SCHEMA)
    found = headings.promote_slides(blocks).where("type = 'heading'").select("doc_id", "text", "level").collect()
    # of the sizes of a, 20 is the most frequent, so "Big words" is no larger than the rest
    assert sorted(map(tuple, found)) == [("a", "First words", 1), ("a", "Titled", 1)]
