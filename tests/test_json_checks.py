"""Checks of JSON documents: odd ones are told apart, and all are parsed once."""

from __future__ import annotations

from blockloom import queries
from blockloom.operators import blocks as B

HEAD = '"doc_id":"d","source_path":"p","fmt":"html"'
FAULTS = {
    "not json": ("<root>", "expected an object"), "[1]": ("<root>", "expected an object"), "3": ("<root>", "expected an object"), "null": ("<root>", "expected an object"),
    "{}": ("<root>", "required field 'doc_id' missing"), '{"doc_id":null,"source_path":"p","fmt":"html"}': ("<root>", "required field 'doc_id' missing"),
    "{%s}" % HEAD: None, '{%s,"blocks":null}' % HEAD: None, '{%s,"blocks":[]}' % HEAD: None,
    '{%s,"blocks":{}}' % HEAD: ("blocks", "expected a list"), '{%s,"blocks":7}' % HEAD: ("blocks", "expected a list"),
    '{%s,"blocks":[7]}' % HEAD: ("blocks[0]", "expected an object"), '{%s,"blocks":[null]}' % HEAD: ("blocks[0]", "expected an object"),
    '{%s,"blocks":[{"type":"code","id":"a"},{"type":null,"id":"b"}]}' % HEAD: ("blocks[1]", "required field 'type' missing"),
    '{%s,"blocks":[{"type":7,"id":"a"}]}' % HEAD: ("blocks[0].type", "unknown block type '7'"),
    '{%s,"blocks":[{"type":"table"}]}' % HEAD: ("blocks[0]", "required field 'id' missing"),
    '{%s,"blocks":[{"type":"table","id":"a"}]}' % HEAD: ("blocks[0]", "required field 'table' missing"),
    '{%s,"blocks":[{"type":"table","id":"a","table":{}}]}' % HEAD: None,
}


def test_odd_documents(spark):
    docs = spark.createDataFrame(list(enumerate(FAULTS)), "doc_id int, json string")
    found = {r["doc_id"]: (r["path"], r["reason"]) for r in B.validate(docs).collect()}
    assert [found.get(i) for i in range(len(FAULTS))] == list(FAULTS.values())


def test_documents_are_parsed_once(spark):
    docs = spark.createDataFrame(list(enumerate(FAULTS)), "doc_id int, json string")
    plan = docs.select(B.fault_of().alias("fault"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json(") == 1


def test_blocks_are_kept_as_json(spark, sf_dir):
    """Kept once as JSON, without the columns that it is made of."""
    made = queries.B.with_json(queries.pages(spark, sf_dir))
    assert "runs" not in made.columns and "_json" in made.columns
    docs = queries.table(spark, sf_dir, "pages").selectExpr("string(page_id) doc_id", "url source_path", "'html' fmt").limit(20)
    plain, kept = (B.documents_json(docs, x).orderBy("doc_id").collect() for x in (queries.pages(spark, sf_dir), made))
    assert plain == kept
