"""The data source of files gives the rows of read_files and blocks; filters on the list open no other file."""

from __future__ import annotations

import pytest

from blockloom import ir
from blockloom.sources import decode, files


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for i in range(12):
        (tmp_path / f"m{i}.md").write_text(f"# Title {i}\n\ntext *{i}*\n\n| a | b |\n|-|-|\n| {i} | |\n")
        (tmp_path / "deep" / f"h{i}.HTML").write_text(f"<h1>T{i}</h1><p>p <b>{i}</b></p>" + "<p>x</p>" * i)
    for name in ("c.docx", "_hidden.md", "e.xyz", "f.pdf"):
        (tmp_path / name).write_bytes(b"no document")
    (tmp_path / "empty.md").write_bytes(b"")
    files.register(spark)
    return str(tmp_path)


def key(rows):
    return sorted(repr(r) for r in rows.select(*[c for c in ir.COLUMNS]).collect())


def test_rows_of_the_source(spark, folder):
    got = spark.read.format("blockloom").option("partition_bytes", 300).load(folder)
    want = decode.blocks(decode.read_files(spark, folder).where("fmt <> 'pdf' and source_path not like '%hidden%'"), with_errors=True)
    assert key(got) == key(want) and got.rdd.getNumPartitions() > 4
    bad = got.where("error is not null").collect()
    assert [(r.doc_id, r.fmt, r.type) for r in bad] == [("c", "docx", None)] and bad[0].error
    paths = {r.source_path for r in decode.read_files(spark, folder).where("fmt = 'html'").collect()}
    assert {r.source_path for r in got.where("fmt = 'html'").collect()} == paths
    flat = spark.read.format("blockloom").option("recursive", "false").load(f"file://{folder}")
    assert {r.fmt for r in flat.collect()} == {"markdown", "docx"}


def test_filters_reach_the_list(spark, folder):
    rows = spark.read.format("blockloom").option("partition_bytes", 1).load(folder)
    some = rows.where("fmt = 'markdown' and doc_id in ('m1', 'm2', 'h1') and type = 'heading'")
    assert sorted((r.doc_id, r.text) for r in some.collect()) == [("m1", "Title 1"), ("m2", "Title 2")]
    assert some.rdd.getNumPartitions() == 2 and rows.where("fmt = 'none'").count() == 0
    assert rows.where("fmt = 'html' and doc_id = 'm1'").count() == 0


def test_tasks_by_bytes():
    many = [files.File(f"{i:03}", f"p{i:03}", "html", size) for i, size in enumerate([10] * 50 + [5000] + [10] * 50)]
    made = files.packed(many, 640)
    assert sorted(f.doc_id for t in made for f in t.files) == [f.doc_id for f in many]
    assert all(len(t.files) == 1 or sum(f.size + 20 for f in t.files) <= 640 for t in made) and [len(t.files) for t in made if t.files[0].size == 5000] == [1]
    assert files.packed([], 10) == []


def test_registered_decoders(spark, tmp_path):
    decode.register("lines", lambda raw: [ir.text_block("paragraph", x) for x in raw.decode().splitlines()], (".lines",))
    files.register(spark)
    (tmp_path / "a.lines").write_text("one\ntwo")
    assert [r.text for r in spark.read.format("blockloom").load(str(tmp_path)).orderBy("ordinal").collect()] == ["one", "two"]


def test_long_documents_leave_in_parts():
    page = ("<p>x</p>" * (2 * decode.BLOCKS + 5)).encode()
    parts = [(len(rows), len(errors)) for rows, errors in decode.decoded([("a", "html", page), ("b", "html", b"<p>y</p>")], {}, False)]
    assert parts == [(decode.BLOCKS, decode.BLOCKS), (decode.BLOCKS, decode.BLOCKS), (6, 6)]
