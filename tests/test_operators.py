"""Operators over block tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from blockloom import ir
from blockloom.functions import columns as C
from blockloom.operators import blocks as B
from blockloom.operators import enrich, headings, pdf_layout, render
from blockloom.operators.render import _nested_html
from blockloom.sources import clients, decode


def decoded(spark, *docs):
    return decode.blocks(spark.createDataFrame([(str(i), fmt, text) for i, (fmt, text) in enumerate(docs)], "doc_id string, fmt string, content string"))


def one(spark, **exprs):
    return spark.range(1).select(*[e.alias(k) for k, e in exprs.items()]).first()


def test_fragments(spark):
    runs = F.array(*[F.struct(F.lit(t).alias("text"), F.array(*map(F.lit, m)).cast("array<string>").alias("marks"), F.lit(u).cast("string").alias("link")) for t, m, u in (("a*", ["bold", "italic"], None), ("2", ["superscript"], None), ("q", ["subscript"], None), ("u<", ["underline"], "x?a=1&b"))])
    r = one(spark, md=C.inline_fragment(F.lit(""), runs), html=C.inline_fragment(F.lit(""), runs, True), lead=C.escape_leading(F.lit("# a\n 1. b\n-c")))
    assert r.md == r"***a\****²<sub>q</sub>[<u>u\<</u>](x?a=1&b)"
    assert r.html == '<strong><em>a*</em></strong>²<sub>q</sub><a href="x?a=1&amp;b"><u>u&lt;</u></a>'
    assert r.lead == "\\# a\n \\1. b\n-c"


def test_comparison(spark):
    r = one(spark, t=C.tokens(F.lit("A  (Straße), 500 — → x.")), c=C.containment(F.lit("a a b"), F.lit("a b c")), n=C.containment(F.lit("-"), F.lit("")), ok=C.criticals_fit(F.lit("500 x"), F.lit("600 x")))
    assert r.t == ["a", "strasse", "500", "x"] and r.c == pytest.approx(2 / 3) and r.n == 1.0 and r.ok is False


def test_nested_lists_as_html():
    assert _nested_html([(0, False, "a"), (1, True, "b"), (1, True, "c"), (0, False, "d")]) == "<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul>"


def test_render(spark):
    out = render.to_markdown(decoded(spark, ("html", "<h2>H</h2><ol><li>a<ul><li>b</li></ul></li><li>c</li></ol><table><tr><td colspan=2>x</td></tr><tr><td>1</td><td>n<table><tr><td>i</td></tr></table></td></tr></table>"))).first().markdown
    assert out == "## H\n\n1. a\n  - b\n2. c\n\n<table><tr><td colspan=\"2\">x</td></tr><tr><td>1</td><td>n<br><table><tr><td>i</td></tr></table></td></tr></table>\n"


def test_json_round_trip_and_faults(spark):
    blocks = decoded(spark, ("html", "<p>a <b>b</b></p><table><tr><td>x</td><td></td></tr></table>"), ("markdown", "# t"))
    docs = spark.createDataFrame([("0", "s", "html"), ("1", "s", "markdown")], "doc_id string, source_path string, fmt string")
    made = B.documents_json(docs, blocks)
    assert B.validate(made).count() == 0 and B.check_invariants(blocks).count() == 0
    import json

    found = json.loads(made.where("doc_id = '0'").first().json)
    assert [b["id"] for b in found["blocks"]] == ["b0", "b1"] and found["blocks"][1]["table"]["cells"][0][1] == {"blocks": []}
    assert "level" not in found["blocks"][0] and found["blocks"][0]["runs"][1] == {"text": "b", "marks": ["bold"]}


def test_looks_of_headings(spark):
    rows = spark.createDataFrame([("d", 0, "INTRODUCTION", True), ("d", 1, "plain words that go on and on until they are a sentence.", False), ("d", 2, "12 May 2020", True)], "doc_id string, ordinal int, text string, bold boolean")
    for c in ("center", "keep_next", "italic", "underline", "blank_before", "blank_after"):
        rows = rows.withColumn(c, F.lit(False))
    rows = rows.withColumns({"font_ratio": F.lit(0.0), "followed": F.lit(True), "outline": F.lit(None).cast("int"), "style_level": F.lit(None).cast("int")})
    got = {r.ordinal: (r.is_heading, r.heading_level) for r in headings.classified(rows).collect()}
    assert got == {0: (True, 2), 1: (False, None), 2: (False, None)}


def test_lines_anchor_on_their_first_word(spark):
    words = [("d", 1, i, w, x, x + 5.0, t, t + 10.0, 10.0, "F-Bold" if w == "b" else "F") for i, (w, x, t) in enumerate([("a", 0.0, 0.0), ("b", 10.0, 4.0), ("c", 20.0, 8.0)])]
    df = spark.createDataFrame(words, "doc_id string, page int, seq int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string").withColumn("column", F.lit(0))
    got = sorted((r.line_no, r.text, [(x.text, x.marks) for x in r.runs]) for r in pdf_layout.lines(df).collect())
    assert got == [(0, "a b", [("a", []), (" b", ["bold"])]), (1, "c", [("c", [])])]


def test_lines_become_blocks(spark):
    lines = [("Head", 0, 0.0, 14.0), ("a", 20, 0.0, 10.0), ("b", 31, 0.0, 10.0), ("• one", 60, 0.0, 10.0), ("two", 71, 5.0, 10.0), ("2) three", 82, 20.0, 10.0), ("flush", 93, 0.0, 10.0), ("4) far", 140, 0.0, 10.0), ("end", 180, 0.0, 10.0)]
    rows = [("d", 1, 0, i, t, x, float(top), top + 10.0, size, [(t, ["bold"] if "t" in t else [], None)]) for i, (t, top, x, size) in enumerate(lines)]
    laid = spark.createDataFrame(rows, f"doc_id string, page int, column int, line_no int, text string, x0 double, top double, bottom double, size double, runs array<{ir.RUN}>")
    got = pdf_layout.specs(laid, spark.createDataFrame([("d", 14.0, 1)], "doc_id string, size double, level int")).orderBy("place").collect()
    assert [(x.kind, x.text, x.level, x.list_group, x.list_level, x.list_ordered) for x in got] == [
        ("heading", "Head", 1, None, None, None), ("paragraph", "a b", None, None, None, None), ("item", "one two", None, 0, 0, False), ("item", "three", None, 0, 1, True),
        ("paragraph", "flush", None, None, None, None), ("item", "far", None, 1, 0, True), ("paragraph", "end", None, None, None, None),
    ]
    assert [(r.text, r.marks) for r in got[2].runs] == [("one", []), (" two", ["bold"])] and got[1].runs is None


def test_gutter(spark):
    words = [("d", 1, r * 8 + c, "w", x, x + 60.0, r * 20.0, r * 20.0 + 10, 10.0, "F") for r in range(20) for c, x in enumerate((10.0, 80.0, 150.0, 220.0, 330.0, 400.0, 470.0, 540.0))]
    df = spark.createDataFrame(words, "doc_id string, page int, seq int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0, 900)], "doc_id string, page int, width double, height double, n_chars int")
    assert 280 < pdf_layout.gutters(df, pages).first().gutter < 330


def test_align_runs():
    runs, at = pdf_layout.align_runs("The cat, sat", [("the", ["bold"]), ("cat", []), ("sat", ["italic"])], 0)
    assert [(r["text"], r["marks"]) for r in runs] == [("The", ["bold"]), (" cat,", []), (" sat", ["italic"])] and at == 3


def test_verdicts(spark):
    r = one(spark, good=enrich.ocr_verdict(F.lit('x {"meaningful": true, "cleaned_text": " a "} y')), empty=enrich.ocr_verdict(F.lit('{"meaningful": true}')), bad=enrich.ocr_verdict(F.lit("no")))
    assert (r.good.meaningful, r.good.cleaned, r.empty.meaningful, r.bad.meaningful) == (True, "a", False, False)


class Reader:
    def complete_vision(self, *, system, user, images, max_tokens):
        return "seen"

    def complete(self, *, system, user, max_tokens):
        return '{"meaningful": true, "cleaned_text": "clean", "content_ok": false, "format_ok": true, "reason": "r"}'


def test_images_are_stored_once_and_tables_flagged(spark):
    uri = "data:image/gif;base64,R0lGODlhAQACAAAAACw="
    blocks = decoded(spark, ("html", f"<p><img src='{uri}'></p><p>t <img src='{uri}'> <img src='http://x/y.png'></p><table><tr><td>a</td></tr></table><table></table>"))
    found = enrich.identified(enrich.from_source_attribute(enrich.unresolved(blocks)))
    assert enrich.new_blobs(found).count() == 1 and {(r.width, r.height) for r in found.collect()} == {(1, 2)}
    full = enrich.with_images(blocks, found, enrich.read_images(found, Reader, Reader))
    assert sorted((r.image_index, r.ocr_text) for r in full.where("type = 'image'").collect()) == [(1, "clean"), (2, "clean"), (3, None)]
    assert enrich.unresolved(full).count() == 1
    told = enrich.described(blocks, Reader, check=True, attempts=2).where("type = 'table'").orderBy("ordinal").collect()
    assert [(t.describe_status, t.describe_attempts) for t in told] == [("flagged", 2), ("empty", 0)]


def test_client_settings(monkeypatch):
    for k in ("LLM_PROVIDER", "LLM_MODEL", "LLM_BASE_URL", "VLM_MODEL", "VLM2_MODEL", "VLM2_PROVIDER"):
        monkeypatch.delenv(k, raising=False)
    with pytest.raises(clients.ModelError):
        clients.text_client()
    monkeypatch.setenv("LLM_BASE_URL", "http://h/v1")
    monkeypatch.setenv("LLM_MODEL", "m")
    assert clients.vision_client().model == "m"
    monkeypatch.setenv("VLM_MODEL", "v")
    assert (clients.vision_client().model, clients.text_client().model) == ("v", "m")
    with pytest.raises(clients.ModelError):
        clients.vision_client("secondary")


def test_structure_replies():
    assert clients.structure_cells('```json\n[{"row": 0, "col": 1, "bbox": [0, 0, 1, 1]}, {"row": "x"}]\n```') == [{"row": 0, "col": 1, "rowspan": 1, "colspan": 1, "bbox": (0.0, 0.0, 1.0, 1.0)}]
    assert clients.structure_cells("nothing") is None and clients.structure_cells("[]") == []


def test_replies_have_a_shape():
    reply = {"tables": [{"bbox": [0, 0, 1, 1], "cells": [{"row": 0, "col": 0, "bbox": [0, 0, 1, 1], "colspan": 2, "more": 1}]}, {"bbox": [1, 1, 2, 2]}]}
    first, second = clients.shaped(reply, clients.TABLES)["tables"]
    assert first["cells"] == [{"row": 0, "col": 0, "rowspan": 1, "colspan": 2, "bbox": (0.0, 0.0, 1.0, 1.0)}] and not second["cells"]
    assert clients.shaped({"choices": [{"message": {"content": None}}]}, clients.CHAT)["choices"][0]["message"]["content"] == ""
    for bad in ({"choices": None}, {"choices": [{}]}, [], {"tables": [{"bbox": [1]}]}):
        with pytest.raises((ValueError, TypeError)):
            clients.shaped(bad, clients.TABLES if "tables" in bad else clients.CHAT)


def test_structure_services_are_asked_over_http():
    import http.server
    import json
    import threading

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "messages" in asked:
                body = {"choices": [{"message": {"content": asked["messages"][1]["content"][1]["image_url"]["url"]}}]}
            else:
                body = {"tables": [{"bbox": asked["table_bboxes"][0], "cells": [{"row": 0, "col": 0, "bbox": asked["text_cells"][0]["bbox"]}]}]}
            self.send_response(500 if self.path == "/broken" else 200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    (found,) = clients.HttpStructureClient(url).detect(b"x", table_bboxes=[(0, 0, 9, 9)], text_cells=[("w", (1, 1, 2, 2))])
    assert found.bbox == (0.0, 0.0, 9.0, 9.0) and found.cells[0].bbox == (1.0, 1.0, 2.0, 2.0)
    assert clients.ChatClient(url, "m").complete_vision(system="s", user="u", images=[("image/png", b"ab")]) == "data:image/png;base64,YWI="
    with pytest.raises(clients.ModelError):
        clients.HttpStructureClient(f"{url}/broken").detect(b"x", table_bboxes=[(0, 0, 9, 9)], text_cells=[("w", (1, 1, 2, 2))])
    server.shutdown()


def test_errors_become_rows(spark):
    docs = spark.createDataFrame([("a", "html", "<table><tr><td rowspan=x>"), ("b", "html", "<p>ok</p>")], "doc_id string, fmt string, content string")
    got = {r.doc_id: r.error for r in decode.blocks(docs, with_errors=True).collect()}
    assert got["b"] is None and got["a"].startswith("ValueError")


def test_stream(spark, tmp_path):
    from blockloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# x\n")
    (tmp_path / "in" / "b.md").write_text("# x\n")
    files = ingest.arriving(spark, str(tmp_path / "in"))
    ingest.start(files, str(tmp_path / "out"), str(tmp_path / "ck"), formats=("markdown",)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "blocks")).count() == 1


def test_words_meet_boxes_by_bins(spark):
    """Against all pairs of a page, with edges, boxes beyond the grid, empty and missing ones; candidates are few."""
    import random

    from blockloom.operators import pdf_layout

    rng = random.Random(6)
    spot = lambda: rng.choice([-20.0, 0.0, 50.0, 100.0, 3999.0, 5000.0, float(rng.randrange(0, 700)), rng.random() * 700])
    words, boxes = [], []
    for i in range(600):
        x, y = spot(), spot()
        words.append(("d", i % 3, i, x - 1, x + 1, y - 1, y + 1, f"w{i}"))
    for i in range(120):
        x, y = spot(), spot()
        boxes.append(("d", i % 4, i, x, x + rng.choice([0.0, -5.0, 50.0, 400.0, 9000.0]), y, y + rng.choice([10.0, 50.0, 300.0])))
    boxes.append(("d", 0, 999, None, None, None, None))
    w = spark.createDataFrame(words, "doc_id string, page int, seq int, x0 double, x1 double, top double, bottom double, text string")
    b = spark.createDataFrame(boxes, "doc_id string, page int, table_no int, x0 double, x1 double, top double, bottom double")
    centre = lambda r: ((r[3] + r[4]) / 2, (r[5] + r[6]) / 2)
    want = {}
    for _, page, no, x0, x1, top, bottom in boxes:
        inside = [r for r in words if x0 is not None and r[1] == page and x0 <= centre(r)[0] < x1 and top <= centre(r)[1] < bottom]
        want[no] = " ".join(r[7] for r in sorted(inside, key=lambda r: (r[5], r[3], r[7])))
    assert {r.table_no: r.text for r in pdf_layout.words_in_boxes(w, b, ["table_no"]).collect()} == want
    out = {r[2] for r in words if not any(x0 is not None and page == r[1] and x0 <= centre(r)[0] <= x1 and top <= centre(r)[1] <= bottom for _, page, _, x0, x1, top, bottom in boxes)}
    assert {r.seq for r in pdf_layout.outside_tables(w, b).collect()} == out

    cells = spark.range(2000).selectExpr("'d' doc_id", "0 page", "cast(id as int) table_no", "id % 40 * 10.0D x0", "id % 40 * 10.0D + 10 x1", "id div 40 * 10.0D top", "id div 40 * 10.0D + 10 bottom")
    grid = spark.range(400).selectExpr("'d' doc_id", "0 page", "cast(id as int) seq", "id * 7 % 400 + 0.25D x0", "id * 7 % 400 + 0.75D x1", "id * 11 % 500 + 0.25D top", "id * 11 % 500 + 0.75D bottom", "'w' text")
    candidates = pdf_layout.binned(grid).join(pdf_layout.box_index(cells, ["table_no"]), ["doc_id", "page", "_across", "_down"]).count()
    assert candidates <= 400 * 36


def test_box_index_is_never_broadcast(spark):
    """Small files that an explode makes large: neither join of words with boxes collects the boxes at the driver."""
    place = ["cast(id as string) doc_id", "cast(id as int) page", "id + 1.0D x0", "id + 2.0D x1", "id + 1.0D top", "id + 2.0D bottom"]
    cells = spark.range(2).selectExpr(*place, "explode(sequence(1, 3)) table_no")
    words = spark.range(2).selectExpr(*place, "cast(id as int) seq", "'w' text")
    for made in (pdf_layout.texts_in_boxes(words, cells, ["table_no"]), pdf_layout.words_in_boxes(words, cells, ["table_no"]).where("text <> ''"), pdf_layout.outside_tables(words, cells)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    # a box that ends where a bin begins is not in that bin, unless its edge belongs to it
    box = spark.sql("select 'd' doc_id, 0 page, 0 table_no, 40.0D x0, 40.0D top, 50.0D x1, 50.0D bottom")
    assert pdf_layout.box_index(box, ["table_no"], closed=False).count() == 1 and pdf_layout.box_index(box, ["table_no"]).count() == 4
