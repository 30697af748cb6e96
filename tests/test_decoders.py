"""Decoders on small documents that are made here."""

from __future__ import annotations

import io
import zipfile

import pytest

from blockloom import ir
from blockloom.sources import docx, html, markdown, pdf, pptx, xlsx


def shape(nodes):
    return [(n["type"], n.get("text")) for n in nodes]


def marks(node):
    return [(r["text"], r["marks"], r["link"]) for r in node["runs"]]


def test_html_marks_and_spaces():
    (p,) = html.decode(b"<p>one <b>two\n  three</b> <i>four</i></p>")
    assert p["text"] == "one two three four"
    assert marks(p) == [("one ", [], None), ("two", ["bold"], None), (" ", [], None), ("three", ["bold"], None), (" ", [], None), ("four", ["italic"], None)]


def test_html_open_mark_holds_on():
    a, b = html.decode(b"<p>x <b>y</p><p>z</p>")
    assert marks(b) == [("z", ["bold"], None)] and a["text"] == "x y"


def test_html_script_title_nav_and_entities():
    nodes = html.decode("<title>T</title><script>var a='</p>';</script><nav>n</nav><p>a&amp;b&copy;</p>".encode())
    assert shape(nodes) == [("paragraph", "Tn"), ("paragraph", "a&b©")]


def test_html_lists_code_links():
    nodes = html.decode(b'<ul><li>a<ol><li>b</li></ol></li></ul><pre><code class="language-py">x = 1\n y</code></pre><p><a href="u">l</a></p>')
    assert [(n.get("list_id"), n.get("list_level"), n.get("list_ordered")) for n in nodes[:2]] == [("L1", 0, False), ("L1", 1, True)]
    assert (nodes[2]["text"], nodes[2]["language"]) == ("x = 1\n y", "py")
    assert marks(nodes[3]) == [("l", [], "u")]


def test_html_tables():
    (t,) = html.decode(b"<table><tr><td rowspan=2>A</td><td colspan=2>B</td></tr><tr><td>C<table><tr><td>n</td></tr></table></td><td><img src=i alt=x></td></tr></table>")
    assert (t["n_rows"], t["n_cols"], t["merges"]) == (2, 3, [{"row": 0, "col": 0, "rowspan": 2, "colspan": 1}, {"row": 0, "col": 1, "rowspan": 1, "colspan": 2}])
    assert t["cells"][1][0] is None and t["cells"][0][2] is None
    rows = list(ir.flatten("d", [t]))
    assert [r["uid"] for r in rows] == ["b0", "b0/0.0.0", "b0/0.1.0", "b0/1.1.0", "b0/1.1.1", "b0/1.1.1/0.0.0", "b0/1.2.0"]
    assert {(s["row"], s["col"]) for s in rows[0]["null_slots"]} == {(1, 0), (0, 2)}


def test_html_image_marker_and_spans():
    p, i = html.decode("<p>é <img src='a.png'> b</p>".encode())
    assert p["text"] == "é <image1> b" and i["span"] == {"byte_start": 6, "byte_end": 23} and p["span"]["byte_start"] == 3


def test_html_bad_span_fails():
    with pytest.raises(ValueError):
        html.decode(b"<table><tr><td rowspan=x>a</td></tr></table>")


def test_markdown_constructs():
    nodes = markdown.decode("# A #\n\nTitle\n===\n\n- x\n  1. y\n\npara **b** ***c*** ~~d~~ [l](u \"t\") *i*\nmore ![al](s.png)\n\n~~~ py\ncode\n~~~\n".encode())
    assert shape(nodes)[:4] == [("heading", "A"), ("heading", "Title"), ("paragraph", "x"), ("paragraph", "y")]
    assert [(n["list_level"], n["list_ordered"]) for n in nodes[2:4]] == [(0, False), (1, True)]
    assert nodes[4]["text"] == "para b c d l i\nmore <image1>"
    assert [r["marks"] for r in nodes[4]["runs"] if r["marks"]] == [["bold"], ["bold", "italic"], ["strike"], ["italic"]]
    assert nodes[5]["type"] == "image" and (nodes[6]["text"], nodes[6]["language"]) == ("code", "py")


def test_markdown_table_pipes_and_padding():
    (t,) = markdown.decode(b"| a | b |\n|:-|-:|\n| x\\|y |\n")
    assert [[c[0]["text"] if c else "" for c in row] for row in t["cells"]] == [["a", "b"], ["x|y", ""]]


def test_markdown_two_lines_are_no_underlined_heading_and_lists_count():
    nodes = markdown.decode(b"a\nb\n---\n\n- ![](s)\n\n- x\n")
    assert nodes[0]["text"] == "a\nb\n---"
    assert [n.get("list_id") for n in nodes[1:]] == ["L1", "L2"]


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word(body: str, **more: str) -> bytes:
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **more})


def test_docx_runs_and_nested_table():
    p = "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r><w:r><w:t> b</w:t></w:r></w:p>"
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr>{p}{inner}</w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    a, t = docx.decode(word(p + table))
    assert marks(a) == [("a", ["bold"], None), (" b", [], None)]
    assert t["merges"] == [{"row": 0, "col": 0, "rowspan": 2, "colspan": 1}] and [n["type"] for n in t["cells"][0][0]] == ["paragraph", "table"]
    assert a["span"]["part"] == "word/document.xml" and a["span"]["byte_start"] > 0


def test_docx_deep_tables_end_as_text():
    body = "<w:p><w:r><w:t>deep</w:t></w:r></w:p>"
    for _ in range(13):
        body = f"<w:tbl><w:tr><w:tc>{body}</w:tc></w:tr></w:tbl>"
    rows = list(ir.flatten("d", docx.decode(word(body))))
    assert sum(r["type"] == "table" for r in rows) == 11 and rows[-1]["text"] == "deep"


def test_xlsx_values_and_merges():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>'
    sheet = f'<worksheet {s}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c></row><row r="3"><c r="B3"><v>1.5</v></c><c r="C3" s="1"><v>45292</v></c></row></sheetData><mergeCells><mergeCell ref="B2:C2"/></mergeCells></worksheet>'
    book = package({
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet,
        "xl/sharedStrings.xml": f"<sst {s}><si><t>head</t></si></sst>", "xl/styles.xml": f'<styleSheet {s}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })
    h, t = xlsx.decode(book)
    assert h["text"] == "S" and t["merges"] == [{"row": 0, "col": 0, "rowspan": 1, "colspan": 2}]
    assert [[c[0]["text"] if c else c for c in row] for row in t["cells"]] == [["head", None], ["1.5", "2024-01-01 00:00:00"]]


def slide(shapes: str) -> bytes:
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="slides/slide1.xml"/></Relationships>'
    return package({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels,
        "ppt/slides/slide1.xml": f"<p:sld {ns}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>",
    })


def box(text: str, ph: str = "", props: str = "") -> str:
    return f'<p:sp><p:nvSpPr><p:cNvPr id="7" name="n"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p>{props}<a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


def test_pptx_titles_lists_groups():
    nodes = pptx.decode(slide(box("T", '<p:ph type="title"/>') + f"<p:grpSp>{box('g')}</p:grpSp>" + box("i", '<p:ph idx="1"/>') + box("n", "", "<a:pPr><a:buAutoNum/></a:pPr>")))
    assert shape(nodes) == [("heading", "T"), ("paragraph", "g"), ("paragraph", "i"), ("paragraph", "n")]
    assert [n.get("list_ordered") for n in nodes] == [None, None, None, True] and nodes[2]["list_id"] == "s1_7"


def page(content: bytes) -> bytes:
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % i + o + b"\nendobj\n" for i, o in enumerate(objects, 1)) + b"trailer\n<< /Root 1 0 R >>\n"


def test_pdf_words_and_cells():
    raw = page(rb"BT /F1 12 Tf 50 700 Td (Hello \(w\)) Tj 0 -20 Td [(a) -900 (b)] TJ ET 50 500 100 40 re S 100 500 m 100 540 l S")
    (p,) = pdf.read(raw)
    words = pdf.words_of(p.chars)
    assert [w["text"] for w in words] == ["Hello", "(w)", "a", "b"] and words[0]["x0"] == 50 and words[0]["size"] == 12
    assert [[c is not None for c in row] for row in pdf.ruled_cells(p.rules)[0]] == [[True, True]]


def test_html_cells_opened_and_ended_again():
    (t,) = html.decode(b"<table><tr><td>lost<td>a</td></td></tr><tr><td>b</tr></table>")
    assert t["n_rows"] == 1 and [[n["text"] for n in c] for c in t["cells"][0]] == [["a"], ["a"]]


def test_html_spans_reach_over_rows_and_columns():
    cells, width, merges = html.place([[("a", 3, 1), ("b", 1, 2)], [("c", 1, 1), ("d", 2, 1)], [("e", 1, 1)], []])
    assert cells == [["a", "b", None], [None, "c", "d"], [None, "e", None], []][:3] + [[None] * 3] and width == 3
    assert merges == [(0, 0, 3, 1), (0, 1, 1, 2), (1, 2, 2, 1)]


def test_html_code_in_a_table_is_a_block_of_the_page():
    nodes = html.decode(b"<table><tr><td>x<pre>c</pre></td></tr></table>y")
    assert [n["type"] for n in nodes] == ["code", "table", "paragraph"]


def test_html_long_lines_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 40_000):
        began = time.process_time()
        assert len(html.decode("<p>é <b>x</b></p>".encode() * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.3


def test_html_runs_of_many_words_take_linear_time():
    """Unmarked text is one run from the start; a marked word stays a run of its own."""
    import time

    from blockloom.sources import html

    def took(n: int) -> float:
        began = time.perf_counter()
        (block,) = html.decode(("<p>" + "word " * n + "<b>x y</b></p>").encode())
        assert len(block["runs"]) == 4 and len(block["text"]) == 5 * n + 3
        return time.perf_counter() - began

    took(10)
    assert took(400_000) < 4


def test_large_word_documents_are_not_held_whole():
    """Neither the tree nor the nodes of a body: memory beyond its bytes stays small, and the rows are whole."""
    import tracemalloc

    from blockloom import ir
    from blockloom.sources import decode, docx

    raw = word("<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>some words</w:t></w:r></w:p>" * 20_000)
    tracemalloc.start()
    parts = list(decode._packed(ir.flatten("d", docx.decode(raw))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) == 5 and peak < 30e6
    assert sum(len(rows) for rows, _ in decode.decoded([("d", "docx", raw)], {}, False)) == 20_000
