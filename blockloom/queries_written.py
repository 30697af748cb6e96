"""Queries over documents that are written from rows: the rows are the expected answer.

Documents of about 40 suppliers of a nation: Word, slides, workbooks, PDF and HTML, so every
decoder runs on as many documents and blocks as the tables have at a scale.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ir, written
from .functions import columns as C
from .operators import blocks as B
from .operators import enrich, headings, page_models, pdf_layout, render
from .plans import convert
from .queries import _CAPS, _WC, long, query, table, task_count
from .scratch import settled
from .sources import blocks_json, clients, decode
from .written import text

#: The number of a supplier's document: about 40 suppliers of a nation share one, so documents become more with the table, not longer.
_DOC = "(s_nationkey + 25 * (s_suppkey // 1000))"
_SPARK_DOC = "s_nationkey + 25 * (s_suppkey div 1000)"
#: Suppliers with their place in their document, as SQL.
_S = f"s AS (SELECT {_DOC}::BIGINT AS doc, s_suppkey::BIGINT AS k, s_name AS name, row_number() OVER (PARTITION BY {_DOC} ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY {_DOC}) AS n FROM supplier)"


def _doc() -> Column:
    return F.col("doc_id").cast("long").alias("doc")


def _field(name: str):
    return lambda v: v[name]


#: Bytes of the suppliers' table that one task writes documents from, some thousand suppliers; what is written of one is some kilobytes.
ROWS = 32 << 10


def _grouped(spark: SparkSession, sf_dir: str, **parts: Column) -> DataFrame:
    """A row for each document: doc_id, n, and parts of its suppliers (k, name, i) joined in order.

    Suppliers are dealt out once, by document and to a fixed number of tasks: Spark would join small partitions into one task, that then writes and decodes all documents.
    """
    s = table(spark, sf_dir, "supplier").select(F.expr(_SPARK_DOC).alias("doc"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    s = s.repartition(task_count(s, ROWS), "doc")
    rows = s.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("k", "name"))).alias("x")).select("doc", F.size("x").alias("n"), F.posexplode("x").alias("i", "x"))
    rows = rows.select("doc", "n", (F.col("i") + 1).alias("i"), "x.k", "x.name")
    joined = rows.select("doc", "n", "i", *(c.alias(p) for p, c in parts.items())).groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("i", *parts))).alias("x"))
    return joined.select(F.col("doc").cast("string").alias("doc_id"), "n", *(F.transform("x", _field(p)).alias(p) for p in parts))


def _all(name: str) -> Column:
    return F.array_join(name, "")


def _runs() -> Column:
    """Runs as one line: text, then marks and link in braces."""
    return F.array_join(F.transform("runs", lambda r: F.concat(r["text"], F.lit("{"), F.array_join(r["marks"], "+"), F.lit("}"))), "")


# Word

def _word(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda props, *runs: text("<w:p><w:pPr>", props, "</w:pPr>", *runs, "</w:p>")
    r = lambda props, t: text("<w:r><w:rPr>", props, '</w:rPr><w:t xml:space="preserve">', t, "</w:t></w:r>")
    k, name = F.col("k"), F.col("name")
    cell = lambda props, t: text("<w:tc><w:tcPr>", props, "</w:tcPr>", p("", r("", t)), "</w:tc>")
    merge = F.when(F.col("i") == 1, '<w:vMerge w:val="restart"/>').otherwise("<w:vMerge/>")
    rows = _grouped(
        spark, sf_dir,
        paragraphs=p("", r("<w:b/>", name), r("", text(" has key ", k, ".")), r('<w:vertAlign w:val="superscript"/>', F.col("i"))),
        items=p(text('<w:numPr><w:ilvl w:val="', k % 2, '"/><w:numId w:val="1"/></w:numPr>'), r("<w:i/><w:u/>", text("item ", name))),
        lines=text("<w:tr>", cell(merge, "all"), cell("", name), "</w:tr>"),
    )
    head = p('<w:pStyle w:val="T1"/>', r("", text("Nation ", F.col("doc_id"))))
    wide = text("<w:tr>", cell('<w:gridSpan w:val="2"/>', "Suppliers"), "</w:tr>")
    inner = text("<w:tr><w:tc>", p("", r("", "in")), "<w:tbl><w:tr>", cell("", "nested"), "</w:tr></w:tbl>", p("", ""), "</w:tc>", cell("", "last"), "</w:tr>")
    picture = p("", '<w:r><a:blip r:embed="r1"/></w:r>')
    body = text(f"<w:document {written.W}><w:body>", head, _all("paragraphs"), _all("items"), "<w:tbl>", wide, _all("lines"), inner, "</w:tbl>", picture, "</w:body></w:document>")
    levels = '<w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl>'
    parts = {
        "word/document.xml": body, "word/_rels/document.xml.rels": written.rels(("r1", "image", "media/image1.png")), "word/media/image1.png": text("picture ", F.col("doc_id")),
        "word/styles.xml": f'<w:styles {written.W}><w:style w:type="paragraph" w:styleId="T1"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {written.W}><w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    }
    return rows.select("doc_id", F.lit("docx").alias("fmt"), F.concat(F.lit("w/"), "doc_id", F.lit(".docx")).alias("source_path"), written.package(parts).alias("content"))


def _word_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.blocks(_word(spark, sf_dir), ("docx",))


_WORD_ROWS = f"""WITH {_S}, d AS (SELECT DISTINCT doc, n FROM s), o AS (
SELECT doc, 0 AS ordinal, 'heading' AS type, 'Nation ' || doc AS text, 2 AS level, NULL AS list_level, NULL::BOOLEAN AS list_ordered, NULL AS runs FROM d
UNION ALL SELECT doc, i, 'paragraph', name || ' has key ' || k || '.' || i, NULL, NULL, NULL, name || '{{bold}} has key ' || k || '.{{}}' || i || '{{superscript}}' FROM s
UNION ALL SELECT doc, n + i, 'paragraph', 'item ' || name, NULL, k % 2, k % 2 = 0, 'item ' || name || '{{italic+underline}}' FROM s
UNION ALL SELECT doc, 2 * n + 1, 'table', NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT doc, 3 * n + 8, 'image', NULL, NULL, NULL, NULL, NULL FROM d)
SELECT doc, ordinal::BIGINT AS ordinal, type, text, level::BIGINT AS level, list_level::BIGINT AS list_level, list_ordered, runs FROM o"""


def _top_rows(blocks: DataFrame) -> DataFrame:
    return B.top_level(blocks).select(_doc(), long("ordinal"), "type", "text", long("level"), long("list_level"), "list_ordered", _runs().alias("runs"))


@query(_WORD_ROWS)
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word documents: styled headings, marks, lists, a table, a picture."""
    return _top_rows(_word_blocks(spark, sf_dir))


_WORD_CELLS = f"""WITH {_S}, d AS (SELECT DISTINCT doc, n FROM s), c AS (
SELECT doc, 0 AS r, 0 AS c, 0 AS pos, 'paragraph' AS type, 'Suppliers' AS text FROM d UNION ALL SELECT doc, 1, 0, 0, 'paragraph', 'all' FROM d UNION ALL SELECT doc, i, 1, 0, 'paragraph', name FROM s
UNION ALL SELECT doc, n + 1, 0, 0, 'paragraph', 'in' FROM d UNION ALL SELECT doc, n + 1, 0, 1, 'table', NULL FROM d UNION ALL SELECT doc, n + 1, 1, 0, 'paragraph', 'last' FROM d UNION ALL SELECT doc, 0, 0, 0, 'paragraph', 'nested' FROM d)
SELECT doc, r::BIGINT AS cell_row, c::BIGINT AS cell_col, pos::BIGINT AS cell_pos, type, text FROM c"""


@query(_WORD_CELLS)
def docx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of Word tables: spans to the right and down, a table in a cell."""
    return _word_blocks(spark, sf_dir).where("parent_uid is not null").select(_doc(), long("cell_row"), long("cell_col"), long("cell_pos"), "type", "text")


@query(f"""WITH {_S}, d AS (SELECT DISTINCT doc, n FROM s) SELECT doc, n + 2 AS n_rows, 2::BIGINT AS n_cols, '0,0,1,2' || CASE WHEN n > 1 THEN ';1,0,' || n || ',1' ELSE '' END AS merges, n::BIGINT AS null_slots FROM d""")
def docx_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of Word tables, and the slots that they cover."""
    spans = F.array_join(F.transform(F.sort_array("merges"), lambda m: F.concat_ws(",", m["row"], m["col"], m["rowspan"], m["colspan"])), ";")
    return B.tables(_word_blocks(spark, sf_dir)).select(_doc(), long("n_rows"), long("n_cols"), spans.alias("merges"), F.size("null_slots").cast("long").alias("null_slots"))


def _flags(k: str) -> dict[str, str]:
    return {"bold": f"{k} % 2 = 0", "center": f"{k} % 3 = 0", "keep_next": f"{k} % 5 = 0", "italic": f"{k} % 7 = 0", "underline": f"{k} % 11 = 0", "large": f"{k} % 4 = 0"}


def _look_sql(w: headings.Weights) -> str:
    flags = _flags("p_partkey")
    terms = [(flags["bold"], w.bold), ("caps", w.caps), ("title AND wc <= 7", w.titlecase), (flags["center"], w.center), (flags["italic"], w.italic), ("wc <= 4", w.short + w.very_short), ("wc > 4 AND wc <= 7", w.short), (flags["underline"], w.underline), (flags["keep_next"], w.keep_next), (flags["large"], w.xlarge_font), ("right(t, 1) IN ('.', '?', '!')", w.sentence), ("right(t, 1) NOT IN ('.', '?', '!', ',', ';', ':')", w.no_punct)]
    score = " + ".join(f"CASE WHEN {cond} THEN {float(weight)} ELSE 0.0 END" for cond, weight in terms)
    return rf"""WITH p AS (SELECT p_brand, p_partkey, p_name AS t, {_WC.replace('t)', 'p_name)')} AS wc, {_CAPS.replace('(t,', '(p_name,')} AS caps, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n,
(NOT {_CAPS.replace('(t,', '(p_name,')} AND len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3)) >= 2 AND len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3 AND NOT regexp_matches(w, '^\p{{Lu}}'))) = 0) AS title FROM part),
q AS (SELECT *, i < n AND {score} >= {w.threshold} AS head FROM p)
SELECT p_brand AS brand, (i - 1)::BIGINT AS ordinal, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS type, t AS text, CASE WHEN head THEN CASE WHEN {flags["large"]} THEN 1 ELSE 2 END END::BIGINT AS level FROM q"""


@query(_look_sql(headings.DOCUMENT))
def docx_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of Word documents that become headings by their looks: size against the body, marks, place."""
    on = lambda name, xml: F.when(F.expr(_flags("p_partkey")[name]), xml).otherwise("")
    props = text(on("center", '<w:jc w:val="center"/>'), on("keep_next", "<w:keepNext/>"))
    look = text(on("bold", "<w:b/>"), on("italic", "<w:i/>"), on("underline", '<w:u w:val="single"/>'), on("large", '<w:sz w:val="40"/>'))
    p = text("<w:p><w:pPr>", props, "</w:pPr><w:r><w:rPr>", look, "</w:rPr><w:t>", C.escape_html("p_name", quote=False), "</w:t></w:r></w:p>")
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", p.alias("p")))).alias("x"))
    body = text(f"<w:document {written.W}><w:body>", F.array_join(F.transform("x", lambda v: v["p"]), ""), "</w:body></w:document>")
    styles = f'<w:styles {written.W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults></w:styles>'
    docs = rows.select(F.col("p_brand").alias("doc_id"), F.lit("docx").alias("fmt"), written.package({"word/document.xml": body, "word/styles.xml": styles}).alias("content"))
    return convert.blocks(docs, ("docx",)).select(F.col("doc_id").alias("brand"), long("ordinal"), "type", "text", long("level"))


# Slides

def _deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deck for each nation: two slides for each of its suppliers."""
    name, k, i = F.col("name"), F.col("k"), F.col("i")
    box = lambda ident, ph, body: text(f'<p:sp><p:nvSpPr><p:cNvPr id="{ident}" name="n"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>', body, "</p:txBody></p:sp>")
    para = lambda props, *runs: text("<a:p>", props, *runs, "</a:p>")
    run = lambda props, t: text("<a:r>", props, "<a:t>", t, "</a:t></a:r>")
    group = text("<p:grpSp>", box(4, "", text(para("", run("", text("grouped ", name)), "<a:br/>", run('<a:rPr i="1"/>', "soft")))), "</p:grpSp>")
    cell = lambda props, t: text(f"<a:tc {props}><a:txBody>", para("", run("", t)), "</a:txBody></a:tc>")
    grid = text('<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tblGrid><a:gridCol/><a:gridCol/></a:tblGrid><a:tr>', cell('gridSpan="2"', "both"), cell('hMerge="1"', ""), "</a:tr><a:tr>", cell("", k), cell("", name), "</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>")
    lists = box(3, '<p:ph idx="1"/>', text(para('<a:pPr lvl="1"/>', run('<a:rPr b="1"/>', text("point ", name))), para("<a:pPr><a:buNone/></a:pPr>", run("", "no point")), para("<a:pPr><a:buAutoNum/></a:pPr>", run("", "counted"))))
    picture = '<p:pic><p:nvPicPr><p:cNvPr id="9" name="logo"/></p:nvPicPr><a:blip r:embed="r1"/></p:pic>'
    first = text(f"<p:sld {written.P}><p:cSld><p:spTree>", box(2, '<p:ph type="ctrTitle"/>', para("", run("", text("Slide of ", name)))), lists, group, grid, picture, "</p:spTree></p:cSld></p:sld>")
    second = text(f"<p:sld {written.P}><p:cSld><p:spTree>", box(2, "", text(para("", run('<a:rPr sz="1200"/>', text("plain words for ", name, ", that go on."))), para('<a:pPr algn="ctr"/>', run('<a:rPr b="1" sz="2400"/>', text("Key ", k))))), "</p:spTree></p:cSld></p:sld>")
    rows = _grouped(spark, sf_dir, first=first, second=second, note=text(f"<p:notes {written.P}><p:cSld><p:spTree>", box(2, '<p:ph type="body"/>', para("", run("", text("note ", i)))), "</p:spTree></p:cSld></p:notes>"))
    listed = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), 2 * F.col("n")), f), "")
    deck = {
        "ppt/presentation.xml": text(f"<p:presentation {written.P}><p:sldIdLst>", listed(lambda s: text('<p:sldId id="', s, '" r:id="r', s, '"/>')), "</p:sldIdLst></p:presentation>"),
        "ppt/_rels/presentation.xml.rels": text(written.RELS, listed(lambda s: text('<Relationship Id="r', s, '" Type="slide" Target="slides/slide', s, '.xml"/>')), "</Relationships>"),
        "ppt/media/image1.png": "logo",
    }
    # parts whose number follows the rows are a map of their own
    named = lambda column, name: F.map_from_arrays(F.transform(column, lambda x, i: name(i)), column)
    own = [
        named(F.col("first"), lambda i: text("ppt/slides/slide", 2 * i + 1, ".xml")), named(F.col("second"), lambda i: text("ppt/slides/slide", 2 * i + 2, ".xml")), named(F.col("note"), lambda i: text("ppt/notesSlides/notesSlide", 2 * i + 1, ".xml")),
        named(F.transform("note", lambda x, i: text(written.RELS, '<Relationship Id="r1" Type="image" Target="../media/image1.png"/><Relationship Id="r2" Type="t/notesSlide" Target="../notesSlides/notesSlide', 2 * i + 1, '.xml"/></Relationships>')), lambda i: text("ppt/slides/_rels/slide", 2 * i + 1, ".xml.rels")),
    ]
    return rows.select("doc_id", F.lit("pptx").alias("fmt"), written.package_of(F.map_concat(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in deck.items() for x in kv]), *own)).alias("content"))


def _slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.blocks(_deck(spark, sf_dir), ("pptx",))


@query(f"""WITH {_S}, b AS (SELECT doc, i, k, name, unnest([
{{'at': 0, 'page': 2 * i - 1, 'type': 'heading', 'text': 'Slide of ' || name, 'level': 1, 'list_level': NULL, 'list_ordered': NULL, 'runs': NULL}},
{{'at': 1, 'page': 2 * i - 1, 'type': 'paragraph', 'text': 'point ' || name, 'level': NULL, 'list_level': 1, 'list_ordered': NULL, 'runs': 'point ' || name || '{{bold}}'}},
{{'at': 2, 'page': 2 * i - 1, 'type': 'paragraph', 'text': 'no point', 'level': NULL, 'list_level': NULL, 'list_ordered': NULL, 'runs': NULL}},
{{'at': 3, 'page': 2 * i - 1, 'type': 'paragraph', 'text': 'counted', 'level': NULL, 'list_level': 0, 'list_ordered': true, 'runs': NULL}},
{{'at': 4, 'page': 2 * i - 1, 'type': 'paragraph', 'text': 'grouped ' || name || ' soft', 'level': NULL, 'list_level': NULL, 'list_ordered': NULL, 'runs': 'grouped ' || name || ' {{}}soft{{italic}}'}},
{{'at': 5, 'page': 2 * i - 1, 'type': 'table', 'text': NULL, 'level': NULL, 'list_level': NULL, 'list_ordered': NULL, 'runs': NULL}},
{{'at': 6, 'page': 2 * i - 1, 'type': 'image', 'text': NULL, 'level': NULL, 'list_level': NULL, 'list_ordered': NULL, 'runs': NULL}},
{{'at': 7, 'page': 2 * i - 1, 'type': 'paragraph', 'text': 'note ' || i, 'level': NULL, 'list_level': NULL, 'list_ordered': NULL, 'runs': NULL}},
{{'at': 8, 'page': 2 * i, 'type': 'paragraph', 'text': 'plain words for ' || name || ', that go on.', 'level': NULL, 'list_level': NULL, 'list_ordered': NULL, 'runs': NULL}},
{{'at': 9, 'page': 2 * i, 'type': 'heading', 'text': 'Key ' || k, 'level': 1, 'list_level': NULL, 'list_ordered': NULL, 'runs': 'Key ' || k || '{{bold}}'}}]) AS x FROM s)
SELECT doc, x.page::BIGINT AS page, (x.at % 8)::BIGINT AS place, x.type AS type, x.text AS text, x.level::BIGINT AS level, x.list_level::BIGINT AS list_level, x.list_ordered::BOOLEAN AS list_ordered, x.runs AS runs FROM b""")
def pptx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides: titles, bullets, groups, soft breaks, tables, pictures, notes, and a title found by its looks."""
    rows = B.top_level(_slides(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("doc_id", "span.page").orderBy("ordinal")) - 1
    return rows.select(_doc(), F.col("span.page").cast("long").alias("page"), place.cast("long").alias("place"), "type", "text", long("level"), long("list_level"), "list_ordered", _runs().alias("runs"))


@query(f"WITH {_S} SELECT doc, (2 * i - 1)::BIGINT AS page, 2::BIGINT AS n_rows, 2::BIGINT AS n_cols, 'both,' || k || ',' || name AS cells, 2::BIGINT AS across FROM s")
def pptx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of slides with the texts of their cells, which meet in one grouping."""
    rows, own = _slides(spark, sf_dir).where("type = 'table' or parent_uid is not null"), F.col("parent_uid").isNull()
    cell, grid = F.when(~own, F.struct("cell_row", "cell_col", "text")), F.when(own, F.struct(F.col("span.page").alias("page"), "n_rows", "n_cols", "merges"))
    held = rows.groupBy("doc_id", F.coalesce("parent_uid", "uid").alias("uid")).agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.max_by(grid, own).alias("grid"))
    texts = F.array_join(F.transform("cells", lambda c: c["text"]), ",")
    return held.where("grid is not null and size(cells) > 0").select(_doc(), F.col("grid.page").cast("long").alias("page"), F.col("grid.n_rows").cast("long").alias("n_rows"), F.col("grid.n_cols").cast("long").alias("n_cols"), texts.alias("cells"), F.col("grid.merges")[0]["colspan"].cast("long").alias("across"))


# Workbooks

def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, at = F.col("k"), F.col("name"), F.col("i") + 2
    line = text('<row r="', at, '"><c r="B', at, '"><v>', k, '</v></c><c r="C', at, '" t="inlineStr"><is><t>', name, '</t></is></c><c r="D', at, '" s="1"><v>', k + 45292, '</v></c><c r="E', at, '" t="b"><v>', k % 2, "</v></c></row>")
    rows = _grouped(spark, sf_dir, lines=line)
    sheet = text(f"<worksheet {written.S}><sheetData>", '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>9</v></c></row>', _all("lines"), '</sheetData><mergeCells><mergeCell ref="B2:C2"/></mergeCells></worksheet>')
    xdr = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    drawing = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/drawing"
    parts = {
        "xl/workbook.xml": text(f'<workbook {written.S} {written.R}><sheets><sheet name="Nation ', F.col("doc_id"), '" r:id="r1"/><sheet name="empty" r:id="r2"/><sheet name="picture" r:id="r3"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": written.rels(*((f"r{i}", "t", f"worksheets/sheet{i}.xml") for i in (1, 2, 3))), "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/sheet2.xml": f"<worksheet {written.S}><sheetData/></worksheet>", "xl/worksheets/sheet3.xml": f"<worksheet {written.S}><sheetData/><drawing/></worksheet>",
        "xl/worksheets/_rels/sheet3.xml.rels": written.rels(("d1", drawing, "../drawings/drawing1.xml")), "xl/drawings/_rels/drawing1.xml.rels": written.rels(("i1", "image", "../media/image1.png")),
        "xl/drawings/drawing1.xml": f'<xdr:wsDr {xdr}><xdr:oneCellAnchor><xdr:from><xdr:col>2</xdr:col><xdr:row>1</xdr:row></xdr:from><xdr:pic><a:blip r:embed="i1"/></xdr:pic></xdr:oneCellAnchor></xdr:wsDr>',
        "xl/media/image1.png": text("sheet picture ", F.col("doc_id")), "xl/sharedStrings.xml": f"<sst {written.S}><si><r><t>Sup</t></r><r><t>pliers</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {written.S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    return rows.select("doc_id", F.lit("xlsx").alias("fmt"), F.concat(F.lit("x/"), "doc_id", F.lit(".xlsx")).alias("source_path"), written.package(parts).alias("content"))


@query(f"""WITH {_S}, d AS (SELECT DISTINCT doc, n FROM s), c AS (SELECT doc, 0 AS r, 0 AS c, 'Suppliers' AS text FROM d UNION ALL SELECT doc, i, 0, k::VARCHAR FROM s UNION ALL SELECT doc, i, 1, name FROM s
UNION ALL SELECT doc, i, 2, strftime(DATE '2024-01-01' + k::INT, '%Y-%m-%d') || ' 00:00:00' FROM s UNION ALL SELECT doc, i, 3, CASE WHEN k % 2 = 1 THEN 'True' ELSE 'False' END FROM s)
SELECT doc, r::BIGINT AS cell_row, c::BIGINT AS cell_col, text FROM c""")
def xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of workbooks: numbers, shared and inline text, dates, truth values; a merged head."""
    return decode.blocks(_book(spark, sf_dir)).where("parent_uid is not null").select(_doc(), long("cell_row"), long("cell_col"), "text")


@query(f"""WITH {_S}, b AS (SELECT DISTINCT doc, n, unnest([{{'place': 0, 'type': 'heading', 'text': 'Nation ' || doc, 'n_rows': NULL, 'locator': NULL}}, {{'place': 1, 'type': 'table', 'text': NULL, 'n_rows': n + 1, 'locator': NULL}},
{{'place': 2, 'type': 'heading', 'text': 'picture', 'n_rows': NULL, 'locator': NULL}}, {{'place': 3, 'type': 'image', 'text': NULL, 'n_rows': NULL, 'locator': 'xl/media/image1.png 1 2'}}]) AS x FROM s)
SELECT doc, x.place::BIGINT AS place, x.type AS type, x.text AS text, x.n_rows::BIGINT AS n_rows, x.locator AS locator FROM b""")
def xlsx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets in order: a heading, the used range, pictures with their anchor; empty sheets are left out."""
    rows = B.top_level(decode.blocks(_book(spark, sf_dir)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")) - 1
    at = [F.get_json_object("locator", f"$.{x}") for x in ("part", "anchor_row", "anchor_col")]
    return rows.select(_doc(), place.cast("long").alias("place"), "type", "text", F.when(F.col("type") == "table", F.col("n_rows")).cast("long").alias("n_rows"), F.when(F.col("type") == "image", F.concat_ws(" ", *at)).alias("locator"))


# PDF

LINES = 20


def _print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF for each nation: pages with a heading, LINES suppliers as a list, text of two lines, a ruled table and a picture."""
    items = _grouped(spark, sf_dir, items=F.col("name"))
    pages = items.withColumn("p", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / LINES).cast("int") - 1))).withColumn("own", F.slice("items", F.col("p") * LINES + 1, LINES))
    show = lambda font, size, x, y, t: text(f"BT /{font} {size} Tf {x} ", y, " Td (", t, ") Tj ET\n")
    listed = F.array_join(F.transform("own", lambda name, i: show("F1", 10, 72, 700 - 14 * i, text(i + 1, "\\) ", name))), "")
    prose = text(show("F1", 10, 50, F.lit(380), "These words are the first line of the text on page"), show("F1", 10, 50, F.lit(368), text("number ", F.col("p") + 1, " of this file.")))
    grid = text("50 200 120 40 re S\n50 220 m 170 220 l S\n110 200 m 110 220 l S\n", show("F1", 8, 55, F.lit(227), "wide cell"), show("F1", 8, 55, F.lit(207), "left"), show("F1", 8, 115, F.lit(207), F.col("p") + 1))
    picture = "q 60 0 0 50 300 100 cm /Im1 Do Q\n"
    stream = text(show("F2", 18, 50, F.lit(740), text("Nation ", F.col("doc_id"))), listed, prose, grid, picture)
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", stream.alias("s")))).alias("x"))
    return docs.select("doc_id", F.lit("pdf").alias("fmt"), written.pdf(F.transform("x", lambda v: v["s"])).alias("content"))


_PRINTED = f"""WITH {_S}, p AS (SELECT doc, (i - 1) // {LINES} + 1 AS page, count(*) AS n FROM s GROUP BY ALL), b AS (
SELECT doc, page, 0 AS place, 'heading' AS type, 'Nation ' || doc AS text, 1 AS level, NULL AS list_level, NULL::BOOLEAN AS list_ordered, 'Nation ' || doc || '{{bold}}' AS runs FROM p
UNION ALL SELECT doc, (i - 1) // {LINES} + 1, (i - 1) % {LINES} + 1, 'paragraph', name, NULL, 0, true, NULL FROM s
UNION ALL SELECT doc, page, n + 1, 'paragraph', 'These words are the first line of the text on page number ' || page || ' of this file.', NULL, NULL, NULL, NULL FROM p
UNION ALL SELECT doc, page, n + 2, 'table', NULL, NULL, NULL, NULL, NULL FROM p UNION ALL SELECT doc, page, n + 3, 'image', NULL, NULL, NULL, NULL, NULL FROM p)
SELECT doc, page::BIGINT AS page, place::BIGINT AS place, type, text, level::BIGINT AS level, list_level::BIGINT AS list_level, list_ordered, runs FROM b"""


@query(_PRINTED)
def pdf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF pages laid out from their own text: headings by size, numbered lists, text over lines, ruled tables, pictures."""
    rows = B.top_level(convert.pdf_blocks(_print(spark, sf_dir)))
    place = F.row_number().over(Window.partitionBy("doc_id", "span.page").orderBy("ordinal")) - 1
    return rows.select(_doc(), F.col("span.page").cast("long").alias("page"), place.cast("long").alias("place"), "type", "text", long("level"), long("list_level"), "list_ordered", _runs().alias("runs"))


@query(f"""WITH {_S}, p AS (SELECT DISTINCT doc, (i - 1) // {LINES} + 1 AS page FROM s) SELECT doc, page::BIGINT AS page, '0,0 wide cell;1,0 left;1,1 ' || page AS cells, '0,0,1,2' AS merges, 2::BIGINT AS n_rows, 2::BIGINT AS n_cols FROM p""")
def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled tables: spans from the grid, text from the words in each cell."""
    rows = convert.pdf_blocks(_print(spark, sf_dir))
    cells = rows.where("parent_uid is not null").groupBy("doc_id", F.col("parent_uid").alias("uid")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_row", "cell_col", "text"))), lambda c: F.concat(c["cell_row"].cast("string"), F.lit(","), c["cell_col"].cast("string"), F.lit(" "), c["text"])), ";").alias("cells"))
    spans = F.array_join(F.transform("merges", lambda m: F.concat_ws(",", m["row"], m["col"], m["rowspan"], m["colspan"])), ";")
    return B.tables(rows).join(cells, ["doc_id", "uid"]).select(_doc(), F.col("span.page").cast("long").alias("page"), "cells", spans.alias("merges"), long("n_rows"), long("n_cols"))


# Word documents seen through the other operators

_UP = "translate({}::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')"


@query(f"""WITH {_S}, t AS (SELECT doc, n, string_agg('**' || name || '** has key ' || k || '.' || {_UP.format('i')}, chr(10) || chr(10) ORDER BY i) AS paragraphs,
string_agg(CASE WHEN k % 2 = 0 THEN number || '. ' ELSE '  - ' END || '<u>*item ' || name || '*</u>', chr(10) ORDER BY i) AS items,
string_agg('<tr>' || CASE WHEN i = 1 THEN '<td' || CASE WHEN n > 1 THEN ' rowspan="' || n || '"' ELSE '' END || '>all</td>' ELSE '' END || '<td>' || name || '</td></tr>', '' ORDER BY i) AS lines
FROM (SELECT *, sum((k % 2 = 0)::INT) OVER (PARTITION BY doc ORDER BY i) AS number FROM s) GROUP BY doc, n)
SELECT doc, '## Nation ' || doc || chr(10) || chr(10) || paragraphs || chr(10) || chr(10) || items || chr(10) || chr(10) || '<table><tr><td colspan="2">Suppliers</td></tr>' || lines ||
'<tr><td>in<br><table><tr><td>nested</td></tr></table></td><td>last</td></tr></table>' || chr(10) || chr(10) || '![](<image1>)' || chr(10) AS markdown FROM t""")
def docx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word documents as Markdown: marks and raised figures, a list of two levels, a table with spans and a table inside."""
    return render.to_markdown(settled(_word_blocks(spark, sf_dir))).select(_doc(), "markdown")


@query(f"""WITH {_S}, t AS (SELECT doc, n, string_agg(CASE WHEN i = 1 THEN 'all' ELSE '' END || ' | ' || name, chr(10) ORDER BY i) AS lines, string_agg('Suppliers: ' || CASE WHEN i = 1 THEN 'all' ELSE '' END || chr(10) || 'col1: ' || name, chr(10) || chr(10) ORDER BY i) AS pairs FROM s GROUP BY doc, n)
SELECT doc, 'Suppliers | ' || chr(10) || lines || chr(10) || 'in' || chr(10) || '| nested |' || chr(10) || '| --- | | last' || chr(10) || '[merged: cell (row 0, col 0) spans 1x2' || CASE WHEN n > 1 THEN '; cell (row 1, col 0) spans ' || n || 'x1' ELSE '' END || ']' AS table_plain,
pairs || chr(10) || chr(10) || 'Suppliers: in' || chr(10) || '| nested |' || chr(10) || '| --- |' || chr(10) || 'col1: last' AS table_text FROM t""")
def nested_table_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with spans and a table inside as a model and as a reader of plain text see it."""
    return render.cell_text(settled(_word_blocks(spark, sf_dir))).where("uid not like '%/%'").select(_doc(), "table_plain", "table_text")


def _again(blocks: DataFrame, fmt: str) -> DataFrame:
    """Blocks as JSON documents, read again."""
    docs = blocks.select("doc_id").distinct().select("doc_id", F.lit("p").alias("source_path"), F.lit(fmt).alias("fmt"))
    return blocks_json.read(B.documents_json(docs, blocks))[1]


@query(_WORD_ROWS)
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level blocks of Word documents that went through JSON."""
    return _top_rows(_again(settled(_word_blocks(spark, sf_dir)), "docx"))


@query(_WORD_CELLS)
def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _again(settled(_word_blocks(spark, sf_dir)), "docx").where("parent_uid is not null")
    return rows.select(_doc(), long("cell_row"), long("cell_col"), long("cell_pos"), "type", "text")


@query(f"SELECT (SELECT count(DISTINCT {_DOC}) FROM supplier)::BIGINT AS documents, 0::BIGINT AS different")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of all blocks of Word documents are as before after JSON."""
    before = settled(_word_blocks(spark, sf_dir))
    after = _again(before, "docx")
    plain = lambda rows: rows.select("doc_id", "uid", F.sha2(F.to_json(F.struct(*(c for c in ir.COLUMNS if c not in ("doc_id", "uid", "signals"))), {"ignoreNullFields": "true"}), 256).alias("h"))
    odd = plain(before).unionByName(plain(after)).groupBy("doc_id", "uid", "h").agg(F.count("*").alias("n"))
    return odd.agg(F.countDistinct("doc_id").alias("documents"), F.sum((F.col("n") != 2).cast("long")).alias("different"))


@query(f"""WITH {_S}, d AS (SELECT DISTINCT doc FROM s) SELECT doc, 1::BIGINT AS cell_row, 0::BIGINT AS cell_col, 'paragraph' AS type, 'one' AS text, 2::BIGINT AS null_slots FROM d
UNION ALL SELECT doc, 0, 1, 'paragraph', 'Nation ' || doc, 2 FROM d""")
def json_version_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the first version, whose cells are strings; null is no cell, an empty string an empty one."""
    body = text('{"doc_id":"', F.col("doc_id"), '","source_path":"p","fmt":"docx","blocks":[{"type":"table","id":"t9","table":{"n_rows":2,"n_cols":2,"cells":[[null,"Nation ', F.col("doc_id"), '"],["one",""]],"merges":[{"row":1,"col":0}]}},{"type":"heading","id":"x","text":"h","level":1}]}')
    rows = settled(blocks_json.read(_grouped(spark, sf_dir, name=F.col("name")).select("doc_id", body.alias("json")))[1])
    tables = B.by_id(rows, "t9").select("doc_id", F.col("uid").alias("parent_uid"), (F.size("null_slots") + 1).cast("long").alias("null_slots"))
    return rows.where("parent_uid is not null").drop("null_slots").join(tables, ["doc_id", "parent_uid"]).select(_doc(), long("cell_row"), long("cell_col"), "type", "text", "null_slots")


@query(f"SELECT DISTINCT {_DOC}::BIGINT AS doc, 3::BIGINT AS page_count, 'text/plain' AS mimetype, '{{\"a\":' || {_DOC} || '}}' AS metadata, sha256({_DOC}::VARCHAR) AS raw_sha256 FROM supplier")
def json_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents say of themselves, after JSON."""
    key = F.col("doc_id")
    docs = _grouped(spark, sf_dir, name=F.col("name")).select("doc_id", F.lit("p").alias("source_path"), F.lit("markdown").alias("fmt"), F.sha2(key, 256).alias("raw_sha256"), F.lit("text/plain").alias("mimetype"), F.lit(3).alias("page_count"), text('{"a":', key, "}").alias("metadata"))
    blocks = decode.blocks(docs.select("doc_id", F.lit("x").alias("content")), "markdown")
    head, _ = blocks_json.read(B.documents_json(docs, blocks))
    return head.select(_doc(), long("page_count"), "mimetype", "metadata", "raw_sha256")


@query(f"WITH {_S} SELECT doc, 'num1' AS list_id, count(*) AS items, string_agg('item ' || name, ',' ORDER BY i) AS texts FROM s GROUP BY doc")
def list_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every list, in order."""
    rows = B.list_items(_word_blocks(spark, sf_dir))
    return rows.select(_doc(), "list_id", F.size("items").cast("long").alias("items"), F.array_join(F.transform("items", lambda x: x["text"]), ",").alias("texts"))


@query(f"WITH {_S} SELECT doc, 1::BIGINT AS tables, 1::BIGINT AS images, max_by(name, -i) || ' has key ' || max_by(k, -i) || '.1' AS first FROM s GROUP BY doc")
def block_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level tables and images, and the block with an id."""
    rows = settled(_word_blocks(spark, sf_dir))
    n = lambda found, name: found.groupBy("doc_id").agg(F.count("*").alias(name))
    return n(B.tables(rows), "tables").join(n(B.images(rows, nested=False), "images"), "doc_id").join(B.by_id(rows, "b1").select("doc_id", F.col("text").alias("first")), "doc_id").select(_doc(), "tables", "images", "first")


@query(f"""WITH {_S}, g AS (SELECT doc, i, k, sum((k % 3 = 0 OR i = 1)::INT) OVER (PARTITION BY doc ORDER BY i) AS island FROM s) SELECT doc, min(i)::BIGINT AS row, count(*) AS rowspan FROM g GROUP BY doc, island HAVING count(*) > 1""")
def cell_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that go on with the one above, as spans."""
    s = table(spark, sf_dir, "supplier").select(F.expr(_SPARK_DOC).alias("doc_id"), F.col("s_suppkey").alias("k"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))
    cells = s.withColumn("row", at).select("doc_id", F.lit("b0").alias("uid"), F.lit(0).alias("col"), "row", ((F.col("k") % 3 != 0) & (F.col("row") > 1)).alias("continues"))
    return B.vertical_merges(cells).select(_doc(), long("row"), long("rowspan"))


# HTML with tables, pictures and nested lists

def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("k"), F.col("name")
    image = text('<img src="data:image/png;base64,', F.base64(name.cast("binary")), '" alt="', name, '">')
    rows = _grouped(spark, sf_dir, lines=text("<tr><td>", k, "</td><td>", name, "</td><td>see ", image, "</td></tr>"), items=text("<li>", name, "<ol><li>key ", k, "</li></ol></li>"))
    head = "<tr><td rowspan=2>both</td><td colspan=2>wide</td></tr><tr><td>x<table><tr><td>inner</td></tr></table></td><td><b>y</b></td></tr>"
    body = text("<h2>Nation ", F.col("doc_id"), "</h2><table>", head, _all("lines"), "</table><ul>", _all("items"), "</ul><p>end <img src='http://far.example/a.png'></p>")
    return rows.select("doc_id", F.lit("html").alias("fmt"), F.concat(F.lit("h/"), "doc_id", F.lit(".html")).alias("source_path"), body.alias("content"))


@query(f"""WITH {_S}, d AS (SELECT DISTINCT doc, n FROM s), c AS (SELECT doc, 0 AS r, 0 AS c, 'paragraph' AS type, 'both' AS text, NULL AS runs FROM d UNION ALL SELECT doc, 0, 1, 'paragraph', 'wide', NULL FROM d UNION ALL SELECT doc, 1, 1, 'paragraph', 'x', NULL FROM d UNION ALL SELECT doc, 1, 1, 'table', NULL, NULL FROM d
UNION ALL SELECT doc, 0, 0, 'paragraph', 'inner', NULL FROM d UNION ALL SELECT doc, 1, 2, 'paragraph', 'y', NULL FROM d UNION ALL SELECT doc, i + 1, 0, 'paragraph', k::VARCHAR, NULL FROM s UNION ALL SELECT doc, i + 1, 1, 'paragraph', name, NULL FROM s
UNION ALL SELECT doc, i + 1, 2, 'paragraph', 'see', NULL FROM s UNION ALL SELECT doc, i + 1, 2, 'image', NULL, NULL FROM s) SELECT doc, r::BIGINT AS cell_row, c::BIGINT AS cell_col, type, text, runs FROM c""")
def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of HTML tables: spans, pictures, a table in a cell; marks don't count there."""
    return decode.blocks(_web(spark, sf_dir)).where("parent_uid is not null").select(_doc(), long("cell_row"), long("cell_col"), "type", "text", _runs().alias("runs"))


@query(f"WITH {_S} SELECT DISTINCT doc, n + 2 AS n_rows, 3::BIGINT AS n_cols, '0,0,2,1;0,1,1,2' AS merges, '1,0;0,2' AS covered FROM s")
def html_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform(F.sort_array("merges"), lambda m: F.concat_ws(",", m["row"], m["col"], m["rowspan"], m["colspan"])), ";")
    covered = F.array_join(F.transform(F.sort_array("null_slots", asc=False), lambda x: F.concat_ws(",", x["row"], x["col"])), ";")
    return B.tables(decode.blocks(_web(spark, sf_dir))).select(_doc(), long("n_rows"), long("n_cols"), spans.alias("merges"), covered.alias("covered"))


@query(f"WITH {_S} SELECT doc, 2 * i - 1 AS place, name AS text, 0::BIGINT AS list_level, false AS list_ordered FROM s UNION ALL SELECT doc, 2 * i, 'key ' || k, 1, true FROM s")
def html_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lists: levels, kinds and order."""
    rows = B.top_level(decode.blocks(_web(spark, sf_dir))).where("list_id is not null")
    return rows.select(_doc(), F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")).cast("long").alias("place"), "text", long("list_level"), "list_ordered")


class Seer:
    """A vision model that reads a picture's bytes as text; none where a 3 is in it."""

    def complete_vision(self, *, system, user, images, max_tokens):
        seen = images[0][1].decode()
        if seen.endswith("7"):
            raise clients.ModelError("no answer")
        return "NO_TEXT" if "3" in seen else f" {seen} "


class Judge:
    """A checker that fails on even last figures, and cleans the others."""

    def complete(self, *, system, user, max_tokens):
        if user[-1] in "02468":
            raise clients.ModelError("no answer")
        return f"Well: {json.dumps({'meaningful': True, 'cleaned_text': user.upper() + ' '})}"


@query(f"""WITH {_S}, m AS (SELECT doc, i, sha256(name) AS image_id, name, 'image/png' AS mime FROM s) SELECT doc, i::BIGINT AS image_index, name AS alt_text, image_id, mime,
CASE WHEN right(name, 1) = '7' THEN NULL WHEN contains(name, '3') THEN false ELSE right(name, 1) NOT IN ('0', '2', '4', '6', '8') END AS ocr_meaningful,
CASE WHEN right(name, 1) <> '7' AND NOT contains(name, '3') AND right(name, 1) NOT IN ('0', '2', '4', '6', '8') THEN upper(name) END AS ocr_text FROM m
UNION ALL SELECT DISTINCT doc, n + 1, NULL, NULL, NULL, NULL::BOOLEAN, NULL FROM s""")
def image_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures with their blob, and what a model read in them, checked by another; calls that fail leave slots empty."""
    docs = _web(spark, sf_dir)
    blocks = settled(decode.blocks(docs))
    found = settled(convert.resolved_images(blocks, docs.withColumn("content", F.col("content").cast("binary"))))
    full = enrich.with_images(blocks, found, enrich.read_images(found, Seer, Judge))
    return B.images(full).select(_doc(), long("image_index"), "alt_text", "image_id", "mime", "ocr_meaningful", "ocr_text")


@query("SELECT sha256(s_name) AS sha256, 'image/png' AS mime, '.png' AS ending, octet_length(encode(s_name))::BIGINT AS bytes FROM supplier WHERE s_suppkey % 2 = 0")
def image_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that a store doesn't have: each picture once, those of odd suppliers are stored already."""
    docs = _web(spark, sf_dir)
    twice = docs.unionByName(docs.withColumn("doc_id", F.concat(F.lit("copy"), "doc_id")))
    found = enrich.identified(enrich.from_source_attribute(enrich.unresolved(decode.blocks(twice))))
    have = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select(F.sha2("s_name", 256).alias("sha256"))
    return enrich.new_blobs(found, have).select("sha256", "mime", "ending", F.octet_length("content").cast("long").alias("bytes"))


@query(f"""WITH d AS (SELECT DISTINCT {_DOC}::BIGINT AS doc FROM supplier) SELECT 'docx' AS fmt, doc, sha256('picture ' || doc) AS image_id, 'image/png' AS mime FROM d UNION ALL SELECT 'xlsx', doc, sha256('sheet picture ' || doc), 'image/png' FROM d
UNION ALL SELECT 'markdown', doc, sha256('local ' || doc), 'image/jpeg' FROM d UNION ALL SELECT 'pdf', doc, sha256('region 1 300.0 642.0 360.0 692.0'), 'image/png' FROM d""")
def fetched_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of pictures by the kind of their locator: package members, files beside a document, regions of pages."""
    word, book = _word(spark, sf_dir), _book(spark, sf_dir)
    md = word.select("doc_id", F.lit("markdown").alias("fmt"), F.concat(F.lit("m/"), "doc_id", F.lit(".md")).alias("source_path"), text("![a](img/", F.col("doc_id"), ".jpg)").cast("binary").alias("content"))
    files = md.select(F.concat(F.lit("m/img/"), "doc_id", F.lit(".jpg")).alias("path"), text("local ", F.col("doc_id")).cast("binary").alias("content"))
    printed = _print(spark, sf_dir).withColumn("source_path", F.lit("p.pdf"))
    docs = word.unionByName(book).unionByName(md).unionByName(printed.select(word.columns)).withColumn("doc_id", F.concat_ws("/", "fmt", "doc_id"))
    docs = settled(docs)
    blocks = settled(convert.blocks(docs, ("docx", "xlsx", "markdown", "pdf")))
    first = blocks.where("type = 'image' and coalesce(span.page, 1) = 1")
    found = convert.resolved_images(first, docs, files, lambda: lambda content, page, box: f"region {page} {' '.join(map(str, box))}".encode())
    return found.select(F.split("doc_id", "/")[0].alias("fmt"), F.split("doc_id", "/")[1].cast("long").alias("doc"), "image_id", "mime")


class Teller:
    """Describes a table, and finds its first try too short."""

    def complete(self, *, system, user, max_tokens):
        if system == enrich.CHECK_DESCRIPTION:
            return json.dumps({"content_ok": "again" in user, "format_ok": True, "reason": "say more"})
        return f"again {user.count('Supplier#')}" if "Avoid: say more" in user else "short"


@query(f"WITH {_S} SELECT doc, 'again ' || count(*) AS description, 'ok' AS status, 2::BIGINT AS attempts FROM s GROUP BY doc")
def table_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level tables described by a model, checked, and described again with the reason."""
    rows = enrich.described(settled(decode.blocks(_web(spark, sf_dir))), Teller, check=True, context=False)
    return B.tables(rows).select(_doc(), F.col("table_description").alias("description"), F.col("describe_status").alias("status"), long("describe_attempts").alias("attempts"))


# Markdown with pictures

@query(f"""WITH {_S} SELECT doc, i::BIGINT AS image_index, name AS alt_text, 'p/' || k || '.png' AS src, 'para <image' || i || '> end' AS carrier FROM s UNION ALL SELECT DISTINCT doc, n + 1, 'in cell', 'c.png', '<image' || (n + 1) || '>' FROM s""")
def md_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in paragraphs and in cells, and the text that carries their marker."""
    rows = _grouped(spark, sf_dir, lines=text("para ![", F.col("name"), "](p/", F.col("k"), '.png "title") end\n\n'))
    docs = rows.select("doc_id", text(_all("lines"), "| a |\n|---|\n| ![in cell](c.png) |\n").alias("content"))
    blocks = decode.blocks(docs, "markdown")
    carriers = blocks.where("text like '%<image%'").select("doc_id", F.regexp_extract("text", r"<image(\d+)>", 1).cast("int").alias("image_index"), F.col("text").alias("carrier"))
    images = B.images(blocks).join(carriers, ["doc_id", "image_index"])
    return images.select(_doc(), long("image_index"), "alt_text", F.get_json_object("locator", "$.src").alias("src"), "carrier")


@query(f"WITH {_S} SELECT doc, i::BIGINT AS cell_row, 0::BIGINT AS cell_col, name || '{{bold}}' AS runs, name AS text FROM s UNION ALL SELECT doc, i, 1, NULL, k || '|' || i FROM s UNION ALL SELECT DISTINCT doc, 0, 0, NULL, 'a' FROM s UNION ALL SELECT DISTINCT doc, 0, 1, NULL, 'b' FROM s")
def md_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with marks and escaped bars."""
    rows = _grouped(spark, sf_dir, lines=text("| **", F.col("name"), "** | ", F.col("k"), "\\|", F.col("i"), " |\n"))
    docs = rows.select("doc_id", text("| a | b |\n|:--|--:|\n", _all("lines")).alias("content"))
    return decode.blocks(docs, "markdown").where("parent_uid is not null").select(_doc(), long("cell_row"), long("cell_col"), _runs().alias("runs"), "text")


# Files and formats

def _split_lines(content: bytes) -> list[ir.Node]:
    return [ir.text_block("paragraph", line) for line in content.decode("utf-8", "replace").split(";")]


@query("""SELECT s_suppkey::BIGINT AS doc, unnest([0, 1])::BIGINT AS ordinal, unnest([s_name, 'end']) AS text, NULL::VARCHAR AS error FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT s_suppkey::BIGINT, 0, 'a' || chr(65533) || 'b ' || s_name, NULL FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT s_suppkey::BIGINT, NULL, NULL, 'failed' FROM supplier WHERE s_suppkey % 4 = 2""")
def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their endings: a registered format, bytes that are no UTF-8, files that can't be decoded (rows with an error), and unknown ones, which are left out."""
    decode.register("lines", _split_lines, (".lines",), ("text/lines",))
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    ending = F.element_at(F.array(F.lit(".LINES"), F.lit(".md"), F.lit(".docx"), F.lit(".other")), (k % 4 + 1).cast("int"))
    content = F.when(k % 4 == 0, text(F.col("s_name"), ";end").cast("binary")).when(k % 4 == 1, F.concat(F.unhex(F.lit("61FF6220")), F.col("s_name").cast("binary"))).otherwise(F.lit("no zip").cast("binary"))
    files = decode.with_format(s.select(F.concat(F.lit("in/"), k.cast("string"), ending).alias("source_path"), content.alias("content")))
    rows = convert.blocks(files, ("lines", "markdown", "docx"), with_errors=True)
    return rows.select(_doc(), long("ordinal"), "text", F.when(F.col("error").isNotNull(), "failed").alias("error"))


@query("SELECT 'in/' || s_suppkey || '.other' AS source_path, 'no decoder for extension .other' AS reason FROM supplier WHERE s_suppkey % 4 = 3")
def unsupported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    files = decode.with_format(s.select(F.concat(F.lit("in/"), k.cast("string"), F.when(k % 4 == 3, ".other").otherwise(".md")).alias("source_path"), F.lit("x").cast("binary").alias("content")))
    return decode.unsupported(files).select("source_path", "reason")


# Pages that models read

class PageReader:
    """Reads pages that a stand-in renders as [page, box]: pages 1 and 2 of four with a wrong figure."""

    def __init__(self, second: bool = False):
        self.second = second

    def complete_vision(self, *, system, user, images, max_tokens):
        page, _ = json.loads(images[0][1])
        if self.second:
            return f"supplier {page + 1} pays" if page % 4 == 1 else "something else"
        said = page + (page % 4 in (1, 2))
        return json.dumps([{"type": "heading", "text": "Bill", "level": 2}, {"type": "paragraph", "text": f"Supplier {said}\npays"}, {"type": "table", "rows": [["other"]]}, {"type": "list_item", "text": "bill", "ordered": True}])


def _draw(content: bytes, page: int, box: list[float] | None) -> bytes:
    return json.dumps([page, box]).encode()


def _detect(png: bytes) -> list[tuple]:
    page, _ = json.loads(png)
    return [(1, 1, i, w, 10.0, 20.0 * i, 50.0, 20.0 * i + 10) for i, line in enumerate((f"Supplier {page}", "pays", "bill", "other")) for w in line.split()]


class GridReader:
    """A vision model that sees a table of one row and two columns."""

    def complete_vision(self, *, system, user, images, max_tokens):
        return '[{"row": 0, "col": 0, "bbox": [0, 0, 0.5, 1]}, {"row": 0, "col": 1, "bbox": [0.5, 0, 1, 1]}]'


def _crop(image: bytes, box: clients.Box) -> tuple[bytes, int, int]:
    return image, int(box[2] - box[0]), int(box[3] - box[1])


def _eight(page: Column) -> Column:
    """The document of a page: eight pages each, so documents become more with the table."""
    return F.floor(page / 8).cast("string").alias("doc_id")


def _model_pages(spark: SparkSession, sf_dir: str, **more: object) -> DataFrame:
    """A page for each supplier: of four, three with text and a ruled table, one a scan."""
    k = F.col("s_suppkey").cast("int")
    s = table(spark, sf_dir, "supplier").select(_eight(k), k.alias("page"))
    own = s.where("page % 4 <> 3")
    at = lambda i, word, font, x, top: F.struct(F.lit(i).alias("seq"), word.alias("text"), F.lit(x).alias("x0"), F.lit(x + 30.0).alias("x1"), F.lit(top).alias("top"), F.lit(top + 10.0).alias("bottom"), F.lit(10.0).alias("size"), F.lit(font).alias("fontname"))
    line = [at(0, F.lit("Bill"), "F", 50.0, 50.0), at(1, F.lit("Supplier"), "F", 50.0, 80.0), at(2, F.col("page").cast("string"), "F-Bold", 90.0, 80.0), at(3, F.lit("pays"), "F", 130.0, 80.0), at(4, F.lit("left"), "F", 105.0, 205.0), at(5, F.lit("right"), "F", 155.0, 205.0)]
    words = own.select("doc_id", "page", F.explode(F.array(*line)).alias("w")).select("doc_id", "page", "w.*")
    pages = s.select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.when(F.col("page") % 4 == 3, 0).otherwise(90).alias("n_chars"))
    pictures = s.where("page % 4 = 3").select("doc_id", "page", F.lit(0).alias("seq"), F.lit(0.0).alias("x0"), F.lit(600.0).alias("x1"), F.lit(0.0).alias("top"), F.lit(800.0).alias("bottom"), F.lit("scan").alias("name"))
    cells = own.select("doc_id", "page", F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.lit(0).alias("col_no"), F.lit(100.0).alias("x0"), F.lit(200.0).alias("top"), F.lit(200.0).alias("x1"), F.lit(240.0).alias("bottom"))
    docs = s.select("doc_id").distinct().withColumn("content", F.lit(b""))
    routes = pdf_layout.triage(words, pages, pictures, pdf_layout.table_boxes(cells))
    models = page_models.Models(lambda: _draw, PageReader, second=lambda: PageReader(True), detector=lambda: _detect, **more)
    rows, _ = page_models.model_blocks(docs, words, pages, pictures, cells, routes, models)
    return convert.as_blocks(pdf_layout.numbered_blocks(rows))


@query("""WITH p AS (SELECT s_suppkey::BIGINT AS page, s_suppkey % 4 AS m FROM supplier), b AS (
SELECT page, 0 AS place, 'heading' AS type, 'Bill' AS text, 2 AS level, 'text-layer-verified' AS provenance, NULL AS runs, false AS crop FROM p WHERE m <> 3
UNION ALL SELECT page, 0, 'heading', 'Bill', 2, 'consensus-verified', NULL, false FROM p WHERE m = 3
UNION ALL SELECT page, 1, 'paragraph', 'Supplier ' || (page + (m IN (1, 2))::INT) || ' pays', NULL, CASE m WHEN 0 THEN 'text-layer-verified' WHEN 2 THEN 'unverified' ELSE 'consensus-verified' END, CASE WHEN m = 0 THEN 'Supplier{} ' || page || '{bold} pays{}' END, m = 2 FROM p
UNION ALL SELECT page, 2, 'table', NULL, NULL, CASE WHEN m = 3 THEN 'consensus-verified' ELSE 'text-layer-verified' END, NULL, false FROM p
UNION ALL SELECT page, 3, 'paragraph', 'bill', NULL, CASE WHEN m = 3 THEN 'consensus-verified' ELSE 'text-layer-verified' END, NULL, false FROM p)
SELECT page, place::BIGINT AS place, type, text, level::BIGINT AS level, provenance, runs, CASE WHEN crop THEN sha256('[' || page || ', null]') END AS source_crop FROM b""")
def model_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a model reads: held to their text, to a second reader and a detector; marks from fonts; crops of what nothing confirms."""
    rows = B.top_level(_model_pages(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("doc_id", "span.page").orderBy("ordinal")) - 1
    return rows.select(F.col("span.page").cast("long").alias("page"), place.cast("long").alias("place"), "type", "text", long("level"), "provenance", _runs().alias("runs"), "source_crop")


@query("SELECT s_suppkey::BIGINT AS page, CASE WHEN s_suppkey % 4 = 3 THEN '0 other' ELSE '0 left,1 right' END AS cells FROM supplier")
def structured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pages that a model reads: the i-th takes the grid that a structure model sees at the i-th place, with the text of the page's words; a scan's keeps the reading's rows."""
    rows = settled(_model_pages(spark, sf_dir, structure=lambda: clients.VisionStructureClient(GridReader, _crop)))
    tops = B.tables(rows).select("doc_id", F.col("uid").alias("parent_uid"), F.col("span.page").cast("long").alias("page"))
    cells = rows.where("parent_uid is not null").join(tops, ["doc_id", "parent_uid"])
    return cells.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_col", "text"))), lambda c: F.concat_ws(" ", c["cell_col"], c["text"])), ",").alias("cells"))


@query("""SELECT s_suppkey::BIGINT AS page, c::BIGINT AS column, r::BIGINT AS line, CASE r % 2 WHEN 0 THEN 'a' || (r // 2) || ' b' || (r // 2) || ' c' || (r // 2) ELSE 'd' || (r // 2) END AS text
FROM supplier, range(2) x(c), range(20) y(r)""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two columns, found by the band between them; a line holds what is near its first word, not its last."""
    s = table(spark, sf_dir, "supplier").select(_eight(F.col("s_suppkey")), F.col("s_suppkey").cast("int").alias("page"))
    at = F.explode(F.sequence(F.lit(0), F.lit(79)))
    rows = s.withColumn("i", at).withColumns({"row": F.floor(F.col("i") / 8), "c": F.col("i") % 8})
    step = F.col("c") % 4
    x = F.when(F.col("c") < 4, 20.0 + 60 * step).otherwise(340.0 + 60 * step)
    words = rows.select("doc_id", "page", F.col("i").alias("seq"), F.concat(F.substring(F.lit("abcd"), step + 1, F.lit(1)), F.col("row").cast("string")).alias("text"), x.alias("x0"), (x + 50).alias("x1"), (20.0 * F.col("row") + 2 * step).alias("top"), (20.0 * F.col("row") + 2 * step + 8).alias("bottom"), F.lit(10.0).alias("size"), F.lit("F").alias("fontname"))
    pages = s.withColumns({"width": F.lit(600.0), "height": F.lit(800.0), "n_chars": F.lit(160)})
    laid = pdf_layout.lines(pdf_layout.with_column(words, pdf_layout.gutters(words, pages)))
    return laid.select(long("page"), long("column"), long("line_no").alias("line"), "text")
