"""Pages that models read: hybrid pages are held to their own text, scans to a detector and a second reader.

A page is rendered where its document is, in the call that reads it, so images never go
through a shuffle: replies come back as text, and what is disputed is rendered again for
the second reader and for the audit crops. Everything between the calls (parsing replies,
pairing tables and figures with what geometry shows, verification) is DataFrame work.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ir
from ..functions import columns as C
from ..scratch import settled
from ..sources.clients import ModelError, StructureClient, VisionClient
from . import pdf_layout as L
from .enrich import Renderer

PAGE = L.PAGE
#: Pixels of a point at the resolution that pages are rendered with, a crop's margin in pixels, and the page share above which a scan's picture is the scan.
SCALE, MARGIN, SCAN_PICTURE = 150 / 72, 8, 0.6
SEEN = "array<struct<block:int,par:int,line:int,seq:int,text:string,x0:double,top:double,x1:double,bottom:double>>"
GRID = "n_rows int, n_cols int, merges array<struct<row:int,col:int,rowspan:int,colspan:int>>, slots array<struct<row:int,col:int,text:string>>"

# Own wording; the shape of the answer is the contract.
READ_PAGE = 'Give the blocks of this page in reading order as a JSON array. Items: {"type": "heading", "level", "text"}, {"type": "paragraph", "text"}, {"type": "list_item", "level", "ordered", "text"}, {"type": "table", "rows"}, {"type": "figure", "bbox"}. Copy the text as printed, line by line; bbox holds fractions of the page.'
ONLY_JSON = "\n\nAnswer with the JSON array and nothing else."
TRANSCRIBE = "Copy all text of the image exactly as printed."

#: detect(png): words (block, par, line, text, x0, top, x1, bottom) in pixels.
Detector = Callable[[bytes], list[tuple[int, int, int, str, float, float, float, float]]]


@dataclass(frozen=True)
class Models:
    """Factories; each task builds its own clients. Only renderer and primary must be there."""

    renderer: Callable[[], Renderer]
    primary: Callable[[], VisionClient]
    second: Callable[[], VisionClient] | None = None
    detector: Callable[[], Detector] | None = None
    structure: Callable[[], StructureClient] | None = None
    max_tokens: int = 8192


def per_document(docs: DataFrame, todo: DataFrame, work: Callable[[], Callable[[bytes, list[Any]], list[tuple]]], schema: str) -> DataFrame:
    """doc_id and what work()(content, the document's rows of todo) gives, each document opened once."""
    row = F.struct(*[F.col(c) for c in todo.columns if c != "doc_id"])
    listed = todo.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("_todo")).join(docs.select("doc_id", "content"), "doc_id")
    names = ["doc_id", *(c.strip().split(" ")[0] for c in _fields(schema))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = work()
        for frame in frames:
            out = [(doc_id, *found) for doc_id, rows, content in zip(frame["doc_id"], frame["_todo"], frame["content"]) for found in call(content, list(rows))]
            yield pd.DataFrame(out, columns=names)

    return listed.mapInPandas(run, f"doc_id string, {schema}")


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def has_items(raw: str | None) -> bool:
    """Whether a reply holds a JSON array with an item of a known kind."""
    text = raw or ""
    try:
        return any(isinstance(x, dict) and x.get("type") in ("heading", "paragraph", "list_item", "table", "figure") for x in json.loads(text[text.index("[") : text.rindex("]") + 1]))
    except ValueError:
        return False


def read_pages(docs: DataFrame, todo: DataFrame, models: Models) -> DataFrame:
    """doc_id, page, raw (null if the read failed), seen (the detector's words of scans, in points). todo: doc_id, page, route, grounding."""

    def work() -> Callable[[bytes, list[Any]], list[tuple]]:
        render, detect = models.renderer(), models.detector() if models.detector else None
        state = {"reader": models.primary(), "failures": 0}

        def read(png: bytes, grounding: str | None) -> str | None:
            asked = "Read this page." + (f"\n\nTEXT LAYER:\n{grounding}" if grounding else "")
            for _ in range(2):
                if state["reader"] is None:
                    return None
                try:
                    raw = state["reader"].complete_vision(system=READ_PAGE, user=asked, images=[("image/png", png)], max_tokens=models.max_tokens)
                except ModelError:
                    state["failures"] += 1
                    if state["failures"] > 1:  # the transport is down
                        state["reader"] = None
                    return None
                if has_items(raw):
                    return raw
                asked += ONLY_JSON
            return None

        def pages(content: bytes, rows: list[Any]) -> list[tuple]:
            out = []
            for r in rows:
                png = render(content, int(r["page"]), None)
                raw = read(png, r["grounding"]) if png else None
                words: list[dict] = []
                if raw and detect and r["route"] == "scanned":
                    try:
                        found = detect(png)
                    except Exception:  # a detector that can't run confirms nothing
                        found = []
                    words = [{"block": b, "par": p, "line": n, "seq": i, "text": t, "x0": x0 / SCALE, "top": y0 / SCALE, "x1": x1 / SCALE, "bottom": y1 / SCALE} for i, (b, p, n, t, x0, y0, x1, y1) in enumerate(found)]
                out.append((int(r["page"]), raw, words))
            return out

        return pages

    return per_document(docs, todo, work, f"page int, raw string, seen {SEEN}")


def second_readings(docs: DataFrame, todo: DataFrame, models: Models) -> DataFrame:
    """doc_id, page, place, line_no, text: the second reader's own reading of regions; of whole pages where box (and place) is null. todo: doc_id, page, place, line_no, box."""

    def work() -> Callable[[bytes, list[Any]], list[tuple]]:
        render = models.renderer()
        state = {"reader": models.second() if models.second else None}

        def regions(content: bytes, rows: list[Any]) -> list[tuple]:
            out = []
            for r in rows:
                if state["reader"] is None:
                    break
                png = render(content, int(r["page"]), None if r["box"] is None else [float(v) for v in r["box"]])
                if not png:
                    continue
                try:
                    text = state["reader"].complete_vision(system=TRANSCRIBE, user="Copy the text.", images=[("image/png", png)], max_tokens=2048)
                except ModelError:
                    state["reader"] = None  # a dead endpoint is asked once
                    break
                place = lambda v: None if v is None else int(v)
                out.append((int(r["page"]), place(r["place"]), place(r["line_no"]), text))
            return out

        return regions

    rows = per_document(docs, todo, work, "page int, place int, line_no int, text string")
    return rows.where(F.trim("text") != "")


def crops(docs: DataFrame, todo: DataFrame, renderer: Callable[[], Renderer]) -> DataFrame:
    """doc_id, page, place, sha256, content of audit crops; of whole pages where box is null. todo: doc_id, page, place, box."""

    def work() -> Callable[[bytes, list[Any]], list[tuple]]:
        render = renderer()

        def regions(content: bytes, rows: list[Any]) -> list[tuple]:
            made = [(r, render(content, int(r["page"]), None if r["box"] is None else [float(v) for v in r["box"]])) for r in rows]
            return [(int(r["page"]), int(r["place"]), hashlib.sha256(png).hexdigest(), png) for r, png in made if png]

        return regions

    return per_document(docs, todo, work, "page int, place int, sha256 string, content binary")


def structured(docs: DataFrame, boxes: DataFrame, words: DataFrame, models: Models) -> DataFrame:
    """Grids of the tables of pages as a structure model sees them, their text from the page's own words: doc_id, page, table_no, the grid, x0, x1, top. Pages where it fails have no row."""
    todo = boxes.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("top", "x0", "x1", "bottom"))).alias("boxes"))
    todo = todo.join(words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("top", "x0", "x1", "bottom", "text"))).alias("words")), PAGE, "left")

    def work() -> Callable[[bytes, list[Any]], list[tuple]]:
        render, client = models.renderer(), models.structure()
        pixels = lambda b: tuple(float(b[c]) * SCALE for c in ("x0", "top", "x1", "bottom"))

        def pages(content: bytes, rows: list[Any]) -> list[tuple]:
            out = []
            for r in rows:
                png = render(content, int(r["page"]), None)
                try:
                    found = client.detect(png, table_bboxes=[pixels(b) for b in r["boxes"]], text_cells=[(w["text"], pixels(w)) for w in r["words"] if w is not None] if r["words"] is not None else []) if png else []
                except ModelError:
                    continue
                for i, t in enumerate(t for t in found if t.cells):
                    box = [v / SCALE for v in t.bbox]
                    out += [(int(r["page"]), i, c.row, c.col, c.rowspan, c.colspan, *(v / SCALE for v in c.bbox), *box) for c in t.cells]
            return out

        return pages

    schema = "page int, table_no int, row_no int, col_no int, rowspan int, colspan int, x0 double, top double, x1 double, bottom double, tx0 double, ttop double, tx1 double, tbottom double"
    cells = per_document(docs, todo, work, schema)
    placed = L.words_in_boxes(words, cells, ["table_no", "row_no", "col_no"])
    one = F.struct(F.col("row_no").alias("row"), F.col("col_no").alias("col"), "rowspan", "colspan")
    return placed.groupBy(*PAGE, "table_no").agg(
        F.max(F.col("row_no") + F.col("rowspan")).alias("n_rows"), F.max(F.col("col_no") + F.col("colspan")).alias("n_cols"), F.sort_array(F.collect_list(F.when((F.col("rowspan") > 1) | (F.col("colspan") > 1), one))).alias("merges"),
        F.sort_array(F.collect_list(F.struct(F.col("row_no").alias("row"), F.col("col_no").alias("col"), "text"))).alias("slots"), F.first("tx0").alias("x0"), F.first("tx1").alias("x1"), F.first("ttop").alias("top"),
    )


# What a reading says, beside what geometry shows

def read_items(replies: DataFrame, routes: DataFrame, grids: DataFrame, pictures: DataFrame) -> DataFrame:
    """Items of readings: doc_id, page, route, place, type, text, level, list_group, list_level, list_ordered, the grid of tables, locator, box (a figure's guess, fractions), check (the text to verify).

    The i-th table and figure of a page take the grid and the picture that are i-th by (top, x0),
    grids only on hybrid pages; pictures without an item follow at the page's end.
    """
    specs = replies.join(routes.select(*PAGE, "route", "width", "height"), PAGE).select(*PAGE, "route", "width", "height", F.posexplode(L.read_specs("raw")).alias("place", "x")).select(*PAGE, "route", "width", "height", "place", "x.*")
    turn = Window.partitionBy(*PAGE).orderBy("place")
    kind = Window.partitionBy(*PAGE, "type").orderBy("place")
    seen = Window.partitionBy(*PAGE).orderBy("top", "x0")
    specs = specs.withColumn("_i", F.row_number().over(kind)).withColumn("_item", F.col("type") == "list_item")
    specs = specs.withColumn("list_group", F.when(F.col("_item"), F.sum((F.col("_item") & ~F.coalesce(F.lag("_item").over(turn), F.lit(False))).cast("int")).over(turn)))
    shown = grids.join(routes.where("route = 'hybrid'").select(*PAGE), PAGE, "left_semi").withColumn("_i", F.row_number().over(seen)).withColumn("type", F.lit("table"))
    # a table's rows as the model gave them
    told = F.flatten(F.transform("rows", lambda r, i: F.transform(r, lambda c, j: F.struct(i.alias("row"), j.alias("col"), c.alias("text")))))
    own = F.col("type") == "table"
    rows = specs.join(shown.select(*PAGE, "type", "_i", *(F.col(c).alias(f"_{c}") for c in ("n_rows", "n_cols", "merges", "slots"))), [*PAGE, "type", "_i"], "left")
    rows = rows.withColumns({
        "n_rows": F.when(own, F.coalesce("_n_rows", F.size("rows"))), "n_cols": F.when(own, F.coalesce("_n_cols", F.array_max(F.transform("rows", F.size)))),
        "slots": F.when(own, F.coalesce("_slots", told)), "merges": F.when(own, F.coalesce("_merges", F.array().cast("array<struct<row:int,col:int,rowspan:int,colspan:int>>"))),
    })
    part = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top")) / F.coalesce(F.nullif(F.col("width") * F.col("height"), F.lit(0.0)), F.lit(1.0))
    usable = L.page_pictures(pictures).join(routes.select(*PAGE, "route", "width", "height"), PAGE).where((F.col("route") == "hybrid") | (part <= SCAN_PICTURE))
    usable = usable.withColumn("_i", F.row_number().over(seen)).select(*PAGE, F.lit("figure").alias("type"), "_i", "route", F.col("locator").alias("_locator"))
    rows = rows.join(usable.drop("route"), [*PAGE, "type", "_i"], "left")
    guess = F.when(F.col("type") == "figure", F.to_json(F.struct("page", F.lit("vlm_figure").alias("region"))))
    rows = rows.withColumn("locator", F.coalesce("_locator", guess)).withColumn("paired", F.col("_locator").isNotNull())
    text = F.when(F.col("type") == "table", F.array_join(F.filter(F.transform("slots", lambda s: s["text"]), lambda t: F.length(t) > 0), " ")).when(F.col("type") != "figure", F.col("text"))
    points = lambda i: F.col("bbox")[i] * F.when(F.lit(i % 2 == 0), F.col("width")).otherwise(F.col("height"))
    rows = rows.select(
        *PAGE, "route", "place", "type", F.when(~F.col("type").isin("table", "figure"), F.col("text")).alias("text"), F.when(F.col("type") == "heading", F.col("level")).alias("level"), "list_group",
        F.when(F.col("_item"), F.col("level")).alias("list_level"), F.when(F.col("_item"), F.col("ordered")).alias("list_ordered"), "n_rows", "n_cols", "merges", "slots", "locator", "paired",
        F.when(F.col("bbox").isNotNull(), F.array(*[points(i) for i in range(4)])).alias("box"), text.alias("check"),
    )
    used = specs.where("type = 'figure'").select(*PAGE, "type", "_i")
    read = specs.select(*PAGE).distinct()
    left = usable.join(used, [*PAGE, "type", "_i"], "left_anti").join(read, PAGE, "left_semi")
    left = left.select(*PAGE, "route", (F.lit(1 << 20) + F.col("_i")).cast("int").alias("place"), "type", F.col("_locator").alias("locator"), F.lit(True).alias("paired"))
    return rows.unionByName(left, allowMissingColumns=True)


def item_lines(items: DataFrame) -> DataFrame:
    """doc_id, page, place, line_no, text: the printed lines of items; of tables, their rows."""
    cells = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_rows"), F.lit(1)) - 1), lambda r: F.array_join(F.filter(F.transform("slots", lambda s: F.when(s["row"] == r, s["text"])), lambda t: F.length(t) > 0), " "))
    listed = F.when(F.col("type") == "table", cells).when(F.col("type") != "figure", F.split("text", "\n"))
    return items.select(*PAGE, "place", F.posexplode(listed).alias("line_no", "text")).where(F.trim("text") != "")


def verified(items: DataFrame, replies: DataFrame, words: DataFrame, docs: DataFrame, models: Models) -> DataFrame:
    """items with provenance, and crop: the box of the audit crop in points, and whether there is one (wants_crop)."""
    key = [*PAGE, "place"]
    texts = items.where("type <> 'figure'")
    own = words.groupBy(*PAGE).agg(F.array_join(F.collect_list("text"), " ").alias("page_text"))
    hybrid = texts.where("route = 'hybrid'").join(own, PAGE, "left")
    hybrid = hybrid.select(*key, "check", L.confirmed("check", "page_text").alias("in_page"))
    detected = L.detected_lines(replies.select(*PAGE, F.explode("seen").alias("w")).select(*PAGE, "w.*"))
    lines = L.verified_lines(item_lines(texts.where("route = 'scanned'")), detected)
    # one whole page, or the regions in dispute, for the second reader
    full = hybrid.where("not in_page").select(*PAGE).unionByName(lines.where("verdict = 'full'").select(*PAGE)).distinct()
    full = full.select(*PAGE, F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("array<double>").alias("box"))
    near = lines.where("verdict = 'reread'").select(*key, "line_no", F.col("bbox").alias("box"))
    again = second_readings(docs, full.unionByName(near), models) if models.second else full.select(*PAGE, "place", "line_no", F.lit(None).cast("string").alias("text")).where("false")
    whole = again.where("place is null").select(*PAGE, F.col("text").alias("other"))
    hybrid = hybrid.join(whole, PAGE, "left")
    of_hybrid = F.when(F.col("in_page"), "text-layer-verified").when(L.confirmed("check", "other"), "consensus-verified").otherwise("unverified")
    done = hybrid.select(*key, of_hybrid.alias("provenance"), F.lit(None).cast("array<double>").alias("crop"))
    lines = lines.join(again.where("place is not null").select(*key, "line_no", F.col("text").alias("region")), [*key, "line_no"], "left").join(whole, PAGE, "left")
    reread = C.criticals_fit("text", "region") & ((L.ratio("text", "region") >= L.LINE_MATCH) | (C.containment("text", "region") >= L.CONTAINED))
    ok = F.when(F.col("verdict").isin("line", "page"), True).when(F.col("verdict") == "reread", F.coalesce(reread, F.lit(False))).otherwise(L.confirmed("text", "other"))
    judged = lines.withColumn("ok", ok).groupBy(*key).agg(F.bool_and("ok").alias("ok"), F.collect_list(F.when(~F.col("ok") & (F.col("verdict") == "reread"), F.col("bbox"))).alias("boxes"))
    scanned = judged.select(*key, F.when(F.col("ok"), "consensus-verified").otherwise("unverified").alias("provenance"), F.when(~F.col("ok") & (F.size("boxes") > 0), L.union_box(F.col("boxes"))).alias("crop"))
    out = items.join(done.unionByName(scanned), key, "left")
    figure = F.col("type") == "figure"
    provenance = F.when(figure & ~F.col("paired"), "unverified").when(~figure, F.coalesce("provenance", F.lit("consensus-verified")))
    out = out.withColumn("provenance", provenance)
    wants = (F.col("provenance") == "unverified") & (~figure | F.col("box").isNotNull())
    return out.withColumn("wants_crop", F.coalesce(wants, F.lit(False))).withColumn("crop", F.when(figure, F.col("box")).otherwise(F.col("crop")))


def with_margin(box: Column, width: Column, height: Column) -> Column:
    """A box with the crop's margin, inside the page."""
    m = MARGIN / SCALE
    return F.array(F.greatest(box[0] - m, F.lit(0.0)), F.greatest(box[1] - m, F.lit(0.0)), F.least(box[2] + m, width), F.least(box[3] + m, height))


def marked(items: DataFrame, words: DataFrame, boxes: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds runs: texts that the page's own text confirms take the marks of its fonts, word by word, going forward over the page."""
    stream = L.with_column(L.outside_tables(words, boxes), routes)
    stream = stream.groupBy(*PAGE).agg(F.transform(F.sort_array(F.collect_list(F.struct("column", "top", "x0", "seq", "text", L.word_marks().alias("marks")))), lambda w: F.struct(w["text"].alias("text"), w["marks"].alias("marks"))).alias("stream"))
    known = items.where("provenance = 'text-layer-verified' and type in ('heading', 'paragraph', 'list_item')")
    pages = known.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("place", C.collapse("text").alias("text")))).alias("texts")).join(stream, PAGE)

    @F.pandas_udf(f"array<struct<place:int,runs:array<{ir.RUN}>>>")
    def aligned(texts: pd.Series, streams: pd.Series) -> pd.Series:
        out = []
        for items_, words_ in zip(texts, streams):
            of, at, found = [(w["text"], list(w["marks"])) for w in words_], 0, []
            for x in items_:
                runs, at = L.align_runs(x["text"], of, at)
                if ir.has_marks(runs):
                    found.append({"place": int(x["place"]), "runs": runs})
            out.append(found)
        return pd.Series(out, dtype=object)

    runs = pages.select(*PAGE, F.explode(aligned("texts", "stream")).alias("x")).select(*PAGE, "x.place", "x.runs")
    return items.join(runs, [*PAGE, "place"], "left")


def model_blocks(docs: DataFrame, words: DataFrame, pages: DataFrame, pictures: DataFrame, cells: DataFrame, routes: DataFrame, models: Models) -> tuple[DataFrame, DataFrame]:
    """Block rows of the pages that were read (as pdf_layout.laid_out gives them), and the audit crops (sha256, content)."""
    boxes = L.table_boxes(cells)
    grounding = words.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", "x0", "text"))), lambda w: w["text"]), " ").alias("grounding"))
    sized = routes.join(pages.select(*PAGE, "width", "height"), PAGE)
    todo = sized.where("route in ('hybrid', 'scanned')").join(grounding, PAGE, "left").select(*PAGE, "route", F.when(F.col("route") == "hybrid", F.col("grounding")).alias("grounding"))
    replies = settled(read_pages(docs, todo, models))
    grids = L.table_grids(cells, words).join(boxes.select(*PAGE, "table_no"), [*PAGE, "table_no"], "left_semi")
    names = [*PAGE, "table_no", "n_rows", "n_cols", "merges", "slots", "x0", "x1", "top"]
    if models.structure:
        hybrid = sized.where("route = 'hybrid'").select(*PAGE)
        better = settled(structured(docs, boxes.join(hybrid, PAGE, "left_semi"), words, models).select(names))
        grids = better.unionByName(grids.select(names).join(better.select(*PAGE).distinct(), PAGE, "left_anti"))
    items = read_items(replies, sized, grids, pictures)
    found = settled(verified(items, replies, words, docs, models))
    wanted = found.where("wants_crop").join(sized.select(*PAGE, "width", "height"), PAGE)
    made = crops(docs, wanted.select(*PAGE, "place", F.when(F.col("crop").isNotNull(), with_margin(F.col("crop"), F.col("width"), F.col("height"))).alias("box")), models.renderer)
    made = settled(made)
    found = marked(found, words, boxes, routes).join(made.select(*PAGE, "place", F.col("sha256").alias("source_crop")), [*PAGE, "place"], "left")
    kind = F.when(F.col("type") == "figure", "image").when(F.col("type") == "list_item", "paragraph").otherwise(F.col("type"))
    out = found.select(
        *PAGE, F.lit(0).alias("column"), F.col("place").cast("double").alias("top"), F.col("place").alias("seq"), kind.alias("type"), C.collapse("text").alias("text"), "level", "runs", "list_group", "list_level", "list_ordered",
        "locator", "provenance", "source_crop", "n_rows", "n_cols", "merges", "slots",
    )
    return out, made.select("sha256", "content")
