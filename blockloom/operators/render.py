"""Block rows back to Markdown, by DataFrame operations.

Inline content is an expression per row. Nested tables are rendered from the inside out,
at the row of the outermost table. Lists are
runs of neighbours with one list_id (gaps and islands); their numbers are ranks within
islands that end at a shallower item. A list that holds more than paragraphs becomes
nested HTML, in one Python call per list. A document is the ordered join of its parts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .nesting import fold_tables


def _image_src() -> Column:
    return F.coalesce(F.when(F.length("image_id") > 0, F.col("image_id")), F.concat(F.lit("<image"), F.col("image_index").cast("string"), F.lit(">")))


def image_md() -> Column:
    ocr = F.when(F.coalesce("ocr_meaningful", F.lit(False)) & (F.length("ocr_text") > 0), F.concat(F.lit("\n\n*OCR: "), C.escape_md("ocr_text"), F.lit("*")))
    return F.concat(F.lit("!["), F.coalesce(C.escape_md("alt_text"), F.lit("")), F.lit("]("), _image_src(), F.lit(")"), F.coalesce(ocr, F.lit("")))


def image_html() -> Column:
    width = F.when(F.col("width") > 0, F.concat(F.lit(' width="'), F.col("width").cast("string"), F.lit('"')))
    return F.concat(F.lit('<img src="'), C.escape_html(_image_src()), F.lit('" alt="'), F.coalesce(C.escape_html("alt_text"), F.lit("")), F.lit('"'), F.coalesce(width, F.lit("")), F.lit(">"))


def code_md() -> Column:
    return F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))


def code_html() -> Column:
    return F.concat(F.lit("<pre><code>"), C.escape_html(F.coalesce("text", F.lit(""))), F.lit("</code></pre>"))


#: What is rendered of a table.
VIEWS = "struct<table_html:string,table_md:string,table_simple:boolean,table_text:string,table_plain:string>"


def with_tables(blocks: DataFrame) -> DataFrame:
    """Adds table_html, table_md, table_simple, table_text and table_plain to tables (all null for other blocks), nested ones resolved.

    table_text is the plain view of a table within a cell: Markdown rows, or `header: value` lines if it holds a table itself;
    table_plain is the view of models: cells joined by bars, spans listed below.
    """
    html = F.when(F.col("type") == "image", image_html()).when(F.col("type") == "code", code_html()).otherwise(C.inline_fragment("text", "runs", html=True))
    text = F.when(F.col("type") != "image", F.coalesce("text", F.lit("")))
    marker = F.when(F.col("type") == "image", F.concat(F.lit("<image"), F.col("image_index").cast("string"), F.lit(">")))
    part = F.struct(html.alias("html"), text.alias("text"), marker.alias("marker"), F.replace(C.inline_fragment("text", "runs"), F.lit("\n"), F.lit(" ")).alias("md"))
    tables = fold_tables(blocks, part, VIEWS, lambda t, lines: C.let(F.transform(lines, lambda line: F.transform(line, _slot_view)), lambda views: _views(t, views)))
    lists = {c: F.coalesce(c, F.array().cast(dict(blocks.dtypes)[c])) for c in ("merges", "null_slots")}
    tables = tables.withColumns(lists).select(*blocks.columns, "made.*")
    return blocks.where("type <> 'table'").unionByName(tables, allowMissingColumns=True)


def _slot_view(slot: Column) -> Column:
    """A slot of a table as HTML, as plain text and as Markdown, and what it holds."""
    parts = slot["parts"]
    full = lambda of: F.filter(F.transform(parts, of), lambda x: F.length(x) > 0)
    either = lambda view, own: lambda p: F.when(p["type"] == "table", p["child"][view]).otherwise(p["part"][own])
    # a marker that the text doesn't carry comes at its end
    ended = lambda s, m: F.when(F.contains(s, m), s).when(s == "", m).otherwise(F.concat(s, F.lit("\n"), m))
    return F.struct(
        slot["absent"].alias("absent"), F.array_join(full(either("table_html", "html")), "<br>").alias("html"),
        F.aggregate(full(lambda p: p["part"]["marker"]), F.array_join(full(either("table_text", "text")), "\n"), ended).alias("plain"),
        F.coalesce(F.get(parts, F.lit(0))["part"]["md"], F.lit("")).alias("md"),
        ((F.size(parts) <= 1) & F.forall(parts, lambda p: p["type"].isin("paragraph", "heading"))).alias("simple"), F.exists(parts, lambda p: p["type"] == "table").alias("has_table"),
    )


def _views(t: Column, views: Column) -> Column:
    """A table from its row and the views of its slots, line by line."""
    merges = F.coalesce(t["merges"], F.array().cast("array<struct<row:int,col:int,rowspan:int,colspan:int>>"))
    grid = lambda f, glue, a, z: F.transform(views, lambda line: F.concat(F.lit(a), F.array_join(F.transform(line, f), glue), F.lit(z)))
    every = lambda holds: F.forall(views, lambda line: F.forall(line, holds))

    def td(v: Column, r: Column, c: Column) -> Column:
        attribute = lambda m, n: F.coalesce(F.when(m[n] > 1, F.concat(F.lit(f' {n}="'), m[n].cast("string"), F.lit('"'))), F.lit(""))
        own = C.let(F.try_element_at(F.filter(merges, lambda m: (m["row"] == r) & (m["col"] == c)), F.lit(-1)), lambda m: F.concat(attribute(m, "rowspan"), attribute(m, "colspan")))
        return F.concat(F.lit("<td"), own, F.lit(">"), v["html"], F.lit("</td>"))

    html = F.transform(views, lambda line, r: F.concat(F.lit("<tr>"), F.array_join(F.transform(line, lambda v, c: F.when(~v["absent"], td(v, r, c))), ""), F.lit("</tr>")))
    ruled = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.greatest(t["n_cols"], F.lit(0))), " | "), F.lit(" |"))
    head = lambda made: C.let(made, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(ruled), F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))), "\n"))
    one_line = lambda v: F.regexp_replace(F.replace(v["plain"], F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+$", "")
    title = lambda v, c: C.let(one_line(v), lambda x: F.when(x != "", x).otherwise(F.concat(F.lit("col"), c.cast("string"))))
    titles = F.transform(F.get(views, F.lit(0)), title)
    body = F.slice(views, 2, F.greatest(F.size(views), F.lit(1)))
    pairs = C.let(titles, lambda names: F.array_join(F.transform(body, lambda line: F.array_join(F.transform(line, lambda v, c: F.concat(F.get(names, c), F.lit(": "), v["plain"])), "\n")), "\n\n"))
    span = lambda m: F.concat(F.lit("cell (row "), m["row"].cast("string"), F.lit(", col "), m["col"].cast("string"), F.lit(") spans "), m["rowspan"].cast("string"), F.lit("x"), m["colspan"].cast("string"))
    merged = F.when(F.size(merges) > 0, F.concat(F.lit("\n[merged: "), F.array_join(F.transform(merges, span), "; "), F.lit("]"))).otherwise(F.lit(""))
    plain_grid = F.coalesce(F.size(t["null_slots"]), F.lit(0)) <= 0
    return F.struct(
        F.concat(F.lit("<table>"), F.array_join(html, ""), F.lit("</table>")).alias("table_html"),
        F.when(t["n_cols"] == 0, F.lit("")).otherwise(head(grid(lambda v: v["md"], " | ", "| ", " |"))).alias("table_md"),
        ((F.size(merges) == 0) & plain_grid & every(lambda v: v["simple"])).alias("table_simple"),
        F.when(t["n_rows"] == 0, F.lit("")).when(~every(lambda v: ~v["has_table"]), pairs).otherwise(head(grid(lambda v: F.replace(one_line(v), F.lit("|"), F.lit("\\|")), " | ", "| ", " |"))).alias("table_text"),
        F.concat(F.array_join(grid(lambda v: v["plain"], " | ", "", ""), "\n"), merged).alias("table_plain"),
    )


def block_md() -> Column:
    """The Markdown of a top-level block outside of lists, from its inline content _md."""
    hashes = F.repeat(F.lit("#"), F.least(F.greatest("level", F.lit(1)), F.lit(6)))
    described = F.when(F.length("table_description") > 0, F.concat(F.lit("\n\n*"), C.escape_md("table_description"), F.lit("*")))
    table = F.concat(F.when(F.col("table_simple"), F.col("table_md")).otherwise(F.col("table_html")), F.coalesce(described, F.lit("")))
    inline = F.col("_md")
    return (
        F.when(F.col("type") == "heading", F.concat(hashes, F.lit(" "), inline))
        .when(F.col("type") == "code", code_md())
        .when(F.col("type") == "table", table)
        .when(F.col("type") == "image", image_md())
        .when(F.col("type") == "paragraph", C.escape_leading(inline))
        .otherwise(F.lit(""))
    )


def list_islands(top: DataFrame) -> DataFrame:
    """Adds island: equal for neighbouring blocks of one list_id; null outside of lists."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    starts = ~F.col("list_id").eqNullSafe(F.lag("list_id").over(order))
    return top.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("island", F.when(F.col("list_id").isNotNull(), F.sum("_starts").over(order))).drop("_starts")


#: Levels of lists whose last items are kept as numbers.
DEEP = 9


def numbered(items: DataFrame) -> DataFrame:
    """Adds number: an ordered item's place among ordered items of its level since the last shallower item of its island."""
    island = Window.partitionBy("doc_id", "island").orderBy("ordinal")
    lvl = F.coalesce("list_level", F.lit(0))
    rows = items.withColumn("_level", lvl).withColumn("_place", F.row_number().over(island))
    # the last earlier item that is shallower: of each level the last place, and of levels beyond DEEP those that stand there
    last = [F.when(F.col("_level") > n, F.max(F.when(F.col("_level") == n, F.col("_place"))).over(island)) for n in range(DEEP)]
    beyond = F.collect_list(F.when(F.col("_level") >= DEEP, F.struct(F.col("_place").alias("p"), F.col("_level").alias("l")))).over(island)
    far = F.when(F.col("_level") > DEEP, F.array_max(F.transform(F.filter(beyond, lambda x: x["l"] < F.col("_level")), lambda x: x["p"])))
    reset = F.greatest(*last, far)
    rows = rows.withColumn("_reset", F.coalesce(reset, F.lit(0)))
    same = Window.partitionBy("doc_id", "island", "_level", "_reset").orderBy("ordinal")
    return rows.withColumn("number", F.sum(F.coalesce(F.col("list_ordered"), F.lit(False)).cast("int")).over(same)).drop("_place", "_reset")


def _nested_html(items: list[tuple[int, bool, str]]) -> str:
    """Items (level, ordered, html) as nested lists; a deeper list stands inside the item before it."""
    root: list = []
    stack: list[tuple[int, list]] = []

    def opened(level: int, ordered: bool, into: list) -> list:
        made: list = [("ol" if ordered else "ul")]
        into.append(made)
        stack.append((level, made))
        return made

    for level, ordered, html in items:
        while stack and stack[-1][0] > level and len(stack) > 1 and stack[-2][0] >= level:
            stack.pop()
        if stack and stack[-1][0] > level:
            if len(stack) == 1:
                break  # shallower than the list's first item: the list is at its end
            stack.pop()
        if not stack:
            opened(level, ordered, root)
        elif stack[-1][0] < level:
            parent = stack[-1][1]
            if len(parent) == 1:
                parent.append([])
            opened(level, ordered, parent[-1])
        stack[-1][1].append([html])

    def text(made: list) -> str:
        body = "".join(f"<li>{''.join(x if isinstance(x, str) else text(x) for x in item)}</li>" for item in made[1:])
        return f"<{made[0]}>{body}</{made[0]}>"

    return text(root[0]) if root else ""


def _lists(rows: DataFrame) -> DataFrame:
    """doc_id, ordinal, md of every list."""
    items = numbered(rows.where("island is not null"))
    indent = F.repeat(F.lit("  "), F.col("_level"))
    marker = F.when(F.coalesce("list_ordered", F.lit(False)), F.concat(F.col("number").cast("string"), F.lit("."))).otherwise(F.lit("-"))
    line = F.concat(indent, marker, F.lit(" "), "_md")
    html = F.when(F.col("type") == "image", image_html()).when(F.col("type") == "table", F.col("table_html")).when(F.col("type") == "code", code_html()).otherwise(C.inline_fragment("text", "runs", html=True))
    items = items.withColumn("_simple", F.bool_and(F.col("type") == "paragraph").over(Window.partitionBy("doc_id", "island")))
    entry = F.struct("ordinal", F.col("_level").alias("level"), F.coalesce("list_ordered", F.lit(False)).alias("ordered"), line.alias("md"), F.when(~F.col("_simple"), html).alias("html"))
    lists = items.groupBy("doc_id", "island").agg(F.min("ordinal").alias("ordinal"), F.bool_and("_simple").alias("simple"), F.sort_array(F.collect_list(entry)).alias("items"))
    plain = lists.where("simple").select("doc_id", "ordinal", F.array_join(F.transform("items", lambda x: x["md"]), "\n").alias("md"))

    @F.pandas_udf("string")
    def nested(column: pd.Series) -> pd.Series:
        return column.map(lambda items: _nested_html([(x["level"], x["ordered"], x["html"]) for x in items]))

    rich = lists.where("not simple").select("doc_id", "ordinal", nested("items").alias("md"))
    return plain.unionByName(rich)


#: Columns that no rendering reads.
UNREAD = ("span", "heading_path", "provenance", "source_crop", "locator", "signals", "describe_status", "describe_attempts", "mime")


def with_inline(blocks: DataFrame) -> DataFrame:
    """Blocks with their inline content as Markdown in _md, made where they are, not in the few tasks of what is grouped later.

    What rendering doesn't read is left out, so it is also what is worth keeping: runs stay in cells and lists only, each
    mark once, as marks that are never closed pile up over a page.
    """
    once = F.transform("runs", lambda r: F.struct(r["text"].alias("text"), F.array_distinct(r["marks"]).alias("marks"), r["link"].alias("link")))
    inside = F.col("parent_uid").isNotNull() | F.col("list_id").isNotNull()
    return blocks.withColumn("runs", once).withColumns({"_md": C.inline_fragment("text", "runs"), "runs": F.when(inside, F.col("runs"))}).drop(*UNREAD)


def parts(blocks: DataFrame) -> DataFrame:
    """doc_id, ordinal, md: the pieces of every document's Markdown."""
    top = with_tables(blocks if "_md" in blocks.columns else with_inline(blocks)).where("parent_uid is null")
    rows = list_islands(top)
    single = rows.where("island is null").select("doc_id", "ordinal", block_md().alias("md")).where("md <> ''")
    return single.unionByName(_lists(rows))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown."""
    pieces = parts(blocks).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "md"))).alias("parts"))
    return pieces.select("doc_id", F.concat(F.array_join(F.transform("parts", lambda p: p["md"]), "\n\n"), F.lit("\n")).alias("markdown"))


def cell_text(blocks: DataFrame) -> DataFrame:
    """doc_id, uid, table_text, table_plain of every table."""
    return with_tables(blocks).where("type = 'table'").select("doc_id", "uid", "table_text", "table_plain")

