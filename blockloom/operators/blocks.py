"""Block tables: selections, section paths, lists, table grids, and the checks of the block schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..ir import BLOCK_TYPES, IR_VERSION
from .nesting import fold_tables


def top_level(blocks: DataFrame, kind: str | None = None) -> DataFrame:
    out = blocks.where("parent_uid is null")
    return out if kind is None else out.where(F.col("type") == kind)


def images(blocks: DataFrame, nested: bool = True) -> DataFrame:
    """Image blocks in reading order; nested ones included unless told otherwise."""
    return blocks.where("type = 'image'") if nested else top_level(blocks, "image")


def tables(blocks: DataFrame) -> DataFrame:
    return top_level(blocks, "table")


def by_id(blocks: DataFrame, block_id: str) -> DataFrame:
    """The first block with an id, of each document."""
    turn = Window.partitionBy("doc_id").orderBy("ordinal")
    return blocks.where(F.col("id") == block_id).withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def list_items(blocks: DataFrame) -> DataFrame:
    """doc_id, list_id and the list's items in order."""
    item = F.struct("ordinal", "id", "list_level", "list_ordered", "text")
    return top_level(blocks).where("list_id is not null").groupBy("doc_id", "list_id").agg(F.sort_array(F.collect_list(item)).alias("items"))


def _open_headings(by: str, order: str, level: Column, is_heading: Column, deepest: int) -> Column:
    """The headings that are open before each row, outermost first: array of (level, ordinal, text).

    The last heading of level L is open if it comes after the last ones of all lower levels.
    """
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(is_heading & (level == L), F.struct(F.col(order).alias("at"), F.col("text").alias("text")))).over(before) for L in range(1, deepest + 1)]
    out = []
    for k in range(deepest):
        later = F.lit(True)
        for j in range(k):
            later = later & F.coalesce(last[k]["at"] > last[j]["at"], F.lit(True))
        out.append(F.when(last[k].isNotNull() & later, F.struct(F.lit(k + 1).alias("level"), last[k]["text"].alias("text"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def with_heading_path(blocks: DataFrame, deepest: int = 9) -> DataFrame:
    """Sets heading_path of top-level blocks: the texts of the headings open before the block.

    A heading's own path is taken before it closes others, so it still names the
    siblings that it ends; null where no heading is open.
    """
    level = F.least(F.col("level"), F.lit(deepest))
    path = _open_headings("doc_id", "ordinal", level, (F.col("type") == "heading") & F.col("parent_uid").isNull(), deepest)
    texts = F.transform(path, lambda x: x["text"])
    return blocks.withColumn("heading_path", F.when(F.col("parent_uid").isNull() & (F.size(texts) > 0), texts))


def breadcrumbs(blocks: DataFrame, deepest: int = 9) -> DataFrame:
    """doc_id, ordinal, breadcrumb of top-level tables: `A > B` of headings with ever lower levels, walking back."""
    top = top_level(blocks)
    path = _open_headings("doc_id", "ordinal", F.least(F.col("level"), F.lit(deepest)), F.col("type") == "heading", deepest)
    named = F.filter(F.transform(path, lambda x: F.trim(x["text"])), lambda t: t != "")
    return top.withColumn("breadcrumb", F.array_join(named, " > ")).where("type = 'table'").select("doc_id", "ordinal", "uid", "breadcrumb")


def table_context(blocks: DataFrame, max_chars: int = 400, before: int = 1, after: int = 1) -> DataFrame:
    """doc_id, uid, context of top-level tables: the section, and the nearest non-empty paragraphs in document order."""
    top = top_level(blocks)
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    text = F.when((F.col("type") == "paragraph") & (F.trim("text") != ""), F.substring(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), 1, max_chars))
    none = F.array().cast("array<string>")
    # every paragraph's rank; a table then needs those of ranks next to its own
    rows = top.withColumn("_text", text).withColumn("_rank", F.count("_text").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    paragraphs = rows.where("_text is not null").select("doc_id", F.col("_rank").alias("_at"), F.col("_text").alias("_t"))
    near = rows.where("type = 'table'").select("doc_id", "uid", "ordinal", "_rank")
    wanted = near.withColumn("_at", F.explode(F.sequence(F.col("_rank") - before + 1, F.col("_rank") + after))) if before + after > 0 else near.withColumn("_at", F.lit(-1))
    found = wanted.join(paragraphs, ["doc_id", "_at"], "left").groupBy("doc_id", "uid", "ordinal", "_rank").agg(F.sort_array(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_at", "_t")))).alias("_near"))
    lines = F.transform("_near", lambda x: F.concat(F.when(x["_at"] <= F.col("_rank"), F.lit("Text before: ")).otherwise(F.lit("Text after: ")), x["_t"]))
    joined = found.join(breadcrumbs(blocks).select("doc_id", "uid", "breadcrumb"), ["doc_id", "uid"])
    section = F.when(F.col("breadcrumb") != "", F.array(F.concat(F.lit("Section: "), F.col("breadcrumb")))).otherwise(none)
    return joined.select("doc_id", "uid", "ordinal", F.array_join(F.concat(section, lines), "\n").alias("context"))


# Table grids

def pad_rows(cells: Column, width: Column) -> Column:
    """Rows of strings, each filled with empty ones up to a width."""
    return F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))


def occupancy(merges: Column) -> Column:
    """Grid slots that merges cover, but their origins: array of (row, col)."""
    one = lambda m: F.flatten(F.transform(F.sequence(m["row"], m["row"] + m["rowspan"] - 1), lambda r: F.transform(F.sequence(m["col"], m["col"] + m["colspan"] - 1), lambda c: F.struct(r.alias("row"), c.alias("col")))))
    return F.array_distinct(F.flatten(F.transform(merges, lambda m: F.filter(one(m), lambda s: (s["row"] != m["row"]) | (s["col"] != m["col"])))))


def vertical_merges(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, uid, col, row, continues) to merges: a cell and the cells below that continue it are one span."""
    column = Window.partitionBy("doc_id", "uid", "col").orderBy("row")
    island = F.sum((~F.col("continues")).cast("int")).over(column)
    spans = cells.withColumn("_island", island).groupBy("doc_id", "uid", "col", "_island").agg(F.min("row").alias("row"), F.count("*").cast("int").alias("rowspan"))
    return spans.where("rowspan > 1").select("doc_id", "uid", "row", "col", "rowspan")


def is_empty_table() -> Column:
    """Whether a rendered table shows nothing; separators count as something."""
    return F.regexp_replace("table_plain", r"(?U)\s+", "") == ""


# Documents as JSON

def block_json() -> Column:
    """A block without nested content as JSON; absent fields are left out."""
    runs = F.when(F.size("runs") > 0, F.transform("runs", lambda r: F.struct(r["text"].alias("text"), r["marks"].alias("marks"), F.when(r["link"] != "", r["link"]).alias("link"))))
    text = F.when(F.col("type").isin("heading", "paragraph", "code"), F.coalesce("text", F.lit("")))
    span = F.when(F.coalesce(*[F.col(f"span.{f}").cast("string") for f in ("byte_start", "byte_end", "part", "page", "page_start", "page_end")]).isNotNull(), F.col("span"))
    fields = [
        "type", "id", span.alias("span"), "list_id", "list_level", "list_ordered", "heading_path", "provenance", "source_crop", text.alias("text"), "level",
        runs.alias("runs"), "language", "table_description", "describe_status", "describe_attempts", "image_index", F.parse_json("locator").alias("locator"),
        "alt_text", "image_id", "ocr_text", "ocr_meaningful", "mime", "width", "height",
    ]
    return F.to_json(F.struct(*fields))


def with_json(blocks: DataFrame) -> DataFrame:
    """Blocks with their own JSON in place of what it is made from: what documents_json needs of them, worth keeping where they are made at a cost."""
    return blocks.select("doc_id", "ordinal", "uid", "parent_uid", "cell_row", "cell_col", "cell_pos", "type", "n_rows", "n_cols", "merges", "null_slots", block_json().alias("_json"))


def blocks_json(blocks: DataFrame) -> DataFrame:
    """doc_id, ordinal, json of top-level blocks (or of with_json of them), with the cells of tables inside them."""
    rows = blocks if "_json" in blocks.columns else with_json(blocks)

    def slot(s: Column) -> Column:
        parts = F.transform(s["parts"], lambda p: F.when(p["type"] == "table", p["child"]["json"]).otherwise(p["part"]["json"]))
        return F.when(s["absent"], F.lit("null")).otherwise(F.concat(F.lit('{"blocks":['), F.array_join(parts, ","), F.lit("]}")))

    def table(t: Column, lines: Column) -> Column:
        listed = F.transform(lines, lambda line: F.concat(F.lit("["), F.array_join(F.transform(line, slot), ","), F.lit("]")))
        grid = F.concat(F.lit('{"n_rows":'), t["n_rows"].cast("string"), F.lit(',"n_cols":'), t["n_cols"].cast("string"), F.lit(',"cells":['), F.array_join(listed, ","), F.lit('],"merges":'), F.coalesce(F.to_json(t["merges"]), F.lit("[]")), F.lit("}"))
        return F.struct(F.concat(F.regexp_replace(t["_json"], r"\}$", ""), F.lit(',"table":'), grid, F.lit("}")).alias("json"))

    tables = fold_tables(rows, F.struct(F.col("_json").alias("json")), "struct<json:string>", table).where("parent_uid is null")
    return rows.where("type <> 'table' and parent_uid is null").select("doc_id", "ordinal", F.col("_json").alias("json")).unionByName(tables.select("doc_id", "ordinal", "made.json"))


def documents_json(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, json. docs: doc_id, source_path, fmt, optionally metadata (JSON); other columns of docs are fields of the head too. blocks: as they are, or with_json."""
    body = blocks_json(blocks).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "json"))).alias("parts"))
    named = [c for c in docs.columns if c not in ("doc_id", "source_path", "fmt", "metadata", "content")]
    more = [F.parse_json("metadata").alias("metadata")] if "metadata" in docs.columns else []
    head = F.to_json(F.struct(F.lit(IR_VERSION).alias("ir_version"), "doc_id", "source_path", "fmt", *named, *more))
    joined = docs.join(body, "doc_id", "left")
    return joined.select("doc_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"blocks":['), F.coalesce(F.array_join(F.transform("parts", lambda p: p["json"]), ","), F.lit("")), F.lit("]}")).alias("json"))


def validate(docs: DataFrame, json: str = "json") -> DataFrame:
    """Rows of docs (doc_id, json) that can't be read, with path and reason."""
    return docs.select("doc_id", fault_of(json).alias("fault")).where("fault is not null").select("doc_id", "fault.path", "fault.reason")


def head_fault(v: Column) -> Column:
    """Path and reason why a parsed document can't be read whatever its blocks are: the version gate, required fields, a list of blocks."""
    version = F.schema_of_variant(F.try_variant_get(v, "$.ir_version", "variant"))
    absent = lambda name: F.try_variant_get(v, f"$.{name}", "variant").isNull() | F.is_variant_null(F.try_variant_get(v, f"$.{name}", "variant"))
    missing = lambda name: F.when(absent(name), F.struct(F.lit("<root>").alias("path"), F.lit(f"required field '{name}' missing").alias("reason")))
    fault = lambda path, reason: F.struct(F.lit(path).alias("path"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    number = F.try_variant_get(v, "$.ir_version", "bigint")
    # what has a field is an object, and what has a first element a list: the schema of a whole document, or a copy of all its blocks, is made for odd ones only
    at = lambda path: F.try_variant_get(v, path, "variant")
    return F.coalesce(
        F.when(v.isNull() | (at("$.doc_id").isNull() & ~F.schema_of_variant(v).startswith("OBJECT")), fault("<root>", "expected an object")),
        F.when(version.isNotNull() & ~version.isin("BIGINT", "BOOLEAN", "VOID"), fault("ir_version", F.concat(F.lit("expected an int, got "), F.lower(version)))),
        F.when(number > IR_VERSION, fault("ir_version", F.concat(F.lit("file is IR v"), number.cast("string"), F.lit(f", this reader supports up to v{IR_VERSION}")))),
        missing("doc_id"), missing("source_path"), missing("fmt"),
        F.when(at("$.blocks[0]").isNull() & ~absent("blocks") & F.try_variant_get(v, "$.blocks", "array<variant>").isNull(), fault("blocks", "expected a list")),
    )


def fault_of(json: str = "json") -> Column:
    """Path and reason why a document can't be read, null if it can: the version gate, required fields, block types and ids. The document is parsed once."""
    of = lambda b, name: F.try_variant_get(b, f"$.{name}", "string")
    table = lambda b: F.try_variant_get(b, "$.table", "variant")

    def block(b: Column, i: Column) -> Column:
        at = F.concat(F.lit("blocks["), i.cast("string"), F.lit("]"))
        kind = of(b, "type")
        # most blocks are fine; the schema of one, with all that is inside, is made for the others only
        fine = of(b, "id").isNotNull() & (kind.isin(*(t for t in BLOCK_TYPES if t != "table")) | ((kind == "table") & table(b).isNotNull()))
        return (
            F.when(F.coalesce(fine, F.lit(False)), F.lit(None))
            .when(~F.schema_of_variant(b).startswith("OBJECT"), F.struct(at.alias("path"), F.lit("expected an object").alias("reason")))
            .when(kind.isNull(), F.struct(at.alias("path"), F.lit("required field 'type' missing").alias("reason")))
            .when(~kind.isin(*BLOCK_TYPES), F.struct(F.concat(at, F.lit(".type")).alias("path"), F.concat(F.lit("unknown block type '"), kind, F.lit("'")).alias("reason")))
            .when(of(b, "id").isNull(), F.struct(at.alias("path"), F.lit("required field 'id' missing").alias("reason")))
            .when((kind == "table") & table(b).isNull(), F.struct(at.alias("path"), F.lit("required field 'table' missing").alias("reason")))
        )

    def fault(v: Column) -> Column:
        faults = F.filter(F.transform(F.try_variant_get(v, "$.blocks", "array<variant>"), block), lambda x: x.isNotNull())
        return F.coalesce(head_fault(v), F.try_element_at(faults, F.lit(1)))

    return C.let(F.try_parse_json(json), fault)


def check_invariants(blocks: DataFrame) -> DataFrame:
    """doc_id, uid, broken: rows that break an invariant of the block table."""
    rules = {
        "runs join to the text": (F.size("runs") > 0) & (C.run_text("runs") != F.col("text")),
        "runs carry a mark or link": (F.size("runs") > 0) & ~C.runs_have_marks("runs"),
        "known type": ~F.col("type").isin(*BLOCK_TYPES),
        "nested blocks have no id": F.col("parent_uid").isNotNull() & (F.col("id") != ""),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return blocks.select("doc_id", "uid", F.explode(broken).alias("broken"))
