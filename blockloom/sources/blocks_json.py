"""Documents as JSON back to block rows, also of older versions whose cells are strings.

A document is parsed once, as a variant, and its blocks are unfolded table level by table
level inside its row: what a level's tables hold is the next level's work. Each block
carries its path, the numbers on the way to it, whose order is the order of the rows. No
shuffle, no job before the reader's own action, no Python, and no limit on levels but the
JSON parser's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ir
from ..functions.columns import let
from ..operators import blocks as B

#: Fields that a block's row takes over as they are.
_PLAIN = tuple(c for c in ir.COLUMNS if c not in ("doc_id", "ordinal", "uid", "parent_uid", "cell_row", "cell_col", "cell_pos", "id", "n_rows", "n_cols", "merges", "null_slots", "locator", "runs", "signals"))
_TABLE = f"struct<n_rows:int,n_cols:int,cells:array<array<variant>>,merges:{ir.COLUMNS['merges']}>"
#: All of a block but its runs, which are most of it: they are read apart, and only where they are asked for.
_BLOCK = "struct<" + ",".join(f"{c}:{ir.COLUMNS[c]}" for c in (*_PLAIN, "id")) + f",locator:variant,table:{_TABLE}>"
_NODES = "array<struct<b:variant,path:array<int>>>"
#: Fields whose values have to be of their type; any scalar will do for a string.
_TYPED = tuple(c for c in _PLAIN if ir.COLUMNS[c] != "string")
#: Runs as far as they can be at fault: a list whose elements have texts. There are many, and to hand on a variant takes a fraction of what a cast to a string does.
_RUNS = "array<struct<text:variant>>"


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _absent(v: Column) -> Column:
    """Neither a missing field nor JSON's null says anything."""
    return v.isNull() | F.is_variant_null(v)


def _object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _or_empty(found: Column, kind: str) -> Column:
    return F.coalesce(found, F.array().cast(kind))


def _cells(b: Column) -> Column:
    return _or_empty(F.when(_at(b, "$.type", "string") == "table", _at(b, "$.table.cells", "array<array<variant>>")), "array<array<variant>>")


def _inside(slot: Column) -> Column:
    """The blocks of a table's slot: null, a string (version 1), or an object with blocks. The schema of a slot, with all that is inside, is made for those without blocks only."""
    said = slot.cast("string")
    alone = F.array(F.to_variant_object(F.struct(F.lit("paragraph").alias("type"), said.alias("text"))))
    return _or_empty(F.coalesce(_at(slot, "$.blocks", "array<variant>"), F.when(_string(slot), F.when(said != "", alone))), "array<variant>")


def _below(node: Column) -> Column:
    """The nodes one level below a node."""
    block = lambda r, c: lambda b, k: F.struct(b.alias("b"), F.concat(node["path"], F.array(r, c, k)).alias("path"))
    row = lambda line, r: F.flatten(F.transform(_or_empty(line, "array<variant>"), lambda slot, c: F.transform(_inside(slot), block(r, c))))
    return F.flatten(F.transform(_cells(node["b"]), row))


def _levels(json: str) -> Column:
    """At least as many as tables lie in each other: each has a key for its cells, whose letters are plain or escaped."""
    times = lambda said: (F.octet_length(json) - F.octet_length(F.replace(F.col(json), F.lit(said), F.lit("")))) / len(said)
    return (times("cells") + times("\\u006") + times("\\u007")).cast("int")


def _nodes(v: Column, json: str) -> Column:
    """All nodes of a document, (b, path), in the order of their rows."""
    top = F.transform(_or_empty(_at(v, "$.blocks", "array<variant>"), "array<variant>"), lambda b, i: F.struct(b.alias("b"), F.array(i).alias("path")))
    start = F.struct(F.array().cast(_NODES).alias("done"), top.alias("todo")).cast(f"struct<done:{_NODES},todo:{_NODES}>")
    turn = lambda acc, _: F.when(F.size(acc["todo"]) == 0, acc).otherwise(F.struct(F.concat(acc["done"], acc["todo"]).alias("done"), F.flatten(F.transform(acc["todo"], _below)).alias("todo")))
    every = F.aggregate(F.sequence(F.lit(0), _levels(json) + 1), start, turn, lambda acc: acc["done"])
    order = lambda nodes: F.sort_array(F.transform(nodes, lambda n, i: F.struct(n["path"].alias("path"), i.alias("i"))))
    return let(every, lambda nodes: F.transform(order(nodes), lambda o: nodes[o["i"]]))


def _steps(path: Column, one) -> Column:
    """The text of the steps below a top-level block."""
    return F.when(F.size(path) > 1, F.array_join(F.transform(F.sequence(F.lit(1), F.size(path) - 3, F.lit(3)), lambda i: one(*(F.get(path, i + k).cast("string") for k in range(3)))), "")).otherwise("")


def _uid(path: Column) -> Column:
    return F.concat(F.lit("b"), F.get(path, F.lit(0)).cast("string"), _steps(path, lambda r, c, k: F.concat(F.lit("/"), r, F.lit("."), c, F.lit("."), k)))


def _where(path: Column) -> Column:
    return F.concat(F.lit("blocks["), F.get(path, F.lit(0)).cast("string"), F.lit("]"), _steps(path, lambda r, c, k: F.concat(F.lit(".table.cells["), r, F.lit("]["), c, F.lit("].blocks["), k, F.lit("]"))))


def _fault(node: Column) -> Column:
    """Path and reason why a block can't be read; null if it can. What has a field is an object: schemas, with all that is inside, are made of odd values only."""
    reason = let(node["b"], lambda b: _reason(b, F.size(node["path"]) == 1))
    return F.when(reason.isNotNull(), F.concat(_where(node["path"]), reason))


def _reason(b: Column, top: Column) -> Column:
    need = lambda name, v: F.when(_absent(_at(v, f"$.{name}")), F.lit(f": required field '{name}' missing"))
    no_list = lambda name, of="": F.lit(f"{of}.{name}: expected a list")
    wrong = lambda name, v, kind, of="": F.when(_at(v, f"$.{name}", kind).isNull() & ~_absent(_at(v, f"$.{name}")), no_list(name, of) if kind.startswith("array") else F.lit(f"{of}.{name}: expected {kind.split('<')[0]}"))
    kind = _at(b, "$.type", "string")
    in_runs = lambda runs: F.coalesce(F.when(runs.isNull() & ~_absent(_at(b, "$.runs")), no_list("runs")), F.when(F.exists(runs, lambda r: ~_string(r["text"]) & _at(r["text"], "$", "string").isNull()), F.lit(".runs: required field 'text' missing")))

    def in_table(table: Column) -> Column:
        fine = lambda x: _at(x, "$.blocks[0].type", "string").isNotNull()
        in_slot = lambda x: F.when(~fine(x) & ~_absent(x) & ~_string(x), F.when(~_object(x), F.lit(": expected an object")).otherwise(F.coalesce(need("blocks", x), wrong("blocks", x, "array<variant>"))))
        in_row = lambda line, r: F.when(line.isNull(), F.array(F.concat(r.cast("string"), F.lit("]: expected a list")))).otherwise(F.transform(line, lambda x, c: F.concat(r.cast("string"), F.lit("]["), c.cast("string"), F.lit("]"), in_slot(x))))
        rows = F.filter(F.flatten(F.transform(_cells(b), in_row)), lambda x: x.isNotNull())
        return F.coalesce(
            F.when(_absent(table), F.lit(": required field 'table' missing")), F.when(_at(table, "$.n_rows").isNull() & ~_object(table), F.lit(".table: expected an object")), need("n_rows", table), need("n_cols", table),
            *[wrong(*x, of=".table") for x in (("n_rows", table, "int"), ("n_cols", table, "int"), ("cells", table, "array<variant>"))], F.concat(F.lit(".table.cells["), F.try_element_at(rows, F.lit(1))),
        )

    return F.coalesce(
        F.when(kind.isNull() & ~_object(b), F.lit(": expected an object")),
        need("type", b),
        F.when(~F.coalesce(kind.isin(*ir.BLOCK_TYPES), F.lit(False)), F.concat(F.lit(".type: unknown block type '"), F.coalesce(kind, F.lit("")), F.lit("'"))),
        F.when(top, need("id", b)),
        *[wrong(c, b, ir.COLUMNS[c]) for c in _TYPED],
        let(_at(b, "$.runs", _RUNS), in_runs),
        F.when(kind == "table", let(_at(b, "$.table"), in_table)),
    )


def blocks(docs: DataFrame, column: str = "json", with_errors: bool = False) -> DataFrame:
    """Block rows of docs (doc_id, json), in the order of the document, nested blocks after their table.

    A document without text gives no rows; one that can't be read ends the job with its path and reason, or, with_errors,
    gives one row with them in a column error. What isn't one JSON object, has a key twice, is too large for a variant
    or holds one string that is too long for the JVM's JSON parser (about 20 million characters) can't be read. Fields of other names are passed over.
    """
    rows = docs.where(F.col(column).isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col(column).cast("string").alias("json"))
    rows = rows.withColumn("v", F.try_parse_json("json")).withColumn("nodes", _nodes(F.col("v"), "json"))
    head = B.head_fault(F.col("v"))
    first = F.try_element_at(F.filter(F.transform("nodes", _fault), lambda x: x.isNotNull()), F.lit(1))
    rows = rows.select("doc_id", "nodes", F.coalesce(F.concat(head["path"], F.lit(": "), head["reason"]), first).alias("error"))
    if not with_errors:
        ended = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("document '"), F.col("doc_id"), F.lit("': "), F.col("error"))).cast(_NODES))
        rows = rows.withColumn("nodes", F.coalesce(ended, F.col("nodes")))
    else:
        rows = rows.withColumn("nodes", F.when(F.col("error").isNull(), F.col("nodes")).otherwise(F.array(F.lit(None)).cast(_NODES)))
    # not posexplode: Spark would infer that nodes isn't empty, and parse and check every document anew below the projections to know it
    rows = rows.select("doc_id", "error", F.posexplode_outer("nodes").alias("at", "node")).where("at is not null").withColumn("x", _at(F.col("node.b"), "$", _BLOCK))

    path, x, table, said = F.col("node.path"), F.col("x"), F.col("x.table"), _at(F.col("node.b"), "$.runs", ir.COLUMNS["runs"])
    nested, is_table = F.size(path) > 1, F.col("x.type") == "table"
    runs = let(said, lambda rs: F.when(F.size(rs) > 0, F.transform(rs, lambda r: F.struct(r["text"].alias("text"), F.coalesce(r["marks"], F.array().cast("array<string>")).alias("marks"), r["link"].alias("link")))))
    merges = F.transform(table["merges"], lambda m: F.struct(m["row"].alias("row"), m["col"].alias("col"), F.coalesce(m["rowspan"], F.lit(1)).alias("rowspan"), F.coalesce(m["colspan"], F.lit(1)).alias("colspan")))
    slots = F.flatten(F.transform(table["cells"], lambda line, r: F.filter(F.transform(line, lambda s, c: F.when(_absent(s), F.struct(r.alias("row"), c.alias("col")))), lambda s: s.isNotNull())))
    made = {c: x[c] for c in _PLAIN} | {
        "doc_id": F.col("doc_id"), "ordinal": F.when(F.col("error").isNull(), F.col("at")), "uid": _uid(path), "parent_uid": F.when(nested, _uid(F.slice(path, 1, F.size(path) - 3))),
        **{name: F.when(nested, F.get(path, F.size(path) - 3 + k)) for k, name in enumerate(("cell_row", "cell_col", "cell_pos"))},
        "id": F.when(nested, F.lit("")).when(x["id"] != "", x["id"]).otherwise(_uid(path)), "runs": runs,
        "locator": F.when(~_absent(x["locator"]), F.to_json(x["locator"])),
        "n_rows": F.when(is_table, table["n_rows"]), "n_cols": F.when(is_table, table["n_cols"]),
        "merges": F.when(is_table, _or_empty(merges, ir.COLUMNS["merges"])), "null_slots": F.when(is_table, _or_empty(slots, ir.COLUMNS["null_slots"])),
        "signals": F.lit(None),
    }
    return rows.select(*[made[c].cast(kind).alias(c) for c, kind in ir.COLUMNS.items()], *(["error"] if with_errors else []))


#: Fields of a document's head that are read unless others are asked for, and their types.
HEAD = {"raw_sha256": "string", "mimetype": "string", "page_count": "int", "access_level": "string"}


def read(docs: DataFrame, column: str = "json", with_errors: bool = False, fields: dict[str, str] = HEAD) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, source_path, fmt, scalar fields of the head, metadata) and block rows of docs (doc_id, json)."""
    v = F.try_parse_json(column)
    of = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind).alias(name)
    head = docs.select(F.coalesce(of("doc_id"), F.col("doc_id")).alias("doc_id"), of("source_path"), of("fmt"), *(of(name, kind) for name, kind in fields.items()), F.to_json(F.try_variant_get(v, "$.metadata", "variant")).alias("metadata"))
    return head, blocks(docs.select("doc_id", column), column, with_errors)
