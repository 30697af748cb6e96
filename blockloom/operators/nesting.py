"""Tables within tables, folded from the inside out within one expression.

The blocks of cells meet at their table, and tables at the outermost table that holds
them; there an aggregate climbs from the deepest level to the top, each table taking the
results of the level below by their number. The plan is the same at any depth, and
making it runs no job. A row holds one outermost table with all that is inside, as does
its rendered text. Work grows with the slots: cells are brought into the order of the
grid once and then taken by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def fold_tables(blocks: DataFrame, part: Column, result: str, table: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of all tables, as in blocks, with a column made of the type result (a struct).

    part: what a block in a cell is worth by itself, over its row. table(t, lines): a table's result from its row t and its
    lines, arrays of slots (absent, parts); parts are (type, part, child) in order, child the result of a part that is a
    table, else null. Slots without blocks have no parts; absent ones carry no cell. Blocks outside of the grid are left
    out, and a slot that is listed as absent but holds blocks is a cell. Tables without rows or columns have no slots.
    """
    whole = F.struct(*[F.col(c) for c in blocks.columns])
    rows = blocks.select("doc_id", "uid", "parent_uid", "cell_row", "cell_col", "cell_pos", "type", part.alias("_part"), whole.alias("_row"), (F.size(F.split("uid", "/")) - 1).alias("_depth"), F.element_at(F.split("uid", "/"), 1).alias("_root"))
    value = rows.schema["_part"].dataType.simpleString()
    parts_type = f"array<struct<type:string,part:{value},child:{result}>>"
    is_table, inside = F.col("type") == "table", F.col("_depth") > 0
    level = Window.partitionBy("doc_id", "_root", "_depth").orderBy("uid")
    nested = rows.where(is_table & inside).withColumn("_number", F.row_number().over(level))
    others = rows.where(~is_table & inside).withColumn("_number", F.lit(None).cast("int"))
    outer = rows.where(is_table & ~inside).withColumn("_number", F.lit(1))

    # one shuffle by table serves both groupings and the join
    keys = ["doc_id", "parent_uid"]
    placed = others.unionByName(nested).select(*keys, "cell_row", "cell_col", F.struct("cell_pos", F.col("_number").alias("number"), "type", F.col("_part").alias("part")).alias("p")).repartition(*keys)
    cells = placed.groupBy(*keys, "cell_row", "cell_col").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    held = cells.groupBy(*keys).agg(F.collect_list(F.struct(F.col("cell_row").alias("r"), F.col("cell_col").alias("c"), "parts")).alias("cells"))
    held = held.withColumnRenamed("parent_uid", "uid")
    tables = outer.unionByName(nested).join(held, ["doc_id", "uid"], "left")
    one = F.struct((-F.col("_depth")).alias("rise"), F.col("_number").alias("number"), F.col("_row").alias("row"), "cells")
    roots = tables.groupBy("doc_id", "_root").agg(F.collect_list(one).alias("tables"))
    places = F.sort_array(F.transform("tables", lambda t, i: F.struct(t["rise"].alias("rise"), t["number"].alias("number"), i.alias("i"))))
    roots = roots.select(F.transform(places, lambda p: F.get("tables", p["i"])).alias("tables"))

    def lines(t: Column, below: Column) -> Column:
        height, width = (F.greatest(F.coalesce(t["row"][k], F.lit(0)), F.lit(0)) for k in ("n_rows", "n_cols"))
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        fits = lambda r, c: (r >= 0) & (r < height) & (c >= 0) & (c < width)
        child = lambda p: F.when(p["type"] == "table", F.get(below, p["number"] - 1))
        full = lambda parts: F.transform(parts, lambda p: F.struct(p["type"].alias("type"), p["part"].alias("part"), child(p).alias("child"))).cast(parts_type)
        slot = lambda at, absent, parts: F.struct(at.alias("at"), F.lit(absent).alias("absent"), parts.alias("parts"))
        bare = lambda at, absent: slot(at, absent, F.array().cast(parts_type))
        found = F.transform(F.filter(t["cells"], lambda x: fits(x["r"], x["c"])), lambda x: slot(x["r"] * width + x["c"], False, full(x["parts"])))
        named = F.transform(F.filter(t["row"]["null_slots"], lambda s: fits(s["row"], s["col"])), lambda s: s["row"] * width + s["col"])
        of = lambda xs, kind: F.coalesce(xs, F.array().cast(kind))

        def laid(have: Column) -> Column:
            taken = F.transform(have, lambda x: x["at"])
            absent = F.array_except(of(named, "array<int>"), taken)
            empty = F.array_except(F.array_except(upto(height * width), taken), of(named, "array<int>"))
            return F.sort_array(F.concat(have, F.transform(absent, lambda at: bare(at, True)), F.transform(empty, lambda at: bare(at, False))))

        kind = f"array<struct<at:int,absent:boolean,parts:{parts_type}>>"
        dense = C.let(of(found, kind), laid)
        return C.let(dense, lambda d: F.transform(upto(height), lambda r: F.slice(d, r * width + 1, width)))

    def climb(done: Column, rise: Column) -> Column:
        here = F.filter("tables", lambda t: t["rise"] == rise)
        made = F.transform(here, lambda t: table(t["row"], lines(t, done["below"])))
        return C.let(made, lambda m: F.struct(m.alias("below"), F.concat(done["all"], m).alias("all")))

    none = F.array().cast(f"array<{result}>")
    climbed = F.aggregate(F.sequence(F.get("tables", F.lit(0))["rise"], F.lit(0)), F.struct(none.alias("below"), none.alias("all")), climb, lambda done: done["all"])
    pairs = roots.select(F.explode(F.arrays_zip(F.transform("tables", lambda t: t["row"]).alias("row"), climbed.alias("made"))).alias("x"))
    return pairs.select("x.row.*", F.col("x.made").alias("made"))
