"""Mixing sources to target weights, with DataFrame functions only.

Targets: the sources, ordered by code point with null last, weigh WEIGHTS in turn and
share the total size. A source's target stops at EPOCHS times its own size; what is
over goes to the others by weight. The level L with sum(min(EPOCHS * size, L * weight))
= total is found from cumulated sums over the sources, ordered by size over weight.

Order: each row gets a hash-random key, 60 bits of the digest of SEED, id and text. Its top bits are a range bucket within the
source, so a partial aggregation gives each bucket's size, and cumulated sums over
buckets find the bucket in which a source's budget ends. Only rows of that bucket are
ordered one by one: all others are wholly in or out. They are range-partitioned by source
and key; prefix sums over the partitions' sums, then within each partition, tell what
was taken before each row, so no task gets a whole bucket. A row there takes what is left
of the budget when its turn comes, so the budget is met to the word. Whole epochs repeat
every row before.

Cases: null text or text without a word has size 0 and takes 0; a source without words
has target 0; null source is a source of its own; rows that are equal in id and text
share a key and are told apart by nothing, so either may get a cut; a long text counts
whole; an empty table gives an empty mix; kept columns may have any name, and one that
is named like a result column comes back with `_` before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, kept_as, plain_columns, word_count, write_shared

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Range buckets of a source; the rows of one of them are ordered.
BUCKET_BITS = 12
SEED = 20240229
OWN = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, weight, target from one row a source (source, source_size)."""
    listed = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = Window.orderBy("ratio", "rank")
    rows = sizes.withColumn("rank", F.row_number().over(listed) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", (epochs * F.col("source_size")).cast("double"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("spent", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    level = (F.col("total") - F.col("full")) / (F.col("weights") - F.col("spent"))
    # the sources before the first with ratio >= level are at their caps
    rows = rows.withColumn("level", level)
    found = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    return rows.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(found, F.col("cap") / F.col("weight")) * F.col("weight")).alias("target"))


def order_key(key: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, keep: list[str], key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """keep, size, source_size, target, taken for every row."""
    plain, at = plain_columns(docs)
    rows = plain.select(
        *(at[c] for c in dict.fromkeys(keep)),
        F.col(at[source]).alias("_source"),
        word_count(at[text]).alias("_size"),
        order_key(F.col(at[key]), F.col(at[text])).alias("_order"),
        F.col(at[key]).alias("_key"),
    )
    rows = rows.withColumn("_bucket", F.shiftright("_order", 60 - BUCKET_BITS))
    buckets = write_shared(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("words")), "buckets")
    plan = targets(buckets.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, epochs)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    upto = Window.partitionBy("_source").orderBy("_bucket")
    cuts = buckets.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    cuts = cuts.join(plan.select(F.col("source").alias("s"), "budget"), F.col("_source").eqNullSafe(F.col("s")))
    cuts = cuts.where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words")))
    cuts = cuts.select(F.col("_source").alias("s"), F.col("_bucket").alias("cut"), (F.col("budget") - F.col("before")).alias("left"))
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "weight", "budget")
    plan = write_shared(plan.select(F.col("source").alias("_of"), "source_size", "target", F.col("epochs").alias("_epochs"), F.col("cut").alias("_cut"), F.col("left").alias("_left")), "mix")

    joined = rows.join(plan, F.col("_source").eqNullSafe(F.col("_of")), "left")
    whole = joined.where(~F.col("_bucket").eqNullSafe(F.col("_cut")))
    ends = joined.where(F.col("_bucket").eqNullSafe(F.col("_cut")))
    # equal rows are told apart by a number, so that they too can be dealt to several partitions
    place = [F.col(c) for c in ("_source", "_order", "_key", "_tie")]
    ends = ends.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*place).sortWithinPartitions(*place)
    ends = write_shared(ends.withColumn("_part", F.spark_partition_id()), "ends")
    sums = ends.groupBy(F.col("_source").alias("_s"), F.col("_part").alias("_p")).agg(F.sum("_size").alias("_sum"))
    over = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = write_shared(sums.select("_s", "_p", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_earlier")), "sums")
    ends = ends.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")), "left")
    turn = Window.partitionBy("_part", "_source").orderBy("_order", "_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_earlier") + F.coalesce(F.sum("_size").over(turn), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_left") - before))
    every = F.when(F.col("_bucket") < F.col("_cut"), F.col("_size")).otherwise(F.lit(0))
    columns = [*(F.col(at[c]).alias(n) for c, n in zip(keep, kept_as(keep, OWN))), F.col("_size").alias("size"), "source_size", "target"]
    taken = lambda last: (F.col("_epochs") * F.col("_size") + last).cast("long").alias("taken")
    return whole.select(*columns, taken(every)).unionByName(ends.select(*columns, taken(part)))


def mix_rows(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of the mix, with the columns of docs: a row for each whole repeat, and one whose text
    keeps its first words if the budget ends inside it. Rows of which nothing is taken are left out."""
    names = docs.columns
    plain, at = plain_columns(docs)
    rows = mixed(plain, plain.columns, at[key], at[source], at[text], weights, epochs).where("taken > 0")
    rows = rows.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.least(F.col("size"), F.col("taken") - (F.col("_turn") - 1) * F.col("size"))
    words = F.regexp_extract_all(F.col(at[text]), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, left.cast("int")), "")
    rows = rows.withColumn(at[text], F.when(left < F.col("size"), cut).otherwise(F.col(at[text])))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


#: Targets by resharing in rounds: a source that would be above its cap stays at it, the others share the rest.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || left(md5('20240229:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 15))::BIGINT AS turn FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
r(turn, source, source_size, weight, capped) AS (
    SELECT 0, source, source_size, weight, false FROM n
    UNION ALL
    SELECT turn + 1, source, source_size, weight, capped OR weight * level > 3 * source_size FROM (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)) / nullif(sum(weight) FILTER (NOT capped) OVER (), 0) AS level FROM r)
    WHERE turn < (SELECT count(*) FROM n)),
t AS (SELECT source, source_size, CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER () END AS target
    FROM r WHERE turn = (SELECT count(*) FROM n)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
w AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken FROM w"""
