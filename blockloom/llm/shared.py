"""Tables that executors share, sizes that are checked, and column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold whole texts; fewer rows a batch keep long texts within a worker's memory.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a new local one if the master is local, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        found = context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='blockloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/blockloom-{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes a table to the shared folder and reads it. Its size is known to the planner afterwards."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_shared(*tables: DataFrame) -> None:
    """Deletes tables of write_shared that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def for_texts(spark: SparkSession) -> None:
    """Small Arrow batches for this session, unless it already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, ARROW_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


#: What operators keep in a worker between tasks, by operator.
caches: dict[str, Callable[[], None]] = {}


def begin(owner: str) -> None:
    """Clears the caches of other operators in this worker."""
    for name, clear in caches.items():
        if name != owner:
            clear()


def finish() -> None:
    """Gives memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for a worker that serves one operator after the other: caches of others go first, and free memory afterwards."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        try:
            yield from run(batches)
        finally:
            finish()

    return inner


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a text as a long; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use, whatever the session's case rule."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def plain_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, .., which clash with no column that an operator adds, and their names by the old ones."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in at.items())), at


def kept_as(keep: list[str], own: tuple[str, ...]) -> list[str]:
    """The names under which kept columns come back: their own, with `_` before them while a result column has that name."""
    used, out = {c.lower() for c in own}, []
    for name in keep:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


#: A key filter has about 16 bits a key, and never more than 2^27 (16 MB); beyond that it lets more rows through, not fewer.
FILTER_BITS = (1 << 20, 1 << 27)


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits)) + 1 for k in (1, 2)]


def filter_bits(n: int) -> int:
    """Bits of a filter of n keys."""
    bits = FILTER_BITS[0]
    while bits < 16 * n and bits < FILTER_BITS[1]:
        bits *= 2
    return bits


def bitmap(rows: DataFrame, places: list[Column], bits: int) -> np.ndarray:
    """Bytes of a bitmap in which all places (from 1 to bits) of all rows are set."""
    place = rows.select(F.explode(F.array(*places)).alias("p"))
    cells = place.groupBy(F.bitmap_bucket_number("p").alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow()
    full = np.zeros(bits // 8, np.uint8)
    for cell, raw in zip(cells["cell"].to_pylist(), cells["bits"].to_pylist()):
        # a cell holds 32768 places
        full[(cell - 1) * 4096 : cell * 4096] = np.frombuffer(raw, np.uint8)
    return full


def marked(full: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at places (from 0) are set."""
    return (full[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def key_filter(keys: DataFrame, key: str):
    """A function of a column: whether its value may be among keys. It is never wrong about a key that is; of others it lets few through.

    The bits are set by an aggregation, so no keys come to the driver, only the bitmap. Put it before a join
    to keep rows without a partner out of the shuffle; the join itself stays exact.
    """
    bits = filter_bits(keys.count())
    shared = keys.sparkSession.sparkContext.broadcast(bitmap(keys, _places(F.col(key), bits), bits))

    @F.pandas_udf("boolean")
    def maybe(p: pd.Series, q: pd.Series) -> pd.Series:
        held = shared.value
        out = np.ones(len(p), bool)
        for x in (p, q):
            out &= marked(held, x.to_numpy(np.int64) - 1)
        return pd.Series(out)

    return lambda column: maybe(*_places(column, bits))


#: Keys that hold more than 1 of this many rows of a join's large side.
HOT = 10_000


def met(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """Inner join of rows, in which a key may be frequent, with a table that has each key once. Both are read repeatedly.

    Keys are counted; those of more than 1 of HOT of all rows are at most HOT, and their side is broadcast.
    All others are joined by a shuffle in which no key is large.
    """
    counts = write_shared(rows.groupBy(key).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = write_shared(unique.join(F.broadcast(counts.where(F.col("_n") * HOT > total).select(key)), key, "left_semi"), "hot-keys")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(unique, key))
