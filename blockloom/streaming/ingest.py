"""Files as a stream: what arrives is decoded once, by content."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import convert
from ..scratch import settled
from ..sources import decode

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def arriving(spark: SparkSession, path: str, suffixes: str = "*.{md,markdown,html,htm,xhtml,docx,pptx,xlsx,pdf}", per_trigger: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", suffixes).option("maxFilesPerTrigger", per_trigger).load(path)
    return decode.with_format(files.select(F.col("path").alias("source_path"), "content"))


def first_arrivals(files: DataFrame) -> DataFrame:
    """Files of known formats, each content once over the whole life of the query: a key for each content is in the query's state."""
    return files.where("fmt is not null").dropDuplicates(["raw_sha256"])


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started meanwhile keep their state in RocksDB, so that keys don't have to fit in memory; a provider that was chosen stays."""
    chosen = spark.conf.get(_PROVIDER, None)
    if chosen is not None and not chosen.endswith("HDFSBackedStateStoreProvider"):
        yield
        return
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if chosen is None else spark.conf.set(_PROVIDER, chosen)


def start(files: DataFrame, out: str, checkpoint: str, available_now: bool = True, formats: tuple[str, ...] = convert.FORMATS) -> StreamingQuery:
    """Writes the blocks of new files to out/blocks, a folder for each batch, so a batch that runs again replaces what it left.
    A file whose content came before, in any batch, adds nothing; what came before is known from the query's state in checkpoint,
    and nothing that was written is read. Files that can't be decoded have a row in out/errors."""

    def add(batch: DataFrame, number: int) -> None:
        # the formats' branches read the batch side by side, which a query's state doesn't allow
        rows = settled(convert.blocks(settled(batch), formats, with_errors=True))
        rows.where("error is null").drop("error").write.mode("overwrite").parquet(f"{out}/blocks/batch={number}")
        rows.where("error is not null").select("doc_id", "error").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    writer = first_arrivals(files).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    with _state_on_disk(files.sparkSession):
        return (writer.trigger(availableNow=True) if available_now else writer).start()
