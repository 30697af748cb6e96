"""Raw documents to block rows: routing in the JVM, decoding in Arrow batches.

A decoder turns the bytes of one document into block nodes. Rows are routed by a column
expression first, so Python sees only columns that it needs, and each document is decoded
once, in the task that reads it. A document that can't be decoded gives one row with its
error instead of failing the job.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ir
from ..functions import columns as C

Decoder = Callable[[bytes], Iterable[ir.Node]]
#: Decoders that were registered beside the built-in ones, and the formats of their file endings and media types.
_extra: dict[str, Decoder] = {}
_routes: dict[str, str] = {}
#: Rows of an Arrow batch on the way to the decoders.
ROWS = 64
#: Block rows that a decoder's task holds before it hands them on.
BLOCKS = 4096
#: Bytes of documents that an Arrow batch brings to a decoder's task, and of those whose rows it holds; a larger document comes alone.
BYTES = 1 << 20


def register(fmt: str, decoder: Decoder, suffixes: tuple[str, ...] = (), mimetypes: tuple[str, ...] = ()) -> None:
    """Adds a decoder for a format, and the file endings (with the dot) and media types that lead to it; what is registered first, or built in, stays."""
    _extra.setdefault(fmt, decoder)
    for name in (*suffixes, *mimetypes):
        _routes.setdefault(name.lower(), fmt)


def format_of(path: str, mimetype: str | None = None) -> Column:
    """The built-in format of a file, else a registered one; null if none fits."""
    out = C.format_of(path, mimetype)
    for name, fmt in _routes.items():
        fits = C.suffix(path) == name
        if mimetype:
            fits = fits | (F.lower(F.col(mimetype)) == name)
        out = F.coalesce(out, F.when(fits, fmt))
    return out


def decoder_for(fmt: str) -> Decoder:
    if fmt == "html":
        from . import html as found
    elif fmt == "markdown":
        from . import markdown as found
    elif fmt == "docx":
        from . import docx as found
    elif fmt == "pptx":
        from . import pptx as found
    elif fmt == "xlsx":
        from . import xlsx as found
    else:
        raise ValueError(f"no decoder for format {fmt!r}")
    return found.decode


def registered() -> tuple[dict[str, Decoder], dict[str, str]]:
    """What was registered beside the built-in formats: decoders, and the formats of file endings and media types."""
    return dict(_extra), dict(_routes)


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """doc_id (file name without ending), source_path, fmt, content, raw_sha256 of every file below a path; fmt is null for unknown endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return with_format(files.select(F.col("path").alias("source_path"), "content"))


def with_format(files: DataFrame, path: str = "source_path", mimetype: str | None = None) -> DataFrame:
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")
    return files.select(stem.alias("doc_id"), F.col(path).alias("source_path"), format_of(path, mimetype).alias("fmt"), "content", C.sha256("content").alias("raw_sha256"))


def unsupported(files: DataFrame) -> DataFrame:
    """Files that no format fits, with the reason."""
    reason = F.concat(F.lit("no decoder for extension "), C.suffix("source_path"))
    return files.where("fmt is null").select("doc_id", "source_path", reason.alias("reason"))


def _packed(rows: Iterator[ir.Node]) -> list[list[ir.Node] | bytes]:
    """All rows of a document, as it may fail at its last: those of a large one packed, BLOCKS at a time, which takes a fraction of the memory of objects."""
    parts: list[list[ir.Node] | bytes] = []
    while part := list(islice(rows, BLOCKS)):
        parts.append(part if len(part) < BLOCKS else pickle.dumps(part))
    return parts


def decoded(docs: Iterable[tuple[str, str, bytes]], extra: dict[str, Decoder], with_errors: bool) -> Iterator[tuple[list[ir.Node], list[str | None]]]:
    """Block rows of (doc_id, fmt, content), and the error of each row, some BLOCKS at a time, or those of some BYTES of documents; extra: registered decoders."""
    decoders: dict[str, Decoder] = {}
    rows: list[ir.Node] = []
    errors: list[str | None] = []
    held = 0
    for name, kind, raw in docs:
        held += len(raw)
        try:
            if kind not in decoders:
                decoders[kind] = extra.get(kind) or decoder_for(kind)
            found, error = _packed(ir.flatten(name, decoders[kind](raw))), None
        except Exception as e:
            if not with_errors:
                raise ValueError(f"document {name!r}: {e}") from e
            found, error = [[{"doc_id": name}]], f"{type(e).__name__}: {e}"
        for part in found:
            rows += pickle.loads(part) if isinstance(part, bytes) else part
            errors += [error] * (len(rows) - len(errors))
            if len(rows) >= BLOCKS or held >= BYTES:
                yield rows, errors
                rows, errors, held = [], [], 0
    if rows:
        yield rows, errors


def blocks(docs: DataFrame, fmt: str | None = None, doc_id: str = "doc_id", content: str = "content", with_errors: bool = False) -> DataFrame:
    """Block rows of docs. fmt: one format for all rows, else the column fmt. with_errors adds a column error, null but for rows that stand for a failed document."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(1000, max(ROWS, 1))) if fmt is None else "1000")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    extra = dict(_extra)
    body = F.col(content)
    body = body.cast("binary") if dict(docs.dtypes)[content] == "string" else body
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), (F.lit(fmt) if fmt else F.col("fmt")).alias("fmt"), body.alias("content")).where("content is not null and fmt is not null")
    schema = ir.SCHEMA + (", error string" if with_errors else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (tuple(c[i].as_py() for c in batch.columns[:3]) for batch in batches for i in range(batch.num_rows))
        for rows, errors in decoded(each, extra, with_errors):
            made = ir.batch(rows)
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(errors, pa.string())], names=[*ir.COLUMNS, "error"]) if with_errors else made

    return rows.mapInArrow(run, schema)
