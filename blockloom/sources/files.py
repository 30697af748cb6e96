"""Files as a data source of blocks: spark.read.format("blockloom").load(folder).

    files.register(spark)
    spark.read.format("blockloom").load("/data/in").where("fmt = 'html'")

Rows are those of decode.blocks over decode.read_files, with source_path, fmt and error
added: a file that can't be decoded has one row with its error. Formats are those that
decoders read one by one (PDF pages are laid out over several columns of a job: see
plans.convert); files of others are left out. The looks of Word and PowerPoint paragraphs
stay in signals, as in decode.blocks; operators.headings turns them into headings.

The folder is listed once, on the driver, as Spark's own file sources do; a task gets
neighbouring files up to a number of bytes and holds one file and a bounded number of
rows at a time. Filters on fmt, doc_id and source_path (= and IN) are
answered from the list, so that files they rule out are never opened.

Options: recursive (true), partition_bytes (128 MB).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .. import ir
from ..functions.columns import FORMATS
from . import decode

NAME = "blockloom"
PARTITION_BYTES = 128 << 20
#: What opening a file costs, as bytes: many small files fill a task too.
OPENING = 4 << 20
MORE = ("source_path", "fmt", "error")
#: Columns whose filters are answered from the list of files.
LISTED = ("fmt", "doc_id", "source_path")


@dataclass
class File:
    doc_id: str
    source_path: str
    fmt: str
    size: int


@dataclass
class Files(InputPartition):
    files: list[File]


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with the decoders registered by now, and lets filters reach it."""
    extra, formats = decode.registered()[0], endings()

    class Registered(BlockSource):  # Spark makes readers in a process of its own, which sees no module's state of here
        def reader(self, schema: object) -> BlockReader:
            return BlockReader(self.options, extra, formats)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Registered)


def endings() -> dict[str, str]:
    """The format of each file ending that a decoder reads."""
    _, routes = decode.registered()
    return {k: v for k, v in routes.items() if k.startswith(".")} | {e: name for name, own, _ in reversed(FORMATS) for e in own if name != "pdf"}


def packed(files: Sequence[File], room: int) -> list[Files]:
    """Neighbours by path together, up to room bytes a task; a larger file is a task of its own."""
    out: list[Files] = []
    left = 0
    for f in sorted(files, key=lambda f: f.source_path):
        cost = f.size + min(OPENING, max(room // 32, 1))
        if not out or cost > left:
            out.append(Files([]))
            left = room
        out[-1].files.append(f)
        left -= cost
    return out


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ir.SCHEMA + "".join(f", {c} string" for c in MORE)

    def reader(self, schema: object) -> BlockReader:
        return BlockReader(self.options, {}, endings())


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str], extra: dict[str, decode.Decoder], formats: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("name a folder: load(path)")
        self.path, self.extra, self.formats = options["path"], extra, formats
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.room = int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in LISTED:
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.wanted[column] = self.wanted[column] & some if column in self.wanted else some
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root, shown = self._place()
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=self.recursive)):
            path = PurePosixPath(info.path)
            fmt = self.formats.get(path.suffix.lower())
            if info.type != fs.FileType.File or fmt is None or any(p.startswith(("_", ".")) for p in path.relative_to(root).parts):
                continue
            file = File(path.stem, shown + info.path, fmt, info.size)
            if all(getattr(file, c) in some for c, some in self.wanted.items()):
                found.append(file)
        return packed(found, self.room) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _, shown = self._place()
        for file in partition.files:
            with system.open_input_stream(file.source_path.removeprefix(shown)) as f:
                content = f.read()
            for rows, errors in decode.decoded([(file.doc_id, file.fmt, content)], self.extra, with_errors=True):
                made = ir.batch(rows)
                named = [pa.array([v] * len(rows), pa.string()) for v in (file.source_path, file.fmt)]
                yield pa.RecordBatch.from_arrays([*made.columns, *named, pa.array(errors, pa.string())], names=[*ir.COLUMNS, *MORE])

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the folder in it, and what stands before its paths in Spark's addresses."""
        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path.rstrip("/") or "/", "file:"
        if self.path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").strip("/"), "file:"
        system, root = fs.FileSystem.from_uri(self.path)
        root = root.rstrip("/")
        return system, root, self.path.rstrip("/").removesuffix(root)
