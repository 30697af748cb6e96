"""Token ids as binary shards, with keyed access through minimal perfect hashes.

Writing: rows are range-partitioned by key, then digest of the text, and sorted within
partitions; each partition is one shard, `shard-<n>.ids`: the ids of its texts one after
another, each text closed by END_ID, as raw little-endian unsigned integers of 2 bytes (4 if
the vocabulary needs them). Shard numbers follow the key order; there is one for about
SHARD_BYTES of text, SHARDS at most, and a key of many rows spans several. A shard is written under a name
of its own attempt and then renamed, so a task that runs again leaves the same file.

Index: keys hash to index parts of about PART_KEYS keys. A part is `part-<n>.npz`: a
minimal perfect hash, and per slot a 32-bit fingerprint, shard, offset (in ids) and
count. A lookup is one part, one slot, one fingerprint and one range of one shard. A key
that isn't stored fails by fingerprint, but for one in 2^32.

Encoding: texts are cut before each run of ASCII white space; no piece of the byte-level
tokenizer crosses such a cut, so a worker that meets a cut again need not encode it again,
as long as CACHE_BYTES hold what it remembers. Texts with other white space, which can join
across a cut, and texts with a cut above LONG_CUT bytes are encoded whole.

Cases: null text counts as empty and holds only END_ID; null keys come first and can be
read by position only through key null; a key that occurs repeatedly has occurrence 0, 1,
.. in the order of its texts' digests; equal rows are stored each; an empty table gives a
store without shards; a long text is encoded and stored whole; other columns, whatever their
names, don't matter.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .perfect_hash import PerfectHash
from .shared import caches, for_texts, lean, new_path
from .textgrid import blocks, mix, span_hashes

END_ID = 0
PART_KEYS = 1_000_000
#: Bytes of a text that a shard holds, about.
SHARD_BYTES = 32 << 20
#: Shards of a store at most, so what is known of each shard stays small everywhere; beyond, shards hold more.
SHARDS = 16_384
#: Bytes of cuts and their ids that a worker remembers, and the cuts that wait to be merged.
CACHE_BYTES = 40 << 20
MERGE_AT = 100_000
LONG_CUT = 1 << 20
#: Bytes of a shard's ids that are held before they are written.
WRITE_BYTES = 8 << 20


def open_fs(url: str) -> tuple[fs.FileSystem, str]:
    """A file system and path for a folder that all executors share: file, hdfs, s3 or gs."""
    parts = urlsplit(url)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


class Encoder:
    """Ids of whole columns, through the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.clear()

    def clear(self) -> None:
        # sorted hashes with (place in flat) << 24 | length; new ones gather in the second pair before they are merged
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.known = [empty, empty]
        self.flat, self.used = np.empty(1 << 20, self.kind), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _merged(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([x[0], y[0]])
        order = np.argsort(keys, kind="stable")  # linear for two sorted runs
        return keys[order], np.concatenate([x[1], y[1]])[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Values of sorted hashes, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, values in self.known:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, values[at], out)
        return out

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> np.ndarray:
        """Encodes new cuts, in the order of their sorted hashes."""
        lists = self.encode(texts)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), self.kind, int(n.sum()))
        if self.used + len(ids) > len(self.flat):
            grown = np.empty(max(2 * len(self.flat), self.used + len(ids)), self.kind)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(ids)] = ids
        values = (self.used + np.cumsum(n) - n) << 24 | n
        self.used += len(ids)
        old, new = self.known
        new = self._merged(new, (hashes, values))
        if len(new[0]) > MERGE_AT:
            old, new = self._merged(old, new), (new[0][:0], new[1][:0])
        self.known = [old, new]
        return values

    def column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts: their ids with END_ID after each, and the number of ids of each text."""
        for b in blocks(column):
            b.find_words()
            data = b.data
            odd = np.zeros(b.rows, bool)
            if len(data) > 1:
                a, z = data[:-1], data[1:]
                joint = ((a == 0xC2) & ((z == 0x85) | (z == 0xA0))) | ((a == 0xE1) & (z == 0x9A)) | ((a == 0xE2) & ((z == 0x80) | (z == 0x81))) | ((a == 0xE3) & (z == 0x80))
                odd[np.searchsorted(b.offsets, np.flatnonzero(joint), "right") - 1] = True
            cuts = np.sort(np.concatenate([b.ends, b.offsets]), kind="stable")
            cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])]
            starts, ends = cuts[:-1], cuts[1:]
            row = np.searchsorted(b.offsets, starts, "right") - 1
            odd[row[ends - starts > LONG_CUT]] = True
            plain = ~odd[row]
            starts, ends, row = starts[plain], ends[plain], row[plain]
            hashes, first, where = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            if sum(k.nbytes + v.nbytes for k, v in self.known) + self.used * self.kind.itemsize > CACHE_BYTES:
                self.clear()
            found = self._find(hashes)
            new = np.flatnonzero(found < 0)
            if len(new):
                raw = data.tobytes()
                found[new] = self._learn(hashes[new], [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at, n = (found >> 24)[where], (found & 0xFFFFFF)[where]
            whole = {int(r): self.encode([data[b.offsets[r] : b.offsets[r + 1]].tobytes().decode("utf-8", "replace")])[0] for r in np.flatnonzero(odd)}
            sizes = np.bincount(row, weights=n, minlength=b.rows).astype(np.int64) if len(row) else np.zeros(b.rows, np.int64)
            for r, ids in whole.items():
                sizes[r] = len(ids)
            sizes += 1
            upto = np.concatenate([[0], np.cumsum(sizes)])
            out = np.full(upto[-1], END_ID, self.kind)
            # a cut's ids go to its text's start plus the ids of the text's cuts before
            run = np.cumsum(n) - n
            head = np.searchsorted(row, np.arange(b.rows))
            to = upto[row] + run - np.append(run, 0)[np.minimum(head, len(run))][row] if len(row) else run
            step = np.arange(int(n.sum())) - np.repeat(run, n)
            out[np.repeat(to, n) + step] = self.flat[np.repeat(at, n) + step]
            for r, ids in whole.items():
                out[upto[r] : upto[r] + len(ids)] = ids
            yield out, sizes


_encoders: dict[str, Encoder] = {}
caches["token_store"] = _encoders.clear


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def key_hash(keys: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64 bits of (key, occurrence); one-to-one where the occurrence is 0."""
    h = mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    more = occurrence > 0
    if more.any():
        h[more] = mix(h[more] + occurrence[more].astype(np.uint64) * np.uint64(0xDA942042E4DD58B5))
    if null.any():
        h[null] = mix(h[null] ^ np.uint64(0xA0761D6478BD642F))
    return h


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


def _replace(store: fs.FileSystem, path: str, payload: bytes) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(payload)
    store.move(own, path)


class TokenStore:
    """Shards and index in one folder."""

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta = spark, path, meta

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> TokenStore:
        """key: an integer column. path: a new folder that all executors share."""
        spark = docs.sparkSession
        for_texts(spark)
        path = path or new_path(spark, "tokens")
        store, root = open_fs(path)
        store.create_dir(root, recursive=True)
        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = partitions or max(1, min(SHARDS, -(-volume // SHARD_BYTES)), min(spark.sparkContext.defaultParallelism, volume >> 20))

        def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId()
            encode = encoder(tokenizer)
            files, base = open_fs(path)
            own = f"{base}/shard-{number:06d}.ids.{uuid.uuid4().hex}"
            offset, last, turn, out = 0, object(), 0, None  # nothing equals last at first
            try:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    if out is None:
                        out = files.open_output_stream(own, buffer_size=WRITE_BYTES)
                    sizes = []
                    for ids, each in encode.column(batch.column(1)):
                        out.write(ids.tobytes())
                        sizes.append(each)
                    count = np.concatenate(sizes)
                    turns = np.zeros(batch.num_rows, np.int64)
                    for i, k in enumerate(batch.column(0).to_pylist()):
                        turn = turn + 1 if k == last else 0
                        last, turns[i] = k, turn
                    at = offset + np.cumsum(count) - count
                    offset += int(count.sum())
                    columns = [batch.column(0), pa.array(turns), pa.array(np.full(batch.num_rows, number, np.int64)), pa.array(at), pa.array(count)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "occurrence", "shard", "offset", "n"])
            except BaseException:
                if out is not None:
                    out.close()
                    files.delete_file(own)
                raise
            if out is not None:
                out.close()
                files.move(own, f"{base}/shard-{number:06d}.ids")

        order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
        manifest = dealt.mapInArrow(lean("token_store", shard), "key bigint, occurrence bigint, shard bigint, offset bigint, n bigint")
        manifest.write.parquet(f"{path}/written")
        manifest = spark.read.schema(manifest.schema).parquet(f"{path}/written")

        # one row a shard: SHARDS at most, however large the table
        ends = manifest.groupBy("shard").agg(
            F.sum("n").alias("ids"), F.count("*").alias("texts"), F.min_by("key", "offset").alias("first"),
            F.max_by(F.struct("key", "occurrence"), "offset").alias("last"),
        )
        starts, total, texts, gone, before = {}, 0, 0, {}, None
        for r in sorted(ends.collect(), key=lambda r: r["shard"]):
            starts[r["shard"]], total, texts = total, total + r["ids"], texts + r["texts"]
            # rows of this shard's first key that stand in shards before
            more = before[1] if before and before[0] == r["first"] else 0
            if more:
                gone[r["shard"]] = (r["first"], more)
            alone = r["last"]["key"] == r["first"]
            before = (r["last"]["key"], r["last"]["occurrence"] + 1 + (more if alone else 0))
        if gone:
            more = spark.createDataFrame([(s, k, m) for s, (k, m) in gone.items()], "shard bigint, first bigint, more bigint")
            names, manifest = manifest.columns, manifest.join(F.broadcast(more), "shard", "left")
            again = F.when(F.col("key").eqNullSafe(F.col("first")), F.coalesce("more", F.lit(0))).otherwise(F.lit(0))
            manifest = manifest.withColumn("occurrence", F.col("occurrence") + again).select(names)
        manifest.write.parquet(f"{path}/manifest")
        manifest = spark.read.schema(manifest.schema).parquet(f"{path}/manifest")
        store.delete_dir(f"{root}/written")
        meta = {"ids": total, "texts": texts, "wide": Encoder(tokenizer).wide, "parts": max(1, -(-texts // PART_KEYS)), "starts": {str(k): v for k, v in starts.items()}, "end_id": END_ID}
        found = cls(spark, path, meta)
        found._index(manifest)
        _replace(store, f"{root}/meta.json", json.dumps(meta).encode())
        return found

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenStore:
        store, root = open_fs(path)
        with store.open_input_stream(f"{root}/meta.json") as f:
            return cls(spark, path, json.loads(f.read()))

    def _index(self, manifest: DataFrame) -> None:
        path, parts = self.path, self.meta["parts"]

        def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = _hashes(b)
                yield pa.RecordBatch.from_arrays([pa.array(part_of(h, parts)), pa.array(h.view(np.int64)), *b.columns[2:]], names=["part", "h", "shard", "offset", "n"])

        def build(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(tables))
            part = table["part"][0].as_py()
            h = table["h"].to_numpy().view(np.uint64)
            hashed = PerfectHash.build(h)
            slot = hashed.slots(h)
            filled = {"fingerprint": np.zeros(len(h), np.uint32)}
            filled["fingerprint"][slot] = fingerprint(h)
            for name, kind in (("shard", np.uint32), ("offset", np.uint64), ("n", np.uint64)):
                filled[name] = np.zeros(len(h), kind)
                filled[name][slot] = table[name].to_numpy()
            raw = io.BytesIO()
            np.savez(raw, **hashed.dump(), **filled)
            files, base = open_fs(path)
            _replace(files, f"{base}/part-{part:06d}.npz", raw.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(h)])], names=["part", "keys"])

        tagged = manifest.mapInArrow(lean("token_store", tag), "part bigint, h bigint, shard bigint, offset bigint, n bigint")
        built = tagged.groupBy("part").applyInArrow(lambda t: pa.Table.from_batches(list(build(iter(t.to_batches())))), "part bigint, keys bigint")
        stored = built.agg(F.sum("keys")).first()[0] or 0
        if stored != self.meta["texts"]:
            raise RuntimeError(f"the index holds {stored} of {self.meta['texts']} texts")

    def locate(self, keys: DataFrame, key: str = "key", occurrence: str | None = None) -> DataFrame:
        """key, occurrence, shard, offset, n of each row of keys; null where the key isn't stored."""
        path, parts = self.path, self.meta["parts"]
        turn = F.col(occurrence).cast("long") if occurrence else F.lit(0).cast("long")

        def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = _hashes(b)
                yield pa.RecordBatch.from_arrays([pa.array(part_of(h, parts)), pa.array(h.view(np.int64)), *b.columns], names=["part", "h", "key", "occurrence"])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = open_fs(path)
            held: tuple[int, object, dict] = (-1, None, {})
            for b in batches:
                h = _hashes(b)
                part = part_of(h, parts)
                out = {c: np.zeros(len(h), np.int64) for c in ("shard", "offset", "n")}
                ok = np.zeros(len(h), bool)
                for p in np.unique(part):
                    if held[0] != p:
                        name = f"{base}/part-{p:06d}.npz"
                        if files.get_file_info(name).type == fs.FileType.NotFound:
                            continue
                        with files.open_input_stream(name) as f:
                            read = dict(np.load(io.BytesIO(f.read())))
                        held = (int(p), PerfectHash.load(read), read)
                    mine = np.flatnonzero(part == p)
                    slot = held[1].slots(h[mine])
                    fits = slot >= 0
                    fits[fits] = held[2]["fingerprint"][slot[fits]] == fingerprint(h[mine][fits])
                    ok[mine] = fits
                    for c in out:
                        out[c][mine[fits]] = held[2][c][slot[fits]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(out[c], pa.int64(), mask=~ok) for c in out)], names=["key", "occurrence", *out])

        rows = keys.select(F.col(key).cast("long").alias("key"), turn.alias("occurrence"))
        if parts > 1:
            # a part's keys are dealt over SPREAD tasks, so a part is read by few tasks and none gets all of a hot one
            tagged = rows.mapInArrow(lean("token_store", tag), "part bigint, h bigint, key bigint, occurrence bigint")
            rows = tagged.repartition("part", F.pmod("h", F.lit(SPREAD))).sortWithinPartitions("part").select("key", "occurrence")
        return rows.mapInArrow(lean("token_store", look), "key bigint, occurrence bigint, shard bigint, offset bigint, n bigint")

    def read(self, keys: DataFrame, key: str = "key", occurrence: str | None = None, ids: bool = True) -> DataFrame:
        """For each stored row of keys: key, occurrence, start (ids before its text), n, crc32 of its ids as
        little-endian unsigned 32-bit integers, and the ids themselves unless ids is False."""
        path, starts = self.path, {int(k): v for k, v in self.meta["starts"].items()}
        kind = np.dtype("<u4" if self.meta["wide"] else "<u2")
        schema = "key bigint, occurrence bigint, start bigint, n bigint, crc32 bigint" + (", ids array<int>" if ids else "")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = open_fs(path)
            name, data = None, None
            for b in batches:
                shard, offset, n = (b.column(i).to_numpy() for i in (2, 3, 4))
                crc, lists = np.zeros(len(n), np.int64), []
                for i in range(len(n)):
                    if shard[i] != name:
                        if data is not None:
                            data.close()
                        name, data = shard[i], files.open_input_file(f"{base}/shard-{shard[i]:06d}.ids")
                    raw = data.read_at(int(n[i]) * kind.itemsize, int(offset[i]) * kind.itemsize)
                    found = np.frombuffer(raw, kind).astype("<u4")
                    crc[i] = zlib.crc32(found.tobytes())
                    if ids:
                        lists.append(found.view(np.int32))
                columns = [b.column(0), b.column(1), pa.array(np.array([starts[s] for s in shard.tolist()], np.int64) + offset), b.column(4), pa.array(crc)]
                if ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in schema.split(", ")])
            if data is not None:
                data.close()

        found = self.locate(keys, key, occurrence).where("n is not null")
        return found.repartition("shard", F.pmod("offset", F.lit(SPREAD))).sortWithinPartitions("shard", "offset").mapInArrow(lean("token_store", fetch), schema)


SPREAD = 8


def _hashes(b: pa.RecordBatch) -> np.ndarray:
    """Of a batch whose first columns are key and occurrence."""
    null = b.column(0).is_null().to_numpy(zero_copy_only=False)
    return key_hash(b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), null)


def digest(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs, reads every text back by its key: key, start, n_tokens, ids_crc32, occurrence."""
    store = TokenStore.write(docs, tokenizer, key=key, text=text)
    manifest = docs.sparkSession.read.parquet(f"{store.path}/manifest").select("key", "occurrence")
    rows = store.read(manifest, occurrence="occurrence", ids=False)
    return rows.select(F.col("key").alias(key), "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"), "occurrence")
