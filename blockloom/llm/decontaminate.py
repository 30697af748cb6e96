"""Benchmark decontamination: short test items inside long documents.

Shingles are SHINGLE_WORDS words. An item is found in a document if the document holds
at least THRESHOLD of the item's distinct shingles.

Search for items of up to BASE shingles: a document that holds one lacks so few of its
shingles that it holds one of any few more; these are its anchors, and are looked up one
by one. This search loses nothing.

Search for longer items: a document's shingles are cut into base blocks; the MinHash of a block under
each of HASHES functions is a minimum, so the minima of blocks twice as long are minima
of pairs. Items are partitioned by size: an item of n shingles belongs to the scale
whose blocks hold n or more, and is searched among windows of two adjacent blocks of
that scale, in which every place of the item lies whole. Windows are at most about four
times the item, so containment c makes a Jaccard similarity of c / 4 or so, however
long the document. Bands have one row: a window that shares any one minimum with an
item is a candidate (c = 0.8 fails to share one with a chance below 1e-5; an item torn
into halves far apart, below 1e-3).

Verification: for each candidate document the exact count of the item's distinct
shingles over the whole document, by 64-bit shingle hashes.

Items are taken in blocks whose index has about INDEX_BYTES, so what each pass broadcasts
is bounded; more items mean more passes over the documents.

Cases: null or shorter texts than SHINGLE_WORDS have no shingles, hold no item, and are
no item; repeated rows and equal items are each reported; long texts are searched whole; an
empty table of documents or items gives no rows; documents keep their columns, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import for_texts, lean
from .textgrid import SHINGLE_WORDS, blocks, mix

THRESHOLD = 0.8
HASHES = 64
BASE = 16
INDEX_BYTES = 32 << 20
_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of texts: first row, rows, the shingle hashes, and each text's bounds among them."""
    for b in blocks(column):
        b.find_words()
        h, at = b.windows(b.word_hashes(), SHINGLE_WORDS)
        yield b.lo, b.rows, h, np.searchsorted(b.word_row[at], np.arange(b.rows + 1))


class ItemIndex:
    """MinHash tables of items by size, and their exact shingle sets."""

    def __init__(self, texts: list[str]):
        sets: list[np.ndarray] = []
        for _, rows, h, bounds in shingle_hashes(pa.array(texts, pa.string())):
            sets += [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(rows)]
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        scale = np.zeros(len(sets), np.int64)
        while (small := BASE << scale < self.sizes).any():
            scale[small] += 1
        small = np.flatnonzero((self.sizes > 0) & (self.sizes <= BASE))
        taken = [sets[i][: 1 + len(sets[i]) - int(np.ceil(THRESHOLD * len(sets[i]) - 1e-9))] for i in small]
        self.anchors = self._table(np.concatenate([np.zeros(0, np.uint64), *taken]), np.repeat(small, np.array([len(x) for x in taken], np.int64)))
        self.scales = {}
        for k in np.unique(scale[self.sizes > BASE]):
            mine = np.flatnonzero((scale == k) & (self.sizes > BASE))
            values, owner = [], []
            for j in range(HASHES):
                values.append(np.array([(sets[i] * _MULTIPLIERS[j]).min() for i in mine], np.uint64) ^ np.uint64(j))
                owner.append(mine)
            self.scales[int(k)] = self._table(np.concatenate(values), np.concatenate(owner))
        self.deepest = max(self.scales, default=-1)

    @staticmethod
    def _table(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(values, kind="stable")
        seen = np.zeros(1 << 16, bool)
        seen[(values >> np.uint64(13)).astype(np.int64) & 0xFFFF] = True
        return values[order], owner[order], seen

    @staticmethod
    def _hits(table: tuple[np.ndarray, np.ndarray, np.ndarray], asked: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct text * 2^32 + item, for the values asked and the texts that they are of."""
        values, items, seen = table
        maybe = np.flatnonzero(seen[(asked >> np.uint64(13)).astype(np.int64) & 0xFFFF])
        lo = np.searchsorted(values, asked[maybe], "left")
        hi = np.searchsorted(values, asked[maybe], "right")
        hit = hi > lo
        lo, hi, at = lo[hit], hi[hit], owner[maybe[hit]]
        width = hi - lo
        which = np.repeat(lo, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        return np.unique(np.repeat(at, width) * np.int64(1 << 32) + items[which])

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs, as rows of two columns, for the texts of one run."""
        n = np.diff(bounds)
        # base blocks never cross texts
        blocks_of = -(-n // BASE)
        first = np.concatenate([[0], np.cumsum(blocks_of)])
        text = np.repeat(np.arange(len(n)), blocks_of)
        starts = bounds[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * BASE
        if not len(starts):
            return np.zeros((0, 2), np.int64)
        found = [self._hits(self.anchors, h, np.repeat(np.arange(len(n)), n))]
        for j in range(HASHES if self.scales else 0):
            minima = np.minimum.reduceat(h * _MULTIPLIERS[j], starts)
            owner = text
            for k in range(self.deepest + 1):
                if k in self.scales:
                    # a window's minimum is that of one of its blocks, so blocks are asked once each
                    found.append(self._hits(self.scales[k], minima ^ np.uint64(j), owner))
                if k < self.deepest:
                    # blocks twice as long, by pairs within a text
                    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    heads = np.flatnonzero(place % 2 == 0)
                    minima, owner = np.minimum.reduceat(minima, heads), owner[heads]
        pairs = np.unique(np.concatenate(found))
        return np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1)

    def contained(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """Verified (text, item, shingles found)."""
        out = []
        pairs = self.candidates(h, bounds)
        for t in np.unique(pairs[:, 0]):
            own = np.unique(h[bounds[t] : bounds[t + 1]])
            for i in pairs[pairs[:, 0] == t, 1]:
                want = self.sets[i]
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                shared = int((own[at] == want).sum())
                if shared >= THRESHOLD * len(want) - 1e-9:
                    out.append((int(t), int(i), shared))
        return out


def _item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items with their ids, in blocks of bounded text; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        block.append((r["i"], r["t"]))
        n = len(r["t"].split())
        # shingles with their anchors, and a minimum for each function
        size += 32 * n + 16 * HASHES * (n > BASE)
        if size >= INDEX_BYTES:
            yield block
            block, size = [], 0
    yield block


def _pass(docs: DataFrame, keep: list[str], text: str, items: list[tuple[int, str]], out: str) -> DataFrame:
    """keep, then out: the items of one block that the text holds, array of (item_id, shared, size), null if none."""
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(ItemIndex([t for _, t in items]))
    ids = [i for i, _ in items]
    kind = docs.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kind] + [f"`{out}` array<struct<item_id:bigint,shared:bigint,size:bigint>>"])
    listed = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("size", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            hits: list[list[dict] | None] = [None] * batch.num_rows
            for lo, _, h, bounds in shingle_hashes(batch.column(len(keep))):
                for t, i, shared in found.contained(h, bounds):
                    if hits[lo + t] is None:
                        hits[lo + t] = []
                    hits[lo + t].append({"item_id": ids[i], "shared": shared, "size": int(found.sizes[i])})
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(hits, listed)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    return docs.select(*keep, F.col(text).alias("_searched")).mapInArrow(lean("decontaminate", run), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id, shared, size, containment: each item that a document holds."""
    for_texts(docs.sparkSession)
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    parts = [_pass(plain, ["key"], "body", block, "hits").where("hits is not null") for block in _item_blocks(benchmark, item, item_text)]
    rows = reduce(DataFrame.unionByName, parts).select("key", F.explode("hits").alias("hit"))
    return rows.select(F.col("key").alias(key), "hit.item_id", "hit.shared", "hit.size", (F.col("hit.shared") / F.col("hit.size")).alias("containment"))


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with their own columns."""
    for_texts(docs.sparkSession)
    names = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    for block in _item_blocks(benchmark, item, item_text):
        rows = _pass(rows, rows.columns, f"c{names.index(text)}", block, "hits").where("hits is null").drop("hits")
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words),
items AS (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM items),
n AS (SELECT item_id, count(*) AS size FROM q GROUP BY item_id)
SELECT d.doc_id, q.item_id, count(*) AS shared, n.size, count(*)::DOUBLE / n.size AS containment
FROM d JOIN q USING (s) JOIN n ON n.item_id = q.item_id GROUP BY d.doc_id, q.item_id, n.size HAVING count(*) >= 0.8 * n.size"""
