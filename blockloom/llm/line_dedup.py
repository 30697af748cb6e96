"""Lines that many documents share, found through two Bloom filters.

A line's key is the line without white space [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased.

First pass: each task sets the bits of its documents' keys in two filters, one for what has
been seen once, one for what has been seen twice, and sends the slices that aren't empty.
Folding two tasks' filters gives once = a | b and twice = a2 | b2 | (a & b), so a key of two
documents always has all its bits in the second filter, whatever the order of the tasks.
Second pass: only keys that the second filter holds are suspected; each is written with its
document as a SHA-256 digest and the numbers of its lines. Digests are counted exactly, over
documents; those of at least min_docs documents are confirmed. Keys that the filter holds
by chance fail here, so it decides nothing but how much is shuffled. A filter has
FILTER_BITS bits, whatever the table; with more than some tens of millions of keys it lets more
through, never less.

Confirmed keys that hold more than 1 of HOT of all suspected rows are at most HOT, and are
broadcast; all others are joined by a shuffle in which no key is large. Texts are shuffled
only if they hold a suspected line, once, to meet the numbers of their lines to drop.

Cases: null or empty text is one empty line, and null stays null; keys of fewer than min_chars code
points always stay; a key counts once a document, however often it is there; equal rows are
documents of their own; long texts and lines are used whole; an empty table gives no rows;
other columns, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import slices
from .shared import for_texts, lean, marked, plain_columns, write_shared
from .textgrid import SPACE, Block, blocks, span_hashes

#: Bits of each filter; 16 MB each in a task, and the second one is broadcast.
FILTER_BITS = 1 << 27
HOT = 10_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Lines:
    """The lines of a block of texts: rows, spans of their keys, and which keys are long enough to count."""

    def __init__(self, b: Block, min_chars: int):
        data, offsets = b.data, b.offsets
        breaks = np.flatnonzero(data == 10)
        self.per_row = 1 + np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=b.rows) if b.rows else np.zeros(0, np.int64)
        # both are in the order of lines
        starts, ends = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
        row = np.repeat(np.arange(b.rows), self.per_row)
        number = np.arange(len(row)) - np.repeat(np.cumsum(self.per_row) - self.per_row, self.per_row)
        ink = np.flatnonzero(~SPACE[data])
        lo, hi = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
        upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        full = np.flatnonzero(hi > lo)
        first, last = ink[lo[full]], ink[hi[full] - 1] + 1
        long = upto[last] - upto[first] >= max(1, min_chars)
        self.row, self.number, self.starts, self.ends = row[full][long], number[full][long], first[long], last[long]
        self.data = _LOWER[data]
        self.hashes = span_hashes(self.data, self.starts, self.ends)


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    low = np.uint64(bits - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64)


class TwoFilters:
    """What a task has seen once, and twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Adds keys, each once a document."""
        for at in places(hashes, self.bits):
            at, n = np.unique(at, return_counts=True)
            bit = np.uint8(1) << (at & 7).astype(np.uint8)
            again = (n > 1) | marked(self.once, at)
            np.bitwise_or.at(self.twice, at[again] >> 3, bit[again])
            np.bitwise_or.at(self.once, at >> 3, bit)


def _fold(state: np.ndarray, at: np.ndarray | slice, once: np.ndarray, twice: np.ndarray) -> None:
    state[1, at] |= twice | (state[0, at] & once)
    state[0, at] |= once


def seen_twice(docs: DataFrame, text: str = "text", min_chars: int = 1, bits: int = FILTER_BITS) -> np.ndarray:
    """The bytes of the filter that holds every key of two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TwoFilters(bits)
        for batch in batches:
            for b in blocks(batch.column(0)):
                lines = Lines(b, min_chars)
                order = np.lexsort((lines.hashes, lines.row))
                h, r = lines.hashes[order], lines.row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                seen.add(h[new])
        yield from slices.cut(seen.once, seen.twice)

    parts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(lean("line_dedup", run), slices.SCHEMA)
    return slices.folded(parts, bits // 8, np.dtype(np.uint8), 2, _fold, lambda s: s[1])


def _suspects(docs: DataFrame, text: str, twice: np.ndarray, bits: int, min_chars: int) -> DataFrame:
    """docs with rid, n_lines, and key and line numbers of each suspected key."""
    held = docs.sparkSession.sparkContext.broadcast(twice)
    at = docs.columns.index(text)
    found = pa.list_(pa.struct([("digest", pa.binary()), ("lines", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = held.value
        for batch in batches:
            n_lines, each = [np.zeros(0, np.int64)], []
            for b in blocks(batch.column(at)):
                lines = Lines(b, min_chars)
                p, q = places(lines.hashes, bits)
                maybe = np.flatnonzero(marked(bitmap, p) & marked(bitmap, q))
                rows: list[dict[bytes, list[int]]] = [{} for _ in range(b.rows)]
                raw = lines.data.tobytes()
                for row, number, lo, hi in zip(*(x[maybe].tolist() for x in (lines.row, lines.number, lines.starts, lines.ends))):
                    rows[row].setdefault(hashlib.sha256(raw[lo:hi]).digest(), []).append(number)
                each += [[{"digest": k, "lines": v} for k, v in r.items()] for r in rows]
                n_lines.append(lines.per_row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n_lines), pa.int64()), pa.array(each, found)], names=[*batch.schema.names, "n_lines", "found"])

    rows = docs.select(*docs.columns, F.monotonically_increasing_id().alias("rid"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(lean("line_dedup", run), f"{kinds}, n_lines bigint, found array<struct<digest: binary, lines: array<int>>>")


def _cut(docs: DataFrame, text: str, first: str | None, min_docs: int, min_chars: int, bits: int) -> tuple[DataFrame, dict[str, str]]:
    """docs under plain names with their texts cut, n_lines and n_dropped; first names the column that orders documents if one line of a key stays."""
    if bits & (bits - 1) or bits < 8 * slices.SLICE:
        raise ValueError("bits is a power of two of at least 2^20")
    spark = docs.sparkSession
    for_texts(spark)
    plain, at = plain_columns(docs)
    column = at[text]
    twice = seen_twice(plain, column, min_chars, bits)
    kept = write_shared(_suspects(plain, column, twice, bits, min_chars), "lines")
    order = F.struct(F.col(at[first]).alias("o"), F.col("rid").alias("rid")) if first else F.struct(F.col("rid").alias("rid"))
    rows = kept.where(F.size("found") > 0).select("rid", order.alias("o"), F.explode("found").alias("f")).select("rid", "o", "f.digest", "f.lines")
    confirmed = write_shared(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("o").alias("o")).where(F.col("n") >= min_docs).select("digest", "n", F.col("o.rid").alias("head")), "confirmed")
    total = confirmed.agg(F.sum("n")).first()[0] or 0
    rows = rows.drop("o")
    large = F.col("n") * HOT > total
    hot = F.broadcast(confirmed.where(large).select("digest", "head"))
    hits = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(confirmed.where(~large).select("digest", "head"), "digest"))
    gone = F.when(F.col("rid") == F.col("head"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")) if first else F.col("lines")
    drops = hits.select("rid", gone.alias("gone")).where(F.size("gone") > 0).groupBy("rid").agg(F.flatten(F.collect_list("gone")).alias("gone"))

    names = [c for c in plain.columns if c != column]
    kind = ", ".join(f"`{c}` {t}" for c, t in plain.select(names).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = [], []
            for value, gone in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 2).to_pylist()):
                if gone:
                    away = set(gone)
                    value = "\n".join(line for i, line in enumerate(value.split("\n")) if i not in away)
                texts.append(value)
                dropped.append(len(gone or ()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), batch.column(len(names) + 1), pa.array(dropped, pa.int64())], names=[*names, column, "n_lines", "n_dropped"])

    meets = kept.where(F.size("found") > 0).drop("found").join(drops, "rid", "left").select(*names, column, "n_lines", "gone")
    cut = meets.mapInArrow(lean("line_dedup", run), f"{kind}{', ' if kind else ''}`{column}` string, n_lines bigint, n_dropped bigint")
    whole = kept.where(F.size("found") == 0).select(*names, column, "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    return whole.unionByName(cut), at


def deduplicated(docs: DataFrame, text: str = "text", order: str = "doc_id", min_docs: int = 2, min_chars: int = 1, bits: int = FILTER_BITS) -> DataFrame:
    """docs, where of each key of at least min_docs documents only the first line stays, in the first document by order (null first)."""
    cut, at = _cut(docs, text, order, min_docs, min_chars, bits)
    return cut.select(*(F.col(at[c]).alias(c) for c in docs.columns))


def without_shared(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, bits: int = FILTER_BITS) -> DataFrame:
    """docs, where keys of at least min_docs documents lose all their lines."""
    cut, at = _cut(docs, text, None, min_docs, min_chars, bits)
    return cut.select(*(F.col(at[c]).alias(c) for c in docs.columns))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, bits: int = FILTER_BITS) -> DataFrame:
    """Per document, of without_shared: key, n_lines, n_dropped, kept_sha256."""
    cut, at = _cut(docs.select(key, text), text, None, min_docs, min_chars, bits)
    return cut.select(F.col(at[key]).alias(key), "n_lines", "n_dropped", F.sha2(F.coalesce(F.col(at[text]), F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with lines as (
    select doc_id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents)
),
shared as (select key from lines where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(shared.key) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where shared.key is null), '')) as kept_sha256
from lines left join shared using (key) group by doc_id
"""
