"""Phrases whose words stand together more often than chance, by hashed buckets and Apriori pruning.

Texts are lower-cased (A-Z), cut into pieces at [.,;:!?\\x0A-\\x0D], and pieces into words
[^\\x20\\x09]+. Everything is counted for each language (null: `und`).

One pass for each length k. The pass counts exactly those k-grams that can be frequent: both
their (k-1)-grams must be in the Bloom filter of the frequent ones (Apriori), and their bucket must
be full (PCY). While it reads, it adds the (k+1)-grams both of whose k-grams it counts to
BUCKETS buckets (DHP), which decide the next pass. Buckets are counted in an array a task, added up
slice by slice, and come back as a bitmap of BUCKETS bits; the filter of frequent k-grams
has at most 2^27 bits. Both are broadcast and let too much through at worst, so that results
are exact: counts are sums over phrases themselves. (Within one block of texts, k-grams of one language
are told apart by 64-bit hashes.)

Every part of a frequent phrase is frequent, so the counts of the parts come from the same tables.
score(cut) = floor(1000 a n / (l r)) in decimals of 38 digits; the lowest cut counts, the
first on ties. A candidate goes if a longer one holds it and has at least `cover` hundredths of its
count. The first `top` of each language come from the first `top` of SALTS parts of it.

Cases: null and empty texts have no words; phrases don't cross pieces or texts; equal rows all count;
overlapping occurrences all count; long texts and words are used whole; an empty table gives
no rows; other columns don't matter. Per-language totals are broadcast while there are at most LANGS languages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import slices
from .shared import bitmap, drop_shared, filter_bits, for_texts, lean, marked, write_shared
from .textgrid import Block, blocks, mix, span_hashes

BUCKETS = 1 << 23
SALTS = 16
LANGS = 100_000
BLOCK = 4 << 20
SCORE = "(cast(a as decimal(20,0)) * cast(1000 as decimal(4,0)) * cast(total as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP[[9, 32]] = True
_PLACE = np.random.default_rng(7).integers(1, 1 << 63, 64, np.int64).astype(np.uint64) | np.uint64(1)


class Grams:
    """Words of a block of texts, and the hashes of runs of words within a piece."""

    def __init__(self, b: Block, seeds: np.ndarray):
        self.data = _LOWER[b.data]
        breaks = _BREAK[b.data]
        ink = ~(breaks | _GAP[b.data])
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        full = np.diff(b.offsets) > 0
        heads, tails = b.offsets[:-1][full], b.offsets[1:][full] - 1
        first[heads], last[tails] = ink[heads], ink[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(b.offsets, self.starts, "right") - 1
        # grows with each break and each text
        self.piece = np.cumsum(breaks)[self.starts] + self.row
        self.words = span_hashes(self.data, self.starts, self.ends)
        self.seeds = seeds[self.row]

    def hashes(self, k: int) -> np.ndarray:
        """One for each run of k words, whether or not it is within a piece."""
        n = max(0, len(self.words) - k + 1)
        total = self.seeds[:n].copy()
        for j in range(k):
            total += self.words[j : j + n] * _PLACE[j]
        return mix(total)

    def inside(self, k: int) -> np.ndarray:
        n = max(0, len(self.words) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The runs of k words that begin at these words, joined by spaces."""
        word = (at[:, None] + np.arange(k)).ravel()
        size = self.ends[word] - self.starts[word] + 1
        upto = np.cumsum(size)
        out = np.full(int(upto[-1]) if len(upto) else 0, 32, np.uint8)
        body = size - 1
        step = np.arange(int(body.sum())) - np.repeat(np.cumsum(body) - body, body)
        out[np.repeat(upto - size, body) + step] = self.data[np.repeat(self.starts[word], body) + step]
        # the space after a phrase goes
        keep = np.ones(len(out), bool)
        keep[upto[k - 1 :: k] - 1] = False
        offsets = np.concatenate([[0], upto[k - 1 :: k] - np.arange(1, len(at) + 1)])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep])).cast(pa.string())


def seed_of(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _seeds(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    each = np.array([seed_of(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.uint64)


class Filter:
    """Two bits a hash."""

    def __init__(self, held: np.ndarray):
        self.held = held
        self.low = np.uint64(len(held) * 8 - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return marked(self.held, (hashes & self.low).astype(np.int64)) & marked(self.held, ((hashes >> np.uint64(32)) & self.low).astype(np.int64))


def _frequent_filter(frequent: DataFrame, k: int, n: int) -> np.ndarray:
    """The filter of a table of frequent k-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.zeros(0, np.uint64)]
            seeds = _seeds(batch.column(0))
            for b in blocks(batch.column(1)):
                grams = Grams(b, seeds[b.lo : b.hi])
                each.append(grams.hashes(k)[grams.inside(k)])  # one a text
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64), pa.int64())], names=["h"])

    bits = filter_bits(n)
    hashes = frequent.select("lang", "phrase").mapInArrow(lean("phrases", run), "h bigint")
    at = [F.col("h").bitwiseAND(F.lit(bits - 1)) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1)) + 1]
    return bitmap(hashes, at, bits)


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) & np.uint64(n - 1)).astype(np.int64)


def _pass(texts: DataFrame, k: int, least: int, last: bool, parts: np.ndarray | None, full: np.ndarray | None, n: int) -> DataFrame:
    """Counts of k-grams that may be frequent, and slices of the buckets of (k+1)-grams."""
    kind = np.dtype(np.uint8 if least <= 255 else np.uint32)
    context = texts.sparkSession.sparkContext
    parts_held, full_held = context.broadcast(parts), context.broadcast(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apriori = Filter(parts_held.value) if k > 1 else None
        bucket = full_held.value
        counts = None if last else np.zeros(n, np.uint32)
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), *slices.ARROW])
        for batch in batches:
            langs, seeds = batch.column(0), _seeds(batch.column(0))
            for b in blocks(batch.column(1), BLOCK):
                grams = Grams(b, seeds[b.lo : b.hi])
                mine = grams.hashes(k)
                ok = grams.inside(k)
                if k > 1:
                    known = apriori(grams.hashes(k - 1))
                    ok &= known[:-1][: len(ok)] & known[1:][: len(ok)]
                    some = np.flatnonzero(ok)
                    ok[some] = marked(bucket, _buckets(mine[some], n))
                some = np.flatnonzero(ok)
                _, first, times = np.unique(mine[some], return_index=True, return_counts=True)
                at = some[first]
                if len(at):
                    nothing = [pa.nulls(len(at), f.type) for f in slices.ARROW]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(b.lo + grams.row[at])), grams.phrases(at, k), pa.array(times, pa.int64()), *nothing], schema=schema)
                if counts is not None and len(ok) > 1:
                    both = np.flatnonzero(ok[:-1] & ok[1:] & grams.inside(k + 1))
                    np.add.at(counts, _buckets(grams.hashes(k + 1)[both], n), np.uint32(1))
        if counts is not None:
            for part in slices.cut(np.minimum(counts, least).astype(kind)):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.int64()), *part.columns], schema=schema)

    return texts.mapInArrow(lean("phrases", run), f"lang string, phrase string, n bigint, {slices.SCHEMA}")


def _full(rows: DataFrame, least: int, n: int) -> np.ndarray:
    """The bitmap of buckets that hold at least `least`; counts stop there, so they never overflow."""
    kind = np.dtype(np.uint8 if least <= 255 else np.uint32)

    def fold(state: np.ndarray, at: np.ndarray | slice, x: np.ndarray, y: np.ndarray) -> None:
        state[0, at] += np.minimum(x, kind.type(least) - state[0, at])

    parts = rows.where(F.col("slice").isNotNull()).select("slice", "at", "x", "y")
    return slices.folded(parts, n, kind, 1, fold, lambda s: np.packbits(s[0] >= least, bitorder="little"))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, buckets: int = BUCKETS) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, n) of the k-grams found at least `least` times, for k = 1 .. longest, and (lang, n) of all words."""
    if buckets & (buckets - 1) or buckets < slices.SLICE:
        raise ValueError("buckets is a power of two of at least 2^17")
    for_texts(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    tables, words, parts, full = [], None, None, None
    for k in range(1, longest + 1):
        rows = write_shared(_pass(texts, k, least, k == longest, parts, full, buckets), f"grams-{k}")
        found = rows.where(F.col("slice").isNull())
        tables.append(write_shared(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"frequent-{k}"))
        if k == 1:
            words = write_shared(found.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        n = tables[-1].count() if k < longest else 0
        if n:
            full, parts = _full(rows, least, buckets), _frequent_filter(tables[-1], k, n)
        drop_shared(rows)
        if not n:
            break
    return tables, words


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, cover: int = 100, top: int | None = 2000, buckets: int = BUCKETS) -> DataFrame:
    """Per language the first `top` phrases (None: all, without rank): lang, rank, phrase, a, l, r, n, score."""
    tables, words = frequent(docs, text, lang, least, longest, buckets)
    spark = docs.sparkSession
    counts = tables[0]
    for t in tables[1:]:
        counts = counts.unionByName(t)
    many = [t.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k")) for k, t in enumerate(tables, 1) if k > 1]
    if not many:
        many = [spark.createDataFrame([], "lang string, phrase string, a bigint, k int")]
    candidates = many[0]
    for t in many[1:]:
        candidates = candidates.unionByName(t)

    def run_of(first: F.Column, length: F.Column) -> F.Column:
        return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")

    # parts of longer candidates, with the highest count of a longer one
    inner = candidates.where("k > 2").select("*", F.explode(F.expr("sequence(2, k - 1)")).alias("m")).select("*", F.explode(F.expr("sequence(1, k - m + 1)")).alias("i"))
    longer = inner.select("lang", run_of(F.col("i"), F.col("m")).alias("phrase"), F.col("a").alias("other")).groupBy("lang", "phrase").agg(F.max("other").alias("other"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("other").isNull() | (F.col("other") * 100 < F.col("a") * F.lit(cover))).drop("other")

    cuts = left.select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("*", run_of(F.lit(1), F.col("cut")).alias("head"), run_of(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    totals = words.select("lang", F.col("n").alias("total"))
    cuts = cuts.join(F.broadcast(totals) if words.count() <= LANGS else totals, "lang")
    scored = cuts.select("lang", "phrase", "a", "cut", "l", "r", F.col("total").alias("n"), F.expr(SCORE).alias("score"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    out = lowest.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
    if top is None:
        return out
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = out.select("*", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
grams as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase from words, unnest([1, 2, 3, 4, 5]) as s(k), unnest(range(1, len(ws) - k + 2)) as t(i)),
counts as (select lang, k, phrase, count(*) as n from grams group by all having count(*) >= 100),
totals as (select lang, count(*) as n from grams where k = 1 group by lang),
candidates as (select lang, k, phrase, n as a from counts where k > 1),
covered as (
    select distinct c.lang, c.phrase from candidates c join candidates d on c.lang = d.lang and c.k < d.k and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') and 100 * d.a >= 100 * c.a
),
cuts as (
    select c.lang, c.phrase, c.a, j, array_to_string(string_split(c.phrase, ' ')[1 : j], ' ') as head, array_to_string(string_split(c.phrase, ' ')[j + 1 : c.k], ' ') as tail
    from candidates c, unnest(range(1, c.k)) as u(j) where (c.lang, c.phrase) not in (select (lang, phrase) from covered)
),
scored as (
    select cuts.lang, cuts.phrase, a, j, l.n as l, r.n as r, totals.n as n, (1000::hugeint * a::hugeint * totals.n::hugeint) // (l.n::hugeint * r.n::hugeint) as score
    from cuts join counts l on l.lang = cuts.lang and l.phrase = cuts.head join counts r on r.lang = cuts.lang and r.phrase = cuts.tail join totals on totals.lang = cuts.lang
),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000
"""
