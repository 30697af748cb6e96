"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

Weights. Shingles are SHINGLE_WORDS words. A shingle that occurs n times in a text weighs
(1 + ln n) * idf. With df texts of N holding it, idf = LOW + (1 - LOW) * ln(N / df) / ln(N / f),
1 at most, where f = FREQUENT * (the sum of all df): a log idf, clipped where a shingle is
rare. The floor LOW lets a group of copies that holds a third of all rows still be alike by
weight: boilerplate loses weight, copies don't lose each other. At most 1 / FREQUENT
shingles have df >= f, whatever the corpus. To find them, runs of texts name the shingles
that reach that share of the run (one that reaches it in the corpus does so in some run),
a bitmap of the names goes to all tasks, and a second pass counts what it lets through,
exactly. So the weights are a function of the texts, not of how they are dealt.

Sampling. Improved consistent weighted sampling: per sample and shingle r, c ~ Gamma(2, 1)
and b ~ U(0, 1) come from a table by hash; t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r; the shingle with least a and its t are the sample. Two texts
agree in a sample with a chance equal to their weighted Jaccard similarity. Weight 1 has
t = 0, so its ln a is a table of its own.

Banding. BANDS bands of ROWS samples: a pair of similarity 0.8 meets in some band but
but for a chance of 3e-6. A bucket is ordered by the samples of the next two bands, so that
texts that agree in more samples stand together; each text is first compared with the bucket's
first and the one before it, in buckets of up to NEAR + 2 also with the NEAR before it, which
compares those in full. Buckets above SALT_ROWS are dealt into salted parts of about that
size for that, and the parts' first are compared with the bucket's. Pairs whose samples agree
too rarely for 0.8 (5 standard deviations) go.

The rest. What these links tie together is one component. In larger buckets that still hold
several components no pair is left to chance: the shingles of their texts are put in one
order (the rarest among these texts first), and a text names those before which at most
1 - 0.8 of its weight lies. Two texts of similarity t have a first common shingle in that
order, and from there on both have a weight of at least t / (1 + t) of the sum of both
weights; pairs for which no named shingle allows that are below 0.8, for sure. A shingle's
texts are cut into blocks of about BLOCK, and all blocks meet. Of the pairs that are left,
first one of each two components is verified, then, between those that this did not tie,
all others. Later links only join components, so they are followed over components.

Verification. Both texts are fetched and their weighted Jaccard similarity is computed.

Classes are the connected components over verified pairs and equal texts, found by
label propagation with pointer jumping over tables; nothing of it comes to the driver.

Cases: equal texts share a class, also if shorter than SHINGLE_WORDS words, which have
no shingles and no other links; null text is a class of its own; repeated rows fall into
one class; of equal similarity all links count; long texts are taken whole; an empty table
gives no rows; other columns don't matter, and deduplicated() returns them as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bitmap, drop_shared, filter_bits, for_texts, key_filter, lean, marked, write_shared
from .textgrid import SHINGLE_WORDS, Block, blocks, duplicated, mix

SIMILARITY = 0.8
BANDS, ROWS = 24, 4
SAMPLES = BANDS * ROWS
NEAR = 2
SALT_ROWS = 1000
BLOCK = 1000
#: Samples of SAMPLES in which a pair of SIMILARITY agrees but for 5 standard deviations.
AGREE = int(SAMPLES * SIMILARITY - 5 * (SAMPLES * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
FREQUENT, LOW = 1e-5, 0.75
#: Shingles of a run, in which frequent ones are named, and bytes of text that a task should have for that: small partitions are put together.
RUN, RUN_BYTES = 2_000_000, 8 << 20
SEED = 7919

_TABLE_BITS = 16
_rng = np.random.default_rng(SEED)
_R = _rng.gamma(2.0, 1.0, 1 << _TABLE_BITS)
_LN_C = np.log(_rng.gamma(2.0, 1.0, 1 << _TABLE_BITS))
_B = _rng.random(1 << _TABLE_BITS)
_SPREAD = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_MAX = np.uint64(2**64 - 1)
_LOW32 = np.uint64(0xFFFFFFFF)


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 order as the upper half of unsigned 64-bit integers."""
    bits = x.astype(np.float32).view(np.uint32)
    return (bits ^ np.where(bits >> 31, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))).astype(np.uint64) << np.uint64(32)


def _ln_a(at: np.ndarray, t: np.ndarray | float) -> np.ndarray:
    return _LN_C[at] - _R[at] * (t - _B[at]) - _R[at]


_UNIT = _ordered(_ln_a(np.arange(1 << _TABLE_BITS), 0.0))


def shingles(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of a block, rows ascending."""
    b.find_words()
    h, at = b.windows(b.word_hashes(), SHINGLE_WORDS)
    return h, b.word_row[at]


class Weights:
    """idf of frequent shingles; of all others it is 1."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], idf[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h))
        if len(self.hashes):
            at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            if len(at):
                near = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                same = self.hashes[near] == h[at]
                out[at[same]] = self.idf[near[same]]
        return out

    def weighted(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of one text, and their weights."""
        u, n = np.unique(h, return_counts=True)
        return u, (1 + np.log(n)) * self.of(u)


def _least(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.full(len(bounds) - 1, _MAX)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.minimum.reduceat(values, bounds[:-1][full])
    return out


def signatures(h: np.ndarray, row: np.ndarray, rows: int, weights: Weights) -> np.ndarray:
    """SAMPLES samples of each text, rows x SAMPLES; without shingles all ones."""
    special = duplicated(mix(h ^ mix(row.astype(np.uint64) + np.uint64(31))))
    idf = weights.of(h)
    special |= idf != 1
    plain_h, plain_bounds = h[~special], np.searchsorted(row[~special], np.arange(rows + 1))
    plain_low = plain_h & _LOW32
    # shingles with other weights, each once per text
    sh, sr, sw = h[special], row[special], idf[special]
    if len(sh):
        order = np.lexsort((sh, sr))
        sh, sr, sw = sh[order], sr[order], sw[order]
        head = np.flatnonzero(np.concatenate([[True], (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])]))
        count = np.diff(np.append(head, len(sh)))
        sh, sr, sw = sh[head], sr[head], np.log((1 + np.log(count)) * sw[head])
    special_bounds = np.searchsorted(sr, np.arange(rows + 1))
    out = np.empty((rows, SAMPLES), np.uint64)
    shift = np.uint64(64 - _TABLE_BITS)
    for k in range(SAMPLES):
        value = _UNIT[(plain_h * _SPREAD[k]) >> shift]
        value |= plain_low
        least = _least(value, plain_bounds)
        if len(sh):
            at = ((sh * _SPREAD[k]) >> shift).astype(np.int64)
            t = np.floor(sw / _R[at] + _B[at])
            low = np.where(t == 0, sh, mix(sh + t.astype(np.int64).view(np.uint64) * np.uint64(0x9FB21C651E98DF25))) & _LOW32
            least = np.minimum(least, _least(_ordered(_ln_a(at, t)) | low, special_bounds))
        out[:, k] = least
    return out


def _runs(texts: DataFrame, size: int, pick, names: list[str]) -> DataFrame:
    """A row for each shingle that pick(hashes, counts, sum of counts) takes from a run of about size shingles, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def report() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            columns = pick(h[head], np.diff(np.append(head, len(h))), len(h))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in batches:
            for b in blocks(batch.column(0)):
                h, row = shingles(b)
                if len(h):
                    order = np.lexsort((h, row))
                    h, row = h[order], row[order]
                    held.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])])
                    total += len(held[-1])
                if total >= size:
                    yield report()
                    held, total = [], 0
        if held:
            yield report()

    return texts.mapInArrow(lean("near_dup", run), ", ".join(f"{n} bigint" for n in names))


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a bitmap keeps shingles, from 0."""
    return [(h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)]


def corpus_weights(docs: DataFrame, text: str = "text") -> Weights:
    """idf of the frequent shingles, at most 1 / FREQUENT of them."""
    spark = docs.sparkSession
    for_texts(spark)
    texts = docs.select(F.col(text).alias("text"))
    count, volume = texts.agg(F.count("text"), F.sum(F.octet_length("text"))).first()
    texts = texts.coalesce(max(spark.sparkContext.defaultParallelism, -(-(volume or 0) // RUN_BYTES)))

    def named(h: np.ndarray, n: np.ndarray, total: int) -> list[np.ndarray]:
        often = n >= FREQUENT * total
        # the first row tells the sum, as shingle null
        return [pa.array(np.concatenate([[0], h[often].view(np.int64)]), mask=np.arange(often.sum() + 1) == 0), np.concatenate([[total], n[often]])]

    names = write_shared(_runs(texts, RUN, named, ["h", "n"]), "named")
    total = names.where("h is null").agg(F.sum("n")).first()[0]
    if not total:
        drop_shared(names)
        return Weights(np.zeros(0, np.uint64), np.zeros(0))
    found = names.where("h is not null")
    bits = filter_bits(found.count())
    # the same places as _places
    at = [F.col("h").bitwiseAND(F.lit(bits - 1)) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1)) + 1]
    shared = spark.sparkContext.broadcast(bitmap(found, at, bits))
    drop_shared(names)

    def counted(h: np.ndarray, n: np.ndarray, _: int) -> list[np.ndarray]:
        p, q = _places(h, bits)
        keep = marked(shared.value, p) & marked(shared.value, q)
        return [h[keep].view(np.int64), n[keep]]

    least = max(1.0, FREQUENT * total)
    often = _runs(texts, RUN, counted, ["h", "n"]).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    shared.unpersist()
    h, n = often["h"].to_numpy().view(np.uint64), often["n"].to_numpy()
    return Weights(h, idf(n, count, least))


def idf(n: np.ndarray, texts: int, least: float) -> np.ndarray:
    """Of shingles in n of texts, where those in fewer than least have 1."""
    return LOW + (1 - LOW) * np.log(np.maximum(texts / n, 1)) / np.log(texts / least) if texts > least else np.ones(len(n))


def _signed(docs: DataFrame, weights: Broadcast) -> DataFrame:
    """tk, bands, packs: per text with shingles, BANDS band hashes, and its samples as 16-bit lanes of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = np.arange(ROWS, dtype=np.uint64) * np.uint64(16)
        factor = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, row = shingles(b)
                have = np.unique(row)
                if not len(have):
                    continue
                s = signatures(h, np.searchsorted(have, row), len(have), weights.value)
                s = mix(s)
                bands = mix((s * factor).reshape(-1, BANDS, ROWS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                packs = ((s & np.uint64(0xFFFF)).reshape(-1, BANDS, ROWS) << lane).sum(2, dtype=np.uint64)
                at = pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32))
                columns = [batch.column(0).take(pa.array(b.lo + have))]
                columns += [pa.ListArray.from_arrays(at, pa.array(x.view(np.int64).ravel())) for x in (bands, packs)]
                yield pa.RecordBatch.from_arrays(columns, names=["tk", "bands", "packs"])

    return docs.select("tk", "text").mapInArrow(lean("near_dup", run), "tk binary, bands array<bigint>, packs array<bigint>")


def _agree(p: Column, q: Column) -> Column:
    """In how many samples two texts' packs agree."""
    lanes = lambda x: sum((F.when(F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0) for k in range(ROWS)), F.lit(0))
    return F.aggregate(F.zip_with(p, q, lambda x, y: lanes(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _candidates(signed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of text ids that stand near each other in some bucket and agree in AGREE samples."""
    rows = signed.select("id", F.posexplode("bands").alias("pos", "bucket"))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1")
    sums = write_shared(sums, "buckets")
    # a bucket of two is a pair; only the members of larger ones are looked up
    large = rows.join(sums.where("n > 2").select("bucket", "n", F.col("a").alias("first")), "bucket")
    order = [F.col("packs")[(F.col("pos") + k) % BANDS] for k in (1, 2)]
    large = large.join(signed.select("id", "packs"), "id").select("bucket", "n", "first", "id", "packs", order[0].alias("o1"), order[1].alias("o2"))
    large = large.withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SALT_ROWS)))
    turn = Window.partitionBy("bucket", "salt").orderBy("o1", "o2", "id")
    # texts stand here with their packs, so no join is needed to compare those that are near
    one = F.struct("id", "packs")
    few = F.col("n") <= NEAR + 2
    near = [F.lag(one, 1).over(turn), *(F.when(few, F.lag(one, k).over(turn)) for k in range(2, NEAR + 1)), F.first(one).over(turn)]
    large = large.select("id", "packs", "first", F.array(*near).alias("near"))
    large = large.withColumn("other", F.explode(F.filter("near", lambda x: x.isNotNull() & (x["id"] != F.col("id"))))).where(_agree(F.col("packs"), F.col("other.packs")) >= AGREE)
    found = large.select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b"))
    # the bucket's first ties its salted parts together
    dealt = rows.join(sums.where(F.col("n") > SALT_ROWS).select("bucket", "n", F.col("a").alias("first")), "bucket")
    heads = dealt.groupBy("bucket", "first", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SALT_ROWS))).agg(F.min("id").alias("id")).where("id <> first")
    far = sums.where("n = 2").select("a", "b").unionByName(heads.select(F.col("first").alias("a"), F.col("id").alias("b"))).distinct()
    packs = signed.select("id", "packs")
    joined = far.join(packs.select(F.col("id").alias("a"), F.col("packs").alias("pa")), "a").join(packs.select(F.col("id").alias("b"), F.col("packs").alias("pb")), "b")
    return joined.where(_agree(F.col("pa"), F.col("pb")) >= AGREE).select("a", "b").unionByName(found).distinct()


def _loose(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """id, tk, root of the texts of larger buckets that labels (node, root) doesn't tie together."""
    rooted = signed.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "tk", F.coalesce("root", "id").alias("root"), "bands")
    rooted = write_shared(rooted, "rooted")
    rows = rooted.select("id", "root", F.explode("bands").alias("bucket"))
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = write_shared(mixed.where((F.col("n") > NEAR + 2) & (F.col("lo") < F.col("hi"))).select("bucket"), "mixed")
    ids = write_shared(rows.join(mixed, "bucket").select("id").distinct(), "ids")
    loose = write_shared(rooted.select("id", "tk", "root").join(ids, "id"), "loose")
    drop_shared(rooted, mixed, ids)
    return loose


def _postings(texts: DataFrame, weights: Broadcast) -> DataFrame:
    """s, id, root, rest, total: each text (id, text, root) under the shingles with at most 1 - SIMILARITY of its weight before them."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                h, row = shingles(b)
                at = np.searchsorted(row, np.arange(b.rows + 1))
                parts = [weights.value.weighted(h[at[i] : at[i + 1]]) for i in range(b.rows)]
                n = np.array([len(u) for u, _ in parts])
                if not n.sum():
                    continue
                u, w = (np.concatenate(x) for x in zip(*parts))
                # a lower idf stands for a higher frequency; 0 for shingles that are not frequent
                often = 1 - weights.value.of(u)
                total = np.repeat([p.sum() for _, p in parts], n)
                ids, root = (np.repeat(batch.column(k).to_numpy()[b.lo : b.hi], n) for k in (0, 1))
                columns = [u.view(np.int64), ids, root, w, total, often]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s", "id", "root", "w", "total", "often"])

    rows = texts.select("id", "root", "text").mapInArrow(lean("near_dup", weigh), "s bigint, id bigint, root bigint, w double, total double, often double")
    rows = write_shared(rows, "shingles")
    # frequent shingles come last in the order, by their frequency everywhere; only others are counted here, so no count is of a hot key
    rare = rows.where("often = 0").withColumn("df", F.count("*").over(Window.partitionBy("s")))
    every = rare.unionByName(rows.where("often > 0").withColumn("df", F.lit(None).cast("bigint")))
    turn = Window.partitionBy("id").orderBy("often", "df", "s").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("rest", F.col("total") - F.coalesce(F.sum("w").over(turn), F.lit(0.0)))
    out = every.where((F.col("rest") >= F.col("total") * SIMILARITY - 1e-6) & ((F.col("df") > 1) | F.col("df").isNull()))
    out = write_shared(out.select("s", "id", "root", "rest", "total"), "postings")
    drop_shared(rows)
    return out


def possible(root: np.ndarray, rest: np.ndarray, total: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (of x, of y) of all pairs of different roots that may reach SIMILARITY with this as their first common shingle, and the room they have."""
    room = np.minimum(rest[x][:, None], rest[y][None, :]) - SIMILARITY / (1 + SIMILARITY) * (total[x][:, None] + total[y][None, :])
    i, j = np.nonzero((room >= -1e-6) & (root[x][:, None] != root[y][None, :]))
    return x[i], y[j], room[i, j]


def _rest(postings: DataFrame) -> DataFrame:
    """a, b, ra, rb, room: pairs of different roots (ra < rb) that no bound excludes; a pair may come repeatedly."""
    groups = postings.groupBy("s").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    groups = write_shared(groups.select("s", F.ceil(F.col("n") / BLOCK).alias("parts")), "groups")
    members = postings.join(groups, "s").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    meets = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    meets = meets.select("s", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "id", "root", "rest", "total")
    dealt = meets.repartition("s", "x", "y").sortWithinPartitions("s", "x", "y")

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        part, ids, root, rest, total = (rows[c].to_numpy() for c in ("part", "id", "root", "rest", "total"))
        group = np.stack([rows[c].to_numpy() for c in ("s", "x", "y")], 1)
        heads = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
        found = []
        for lo, hi in zip(heads, np.append(heads[1:], len(group))):
            at = np.arange(lo, hi)
            first = part[lo:hi] == group[lo, 1]
            inside = group[lo, 1] == group[lo, 2]
            i, j, room = possible(root, rest, total, at, at) if inside else possible(root, rest, total, at[first], at[~first])
            if inside:
                once = i < j
                i, j, room = i[once], j[once], room[once]
            found.append((i, j, room))
        i, j, room = (np.concatenate(x) for x in zip(*found))
        turn = root[i] > root[j]
        i, j = np.where(turn, j, i), np.where(turn, i, j)
        columns = [np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), root[i], root[j], room]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "ra", "rb", "room"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            # the last group may go on in the next batch
            last = [held[c][-1].as_py() for c in ("s", "x", "y")]
            same = np.logical_and.reduce([held[c].to_numpy() == v for c, v in zip(("s", "x", "y"), last)])
            whole = int(np.argmax(same))
            if whole:
                yield from pairs(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from pairs(held)

    return dealt.mapInArrow(lean("near_dup", run), "a bigint, b bigint, ra bigint, rb bigint, room double")


def similarity(x: np.ndarray, y: np.ndarray, weights: Weights) -> float:
    """Weighted Jaccard similarity of two texts' shingle hashes."""
    (u, p), (v, q) = weights.weighted(x), weights.weighted(y)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    least = np.minimum(p[i], q[j]).sum()
    return float(least / (p.sum() + q.sum() - least)) if len(u) and len(v) else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, weights: Broadcast) -> DataFrame:
    """a, b of pairs that are alike."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def hashes(column: pa.Array) -> list[np.ndarray]:
        out = []
        for b in blocks(column):
            h, row = shingles(b)
            at = np.searchsorted(row, np.arange(b.rows + 1))
            out += [h[at[i] : at[i + 1]] for i in range(b.rows)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(x, y, weights.value) >= SIMILARITY - 1e-9 for x, y in zip(hashes(batch.column(2)), hashes(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.select("a", "b", "ta", "tb").mapInArrow(lean("near_dup", run), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b): the least node that it is connected with."""
    both = write_shared(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    held = write_shared(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    labels = held
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("root").alias("around"))
        heard = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("around").alias("around"))
        told = labels.join(heard, "node").select("node", "root", F.least("root", "around").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("root").alias("above"))
        told = write_shared(told.join(jump, "lower").select("node", "root", F.least("lower", "above").alias("next")), "labels")
        drop_shared(held)
        held, changed = told, told.where("root <> next").limit(1).count()
        labels = told.select("node", F.col("next").alias("root"))
        if not changed:
            drop_shared(both)
            return labels


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels (node, root) after more links (a, b), which may have nodes of their own."""
    new = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = write_shared(labels.unionByName(new.select("node", F.col("node").alias("root"))), "labels")
    of = lambda c: every.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = more.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    now = components(between).select(F.col("node").alias("root"), F.col("root").alias("now"))
    return every.join(now, "root", "left").select("node", F.coalesce("now", "root").alias("root"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tk (digest of the text) and class_id (the least key of the class) of each row; a null text is a class of its own."""
    spark = docs.sparkSession
    for_texts(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("tk"))
    bodies = rows.where("text is not null").select("tk", "text")
    weights = spark.sparkContext.broadcast(corpus_weights(bodies))
    # ids are fixed by writing them; equal texts have one
    signed = _signed(bodies, weights).groupBy("tk").agg(F.first("bands").alias("bands"), F.first("packs").alias("packs"))
    signed = write_shared(signed.withColumn("id", F.monotonically_increasing_id()), "signed")
    pairs = write_shared(_candidates(signed), "pairs")

    def texts_of(keys: DataFrame) -> DataFrame:
        """keys (id, tk, ..) with their texts, each once."""
        found = bodies.where(key_filter(keys, "tk")(F.col("tk"))).join(keys, "tk").dropDuplicates(["id"]).drop("tk")
        return write_shared(found, "texts")

    def alike(pairs: DataFrame) -> DataFrame:
        keys = write_shared(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(signed.select("id", "tk"), "id"), "keys")
        texts = texts_of(keys)
        out = write_shared(_verified(pairs, texts, weights), "alike")
        drop_shared(keys, texts)
        return out

    labels = components(alike(pairs))
    loose = _loose(signed, labels)
    if not loose.isEmpty():
        texts = texts_of(loose)
        postings = _postings(texts, weights)
        # one pair of each two components, that with the most room, may tie them
        tied = _rest(postings).join(pairs, ["a", "b"], "left_anti").groupBy("ra", "rb").agg(F.max_by(F.struct("a", "b"), F.struct("room", "a", "b")).alias("p")).select("p.a", "p.b")
        tried = write_shared(tied, "tied")
        more = alike(tried)
        if not more.isEmpty():
            labels = write_shared(merged(labels, more), "roots")
            now = labels.select(F.col("node").alias("id"), F.col("root").alias("now"))
            postings = write_shared(postings.join(now, "id", "left").withColumn("root", F.coalesce("now", "root")).drop("now"), "postings")
        left = _rest(postings).select("a", "b").distinct().join(pairs.unionByName(tried), ["a", "b"], "left_anti")
        left = write_shared(left, "left")
        more = alike(left)
        labels = merged(labels, more) if not more.isEmpty() else labels
        drop_shared(texts, postings, tried, left)
    found = labels.join(signed.select("id", "tk"), F.col("node") == F.col("id")).select("tk", "root")
    # texts without links are classes of their own: theirs is the class of their digest
    narrow = rows.select("key", "tk").join(found, "tk", "left")
    joined = narrow.select("key", "tk", F.when(F.col("root").isNotNull(), F.concat(F.lit("c"), F.col("root").cast("string"))).otherwise(F.hex("tk")).alias("root"))
    joined = write_shared(joined, "members")
    # written, so that a large class can be split in the join
    lowest = write_shared(joined.where("root is not null").groupBy("root").agg(F.min("key").alias("class_id")), "lowest")
    # null texts are kept out of the join
    alone = joined.where("root is null").select(F.col("key").alias(key), "tk", F.col("key").alias("class_id"))
    together = joined.where("root is not null").join(lowest, "root").select(F.col("key").alias(key), "tk", "class_id")
    return together.unionByName(alone)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that with the least key, with its own columns."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    found = write_shared(classes(plain, k, t), "classes")
    own = F.unhex(F.md5(F.col(t).cast("binary")))
    # a class's row may occur again, or its key with an equal class's other text
    kept = found.where(F.col("tk").isNotNull() & F.col(k).eqNullSafe(F.col("class_id")))
    again = kept.groupBy("class_id").agg(F.count("*").alias("n"), F.min("tk").alias("least")).where("n > 1")
    again = write_shared(again, "again")
    gone = found.where(F.col("tk").isNotNull() & ~F.col(k).eqNullSafe(F.col("class_id"))).select(F.col(k).alias("_k"), F.col("tk").alias("_t")).distinct()
    rows = plain.withColumn("_tk", own)
    # only rows that may have to go are dealt out for the exact anti join
    gone = write_shared(gone, "gone")
    maybe = F.coalesce(key_filter(gone.select(F.xxhash64("_k", "_t").alias("_h")), "_h")(F.xxhash64(F.col(k), F.col("_tk"))), F.lit(True))
    rows = rows.withColumn("_maybe", maybe)
    left = rows.where("_maybe").join(gone, (F.col(k) == F.col("_k")) & (F.col("_tk") == F.col("_t")), "left_anti").unionByName(rows.where("not _maybe")).drop("_maybe")
    if not again.isEmpty():
        twice = again.select(F.col("class_id").alias("_c"), F.col("least").alias("_l"))
        once = left.join(twice, (F.col(k) == F.col("_c")) & (F.col("_tk") == F.col("_l"))).dropDuplicates([k, "_tk"]).drop("_c", "_l")
        left = left.where(F.col("_tk").isNotNull()).join(twice, F.col(k) == F.col("_c"), "left_anti").unionByName(once).unionByName(left.where(F.col("_tk").isNull()))
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
