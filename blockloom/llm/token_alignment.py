"""Tokens of two tokenizers, aligned by the bytes they cover, with corpus-wide counts of linked ids.

A text is encoded by a byte-level BPE tokenizer (A: a space and the text) and by a piece
tokenizer with byte fallback (B, which adds the space). An A and a B token whose bytes overlap are
joined by an edge; union-find over these edges gives components, which are exactly
the minimal groups: no token crosses a component's ends, and a smaller group would cut one.
Every A token of a group is linked to every B token of it.

A text is cut into chunks before each space that follows a visible character; no token of either
tokenizer crosses such a cut (checked against the vocabulary of B when it is loaded), so a
chunk is encoded and grouped once in a worker while its cache holds it (CACHE_ITEMS). New chunks
of a block are aligned together, in numpy.

Counting: each document's distinct pairs, with how many links they make, are written once. A
pair's count is its number of rows. Pairs that hold more than 1 of HOT of all rows are at most HOT
and are broadcast; the others meet their counts by a shuffle in which no pair is large. Sums go
back to documents by row number.

Cases: null, empty and unfaithful texts (whose joined token bytes differ from a space and the
text, such as texts with U+2581) have no tokens: zeros and ''. Special strings inside a
text are plain text; equal rows are documents of their own; long texts are aligned whole; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import caches, for_texts, lean, write_shared
from .textgrid import SPACE, Block, blocks, span_hashes
from .token_count import byte_alphabet

CACHE_ITEMS = 300_000
CACHE_LINKS = 6_000_000
HOT = 100_000
BLOCK = 2 << 20


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, by union-find over edges u-v: roots are hooked to lower roots, paths halved until flat."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after another."""
    return flat[np.repeat(starts, sizes) + ramp(sizes)]


class Vocabulary:
    """Bytes of ids, flat."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[ids], self.sizes[ids])


class Aligner:
    """Both tokenizers, and what is known of chunks."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: i for i, c in enumerate(byte_alphabet())}
        size_a = self.a.get_vocab_size(with_added_tokens=True)
        names = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.in_a = Vocabulary([bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.in_b = Vocabulary([bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(pieces)])
        if any("▁" in s.lstrip("▁") for s in pieces):
            raise ValueError("a piece goes on after a space: texts can't be cut before spaces")
        self.size_b = len(pieces)
        many = max(size_a, self.size_b)
        #: An id with what follows it: another of its side, the other side, another group, or nothing.
        self.printed = np.array([f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(many)], object)
        self.many = many
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.text: list[str] = []
        self.figures = np.zeros((1024, 7), np.int64)  # n_a, n_b, n_groups, n_links, first pair, pairs, faithful
        self.pairs, self.times, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def learn(self, raw: list[bytes]) -> None:
        """Aligns new chunks, each of which begins with a space."""
        texts = [r.decode("utf-8", "replace") for r in raw]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        good = np.ones(len(raw), bool)
        own_a, own_b = np.repeat(np.arange(len(raw)), n_a), np.repeat(np.arange(len(raw)), n_b)
        for ids, own, vocabulary in ((ids_a, own_a, self.in_a), (ids_b, own_b, self.in_b)):
            good &= np.bincount(own, weights=vocabulary.sizes[ids], minlength=len(raw)).astype(np.int64) == size
        for ids, own, vocabulary in ((ids_a, own_a, self.in_a), (ids_b, own_b, self.in_b)):
            fits = good[own]
            same = vocabulary.joined(ids[fits]) == gather(data, (ends - size)[good], size[good])
            which = np.repeat(np.flatnonzero(good), size[good])
            good[which[~same]] = False
        ids_a, own_a, ids_b, own_b = ids_a[good[own_a]], own_a[good[own_a]], ids_b[good[own_b]], own_b[good[own_b]]

        # an edge for each stretch between neighbouring token ends of either side
        ends_a, ends_b = np.cumsum(self.in_a.sizes[ids_a]), np.cumsum(self.in_b.sizes[ids_b])
        stretch = np.union1d(ends_a, ends_b)
        root = components(np.searchsorted(ends_a, stretch), len(ids_a) + np.searchsorted(ends_b, stretch), len(ids_a) + len(ids_b))
        heads = np.flatnonzero(root[: len(ids_a)] == np.arange(len(ids_a)))  # a component's least node is its first A token
        group_a, group_b = np.searchsorted(heads, root[: len(ids_a)]), np.searchsorted(heads, root[len(ids_a) :])
        own = own_a[heads]
        many_a, many_b = np.bincount(group_a, minlength=len(heads)), np.bincount(group_b, minlength=len(heads))

        # print groups
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids, group, side = np.concatenate([ids_a, ids_b])[order], np.concatenate([group_a, group_b])[order], np.repeat([0, 1], [len(ids_a), len(ids_b)])[order]
        after = np.full(len(ids), 3)
        if len(ids):
            more = group[1:] == group[:-1]
            after[:-1] = np.where(more, np.where(side[1:] == side[:-1], 0, 1), np.where(own[group[1:]] == own[group[:-1]], 2, 3))
        words = self.printed[after * self.many + ids].tolist()
        upto = np.concatenate([[0], np.cumsum(np.bincount(own[group], minlength=len(raw)))]).tolist()
        text = ["".join(words[x:y]) for x, y in zip(upto, upto[1:])]

        # links of a group: its distinct A ids with its distinct B ids
        kinds = []
        for ids, group, many in ((ids_a, group_a, self.many), (ids_b, group_b, self.many)):
            key, times = np.unique(group * many + ids, return_counts=True)
            kinds.append((key // many, key % many, times))
        (ga, a_ids, ta), (gb, b_ids, tb) = kinds
        wide = np.bincount(gb, minlength=len(heads))
        at = np.repeat(np.cumsum(wide) - wide, np.bincount(ga, minlength=len(heads))) if len(ga) else ga
        to = np.repeat(at, wide[ga]) + ramp(wide[ga])
        pairs, times = np.repeat(a_ids, wide[ga]) * self.size_b + b_ids[to], np.repeat(ta, wide[ga]) * tb[to]
        per = np.bincount(own[np.repeat(ga, wide[ga])], minlength=len(raw))

        if self.used + len(pairs) > len(self.pairs):
            room = max(2 * len(self.pairs), self.used + len(pairs))
            self.pairs, self.times = np.resize(self.pairs, room), np.resize(self.times, room)
        self.pairs[self.used : self.used + len(pairs)], self.times[self.used : self.used + len(pairs)] = pairs, times
        lo = len(self.text)
        if lo + len(raw) > len(self.figures):
            self.figures = np.concatenate([self.figures, np.zeros((max(len(self.figures), lo + len(raw)), 7), np.int64)])
        self.figures[lo : lo + len(raw)] = np.stack([
            np.where(good, n_a, 0), np.where(good, n_b, 0), np.bincount(own, minlength=len(raw)),
            np.bincount(own, weights=many_a * many_b, minlength=len(raw)).astype(np.int64), self.used + np.cumsum(per) - per, per, good,
        ], axis=1)
        self.used += len(pairs)
        for i, r in enumerate(raw):
            self.place[r] = lo + i
        self.text += text

    def known(self, chunks: list[bytes]) -> np.ndarray:
        """Where distinct chunks are; those that aren't known are learnt."""
        if len(self.text) + len(chunks) > CACHE_ITEMS or self.used > CACHE_LINKS:
            self.clear()
        place = self.place
        new = [c for c in chunks if c not in place]
        if new:
            self.learn(new)
        return np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))


def cuts(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's texts, each after a space: data, starts and ends of chunks, and their rows. Empty texts have none."""
    size = np.diff(b.offsets)
    full = np.flatnonzero(size)
    # a space before each text that isn't empty
    data = np.insert(b.data, b.offsets[:-1][full], 32)
    heads = b.offsets[:-1][full] + np.arange(len(full))
    space = data == 32
    ok = np.zeros(len(data), bool)
    before = data[:-1]
    # bytes that end a code point that may be white space beyond ASCII
    odd = np.zeros(len(data), bool)
    if len(data) > 1:
        a, z = data[:-1], data[1:]
        odd[1:] = (a == 0xC2) & ((z == 0x85) | (z == 0xA0))
    if len(data) > 2:
        a, z = data[:-2], data[1:-1]
        odd[2:] |= ((a == 0xE1) & (z == 0x9A)) | ((a == 0xE2) & ((z == 0x80) | (z == 0x81))) | ((a == 0xE3) & (z == 0x80))
    ok[1:] = space[1:] & ~SPACE[before] & (before > 32) & (before != 127) & ~odd[:-1]
    # a text's last space stays with the chunk before: alone it would be an empty text to B
    ok[b.offsets[1:][full] + np.arange(len(full))] = False
    ok[heads] = True
    starts = np.flatnonzero(ok)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    return data, starts, ends, full[np.searchsorted(heads, starts, "right") - 1]


_aligners: dict[tuple[str, str], Aligner] = {}
caches["token_alignment"] = _aligners.clear


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def distinct(rows: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of times for each row and pair, sorted by both."""
    key = rows << 42 | pairs
    single = times == 1
    one, n = np.unique(key[single], return_counts=True)
    if not single.all():  # few: links of repeated ids
        many, where = np.unique(key[~single], return_inverse=True)
        sums = np.bincount(where, weights=times[~single]).astype(np.int64)
        at = np.searchsorted(one, many)
        there = (at < len(one)) & (one[np.minimum(at, len(one) - 1)] == many) if len(one) else np.zeros(len(many), bool)
        n = n.copy()
        n[at[there]] += sums[there]
        one, n = np.insert(one, at[~there], many[~there]), np.insert(n, at[~there], sums[~there])
    return one >> 42, one & ((1 << 42) - 1), n


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text", groups: bool = True) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`; if asked for), groups_sha256, pairs (A id * size of B + B id) and times, sorted."""
    for_texts(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(tokenizer_a, tokenizer_b)
        for batch in batches:
            for b in blocks(batch.column(1), BLOCK):
                data, starts, ends, row = cuts(b)
                _, first, where = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                raw = data.tobytes()
                at = both.known([raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())])[where]
                faithful = np.bincount(row, weights=both.figures[at, 6] == 0, minlength=b.rows) == 0
                at, row = at[faithful[row]], row[faithful[row]]
                figures = both.figures[at]
                sums = [np.bincount(row, weights=figures[:, i], minlength=b.rows).astype(np.int64) for i in range(4)]
                upto = np.searchsorted(row, np.arange(b.rows + 1)).tolist()
                words = list(map(both.text.__getitem__, at.tolist()))
                texts = [";".join(words[x:y]) for x, y in zip(upto, upto[1:])]
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                size = figures[:, 5]
                r, pairs, times = distinct(np.repeat(row, size), gather(both.pairs, figures[:, 4], size), gather(both.times, figures[:, 4], size))
                bounds = pa.array(np.searchsorted(r, np.arange(b.rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (pairs, times)]
                head = [batch.column(0).slice(b.lo, b.rows), *(pa.array(s, pa.int64()) for s in sums), pa.array(digests, pa.string()), *lists]
                names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                yield pa.RecordBatch.from_arrays(head + [pa.array(texts, pa.string())] * groups, names=names + ["groups"] * groups)

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>{', groups string' * groups}"
    return rows.mapInArrow(lean("token_alignment", run), schema)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """From aligned(): a_id, b_id, n documents, and whether no B id is linked to the A id in more documents (best)."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a_id", F.expr(f"pair div {size_b}"))
    most = counts.groupBy("a_id").agg(F.max("n").alias("most"))
    return counts.join(most, "a_id").select("a_id", F.expr(f"pair % {size_b}").alias("b_id"), "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def digest(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_b).get_piece_size()
    rows = write_shared(aligned(docs, tokenizer_a, tokenizer_b, key, text, groups=False).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = write_shared(pair_counts(rows, size_b), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * HOT > total
    links = rows.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    hot = F.broadcast(counts.where(large).select("pair", "n", "best"))
    rest = counts.where(~large).select("pair", "n", "best")
    met = [links.join(hot, "pair"), links.join(hot, "pair", "left_anti").join(rest.hint("shuffle_hash"), "pair")]
    sums = [m.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")) for m in met]
    zero = F.lit(0).cast("long")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in rows.select("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").dtypes]
    heads = rows.select("rid", F.lit(True).alias("own"), "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", zero.alias("n_best"), zero.alias("count_sum"))
    for s in sums:
        heads = heads.unionByName(s.select("rid", F.lit(False).alias("own"), *nothing, "n_best", "count_sum"))
    own = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    out = heads.groupBy("rid").agg(own("key"), *(own(c) for c in ("n_a", "n_b", "n_groups", "n_links")), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), own("groups_sha256"))
    return out.drop("rid").withColumnRenamed("key", key)
