"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a piece form a doubly linked list; adjacent pairs that have a rank wait
in a heap. The lowest rank, leftmost on ties, is popped and merged until no pair is
left. A piece counts its initial symbols minus its merges; ids are never built.

Texts are cut at ASCII white space, which no piece crosses, and each distinct word is
merged once in a worker (its cache is cleared at CACHE words). Counts of repeated
words come from that cache, so whole texts are counted at the cost of distinct words.

Cases: null text counts as empty and has 0 tokens; special strings inside a text are
one token each, as the tokenizer file's library has it; repeated rows each count; long texts
are counted whole, however long a word; an empty table gives no rows; other columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import caches, for_texts, lean
from .textgrid import blocks

CACHE = 600_000
LIMIT = 2048


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if visible, else the next free code point from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class PairMerger:
    """Counts tokens as a tokenizer file of kind BPE with word ends does."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"not a BPE tokenizer: {model['type']}")
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = [vocab.get(c, -1) for c in alphabet]
        self.last = [vocab.get(c + end, -1) for c in alphabet]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        split = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(split[0])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[int, int] = {}
        self.sizes: dict[str, int] = {}

    def merged(self, raw: bytes) -> int:
        """Tokens of one piece."""
        ids = [self.inner[b] for b in raw]
        if not ids:
            return 0
        ids[-1] = self.last[raw[-1]]
        ids = [i for i in ids if i >= 0]
        n = len(ids)
        if n < 2:
            return n
        merges = self.merges
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = [(found[0], at, found[1], ids[at], ids[at + 1]) for at in range(n - 1) if (found := merges.get(ids[at] << 20 | ids[at + 1]))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, at, new, a, b = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] != a or nxt < 0 or ids[nxt] != b:
                continue  # one of the two has been merged since
            ids[at], ids[nxt] = new, -1
            after[at] = follow = after[nxt]
            left -= 1
            if follow >= 0:
                before[follow] = at
                if found := merges.get(new << 20 | ids[follow]):
                    heapq.heappush(heap, (found[0], at, found[1], new, ids[follow]))
            if (prior := before[at]) >= 0 and (found := merges.get(ids[prior] << 20 | new)):
                heapq.heappush(heap, (found[0], prior, found[1], ids[prior], new))
        return left

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        else:
            text = text.lower()
        total = 0
        for piece in self.pieces.findall(text):
            size = self.sizes.get(piece)
            if size is None:
                if len(self.sizes) >= CACHE:
                    self.sizes.clear()
                self.sizes[piece] = size = self.merged(piece.encode())
            total += size
        return total

    def count(self, text: str) -> int:
        """Tokens of any text."""
        if self.special is None or "<" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def count_column(self, column: pa.Array) -> np.ndarray:
        out = []
        for b in blocks(column):
            b.find_words()
            words, first, where = np.unique(b.word_hashes(), return_index=True, return_inverse=True)
            known = self.known
            if len(known) > CACHE:
                known.clear()
            sizes = [known.get(h, -1) for h in words.tolist()]
            data = b.data
            for i, size in enumerate(sizes):
                if size < 0:
                    at = first[i]
                    sizes[i] = known[int(words[i])] = self.count(data[b.starts[at] : b.ends[at]].tobytes().decode("utf-8", "replace"))
            each = np.array(sizes, np.int64)[where] if len(sizes) else np.zeros(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(each)])
            out.append(upto[b.word_bounds[1:]] - upto[b.word_bounds[:-1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_mergers: dict[str, PairMerger] = {}
caches["token_count"] = _mergers.clear


def merger(path: str) -> PairMerger:
    """One per worker process."""
    if path not in _mergers:
        _mergers[path] = PairMerger(path)
    return _mergers[path]


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit. tokenizer: path of the file, readable on every executor."""
    for_texts(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count.count_column(batch.column(2)), pa.int64())], names=["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    counted = rows.mapInArrow(lean("token_count", run), f"key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
