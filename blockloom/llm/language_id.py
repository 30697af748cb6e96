"""Language identification with a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes. Each byte has an embedding;
filters of several widths slide over it; each filter's maximum over the window goes
through a rectifier to a softmax over the languages. Windows are taken in batches of
BATCH, as one matrix product: narrower filters are filters of the widest width with
zeros. A text's score for a language is the mean over its windows of the log
probabilities, weighted by the bytes in each window, so all of the text counts.

Training takes at most SAMPLE windows a language, from rows chosen by the hash of their
id, so the sample is spread over the whole table and the same in every run. Where a
language has fewer rows, a row gives up to MOST windows.

Cases: null text, or text without a letter, is `und` with score 0; if no row is labelled
every text is; a null language is no label; repeated rows each get their answer; of
equal scores the first language in code point order wins; long texts are read whole; an
empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import for_texts, lean
from .textgrid import strings

WINDOW = 128
BATCH = 256
EMBED = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
#: Windows of labelled texts for training, per language.
SAMPLE = 3000
#: Windows of one text, where there are fewer texts than SAMPLE.
MOST = 8
EPOCHS = 12
#: Training steps at least.
STEPS = 600
SEED = 11


def windows(data: np.ndarray, offsets: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of each window, and the text it belongs to."""
    n = -(-np.diff(offsets) // length)
    text = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    starts = offsets[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * length
    return starts, np.minimum(length, offsets[1:][text] - starts), text


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Windows as rows of byte codes 1..256, with 0 beyond their end."""
    step = np.arange(length)
    at = np.minimum(starts[:, None] + step, max(0, len(data) - 1))
    out = data[at].astype(np.int16) + 1
    out[step >= sizes[:, None]] = 0
    return out


class ByteConv:
    """Embedding, filters with max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.wide, self.filters = max(WIDTHS), FILTERS * len(WIDTHS)
        self.p = {
            "embed": rng.normal(0, 0.3, (257, EMBED)), "kernel": rng.normal(0, 0.2, (self.wide, EMBED, self.filters)), "bias": np.zeros(self.filters),
            "out": rng.normal(0, 0.2, (self.filters, len(languages))), "out_bias": np.zeros(len(languages)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.open = np.zeros((self.wide, 1, self.filters), np.float32)
        for i, w in enumerate(WIDTHS):
            self.open[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p["kernel"] *= self.open

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """(windows, positions, width * embed) of the widest width."""
        padded = np.zeros((len(codes), codes.shape[1] + self.wide - 1), codes.dtype)
        padded[:, : codes.shape[1]] = codes
        x = self.p["embed"][padded]
        view = np.lib.stride_tricks.as_strided(x, (len(codes), codes.shape[1], self.wide * EMBED), (x.strides[0], x.strides[1], x.strides[2]))
        return np.ascontiguousarray(view)

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.columns(codes)
        y = (x.reshape(-1, x.shape[2]) @ self.p["kernel"].reshape(-1, self.filters)).reshape(len(codes), codes.shape[1], self.filters)
        return x, y

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        _, y = self.pooled(codes)
        z = np.maximum(y.max(1) + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01) -> None:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(SEED)
        epochs = max(epochs, -(-STEPS * batch // max(1, len(codes))))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(codes))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                c, n = codes[pick], len(pick)
                x, y = self.pooled(c)
                top = y.argmax(1)
                best = np.take_along_axis(y, top[:, None, :], 1)[:, 0, :] + self.p["bias"]
                hidden = np.maximum(best, 0)
                z = hidden @ self.p["out"] + self.p["out_bias"]
                z -= z.max(1, keepdims=True)
                g = np.exp(z)
                g /= g.sum(1, keepdims=True)
                g[np.arange(n), labels[pick]] -= 1
                g /= n
                grad = {"out": hidden.T @ g, "out_bias": g.sum(0)}
                back = (g @ self.p["out"].T) * (best > 0)
                grad["bias"] = back.sum(0)
                seen = x[np.arange(n)[:, None], top]  # (n, filters, width * embed)
                grad["kernel"] = np.einsum("nf,nfk->kf", back, seen, optimize=True).reshape(self.wide, EMBED, self.filters) * self.open
                to = np.einsum("nf,kf->nfk", back, self.p["kernel"].reshape(-1, self.filters), optimize=True).reshape(n, self.filters, self.wide, EMBED)
                padded = np.zeros((n, c.shape[1] + self.wide - 1), c.dtype)
                padded[:, : c.shape[1]] = c
                at = padded[np.arange(n)[:, None, None], top[:, :, None] + np.arange(self.wide)]
                grad["embed"] = np.zeros_like(self.p["embed"])
                np.add.at(grad["embed"], at.ravel(), to.reshape(-1, EMBED))
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, d in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v2[k] = 0.99 * v2[k] + 0.01 * d * d
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of every text of a column, over all of its windows."""
        data, offsets = strings(column)
        rows = len(offsets) - 1
        total, weight = np.zeros((rows, len(self.languages))), np.zeros(rows)
        starts, sizes, text = windows(data, offsets)
        for lo in range(0, len(starts), BATCH):
            s, n, t = starts[lo : lo + BATCH], sizes[lo : lo + BATCH], text[lo : lo + BATCH]
            np.add.at(total, t, self.log_probabilities(gather(data, s, n)) * n[:, None])
            np.add.at(weight, t, n)
        total /= np.maximum(weight, 1)[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(rows), best]


def _sample(labelled: DataFrame) -> tuple[list[str], pa.Table]:
    """At most SAMPLE windows of text a language, of rows spread by hash over all of labelled (key, text, lang)."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], pa.table({"lang": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    of = lambda f: F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, f(n))])[F.col("lang")]
    share, per = of(lambda n: min(1.0, 1.2 * SAMPLE / n)), of(lambda n: min(MOST, -(-SAMPLE // n)))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(1 << 24)) / (1 << 24)
    place = F.pmod(F.xxhash64(F.lit(SEED + 1), "key", "turn"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    rows = labelled.where(draw < share).withColumn("turn", F.explode(F.sequence(F.lit(1), per)))
    rows = rows.select("lang", F.substring("text", place, F.lit(WINDOW)).alias("text"), F.xxhash64("turn", "key").alias("draw"))
    table = rows.toArrow().sort_by([("draw", "ascending"), ("text", "ascending")])
    return sorted(counts), table


def trained(labelled: DataFrame) -> ByteConv | None:
    """A network from labelled rows (key, text, lang); None without any."""
    languages, table = _sample(labelled)
    if not languages:
        return None
    parts, labels = [], []
    langs = np.array(table["lang"].to_pylist(), object)
    for i, lang in enumerate(languages):
        mine = table["text"].combine_chunks().filter(pa.array(langs == lang))[:SAMPLE]
        data, offsets = strings(mine)
        sizes = np.minimum(np.diff(offsets), WINDOW)
        parts.append(gather(data, offsets[:-1], sizes))
        labels.append(np.full(len(sizes), i))
    net = ByteConv(languages)
    net.fit(np.concatenate(parts), np.concatenate(labels))
    return net


def has_letter(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predicted(docs: DataFrame, net: ByteConv | None, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred, score."""
    if net is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    for_texts(spark)
    shared = spark.sparkContext.broadcast(net)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for batch in batches:
            best, score = model.judge(batch.column(len(keep)))
            letters = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            lang = np.where(letters, names[best], "und")
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("_text"), has_letter(text).alias("_letters")).mapInArrow(lean("language_id", run), schema)


def held_out(key: str) -> Column:
    """Rows that training never sees: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score: trained on the rows that aren't held out and have a language."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(key).alias("held_out"))
    net = trained(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("key", "text", "lang"))
    return predicted(rows, net, ["key", "held_out"]).select(F.col("key").alias(key), "held_out", "lang_pred", "score")
