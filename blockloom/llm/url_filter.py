"""URL filters: rules first, else naive Bayes over segmented host and path words.

Segmentation. Host labels are split at other characters than letters and digits; each
piece is split into words by Viterbi search over unigram log probabilities. A word that
is not in the lexicon costs more with each letter, so unknown names stay in one piece.
The lexicon counts words of page texts and of paths, and the pieces of hyphenated hosts,
over all pages; SEEDS are added to it. It stays a table: each distinct piece is joined
with the counts of its own parts, of LONGEST letters at most (the longest word that the
lexicon counts), and split by them alone, which is all of the lexicon that its split depends
on. Parts without a word may be of any length. Parts go as (number of the piece, part), in
batches of PARTS, and only if a filter of the lexicon may have them, so a piece of any length is
split at a cost in proportion to it. Frequent parts and pieces are met by broadcast (`met`).

Classifier. At most SAMPLE pages, chosen by the hash of their url, are labelled by their host: block if it has one of the
SEEDS as a word, else allow. A multinomial naive Bayes with add-one smoothing learns the
words of both classes; a url is blocked if its log odds are above 0. Generic words
(STOP and the last host label) count for nothing.

Rules. A rule fits its host and all subdomains if the path starts with the rule's path;
the longest fitting rule gives the verdict.

Cases: null url, or a url without ://, has empty host and path, no words, and is allowed;
ties in log odds are allowed; repeated rows each get their verdict; an empty table gives
no rows; hosts and paths of any length are segmented whole; null or empty html adds no words; kept columns may
have any name, and one that is named like a result column comes back with `_` before it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import for_texts, kept_as, key_filter, met, plain_columns, write_shared

#: Pages whose words train the classifier.
SAMPLE = 5000
LONGEST = 24
#: What each letter of an unknown part costs.
LETTER = 2.5
CACHE = 200_000
#: Parts of names that a worker holds before it sends them.
PARTS = 100_000

#: Words of hosts that are commonly blocked.
SEEDS = (
    "adult", "ads", "bets", "betting", "bonus", "casino", "cheap", "crack", "dating", "escort", "gambling", "hack", "jackpot", "keygen",
    "loans", "malware", "nude", "payday", "phishing", "pills", "poker", "porn", "replica", "scam", "sex", "slots", "spam", "torrent",
    "tracker", "viagra", "warez", "xxx",
)
#: Common words that blocked names are joined with.
COMMON = ("best", "buy", "farm", "free", "get", "home", "live", "my", "news", "now", "online", "shop", "site", "store", "the", "top", "track", "web", "win", "world")
STOP = frozenset(("www", "m", "blog", "html", "htm", "php", "index", "#"))

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_PIECE = re.compile(r"[^\W_]+")


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a url."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    found = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested last and outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.lit(h + p)).otherwise(found)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


class Lexicon:
    """Unigram log probabilities and the best split of a name."""

    def __init__(self, counts: Counter[str], total: int | None = None):
        """total: of all counts, if these are only some."""
        self.counts = counts
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.log = {w: math.log(n / self.total) for w, n in counts.items()}
        self.unknown = math.log(10 / self.total)
        self.known: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name in self.known:
            return self.known[name]
        if name.isdigit():
            return ["#"]
        best, back = [0.0], [0]
        # where an unknown part of any length best starts: its cost grows evenly with its end
        begun, opened = 0.0, 0
        for end in range(1, len(name) + 1):
            score, start = self.unknown + begun - LETTER * end, opened
            for at in range(max(0, end - LONGEST), end):
                cost = self.log.get(name[at:end])
                if cost is not None and (best[at] + cost, at) > (score, start):
                    score, start = best[at] + cost, at
            best.append(score)
            back.append(start)
            if score + LETTER * end >= begun:
                begun, opened = score + LETTER * end, end
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        words = [("#" if w.isdigit() else w) for w in reversed(words)]
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[name] = words
        return words


class Splits:
    """Splits that are known already."""

    def __init__(self, known: dict[str, list[str]]):
        self.known = known

    def split(self, name: str) -> list[str]:
        return ["#"] if name.isdigit() else self.known[name]


def count_words(counts: Counter[str], host: str, path: str, text: str) -> None:
    """Adds what a page tells the lexicon."""
    counts.update(w for w in _PIECE.findall(text.lower()) if 1 < len(w) <= LONGEST and not w.isdigit())
    counts.update(w for w in _PIECE.findall(path.lower()) if len(w) > 1 and not w.isdigit())
    for label in host.split("."):
        pieces = _PIECE.findall(label)
        if len(pieces) > 1:
            counts.update(w for w in pieces if not w.isdigit())


def added(pages: int) -> Counter[str]:
    """What the lexicon counts of fixed words, beside pages."""
    counts: Counter[str] = Counter()
    for w in (*SEEDS, *COMMON):
        counts[w] += max(10, pages // 100)
    return counts


def pieces(host: str, path: str) -> list[str]:
    """Names of a url that are split into words."""
    labels = host.split(":")[0].split(".")
    return [piece for label in labels[:-1] for piece in _PIECE.findall(label)] + _PIECE.findall(path.lower())


class UrlModel:
    """A lexicon and naive Bayes weights."""

    def __init__(self, rows: list[tuple[str, str, str]], lexicon: Lexicon | Splits | None = None):
        """rows: (host, path, page text); without a lexicon they make one."""
        if lexicon is None:
            counts = added(len(rows))
            for row in rows:
                count_words(counts, *row)
            lexicon = Lexicon(counts)
        self.lexicon = lexicon
        seeds = set(SEEDS)
        seen: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
        pages: Counter[bool] = Counter()
        for w in SEEDS:  # a labelled example of each seed
            seen[True][w] += 1
        for host, path, _ in rows:
            words = self.words(host, path)
            bad = not seeds.isdisjoint(words)
            pages[bad] += 1
            seen[bad].update(words)
        vocabulary = len(seen[True].keys() | seen[False].keys()) + 1
        sums = {k: sum(c.values()) + vocabulary for k, c in seen.items()}
        self.prior = math.log((pages[True] + 1) / (pages[False] + 1))
        self.odds = {w: math.log((seen[True][w] + 1) / sums[True]) - math.log((seen[False][w] + 1) / sums[False]) for w in seen[True].keys() | seen[False].keys()}
        self.hosts: dict[str, list[str]] = {}

    def words(self, host: str, path: str) -> list[str]:
        found = [w for piece in pieces(host, path) for w in self.lexicon.split(piece)]
        return [w for w in found if w not in STOP]

    def score(self, host: str, path: str) -> float:
        """Log odds of block."""
        words = self.words(host, path)
        return self.prior + sum(self.odds.get(w, 0.0) for w in words) if words else -math.inf


def lexicon_counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """word, n over the whole texts, paths and hosts of all pages, and the fixed words."""
    host, path = parts(url)
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                count_words(counts, *(x or "" for x in row))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = pages.select(host.alias("host"), path.alias("path"), text.alias("text")).mapInArrow(run, "word string, n bigint")
    fixed = pages.sparkSession.createDataFrame(list(added(pages.count()).items()), "word string, n bigint")
    return rows.unionByName(fixed).groupBy("word").agg(F.sum("n").alias("n"))


def split_pieces(used: DataFrame, counts: DataFrame) -> DataFrame:
    """piece, words: the split of each distinct piece by the counts of its own parts."""
    total = counts.agg(F.sum("n")).first()[0]

    def subwords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[int, str]] = set()
        for batch in batches:
            for at, name in zip(*(c.to_pylist() for c in batch.columns)):
                for i in range(len(name)):
                    held.update((at, name[i:j]) for j in range(i + 1, min(len(name), i + LONGEST) + 1))
                    if len(held) >= PARTS:
                        yield _parts(held)
                        held.clear()
        if held:
            yield _parts(held)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [Lexicon(Counter({r["word"]: r["n"] for r in known or ()}), total).split(name) for name, known in zip(names, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["piece", "words"])

    names = write_shared(used.select("piece").distinct().withColumn("at", F.monotonically_increasing_id()), "pieces")
    # a part goes on only if the lexicon may have it: of a long name's parts, few do
    may = key_filter(counts, "word")
    parts = write_shared(names.select("at", "piece").mapInArrow(subwords, "at bigint, word string").where(may(F.col("word"))), "parts")
    known = met(parts, counts, "word").groupBy("at").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    return names.join(known, "at", "left").select("piece", "known").mapInArrow(split, "piece string, words array<string>")


def _parts(held: set[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at for at, _ in held], pa.int64()), pa.array([w for _, w in held], pa.string())], names=["at", "word"])


def judged(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """keep, host, path, rule, verdict, score (log odds of block; null without words)."""
    for_texts(pages.sparkSession)
    plain, at = plain_columns(pages)
    host, path = parts(at[url])
    draw = F.xxhash64(F.lit(3), F.col(at[url]))
    rows = plain.select(*dict.fromkeys(at[c] for c in keep), host.alias("_host"), path.alias("_path"), draw.alias("_draw"), F.monotonically_increasing_id().alias("_row"))
    rows = write_shared(rows, "urls")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, p) for i, h, path in zip(*(c.to_pylist() for c in batch.columns)) for p in pieces(h or "", path or "") if not p.isdigit()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())], names=["_row", "piece"])

    used = write_shared(rows.select("_row", "_host", "_path").mapInArrow(cut, "_row bigint, piece string"), "used")
    counts = write_shared(lexicon_counts(pages, url, html), "lexicon")
    splits = write_shared(split_pieces(used, counts), "splits")
    # at most SAMPLE pages, spread by hash over the whole table, and their splits come to the driver
    share = min(1.0, 1.3 * SAMPLE / max(1, rows.count()))
    drawn = rows.where(F.pmod("_draw", F.lit(1 << 24)) / (1 << 24) < share).orderBy("_draw", "_host", "_path").limit(SAMPLE)
    drawn = write_shared(drawn.select("_row", "_host", "_path"), "sample")
    theirs = drawn.mapInArrow(cut, "_row bigint, piece string").select("piece").distinct()
    lexicon = Splits({r["piece"]: r["words"] for r in splits.join(theirs, "piece").collect()})
    model = UrlModel([(r["_host"] or "", r["_path"] or "", "") for r in drawn.collect()], lexicon)
    prior, odds = model.prior, pages.sparkSession.sparkContext.broadcast(model.odds)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[w for w in ws if w not in STOP] for ws in batch.column(1).to_pylist()]
            odd = pa.array([sum(odds.value.get(w, 0.0) for w in ws) for ws in words], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), odd, pa.array([len(ws) for ws in words], pa.int64())], names=["piece", "odd", "words"])

    weights = write_shared(splits.mapInArrow(weigh, "piece string, odd double, words bigint").where("words > 0"), "weights")
    # in one order, so that sums don't depend on how rows are dealt
    sums = met(used, weights, "piece").groupBy("_row").agg(F.array_sort(F.collect_list("odd")).alias("odd"))
    scored = rows.join(sums, "_row", "left").withColumn("_score", F.when(F.col("odd").isNotNull(), F.aggregate("odd", F.lit(float(prior)), lambda s, x: s + x)))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    method = F.when(F.coalesce(F.col("_score") > 0, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    kept = [F.col(at[c]).alias(n) for c, n in zip(keep, kept_as(keep, ("host", "path", "rule", "verdict", "score")))]
    return scored.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("_score").alias("score"))
