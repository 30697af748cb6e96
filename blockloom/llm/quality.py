"""Quality rules with adaptive thresholds.

Per text, numpy passes count words, symbols, repeated lines and repeated windows; what they
find is written once and read for the sketches and for the verdicts.
Each measure is put into buckets of a mergeable quantile sketch. Buckets grow by GROWTH:
bucket k > 0 ends at LEAST_VALUE * GROWTH ** k, bucket 0 at LEAST_VALUE, the last takes all
above, so a quantile is off by GROWTH at most, and a sketch has LAST + 1 buckets at most,
however many texts. Sketches merge by adding counts, so they are an ordinary partial
aggregation over (language, source, measure, bucket).

A measure of a text is out of line above Q3 + FENCE * (Q3 - Q1) + slack, the least distance
that the measure needs to tell texts apart. Most texts have none of some measures, so that both
quartiles are 0; slack is adaptive too: SLACK for all texts together, and for a group SLACK
times the root of P / P of all texts, where P is the first quartile of the values above
0. A source whose texts have more symbols, where they have any, gets a higher ceiling. In a short text
slack is larger by SHORT / its words. Quartiles are those of the text's language and
source, drawn to those of its language as if TRUST texts had them, and these to those of all
texts in the same way (P by its bucket, weighed by the texts above 0): many texts speak
for themselves, few lean on what is known of others, and there is no size at which that
switches. Thresholds come back by a join on language and source.

Cases: null text counts as empty and fails the base rule; null language or source are
groups of their own; ties in a sketch fall into one bucket; repeated rows count each; a long
text is measured whole; an empty table gives no rows; kept columns may have any name, and one
that is named like a result column comes back with `_` before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import for_texts, free_name, kept_as, lean, plain_columns, write_shared
from .textgrid import blocks, duplicated, mix, span_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[0xC3:0x100] = True  # lead bytes of letters beyond ASCII
MARKS = np.zeros(256, bool)
MARKS[33:127] = True
MARKS &= ~LETTER
MARKS[48:58] = False

WINDOW = 8
MIN_WORDS = 20
LEAST_VALUE, GROWTH = 1e-4, 1.02
LAST = math.ceil(math.log(1e8 / LEAST_VALUE) / math.log(GROWTH))
FENCE = 3.0
TRUST = 100
#: A measure of few words is less sure: slack * (1 + SHORT / words).
SHORT = 60
#: Measures, each 0 or more, with their slack.
SLACK = {"symbol_share": 0.1, "mark_share": 0.15, "upper_share": 0.15, "twin_share": 0.2, "line_share": 0.25, "window_share": 0.2, "word_size": 0.9}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts and the measures of every text of a column."""
    parts = []
    for b in blocks(column):
        b.find_words()
        n = np.diff(b.word_bounds)
        words = b.word_hashes()
        lead = (b.data & 0xC0) != 0x80
        chars = b.sums(b.ink & lead)
        symbols = b.sums(SYMBOLS[b.data])

        # lines: spans between newlines and text ends, kept if a word starts inside
        breaks = np.flatnonzero(b.data == 10)
        heads = np.unique(np.concatenate([b.offsets[:-1], breaks + 1]))
        heads = heads[heads < len(b.data)]
        row = np.searchsorted(b.offsets, heads, "right") - 1
        tails = np.minimum(np.append(breaks, len(b.data))[np.searchsorted(breaks, heads)], b.offsets[row + 1])
        inked = np.searchsorted(b.starts, tails) > np.searchsorted(b.starts, heads)
        heads, tails, row = heads[inked], tails[inked], row[inked]
        line = span_hashes(b.data, heads, tails)
        key = mix(line ^ mix(row.astype(np.uint64) + np.uint64(77)))
        lines = np.bincount(row, minlength=b.rows)
        _, firsts = np.unique(key, return_index=True)
        dup_lines = lines - np.bincount(row[firsts], minlength=b.rows)

        window, at = b.windows(words, WINDOW)
        again = at[duplicated(mix(window ^ mix(b.word_row[at].astype(np.uint64) + np.uint64(99))))]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + WINDOW, -1)
        repeat = np.bincount(b.word_row[np.cumsum(cover)[:-1] > 0], minlength=b.rows)

        twin = np.bincount(b.word_row[1:][(words[1:] == words[:-1]) & (b.word_row[1:] == b.word_row[:-1])], minlength=b.rows) if len(words) > 1 else np.zeros(b.rows, np.int64)
        upper, letter, mark = b.sums(UPPER[b.data]), b.sums(LETTER[b.data]), b.sums(MARKS[b.data])
        some = np.maximum(n, 1)
        parts.append({
            "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
            "symbol_share": symbols / some, "mark_share": mark / np.maximum(chars, 1), "upper_share": upper / np.maximum(letter, 1),
            "twin_share": twin / some, "line_share": dup_lines / np.maximum(lines, 1), "window_share": repeat / some, "word_size": chars / some,
        })
    names = (*COUNTS, *SLACK)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep, then the counts (long) and measures (double) of each row's text."""
    for_texts(docs.sparkSession)
    names = [*COUNTS, *SLACK]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{c}` {'bigint' if c in COUNTS else 'double'}" for c in names])
    inner = free_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(len(keep)))
            arrays = [batch.column(i) for i in range(len(keep))]
            arrays += [pa.array(found[c], pa.int64() if c in COUNTS else pa.float64()) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return docs.select(*keep, F.col(text).alias(inner)).mapInArrow(lean("quality", run), schema)


def bucket(value: F.Column) -> F.Column:
    """The sketch bucket of a value."""
    at = F.ceil(F.log(value / LEAST_VALUE) / math.log(GROWTH))
    return F.when(value <= LEAST_VALUE, 0).otherwise(F.least(at, F.lit(LAST))).cast("long")


def sketches(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Quantile sketches: a count for each language, source, measure and bucket."""
    stack = ", ".join(f"'{c}', `{c}`" for c in SLACK)
    return (
        rows.where(F.col("n_words") > 0)
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.expr(f"stack({len(SLACK)}, {stack}) as (measure, value)"))
        .groupBy("lang", "source", "measure", bucket(F.col("value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def _quartiles(counts: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of merged sketches, of LAST + 1 buckets at most each."""
    merged = counts.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    listed = merged.groupBy(*by, "measure").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"))
    at = """aggregate(cells, named_struct('seen', 0L, 'at', cast(null as bigint)),
        (s, c) -> named_struct('seen', s.seen + c.n, 'at', coalesce(s.at, if(s.seen + c.n >= {q} * total, c.bucket, null))), s -> s.at)"""
    value = lambda q: F.when(F.expr(at.format(q=q)) > 0, LEAST_VALUE * F.pow(F.lit(GROWTH), F.expr(at.format(q=q)))).otherwise(F.lit(0.0))
    # the same over what is above 0: cells begin with bucket 0, if there is one
    above = listed.select("*", F.when(F.col("cells")[0]["bucket"] == 0, F.col("cells")[0]["n"]).otherwise(0).alias("zero"))
    first = """aggregate(cells, named_struct('seen', -zero, 'at', cast(null as bigint)),
        (s, c) -> named_struct('seen', s.seen + c.n, 'at', coalesce(s.at, if(c.bucket > 0 and s.seen + c.n >= 0.25 * (total - zero), c.bucket, null))), s -> s.at)"""
    return above.select(*by, "measure", "total", value(0.25).alias("q1"), value(0.75).alias("q3"), (F.col("total") - F.col("zero")).alias("some"), F.expr(first).alias("p"))


def thresholds(counts: DataFrame) -> DataFrame:
    """Per language and source one row: lang, source and a ceiling for each measure."""
    counts = write_shared(counts, "sketches")
    own = _quartiles(counts, ["lang", "source"])
    lang = _quartiles(counts, ["lang"]).select(F.col("lang").alias("lang_l"), F.col("measure").alias("measure_l"), F.struct("total", "q1", "q3", "some", "p").alias("of_lang"))
    every = _quartiles(counts, []).select(F.col("measure").alias("measure_e"), F.struct("total", "q1", "q3", "some", "p").alias("of_all"))
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_l")) & (F.col("measure") == F.col("measure_l"))).join(F.broadcast(every), F.col("measure") == F.col("measure_e"))

    def drawn(q: str) -> F.Column:
        of_lang = (F.col("of_lang.total") * F.col(f"of_lang.{q}") + TRUST * F.col(f"of_all.{q}")) / (F.col("of_lang.total") + TRUST)
        return (F.col("total") * F.col(q) + TRUST * of_lang) / (F.col("total") + TRUST)

    # where nothing is above 0, a group has no bucket and no weight; where that holds for all texts, slack is SLACK
    p = lambda of: F.coalesce(F.col(f"{of}p"), F.lit(0))
    of_lang = (F.col("of_lang.some") * p("of_lang.") + TRUST * F.col("of_all.p")) / (F.col("of_lang.some") + TRUST)
    bucket_of = (F.col("some") * p("") + TRUST * of_lang) / (F.col("some") + TRUST)
    scale = F.coalesce(F.pow(F.lit(GROWTH), (bucket_of - F.col("of_all.p")) / 2), F.lit(1.0))
    ceiling = drawn("q3") + FENCE * (drawn("q3") - drawn("q1")) + slack[F.col("measure")] * scale
    return joined.select("lang", "source", "measure", ceiling.alias("ceiling")).groupBy("lang", "source").pivot("measure", list(SLACK)).agg(F.first("ceiling"))


def judged(docs: DataFrame, keep: list[str], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """keep, the counts, base_failed, and kept: false if base_failed, else whether every measure is within its group's ceiling."""
    plain, at = plain_columns(docs)
    inner = list(dict.fromkeys(at[c] for c in keep))
    rows = plain.select(*inner, F.col(at[lang]).alias("_lang"), F.col(at[source]).alias("_source"), F.col(at[text]).alias("_body"))
    rows = write_shared(measured(rows, [*inner, "_lang", "_source"], "_body"), "measures")
    limits = write_shared(thresholds(sketches(rows, "_lang", "_source")), "ceilings")
    limits = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *(F.col(c).alias(f"_max_{c}") for c in SLACK))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = F.lit(True)
    for c in SLACK:
        fine = fine & F.coalesce(F.col(c) <= F.col(f"_max_{c}") + SLACK[c] * SHORT / F.greatest("n_words", F.lit(1)), F.lit(True))
    joined = rows.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    kept = [F.col(at[c]).alias(n) for c, n in zip(keep, kept_as(keep, (*COUNTS, "base_failed", "kept")))]
    return joined.select(*kept, *COUNTS, failed.alias("base_failed"), (~failed & fine).alias("kept"))


def filtered(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    names = docs.columns
    plain, pick = plain_columns(docs)
    out = judged(plain, plain.columns, pick[lang], pick[source], pick[text]).where("kept")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def oracle_sql() -> str:
    """The same judgement in DuckDB's SQL: counts from regular expressions, quartiles from ordered buckets."""
    slack = ", ".join(f"('{c}', {x}::DOUBLE)" for c, x in SLACK.items())
    stack = " UNION ALL ".join(f"SELECT doc_id, lang, source, n_words, '{c}' AS measure, {c}::DOUBLE AS value FROM m" for c in SLACK)
    value = lambda q: f"min(CASE WHEN seen >= {q} * total THEN CASE WHEN bucket > 0 THEN {LEAST_VALUE} * pow({GROWTH}::DOUBLE, bucket) ELSE 0 END END)"
    quartiles = lambda by: f"""SELECT {by}measure, max(total) AS total, {value(0.25)} AS q1, {value(0.75)} AS q3, max(total - zero) AS some, {first} AS p FROM (
        SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS seen, sum(CASE WHEN bucket = 0 THEN n ELSE 0 END) OVER (PARTITION BY {by}measure) AS zero, sum(n) OVER (PARTITION BY {by}measure) AS total
        FROM (SELECT {by}measure, bucket, count(*) AS n FROM b GROUP BY {by}measure, bucket)) GROUP BY {by}measure"""  # noqa: E731
    first = "min(CASE WHEN bucket > 0 AND seen - zero >= 0.25 * (total - zero) THEN bucket END)"
    drawn = f"(own.some * coalesce(own.p, 0) + {TRUST} * (l.some * coalesce(l.p, 0) + {TRUST} * e.p) / (l.some + {TRUST})) / (own.some + {TRUST})"
    lean = lambda q: f"(own.total * own.{q} + {TRUST} * (l.total * l.{q} + {TRUST} * e.{q}) / (l.total + {TRUST})) / (own.total + {TRUST})"
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS place FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS twins,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z\x{{C0}}-\x{{10FFFF}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^!-/:-@\[-`{{-~]', '', 'g')) AS marks FROM w LEFT JOIN again USING (doc_id)),
m AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbol_share, marks / greatest(word_chars, 1) AS mark_share, upper / greatest(letters, 1) AS upper_share, twins / greatest(n_words, 1) AS twin_share,
    n_dup_lines / greatest(n_lines, 1) AS line_share, n_repeat_words / greatest(n_words, 1) AS window_share, word_chars / greatest(n_words, 1) AS word_size FROM c),
v AS ({stack}),
b AS (SELECT *, CASE WHEN value <= {LEAST_VALUE} THEN 0 ELSE least(ceil(ln(value / {LEAST_VALUE}) / {math.log(GROWTH)!r}), {LAST}) END::BIGINT AS bucket FROM v WHERE n_words > 0),
own AS ({quartiles("lang, source, ")}), l AS ({quartiles("lang, ")}), e AS ({quartiles("")}),
limits AS (SELECT own.lang, own.source, own.measure, slack, {lean("q3")} + {FENCE} * ({lean("q3")} - {lean("q1")}) + slack * coalesce(pow({GROWTH}::DOUBLE, ({drawn} - e.p) / 2), 1) AS ceiling
    FROM own JOIN l ON own.lang IS NOT DISTINCT FROM l.lang AND own.measure = l.measure JOIN e ON own.measure = e.measure JOIN (VALUES {slack}) s(measure, slack) ON s.measure = own.measure),
fine AS (SELECT v.doc_id, bool_and(coalesce(value <= ceiling + slack * {SHORT} / greatest(n_words, 1), true)) AS fine
    FROM v LEFT JOIN limits x ON v.lang IS NOT DISTINCT FROM x.lang AND v.source IS NOT DISTINCT FROM x.source AND v.measure = x.measure GROUP BY v.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m JOIN fine USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    base_failed, NOT base_failed AND fine AS kept FROM f"""
