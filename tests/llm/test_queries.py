"""Operators on small tables with nulls, empty texts, repeats and clashing names, and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import decontaminate, language_id, licenses, mixing, near_dup, pii, quality, queries, token_count, token_store, url_filter

LINE = "Licensed under the Apache License, Version 2.0."
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, c0 string, _text string, `key` string, taken string"


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(30, None, "en", "s0"), (31, "", None, None), (32, "one two", "en", None), (33, prose(1), "en", "s1"), (None, prose(99), None, "s2"), (34, f"{prose(5)}\n{LINE}\n", "en", "s2"), (35, " ".join(prose(2).split()[:-1] + ["changed"]), "en", "s0"), (36, prose(7, 20_000), "en", "s0"), (5, prose(5), "en", "s2")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y", "z", "t") for r in rows], SCHEMA)


def test_every_query_is_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_quality(docs):
    got = {r.doc_id: r for r in quality.judged(docs, ["doc_id"]).collect()}
    assert got[30].base_failed and not got[32].kept and got[0].kept and got[36].n_words == 20_000
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 32").isEmpty()


def test_token_counts(docs):
    got = {r.doc_id: r for r in token_count.token_counts(docs, queries.vocabulary("word_bpe_49k.json")).collect()}
    assert (got[30].n_tokens, got[31].n_bytes, got[36].over_limit) == (0, 0, True)


def test_licenses(docs):
    got = {r.doc_id: (r.license, r.n_matches) for r in licenses.scanned(docs, ["doc_id"]).collect()}
    assert got[34] == ("Apache-2.0", 1) and got[30] == got[0] == (None, 0)


def test_mixing_meets_its_targets(docs):
    rows = mixing.mixed(docs, ["doc_id", "source"]).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [0, r.source_size, r.target, 0])
        s[0] += r.taken
        s[3] += r.size
        assert 0 <= r.taken <= 3 * r.size
    total = sum(s[3] for s in by.values())
    sizes = {k: s[3] for k, s in by.items()}
    # plain resharing
    weight = dict(zip(sorted(sizes, key=lambda k: (k is None, k)), [5, 2, 1, 5]))
    want, left, open_ = {}, float(total), dict(weight)
    while True:
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        full = [k for k in open_ if share[k] > 3 * sizes[k]]
        if not full:
            want |= share
            break
        for k in full:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
            del open_[k]
    for k, (taken, size, target, seen) in by.items():
        assert size == seen and target == pytest.approx(want[k]) and taken == int(target + 1e-9)
    assert mixing.mix_rows(docs).columns == docs.columns
    words = sum(len((r.text or "").split()) for r in mixing.mix_rows(docs).collect())
    assert words == sum(s[0] for s in by.values())


def test_near_duplicates(docs):
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got[33] == 1 and got[35] == 2 and got[5] == 5 and got[30] == 30 and got[36] == 36
    left = near_dup.deduplicated(docs)
    ids = sorted(r.doc_id for r in left.where("doc_id is not null").collect())
    assert left.columns == docs.columns and 33 not in ids and 35 not in ids and ids.count(5) == 1 and 30 in ids


def test_containment(spark, docs):
    items = spark.createDataFrame([(1, " ".join(prose(3).split()[10:40])), (2, None), (3, "too short"), (4, prose(1000))], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(3, 1)}
    assert decontaminate.cleaned(docs, items).count() == docs.count() - 1


def test_store_round_trip(spark, docs):
    path = queries.vocabulary("byte_bpe_50k.json")
    store = token_store.TokenStore.write(docs, path, partitions=3)
    keys = docs.select(F.col("doc_id").alias("key")).distinct().unionByName(spark.createDataFrame([(10**9,)], "key bigint"))
    rows = {r.key: list(r.ids) for r in token_store.TokenStore.open(spark, store.path).read(keys).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    assert 10**9 not in rows and rows[0] == library.encode(prose(0)).ids + [0] and rows[30] == [0]
    got = token_store.digest(docs, path).orderBy("start").collect()
    assert [r.start for r in got[1:]] == [r.start + r.n_tokens for r in got[:-1]] and len(got) == docs.count()
    assert {r.occurrence for r in got if r.doc_id == 5} == {0, 1}


def test_personal_data(spark):
    rows = spark.createDataFrame([(1, "a@b.co and +1 (614) 555-8001"), (2, None), (3, "x (at) y (dot) org")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.digest(rows).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].spans) == (1, 1, "email:0:6,phone:11:28") and got[2].spans == "" and got[3].n_added == 1 and got[3].n_email == 0
    assert {r.doc_id: r.text for r in pii.masked(rows).collect()} == {1: "<email> and <phone>", 2: None, 3: "<email>"}


def test_urls(spark):
    urls = ("http://A.Example.com/en/71?x", "https://x.com/en/1", "http://example.net/de/80#a", "http://b.net/de/1", "none", None, "http://q.org?x/es/")
    pages = spark.createDataFrame([(i, u, "<p>a b</p>") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, ["page_id"]).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1] == ("x.com", "/en/1", "com/en/", "block")
    assert got[2] == ("example.net", "/de/80", "example.net/de/8", "block") and got[3][2:] == ("net/de/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6] == ("q.org", "", None, "allow")


def test_languages_by_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "123 !", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    rows = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.doc_id >= 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert {r.lang_pred for r in rows if r.doc_id < 0} == {"und"} and all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert quality.judged(none, ["doc_id"]).isEmpty() and mixing.mixed(none, ["doc_id"]).isEmpty() and near_dup.classes(none).isEmpty()
    assert token_store.digest(none, queries.vocabulary("byte_bpe_50k.json")).isEmpty() and language_id.identified(none).isEmpty() and licenses.scanned(none, ["doc_id"]).isEmpty()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "decontamination", "mixing", "token_ids"]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < len(got) and {r.doc_id for r in got} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_duplicates_among_loosely_alike_texts(spark):
    """All texts share a long passage; only those of one pair share enough for a class."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    passage = r.choices(words, k=400)
    texts = {}
    for pair in range(150):
        own = r.choices(words, k=15)
        for side in "ab":
            texts[f"{r.random():.9f}"] = pair, " ".join(passage + own + r.choices(words, k=30))
    want = {key: min(k for k in texts if texts[k][0] == pair) for key, (pair, _) in texts.items()}
    rows = spark.createDataFrame([(key, text) for key, (_, text) in sorted(texts.items())], "doc_id string, text string").repartition(4)
    assert {row.doc_id: row.class_id for row in near_dup.classes(rows).collect()} == want


def test_longer_disguised_spans_are_masked(spark):
    rows = spark.createDataFrame([(1, "ask john (dot) doe@example.com now"), (2, "ask doe@example.com (dot) uk now")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in pii.masked(rows).collect()} == {1: "ask <email> now", 2: "ask <email> now"}


def test_lexicon_counts_whole_pages_and_all_of_them(spark):
    """Words beyond a page's first 20,000 characters, and beyond the first 5,000 pages, split hosts."""
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id, '.org/') AS url", "concat('word', cast(id AS string)) AS html")
    late = spark.createDataFrame([(-1, "http://zebrapelican.org/", "<b>" + "x " * 15_000 + "zebra pelican " * 60 + "</b>")], "page_id bigint, url string, html string")
    counts = {r.word: r.n for r in url_filter.lexicon_counts(pages.unionByName(late)).collect()}
    assert counts["zebra"] == counts["pelican"] == 60 and all(f"word{i}" in counts for i in range(6000))
    used = spark.createDataFrame([("zebrapelican",), ("qzxv",)], "piece string")
    got = url_filter.split_pieces(used, url_filter.lexicon_counts(late)).collect()
    assert {r.piece: r.words for r in got} == {"zebrapelican": ["zebra", "pelican"], "qzxv": ["qzxv"]}


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_its_sql(spark, sf_dir, sql, name):
    got, want = queries.QUERIES[name](spark, sf_dir), sql.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_digests_of_personal_data(spark, sf_dir):
    """Counts and base_sha256 of every document, from plain expressions."""
    from .test_kernels import plain_spans

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_pii(spark, sf_dir).collect():
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.line(base).encode()).hexdigest() and set(pii.line(base).split(",")) <= set(r.spans.split(","))


def test_ids_of_every_document(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at = 0
    for r in sorted(queries.op6_token_store(spark, sf_dir).collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_a_key_may_span_shards(spark):
    rows = spark.createDataFrame([(k, f"text {i}") for i, k in enumerate([None] * 20 + [1] + [7] * 40 + [9])], "doc_id bigint, text string")
    path = queries.vocabulary("byte_bpe_50k.json")
    store = token_store.TokenStore.write(rows, path, partitions=6)
    manifest = spark.read.parquet(f"{store.path}/manifest").collect()
    assert len({r.shard for r in manifest if r.key == 7}) > 1
    for k in (None, 1, 7, 9):
        assert sorted(r.occurrence for r in manifest if r.key == k) == list(range(sum(r.key == k for r in manifest)))
    keys = spark.createDataFrame([(7, i) for i in range(41)], "key bigint, turn bigint")
    found = store.read(keys, occurrence="turn").collect()
    assert len(found) == 40 and len({tuple(r.ids) for r in found}) == 40


def test_weights_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, *others = (near_dup.corpus_weights(docs.repartition(n)) for n in (1, 4, 40))
    for w in others:
        assert (w.hashes == first.hashes).all() and np.allclose(w.idf, first.idf)
    counts = Counter(h for t in docs.collect() for h in {tuple(x) for w in [(t.text or "").split()] for x in zip(*(w[i:] for i in range(5)))})
    assert len(first.hashes) == len(counts)


def brute_classes(texts: dict) -> dict:
    """Class of each key by the similarity of all pairs."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t) for k, t in texts.items()}
    grams = {k: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for k, w in words.items()}
    bodies = {texts[k]: grams[k] for k in texts}
    df = Counter(g for c in grams.values() for g in c)
    least = max(1.0, near_dup.FREQUENT * sum(df.values()))
    idf = {g: float(near_dup.idf(np.array([n]), len(texts), least)[0]) if n >= least else 1.0 for g, n in df.items()}
    weighed = {t: {g: (1 + math.log(n)) * idf[g] for g, n in c.items()} for t, c in bodies.items()}
    root = {t: t for t in bodies}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    total = {t: sum(w.values()) for t, w in weighed.items()}
    for s, t in itertools.combinations(weighed, 2):
        x, y = weighed[s], weighed[t]
        if x and y and min(total[s], total[t]) >= 0.8 * max(total[s], total[t]) - 1e-9:
            least_ = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
            if least_ / (total[s] + total[t] - least_) >= near_dup.SIMILARITY - 1e-9:
                root[find(s)] = find(t)
    members: dict = {}
    for k, t in texts.items():
        members.setdefault(find(t), []).append(k)
    return {k: min(ks) for ks in members.values() for k in ks}


def test_near_duplicates_by_planted_similarity(spark):
    """Of pairs planted at 0.8 to 0.95, all are found that brute force finds, among texts that share a passage."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    passage = r.choices(words, k=60)
    texts = {}
    for i in range(120):
        body = passage + r.choices(words, k=240) if i % 3 == 0 else r.choices(words, k=300)
        twin = list(body)
        for at in r.sample(range(300), k=1 + i % 6):
            twin[at] = r.choice(words)
        texts[2 * i], texts[2 * i + 1] = " ".join(body), " ".join(twin)
    want = brute_classes(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.class_id for x in near_dup.classes(rows).collect()}
    assert got == want and sum(want[2 * i] == want[2 * i + 1] for i in range(120)) > 90


def test_columns_that_clash(spark, docs):
    """Kept columns named like results come back with _ before them; names that operators use inside don't matter."""
    odd = docs.select("doc_id", "text", "lang", "source", *(F.lit(1).alias(c) for c in ("_lang", "n_words", "kept", "size", "_size", "target", "_text", "_hits", "license", "_host", "verdict", "c1")))
    keep = [c for c in odd.columns if c != "text"]
    got = quality.judged(odd, keep)
    assert {"_n_words", "_kept", "_lang", "n_words", "kept"} <= set(got.columns) and got.count() == docs.count()
    assert {"_size", "__size", "size", "_target"} <= set(mixing.mixed(odd, keep).columns)
    assert {"_license", "license", "_text"} <= set(licenses.scanned(odd, keep).columns)
    pages = odd.select(F.lit("http://a.b/c").alias("url"), F.lit("x").alias("html"), *keep)
    got = url_filter.judged(pages, keep)
    assert {"_verdict", "verdict", "_host"} <= set(got.columns) and got.count() == docs.count()
    assert quality.filtered(odd).columns == odd.columns == near_dup.deduplicated(odd).columns == mixing.mix_rows(odd).columns


def test_empty_tables_and_repeated_rows(spark, docs):
    none = docs.where("false")
    items = spark.createDataFrame([(1, prose(3)), (2, prose(3))], "item_id bigint, text string")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://spam.x/y").alias("url"), F.lit(None).cast("string").alias("html"))
    path = queries.vocabulary("word_bpe_49k.json")
    assert pii.digest(none).isEmpty() and token_count.token_counts(none, path).isEmpty() and url_filter.judged(pages.where("false"), ["page_id"]).isEmpty()
    assert decontaminate.contaminated(none, items).isEmpty() and decontaminate.contaminated(docs, items.where("false")).isEmpty() and mixing.mix_rows(none).isEmpty() and quality.filtered(none).isEmpty()
    twice = docs.where("doc_id in (1, 3, 34)").unionByName(docs.where("doc_id in (1, 3, 34)"))
    for made in (pii.digest(twice), token_count.token_counts(twice, path), licenses.scanned(twice, ["doc_id"]), decontaminate.contaminated(twice, items), language_id.identified(twice), url_filter.judged(pages.unionByName(pages), ["page_id"]), quality.judged(twice, ["doc_id"])):
        counts = Counter(tuple(r) for r in made.collect())
        assert counts and all(n % 2 == 0 for n in counts.values())
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(twice, items).collect()) == [(3, 1), (3, 1), (3, 2), (3, 2)]


def test_long_texts_and_ties(spark):
    rows = spark.createDataFrame([(1, "a@b.co " + "x" * 300_000 + " 8.8.8.8"), (2, "word " * 60_000 + LINE)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.digest(rows).collect()}
    assert (got[1].n_email, got[1].n_ip) == (1, 1)
    assert {r.doc_id: r.license for r in licenses.scanned(rows, ["doc_id"]).collect()} == {1: None, 2: "Apache-2.0"}
    wrapped = spark.createDataFrame([(1, "see Licensed under the Apache\nLicense,\nVersion 2.0. and more"), (2, "x Released under the MIT License. Licensed under CC BY 4.0. y")], "doc_id bigint, text string")
    assert {r.doc_id: (r.license, r.dice, r.n_matches) for r in licenses.scanned(wrapped, ["doc_id"]).collect()} == {1: ("Apache-2.0", 1.0, 1), 2: ("MIT", 1.0, 2)}
    same = spark.createDataFrame([(i, "one two three four five", "s") for i in (5, 5, 5, 6)], "doc_id bigint, text string, source string")
    mixed = mixing.mixed(same, ["doc_id"]).collect()
    assert sum(r.taken for r in mixed) == int(mixed[0].target)


def test_pipeline_against_brute_force(spark, sf_dir, sql):
    """Every stage by plain means: the quality SQL, all pairs, shingle sets, the mixing SQL, the tokenizers library."""
    import corpus_pipeline

    kept = {r[0] for r in sql.sql(f"select doc_id from ({queries.ORACLES['op7_quality']}) where kept").fetchall()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.doc_id in kept}
    classes = brute_classes({k: r.text for k, r in docs.items()})
    docs = {k: r for k, r in docs.items() if classes[k] == k}
    grams = lambda t: {x for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")] for x in zip(*(w[i:] for i in range(5)))}
    items = [s for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (s := grams(r.text))]
    docs = {k: r for k, r in docs.items() if not any(len(s & grams(r.text)) >= 0.8 * len(s) for s in items)}
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.values()]))
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")), Counter()
    for doc_id, size, taken in con.sql(f"select doc_id, size, taken from ({mixing.ORACLE_SQL})").fetchall():
        text, words = docs[doc_id].text or "", re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", docs[doc_id].text or "")
        for body in [text] * (taken // size) + (["".join(words[: taken % size])] if taken % size else []):
            ids = [*library.encode(body, add_special_tokens=False).ids, 0]
            want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and len(got) > 20


def test_every_page_is_judged_as_by_one_model(spark, sf_dir):
    """The query against one lexicon and one model in memory; all pages are in the sample here."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = url_filter.parts("url")
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    rows = pages.select("page_id", host.alias("h"), path.alias("p"), text.alias("t")).collect()
    assert len(rows) <= url_filter.SAMPLE
    model = url_filter.UrlModel([(r.h, r.p, r.t) for r in rows])
    got = {r.page_id: r for r in url_filter.judged(pages, ["page_id"]).collect()}
    assert len(got) == len(rows)
    for r in rows:
        mine, score = got[r.page_id], model.score(r.h, r.p)
        assert (mine.host, mine.path) == (r.h, r.p) and (mine.score is None) == (score == -math.inf)
        assert mine.score is None or mine.score == pytest.approx(score)
        fits = [(len(h + p), kind, h + p) for kind, h, p in url_filter.RULES if (r.h == h or r.h.endswith("." + h)) and r.p.startswith(p)]
        assert (mine.rule, mine.verdict) == ((max(fits)[2], max(fits)[1]) if fits else (None, "block" if score > 0 else "allow"))


def test_urls_of_any_length(spark):
    long = "q" * 100_000
    rows = [(1, f"http://{long}casino.example.com/{long}", "<p>casino news"), (2, f"http://a.example.com/{'news/' * 20_000}", None), (3, None, None)]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string"), ["page_id"]).collect()}
    assert got[1].host == f"{long}casino.example.com" and got[1].verdict == "block" and got[3].verdict == "allow"


def test_groups_have_their_own_ceilings(spark):
    """Texts of one source have more symbols where they have any, and both quartiles are 0 in both."""
    rows = []
    for source, times in (("plain", 1), ("code", 30)):
        for i in range(400):
            words = prose(1000 * times + i, 100).split()
            if i % 8 == 0:
                words[::10] = ["#" * times] * 10
            rows.append((i, " ".join(words), "en", source))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.source: r for r in quality.thresholds(quality.sketches(quality.measured(docs, ["lang", "source"]), "lang", "source")).collect()}
    assert got["code"].symbol_share > 1.5 * got["plain"].symbol_share and got["plain"].symbol_share > 0.02


def test_ceilings_follow_the_groups(spark, sf_dir):
    rows = quality.measured(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["lang", "source"])
    got = quality.thresholds(quality.sketches(rows, "lang", "source")).collect()
    for c in quality.SLACK:
        assert len({round(r[c], 6) for r in got}) > 1
