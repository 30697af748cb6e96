"""Line dedup, aligned tokens and phrases against plain versions, with odd texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

from blockloom.llm import line_dedup, phrases, slices, token_alignment
from blockloom.llm.queries import vocabulary
from blockloom.llm.token_count import byte_alphabet

SCHEMA = "doc_id bigint, text string, lang string, rid string, found string, c0 string, digest string, phrase string, slice string, pairs string, `key` string"
BLANK = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"rfcdpsxk") for r in rows], SCHEMA).repartition(3)


# --- lines


def key(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def line_rows():
    rng = random.Random(3)
    pool = ["Menu", " MENU ", "Ünder", "ÜNDER", "x\r", "  ", "", "Share this", "a b", "é", "long " * 2000]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {i} {j}" for j in range(rng.randrange(0, 7))), "en") for i in range(40)]
    return rows + [(100, None, None), (101, "", "en"), (102, "\n\n", "en"), (None, "menu\nmenu\nx", "en"), (5, "menu", "en"), (5, "menu", "en"), (103, "only here\nonly here", "en")]


def test_lines_of_many_documents(spark):
    rows = line_rows()
    docs = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    for least, chars in ((10, 1), (3, 3)):
        want = []
        for i, t, _ in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if len(key(x)) < max(1, chars) or docs[key(x)] < least]
            want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        got = line_dedup.digest(table(spark, rows), min_docs=least, min_chars=chars, bits=1 << 20)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    whole = line_dedup.without_shared(table(spark, rows))
    assert whole.columns == table(spark, rows).columns
    by = {r.doc_id: r for r in whole.collect()}
    assert by[100].text is None and by[102].text == "\n\n" and by[103].text == "only here\nonly here" and by[101].rid == "r"


def test_first_lines_stay(spark):
    rows = [(i, t, g) for i, (_, t, g) in enumerate(line_rows())]
    docs = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    held, want = set(), {}
    for i, t, _ in rows:
        kept = []
        for x in (t or "").split("\n"):
            if not key(x) or docs[key(x)] < 2 or key(x) not in held:
                kept.append(x)
                if key(x):
                    held.add(key(x))
            # later lines of the same key go, in the first document too
        want[i] = None if t is None else "\n".join(kept)
    # a key of one document keeps all its lines
    want[len(rows) - 1] = "only here\nonly here"
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(table(spark, rows)).collect()}
    assert got == want


def test_two_filters_fold_in_any_order():
    rng = np.random.default_rng(1)
    each = [rng.integers(0, 1 << 62, 500).astype(np.uint64) for _ in range(4)]
    shared = each[0][:50]
    each[2][:50] = shared
    for order in ([0, 1, 2, 3], [2, 3, 1, 0]):
        state = np.zeros((2, slices.SLICE), np.uint8)
        for i in order:
            seen = line_dedup.TwoFilters(8 * slices.SLICE)
            seen.add(each[i])
            for batch in slices.cut(seen.once, seen.twice):
                for at, x, y in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                    where = np.frombuffer(at, np.uint32) if at else slice(None)
                    line_dedup._fold(state, where, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
        inside = [all(state[1][p >> 3] >> (p & 7) & 1 for p in (int(h) & (8 * slices.SLICE - 1), int(h) >> 32 & (8 * slices.SLICE - 1))) for h in shared]
        assert all(inside)
        assert np.unpackbits(state[1]).sum() < 400  # but for chance, only those


def test_dense_slices_are_whole():
    rng = np.random.default_rng(2)
    for share in (0.001, 0.6):
        x = np.where(rng.random(2 * slices.SLICE) < share, rng.integers(1, 99, 2 * slices.SLICE), 0).astype(np.uint8)
        back = np.zeros_like(x)
        for batch in slices.cut(x):
            for k, at, v in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                part = back[k * slices.SLICE : (k + 1) * slices.SLICE]
                part[np.frombuffer(at, np.uint32) if at else slice(None)] = np.frombuffer(v, np.uint8)
        assert (x == back).all()


# --- phrases


def plain_phrases(rows, least, longest, cover, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        many = {p: n for p, n in c.items() if len(p) > 1 and n >= least}
        found = []
        for p, a in many.items():
            if any(len(q) > len(p) and b * 100 >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in many.items()):
                continue
            score, cut = min((1000 * a * totals[lang] // (c[p[:j]] * c[p[j:]]), j) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "cover", "top"), [(5, 5, 100, 2000), (3, 4, 60, 7), (300, 3, 100, 5)])
def test_phrases(spark, least, longest, cover, top):
    rng = random.Random(4)
    words = ["new", "New", "york", "city", "of", "the", "Ünder", "é　x", "a-b", "it's", "x" * 3000]
    def text():
        return "".join(rng.choice(words[: rng.choice((4, 6, 11))]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!", "\x1c"]) for _ in range(rng.randrange(0, 60)))
    rows = [(i, text(), rng.choice(["en", "en", "de", None, "und"])) for i in range(120)] + [(200, None, "en"), (201, "", "fr"), (202, "one two", "es")]
    got = phrases.collocations(table(spark, rows), least=least, longest=longest, cover=cover, top=top, buckets=1 << 17)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, longest, cover, top)


def test_scores_pass_64_bits(spark):
    expr = phrases.SCORE.replace("total", "n")
    big = [(3 * 10**12 + 7, 9 * 10**13 + 1, 4 * 10**12 + 9, 10**13 + 3), (100, 10**15, 100, 100), (10**6, 10**6, 10**6, 10**6)]
    got = spark.createDataFrame(big, "a bigint, n bigint, l bigint, r bigint").selectExpr("a", "n", "l", "r", f"{expr} as score").collect()
    assert [r.score for r in got] == [1000 * a * n // (left * right) for a, n, left, right in big]


# --- tokens

ODD = [
    None, "", "a  b   c", "   lead", "tail   ", "x▁y", "<s> </s> <|endoftext|> <unk> <0x0A>", "日本語 テスト　全角 空白", "a  b  c  d", "\n\n \n a\t b \r\n", "\x00 \x1c z", "é ́x",
    "🙂🙂 👩‍👩‍👧 ok", "haha hahaha " * 50, "-----------------------------" * 20, "it's I'll  don't 've", "Ａ﷽ ﬁ", " ", "▁", "a" * 5000, "\x85 x\x85 y", "  a　 b", "same text", "same text",
]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    back = {c: i for i, c in enumerate(byte_alphabet())}
    in_a = {i: bytes(back[c] for c in w) if all(c in back for c in w) else w.encode() for w, i in a.get_vocab().items()}
    in_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    each, counts = [], Counter()
    for i, text in rows:
        ids_a = ids_b = []
        if text:
            ids_a, ids_b, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
            if b"".join(in_a[t] for t in ids_a) != raw or b"".join(in_b[t] for t in ids_b) != raw:
                ids_a = ids_b = []
        ends = [{sum(len(v[t]) for t in ids[:n]): n for n in range(1, len(ids) + 1)} if len(ids) < 50 else dict(zip(np.cumsum([len(v[t]) for t in ids]).tolist(), range(1, len(ids) + 1))) for ids, v in ((ids_a, in_a), (ids_b, in_b))]
        common = [(0, 0), *((ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys()))]
        groups = [(ids_a[x:y], ids_b[p:q]) for (x, p), (y, q) in pairwise(common)]
        links = Counter((s, t) for g, h in groups for s in g for t in h)
        counts.update(links.keys())
        each.append((i, len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (s, _), n in counts.items():
        best[s] = max(best[s], n)
    out = []
    for i, n_a, n_b, groups, links in each:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, n_a, n_b, len(groups), links.total(), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark):
    rows = [*enumerate(ODD), (None, "same text"), (3, "again 3"), (3, "again 3")]
    got = token_alignment.digest(table(spark, [(*r, "en") for r in rows]), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert sorted(got.columns) == sorted(COLUMNS)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == plain_alignment(rows)


def test_alignment_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = token_alignment.digest(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == plain_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_components():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randrange(1, 40)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 30))]
        label = list(range(n))
        for _ in range(n):
            for x, y in edges:
                label[x] = label[y] = min(label[x], label[y])
        u, v = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        assert token_alignment.components(u, v, n).tolist() == label


def test_empty_tables(spark):
    empty = table(spark, [(1, "x", "en")]).where("false")
    assert line_dedup.digest(empty).isEmpty() and line_dedup.deduplicated(empty).isEmpty()
    assert phrases.collocations(empty).isEmpty()
    assert token_alignment.digest(empty, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).isEmpty()
