"""Vectorised kernels against plain Python."""

from __future__ import annotations

import random
import time
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blockloom.llm import decontaminate, language_id, licenses, near_dup, pii, quality, textgrid, token_count, token_store, url_filter
from blockloom.llm.perfect_hash import PerfectHash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", "a b", "\n", "x\n\nx\n x", "é ü\té\x0bé", "w " * 50, "end", "a b c d e f g h i a b c d e f g h", " b\r\nb\r\n", "[#] *$% &|<>", "日本 語 x", "l" * 3000]


def test_words_and_hashes():
    for limit in (1, 7, 1 << 20):
        seen = {}
        got = []
        for b in textgrid.blocks(pa.array(TEXTS), limit):
            b.find_words()
            h = b.word_hashes()
            for i in range(b.rows):
                lo, hi = b.word_bounds[i], b.word_bounds[i + 1]
                words = [b.data[b.starts[k] : b.ends[k]].tobytes().decode() for k in range(lo, hi)]
                got.append(words)
                for w, x in zip(words, h[lo:hi].tolist()):
                    assert seen.setdefault(w, x) == x
        assert got == [WORDS.findall(t or "") for t in TEXTS]
        assert len(set(seen.values())) == len(seen)


def plain_counts(text):
    t = text or ""
    w = WORDS.findall(t)
    lines, seen, dup = [x for x in t.split("\n") if WORDS.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_quality_counts():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a", "b ", "\n", "é ", " ", "# "]) for _ in range(rng.randrange(200))) for _ in range(100)]
    m = quality.measure(pa.array(texts))
    got = list(zip(*(m[c].tolist() for c in quality.COUNTS)))
    assert got == [plain_counts(t) for t in texts]


@pytest.fixture(scope="module")
def word_bpe():
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_count.PairMerger(path), Tokenizer.from_file(path)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_token_counts(word_bpe, text):
    merger, library = word_bpe
    texts = [text, text + "<|endoftext|>" + text, f" {text}\n{text} "]
    assert merger.count_column(pa.array(texts)).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_edges(word_bpe):
    merger, library = word_bpe
    texts = [t or "" for t in TEXTS] + ["İstanbul ΣΑΣ", "don't we'll", "<|startoftext|>a<|endoftext|>", "é x"]
    assert merger.count_column(pa.array(texts)).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab '\n\t  é<|endoftx>.9", max_size=40), max_size=5))
def test_token_ids(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_store.encoder(path)
    ids = [i.tolist() for i, _ in encoder.column(pa.array(texts, pa.string()))]
    want = [e.ids + [0] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)] if texts else []
    assert sum(ids, []) == sum(want, [])


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    keys = np.unique(np.concatenate([keys, np.arange(10, dtype=np.uint64)]))
    h = PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    again = PerfectHash.load(h.dump())
    assert (again.slots(keys[:100]) == h.slots(keys[:100])).all()
    assert PerfectHash.build(np.zeros(0, np.uint64)).slots(keys[:2]).tolist() == [-1, -1]
    same = PerfectHash.build(np.array([5, 5, 7], np.uint64))
    assert len(same.rest) == 2


BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1b2.@+- ()%59_0é\n", max_size=60))
def test_base_spans(text):
    assert pii.detect(text) == plain_spans(text)


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("x john.doe (at) ex (dot) com y", "email", "john.doe (at) ex (dot) com"), ("john at mail dot ex dot com", "email", "john at mail dot ex dot com"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("plus one five five five zero one two three four five six", "phone", "plus one five five five zero one two three four five six"), ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
])
def test_disguises_map_back(text, kind, value):
    base, spans = pii.find(text)
    assert not base and [(k, text[a:b]) for k, a, b in spans] == [(kind, value)]


def test_plain_prose_has_no_spans():
    for text in ("he was at the house. dot on it", "one two three", "call at ten", None, "a.b.c 1.2.3"):
        assert pii.find(text) == ([], [])


def test_segments_and_verdicts():
    model = url_filter.UrlModel([("www.cheap-pills.example.com", "/en/1", "the news of the world")] * 5 + [("news.example.com", "/en/2", "the world news today")] * 30)
    assert model.lexicon.split("cheappills") == ["cheap", "pills"] and model.lexicon.split("qzxv") == ["qzxv"]
    assert model.score("cheappills.example.org", "/") > 0 > model.score("news.example.org", "/en/3")
    assert model.lexicon.split("a" * 200)


def test_containment_is_exact():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (3, 5, 12, 40, 150)]
    docs = [" ".join([word() for _ in range(n)]) for n in (0, 4, 100, 5000)]
    docs += [f"{docs[3]} {x} {docs[2]}" for x in items]
    w = items[3].split()
    docs += [" ".join([*w[:20], *(word() for _ in range(300)), *w[20:]]), " ".join(w[:30]), None]
    index = decontaminate.ItemIndex(items)
    got = {(lo + t, i) for lo, _, h, b in decontaminate.shingle_hashes(pa.array(docs)) for t, i, _ in index.contained(h, b)}
    sets = lambda t: {tuple(x[i : i + 5]) for x in [(t or "").split()] for i in range(len(x) - 4)}
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if sets(x) and len(sets(x) & sets(t)) >= 0.8 * len(sets(x))}
    assert got == want and {(4 + k, k) for k in range(1, 5)} <= got


def test_samples_estimate_weighted_similarity():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    a = [rng.choice(words) for _ in range(600)]
    b = list(a)
    for i in range(0, 600, 40):
        b[i] = rng.choice(words)
    texts = pa.array([" ".join(a), " ".join(b), " ".join(a[:100] * 3)])
    weights = near_dup.Weights(np.zeros(0, np.uint64), np.zeros(0))
    (block,) = textgrid.blocks(texts)
    h, row = near_dup.shingles(block)
    s = near_dup.signatures(h, row, 3, weights)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert abs((s[i] == s[j]).mean() - near_dup.similarity(h[row == i], h[row == j], weights)) < 0.2
    heavy = near_dup.Weights(h[row == 0][:300], np.full(300, 0.8))
    t = near_dup.signatures(h, row, 3, heavy)
    assert abs((t[0] == t[1]).mean() - near_dup.similarity(h[row == 0], h[row == 1], heavy)) < 0.2


def test_anchors_lose_nothing():
    for name, text in licenses.TEMPLATES:
        pairs = licenses.pairs_of(text)
        lacking = len(pairs) - licenses.bounds(len(pairs), 0.8)[0]
        assert sum(p in licenses.anchors(text, 0.8) for p in pairs) > lacking, name


def test_windows_cover_texts():
    data, offsets = textgrid.strings(pa.array(["a" * 300, "", "b"]))
    starts, sizes, text = language_id.windows(data, offsets)
    assert list(zip(sizes.tolist(), text.tolist())) == [(128, 0), (128, 0), (44, 0), (1, 2)]


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("ask anna at example.com now", "email", "anna at example.com"), ("ask anna@example dot com now", "email", "anna@example dot com"), ("on 192 dot 168 dot 1 dot 7 now", "ip", "192 dot 168 dot 1 dot 7"),
    ("on 8 dot 8 dot 8 dot 8 now", "ip", "8 dot 8 dot 8 dot 8"), ("on ¹⁰.0.0.1 now", "ip", "¹⁰.0.0.1"),
])
def test_disguises_need_no_other_sign(text, kind, value):
    for rest in ("", " with [dot] elsewhere"):
        assert [(k, text[a:b]) for k, a, b in pii.find(text + rest)[1] if (k, a, b) not in pii.detect(text)] == [(kind, value)]


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("on eight dot eight dot eight dot eight now", "ip", "eight dot eight dot eight dot eight"), ("on one two seven dot zero dot zero dot one now", "ip", "one two seven dot zero dot zero dot one"),
    ("ask john (dot) doe@example.com now", "email", "john (dot) doe@example.com"), ("ask doe@example.com (dot) uk now", "email", "doe@example.com (dot) uk"),
])
def test_short_addresses_and_longer_spans(text, kind, value):
    base, spans = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in spans if (k, a, b) not in base] == [(kind, value)] and set(base) <= set(spans)
    assert pii.find("one two three four. five dot six")[1] == []


def test_short_items_are_always_found():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [" ".join(word() for _ in range(5 + k % 16)) for k in range(1600)]
    filler = [word() for _ in range(600)]
    docs = [" ".join([*filler[:at], items[i], *filler[at:]]) for i in range(len(items)) for at in [rng.randrange(600)]]
    index = decontaminate.ItemIndex(items)
    got = {(lo + t, i) for lo, _, h, b in decontaminate.shingle_hashes(pa.array(docs)) for t, i, _ in index.contained(h, b)}
    assert got == {(i, i) for i in range(len(items))}


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("on ٨.٨.٨.٨ now", "ip", "٨.٨.٨.٨"), ("two ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"), ("plus one (five five five) zero one two three four five six", "phone", "plus one (five five five) zero one two three four five six"),
    ("𝗷ohn@example.com", "email", "𝗷ohn@example.com"), ("a@b.example (dot) com", "email", "a@b.example (dot) com"),
])
def test_digits_of_all_scripts_and_mixed_figures(text, kind, value):
    base, spans = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in spans if (k, a, b) not in base] == [(kind, value)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1٣４ @.+(-)dotaneｏо", max_size=50))
def test_spans_lie_in_the_text_and_base_spans_stay(text):
    base, spans = pii.find(text)
    assert set(base) <= set(spans) and len(set(spans)) == len(spans) and all(0 <= a < b <= len(text) for _, a, b in spans) and base == plain_spans(text)


def best_cost(name, lexicon):
    """The best split by trying all."""
    best = None
    for cuts in range(1 << max(0, len(name) - 1)):
        parts, last = [], 0
        for i in range(1, len(name) + 1):
            if i == len(name) or cuts >> (i - 1) & 1:
                parts.append(name[last:i])
                last = i
        cost = sum(lexicon.log.get(p, lexicon.unknown - url_filter.LETTER * len(p)) for p in parts)
        best = cost if best is None else max(best, cost)
    return best


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=10), st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=4), st.integers(1, 50)), max_size=8))
def test_viterbi_finds_the_best_split(name, counts):
    lexicon = url_filter.Lexicon(Counter(dict(counts)))
    words = lexicon.split(name)
    assert "".join(words) == name
    assert sum(lexicon.log.get(w, lexicon.unknown - url_filter.LETTER * len(w)) for w in words) == pytest.approx(best_cost(name, lexicon))


def test_long_names_stay_whole_and_bayes_is_plain():
    model = url_filter.UrlModel([("spamfarm.example.com", "/a", ""), ("news.example.com", "/a", "")] * 4)
    assert model.lexicon.split("q" * 200) == ["q" * 200]
    rows = [(["spam", "farm"], True)] * 4 + [(["news"], False)] * 4
    seen = {k: Counter(w for ws, bad in rows if bad is k for w in [*ws, "example", "a"]) for k in (True, False)}
    seen[True].update(url_filter.SEEDS)
    v = len(seen[True] | seen[False]) + 1
    like = lambda w, k: (seen[k][w] + 1) / (sum(seen[k].values()) + v)
    import math

    want = math.log(5 / 5) + sum(math.log(like(w, True) / like(w, False)) for w in ("news", "example", "spam"))
    assert model.score("news.example.spam.org", "") == pytest.approx(want)


def test_shingle_bounds_exclude_no_alike_pair():
    """Every pair of SIMILARITY or more has a named shingle that allows it, in any order of shingles."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        u = rng.integers(0, 1 << 60, 40).astype(np.uint64)
        x, y = ({int(h): w for h, w in zip(u[rng.random(40) < 0.93], rng.random(40) + 0.5)} for _ in range(2))
        for h in set(x) & set(y):
            if rng.random() < 0.8:
                y[h] = x[h]
        least = sum(min(x[h], y[h]) for h in set(x) & set(y))
        alike = least / (sum(x.values()) + sum(y.values()) - least)
        order = rng.permutation(sorted(set(x) | set(y))).tolist()
        sides = []
        for t in (x, y):
            total, before, named = sum(t.values()), 0.0, {}
            for h in order:
                if h in t:
                    if total - before >= near_dup.SIMILARITY * total - 1e-6:
                        named[h] = total - before
                    before += t[h]
            sides.append((named, total))
        (p, tx), (q, ty) = sides
        found = any(len(near_dup.possible(np.array([0, 1]), np.array([p[h], q[h]]), np.array([tx, ty]), np.array([0]), np.array([1]))[0]) for h in set(p) & set(q))
        assert found or alike < near_dup.SIMILARITY


def test_language_scores_are_a_plain_convolution():
    """Embedding, filters of each width at every place, the greatest answer, softmax, and the mean over windows, one by one."""
    net = language_id.ByteConv(["a", "b", "c"], seed=3)
    texts = ["plain ascii text", "é" * 150, "x"]
    best, score = net.judge(pa.array(texts))
    embed, kernel = net.p["embed"].astype(float), net.p["kernel"].astype(float)
    for t, text in enumerate(texts):
        raw, total = text.encode(), np.zeros(3)
        for lo in range(0, len(raw), language_id.WINDOW):
            part = raw[lo : lo + language_id.WINDOW]
            codes = [b + 1 for b in part] + [0] * (language_id.WINDOW - len(part) + net.wide)
            hidden = np.zeros(net.filters)
            for f in range(net.filters):
                width = language_id.WIDTHS[f // language_id.FILTERS]
                answers = [sum(embed[codes[p + k]] @ kernel[k, :, f] for k in range(width)) for p in range(language_id.WINDOW)]
                hidden[f] = max(0.0, max(answers) + net.p["bias"][f])
            z = hidden @ net.p["out"].astype(float) + net.p["out_bias"]
            total += (z - np.log(np.exp(z).sum())) * len(part)
        p = np.exp(total / len(raw))
        p /= p.sum()
        assert best[t] == p.argmax() and score[t] == pytest.approx(p.max(), rel=1e-3)


def test_idf_falls_with_frequency():
    w = near_dup.idf(np.array([1, 10, 100, 1000]), 1000, 10.0)
    assert (np.diff(np.minimum(w, 1)) <= 0).all() and w[-1] == near_dup.LOW and w[1] == 1 and (near_dup.idf(np.array([1]), 1, 1.0) == 1).all()


def test_long_cuts_are_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_store.Encoder(path)
    texts = ["ab " + "x1" * (token_store.LONG_CUT // 2 + 1), "ab cd"]
    got = np.concatenate([i for i, _ in encoder.column(pa.array(texts))]).tolist()
    assert got == sum((e.ids + [0] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)), [])


@pytest.mark.parametrize("unit", ["12.5 ", "one two ", "a at b.c ", "+1 2", "1.O."])
def test_spans_take_time_in_proportion(unit):
    took = []
    for size in (400_000, 800_000):
        began = time.process_time()
        pii.find(unit * (size // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] < 2.3 * took[0] + 0.3


def test_five_megabytes_of_numbers():
    began = time.process_time()
    assert pii.find("12.5 " * 1_000_000) == ([], [])
    assert time.process_time() - began < 60


@pytest.mark.parametrize(("text", "found"), [
    ("look at example.com", None), ("I was at home.Then we left", None), ("meet me at the.park", None), ("mail anna at example.com", "anna at example.com"), ("j.doe at example.com", "j.doe at example.com"),
    ("anna at example dot com", "anna at example dot com"), ("anna(a)example.com", "anna(a)example.com"), ("from 192.168.O.1 on", "192.168.O.1"), ("E-mail: anna at example.com", "anna at example.com"),
])
def test_words_for_at(text, found):
    assert [text[a:b] for _, a, b in pii.find(text)[1]] == ([found] if found else [])


def test_a_name_of_a_million_letters():
    lexicon = url_filter.Lexicon(Counter({"news": 50, "site": 50}))
    began = time.process_time()
    words = lexicon.split("q" * 500_000 + "newssite" + "q" * 500_000)
    assert words == ["q" * 500_000, "news", "site", "q" * 500_000]
    assert time.process_time() - began < 60
