"""The most similar of a page's texts."""

from __future__ import annotations

import random

from blockloom.operators import pdf_layout, similar


def all_pairs(texts, among):
    out = []
    for t in texts:
        scores = [(similar.similarity(t, o), -i) for i, o in enumerate(among) if t is not None and o is not None]
        best = max(scores, default=None)
        out.append((None, None) if best is None else (-best[1], best[0]))
    return out


def page(seed, lines, odd=0.3):
    """Lines of a page and a reading of them with some characters changed, words swapped, lines joined or made up."""
    r = random.Random(seed)
    words = ["".join(r.choices("etaoinshrdlucmfw", k=r.randint(2, 9))) for _ in range(400)] + [str(n) for n in range(50)]
    seen = [" ".join(r.choices(words, k=r.randint(4, 12))) for _ in range(lines)]
    read = []
    for i, line in enumerate(seen):
        if r.random() < odd:
            chars = list(line)
            for _ in range(r.randint(1, 4)):
                chars[r.randrange(len(chars))] = r.choice("xyz0")
            line = "".join(chars)
        if r.random() < 0.05:
            line = f"{line} {seen[i - 1]}"
        if r.random() < 0.03:
            line = " ".join(r.choices(words, k=6))
        read.append(line)
    return read, seen


def test_same_as_all_pairs_with_a_tenth_of_the_comparisons():
    read, seen = page(1, 150)
    got, compared = similar.closest(read, seen)
    assert got == all_pairs(read, seen) and compared <= len(read) * len(seen) / 10


def test_tables_of_few_texts_change_nothing(monkeypatch):
    read, seen = page(2, 40, odd=0.9)
    whole = similar.closest(read, seen)[0]
    monkeypatch.setattr(similar, "TABLE", 50)
    assert similar.closest(read, seen)[0] == whole == all_pairs(read, seen)


def test_odd_texts():
    """Nulls, empty texts, ties and repeats, other scripts, nothing in common, a text long enough for popular characters to be passed over."""
    among = ["", "ab", "ba", "ab", None, "漢字 かな", "a" * 300 + "b", "🙂", "zz"]
    texts = ["", "ab", "abx", "ba ab", None, "漢字", "a" * 299, "qqq", "🙂!", "ab"]
    assert similar.closest(texts, among)[0] == all_pairs(texts, among)
    for none in ([], [None]):
        assert similar.closest(["a", None], none) == ([(None, None), (None, None)], 0)
    assert similar.closest([], among) == ([], 0)


def test_verdicts_over_pages(spark):
    """Every read line of every page once, with the match of all pairs; a page without detected lines, null and repeated texts."""
    rows, seen_rows, wanted = [], [], {}
    for p in range(3):
        read, seen = page(10 + p, 30)
        read, seen = [*read, read[0], None], sorted([*seen, seen[0]])
        rows += [("d", p, 0, i, t) for i, t in enumerate(read)]
        seen_rows += [("d", p, t, [0.0, 0.0, 1.0, float(i)]) for i, t in enumerate(seen)]
        wanted |= {(p, i): (seen[at] if at is not None else None, score) for i, (at, score) in enumerate(all_pairs(read, seen))}
    rows += [("d", 9, 0, 0, "alone")]
    wanted[(9, 0)] = (None, None)
    read_df = spark.createDataFrame(rows, "doc_id string, page int, place int, line_no int, text string")
    seen_df = spark.createDataFrame(seen_rows, "doc_id string, page int, text string, bbox array<double>")
    got = pdf_layout.verified_lines(read_df, seen_df).collect()
    assert {(r.page, r.line_no): (r.match, r.score) for r in got} == wanted and len(got) == len(rows)
    assert {r.verdict for r in got if r.page == 9 or r.text is None} == {"full"}
