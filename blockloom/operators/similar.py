"""The most similar of a page's texts, without comparing all pairs.

Similarity is that of matching blocks. Matching blocks can't hold more characters than both
texts have in common as multisets, so 2 * common / (both lengths) bounds it from above. A
page's bounds come from a table of character counts; comparisons go down the bounds and end
where no bound is above the best found, so the result is that of all pairs.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of a table of character counts; more texts come as further tables.
TABLE = 1 << 22


def similarity(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def closest(texts: Sequence[str | None], among: Sequence[str | None]) -> tuple[list[tuple[int | None, float | None]], int]:
    """For each text the place of the most similar of among, the first of equals, and its similarity (both None without either); and the number of comparisons."""
    first: dict[str, int] = {}
    for i, other in enumerate(among):
        if other is not None:
            first.setdefault(other, i)
    best: dict[str, tuple[int | None, float]] = {t: (None, -1.0) for t in texts if t is not None}
    best |= {t: (first[t], 1.0) for t in best if t in first}
    # only an equal text has similarity 1, but for two empty ones, which are equal
    open_texts = [t for t in best if t not in first]
    others = list(first)
    codes = [_codes(o) for o in others]
    alphabet = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint32)
    compared, step = 0, max(1, TABLE // max(len(alphabet), 1))
    for lo in range(0, len(others) if open_texts else 0, step):
        part = codes[lo : lo + step]
        counts = np.zeros((len(part), len(alphabet)), np.int32)
        for row, found in enumerate(part):
            np.add.at(counts[row], np.searchsorted(alphabet, found), 1)
        length = np.array([len(c) for c in part])
        for text in open_texts:
            chars, n = np.unique(_codes(text), return_counts=True)
            at = np.searchsorted(alphabet, chars)
            known = at < len(alphabet)
            known[known] = alphabet[at[known]] == chars[known]
            common = np.minimum(counts[:, at[known]], n[known]).sum(1)
            bound = 2.0 * common / (length + len(text))
            where, score = best[text]
            for j in np.argsort(-bound, kind="stable"):
                # later tables hold later texts, so of equals the first stays
                if bound[j] < score or (bound[j] == score and where is not None and first[others[lo + j]] > where):
                    break
                compared += 1
                found = similarity(text, others[lo + j])
                place = first[others[lo + j]]
                if found > score or (found == score and place < where):
                    where, score = place, found
            best[text] = (where, score)
    return [(None, None) if t is None or best[t][0] is None else best[t] for t in texts], compared


def closest_of(texts: Column, among: Column) -> Column:
    """closest() of two arrays of strings: an array of (at, score), one a text."""

    @F.pandas_udf("array<struct<at:int,score:double>>")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"at": at, "score": score} for at, score in closest(list(a), [] if b is None else list(b))[0]] for a, b in zip(x, y)], dtype=object)

    return of(texts, among)
