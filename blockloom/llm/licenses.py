"""License scans with DataFrame functions only.

Units of a text are the whole text, its lines, its sentences, and for each template all
windows of as many words as the template has, across lines and sentences (cut short at the
text's ends); so a notice that is wrapped, or stands inside a longer sentence, is a unit. A
unit is lower-cased, every run of other characters than letters and digits becomes one
space, and its set of adjacent word pairs is compared with each template's by the Dice
coefficient, 2 * |A and B| / (|A| + |B|); windows only with the template that they are of.
A unit matches from THRESHOLD on. At threshold t a match
needs t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|, so units of other sizes are pruned
per template. It also shares at least t / (2 - t) of the template's pairs; so if more
pairs than the rest are taken as anchors, every match holds an anchor: a text in
which none occurs needs no units at all, and only windows around an anchor of their template
are laid out. All prunings lose nothing.

There is no shuffle: a row is judged by itself.

Cases: null or empty text has no license; of equal scores the first template in the
list wins; repeated rows each get their row; very long texts are scanned whole and only cost
their own units; an empty table gives no rows; kept columns may have any name, and one that
is named like a result column comes back with `_` before it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept_as, plain_columns

THRESHOLD = 0.8

#: Short notices by which public licenses are commonly stated.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)

OTHER = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def pairs_of(text: str) -> list[str]:
    """Distinct adjacent word pairs of a template, in order."""
    words = words_of(text)
    return list(dict.fromkeys(" ".join(x) for x in zip(words, words[1:])))


def bounds(size: int, t: float) -> tuple[int, int]:
    """Sizes that a unit can have to match a template of this size."""
    return math.ceil(size * t / (2 - t) - 1e-9), math.floor(size * (2 - t) / t + 1e-9)


def anchors(text: str, t: float) -> list[str]:
    """Pairs of a template, one more than a match can lack; longer pairs are rarer in prose."""
    pairs = sorted(pairs_of(text), key=lambda p: (-len(p), p))
    return pairs[: 1 + len(pairs) - math.ceil(len(pairs) * t / (2 - t) - 1e-9)]


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), OTHER, " "))


def _has_anchor(text: Column, found: list[str]) -> Column:
    low, any_of = F.lower(text), F.lit(False)
    for pair in found:
        a, b = pair.split(" ")
        first, second = sorted((a, b), key=len, reverse=True)
        any_of = any_of | (low.contains(first) & low.contains(second) & low.rlike(f"{a}{OTHER}{b}"))
    return any_of


def _of(words: Column) -> Column:
    """Adjacent pairs of an array of words, in order. words is used for every pair, so it must be a column or a lambda's argument, not an expression."""
    pair = lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1))
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), pair)).otherwise(F.array().cast("array<string>"))


def scanned(docs: DataFrame, keep: list[str], text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """keep, then license, dice (of the best unit) and n_matches (templates that some unit matches)."""
    plain, at = plain_columns(docs)
    inner = list(dict.fromkeys(at[c] for c in keep))
    sets = [pairs_of(x) for _, x in templates]
    limits = [bounds(len(s), threshold) for s in sets]
    marks = [anchors(x, threshold) for _, x in templates]
    every = list(dict.fromkeys(p for m in marks for p in m))
    lowest, highest = min(a for a, _ in limits), max(b for _, b in limits)
    listed = F.array(*[
        F.struct(
            F.lit(i).alias("at"), F.lit(name).alias("name"), F.array(*map(F.lit, s)).alias("pairs"), F.lit(len(s)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
            F.array(*map(F.lit, m)).alias("anchors"), F.lit(len(words_of(text)) - 1).alias("wide"),
        )
        for i, ((name, text), s, (lo, hi), m) in enumerate(zip(templates, sets, limits, marks))
    ])
    body = F.when(F.coalesce(_has_anchor(F.col(at[text]), every), F.lit(False)), F.col(at[text]))
    rows = plain.select(*inner, body.alias("_text")).withColumn("_all", F.transform(F.array(F.split(normal(F.col("_text")), " ")), _of)[0])
    body = F.col("_text")
    sentences = F.split(F.regexp_replace(body, r"([.!?])[\x20\x09-\x0D]+", "$1\n"), "\n")
    units = F.array_distinct(F.transform(F.concat(F.split(body, "\n"), sentences), normal))
    units = F.filter(F.transform(units, lambda u: F.split(u, " ")), lambda w: F.size(w) > lowest)
    pairs = F.transform(F.concat(F.array(F.col("_all")), F.transform(units, _of)), F.array_distinct)
    pairs = F.filter(pairs, lambda p: F.size(p).between(lowest, highest))
    # where an anchor of any template stands
    spots = F.filter(F.sequence(F.lit(1), F.size("_all")), lambda i: F.element_at("_all", i).isin(every))
    spots = F.when(F.size("_all") > 0, spots).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*inner, "_all", pairs.alias("_units"), F.when(body.isNotNull(), spots).alias("_spots"))

    def dice(p: Column, m: Column) -> Column:
        return F.lit(2.0) * F.size(F.array_intersect(p, m["pairs"])) / (F.size(p) + m["n"])

    def best(m: Column) -> Column:
        """The best score of a template."""
        own = F.filter("_spots", lambda i: F.array_contains(m["anchors"], F.element_at("_all", i)))
        starts = F.array_distinct(F.flatten(F.transform(own, lambda i: F.sequence(i - m["wide"] + 1, i))))
        window = lambda i: F.array_distinct(F.slice("_all", F.greatest(i, F.lit(1)), m["wide"] + F.least(i, F.lit(1)) - 1))
        fits = lambda p: F.size(p).between(m["lo"], m["hi"])
        scores = F.transform(F.filter(F.concat("_units", F.transform(starts, window)), fits), lambda p: dice(p, m))
        return F.struct(F.coalesce(F.array_max(scores), F.lit(0.0)).alias("dice"), (-m["at"]).alias("at"), m["name"].alias("name"))

    hits = F.when(F.size("_spots") > 0, F.filter(F.transform(listed, best), lambda s: s["dice"] >= threshold))
    rows = rows.select(*inner, hits.alias("_hits"))
    top = F.array_max("_hits")
    kept = [F.col(at[c]).alias(n) for c, n in zip(keep, kept_as(keep, ("license", "dice", "n_matches")))]
    return rows.select(*kept, top["name"].alias("license"), top["dice"].alias("dice"), F.coalesce(F.when(F.size("_hits") >= 0, F.size("_hits")), F.lit(0)).cast("long").alias("n_matches"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB's SQL; only windows that hold no pair of their template are left out."""
    values = ", ".join(f"({i}, '{name}', {pairs_of(text)!r}, {len(words_of(text)) - 1})" for i, (name, text) in enumerate(TEMPLATES))
    whole, unit = (f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))" for x in ("text", "x"))
    pairs = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    return f"""
WITH t(k, name, pairs, wide) AS (VALUES {values}),
whole AS (SELECT doc_id, {pairs} AS p FROM (SELECT doc_id, string_split({whole}, ' ') AS words FROM documents WHERE text IS NOT NULL)),
u AS (SELECT doc_id, unnest(list_distinct(list_transform(list_concat(string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10))),
        lambda x: {unit}))) AS unit FROM documents),
units AS (SELECT doc_id, list_distinct({pairs}) AS p FROM (SELECT doc_id, string_split(unit, ' ') AS words FROM u) UNION ALL SELECT doc_id, list_distinct(p) FROM whole),
tp AS (SELECT k, wide, unnest(pairs) AS pair FROM t),
spots AS (SELECT doc_id, unnest(p) AS pair, generate_subscripts(p, 1) AS i FROM whole),
starts AS (SELECT DISTINCT doc_id, k, wide, unnest(range(i - wide + 1, i + 1)) AS i FROM spots JOIN tp USING (pair)),
windows AS (SELECT doc_id, k, list_distinct(p[greatest(i, 1):i + wide - 1]) AS p FROM starts JOIN whole USING (doc_id)),
s AS (SELECT doc_id, t.k, t.name, 2.0::DOUBLE * len(list_intersect(units.p, t.pairs)) / (len(units.p) + len(t.pairs)) AS dice FROM units, t WHERE list_has_any(units.p, t.pairs)
    UNION ALL SELECT doc_id, t.k, t.name, 2.0::DOUBLE * len(list_intersect(windows.p, t.pairs)) / (len(windows.p) + len(t.pairs)) FROM windows JOIN t USING (k)),
m AS (SELECT doc_id, k, name, max(dice) AS dice FROM s GROUP BY ALL HAVING max(dice) >= {threshold}),
h AS (SELECT doc_id, max({{'dice': dice, 'k': -k, 'name': name}}) AS best, count(*) AS n FROM m GROUP BY doc_id)
SELECT d.doc_id, h.best.name AS license, h.best.dice AS dice, coalesce(h.n, 0)::BIGINT AS n_matches FROM documents d LEFT JOIN h USING (doc_id)"""
