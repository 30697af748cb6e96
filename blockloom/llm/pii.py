"""Personal data, also if disguised, with spans in the source text.

Base spans are found in the text as it is: email, ip, card, phone.

Disguises are undone by transducers over (character, source start, source end):
 1. homoglyphs, compatibility forms and digits of all scripts become ASCII, invisible
    characters go;
 2. bracketed or spelled `at` and `dot` become @ and . where a name and a domain stand
    around them;
 3. runs of spelled digits become digits, spelled `plus` before one becomes +, and a
    letter o or l between digits becomes 0 or 1.
Each output character keeps the source span that it came from, so a span found in the
normalised text maps back to source characters. A span found there is added unless it
lies within a base span of its kind; so is one found after the first transducer, if it
shares no character with those, as spelled words beside figures may hide it later.

Every detector is linear in the text: matches are taken from maximal runs.

Cases: null or empty text has no spans; spans are in code points, end exclusive, ordered
by start, then kind as listed, then end; long texts are read whole; repeated rows each get
theirs; an empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import for_texts, lean

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        at, spans = chain.start(), []
        for part in chain[0].split("."):
            spans.append((at, at + len(part), len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255))
            at += len(part) + 1
        for i in range(0, len(spans) - 3, 4):
            if all(s[2] for s in spans[i : i + 4]):
                yield spans[i][0], spans[i + 3][1]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                yield m.span()


def detect(text: str) -> list[Span]:
    """Base spans, by start, then kind."""
    found = [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)] + [("phone", *s) for s in phones(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Letters of other scripts that look like ASCII ones, in pairs.
_LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУавеѕіјкмнорсԁցһӏԛԝхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧαειοκνρτυχ", "ABESIJKMHOPCTXYabesijkmhopcdghlqwxyABEZHIKMNOPTYXaeioknptux"))
_INVISIBLE = frozenset("­͏᠎​‌‍‎‏⁠⁡⁢⁣﻿")
_MARKS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＋": "+", " ": " ", " ": " ", " ": " "}

#: Spelled digits in four languages.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: By first letter, so that a word that can't be one of them is told by few comparisons.
_FIRST = sorted({w[0] for w in DIGIT_WORDS})
_WORDS = "|".join(f"{c}(?:{'|'.join(w[1:] for w in sorted(DIGIT_WORDS, key=len, reverse=True) if w[0] == c)})" for c in _FIRST)
_TOKEN = rf"(?:(?:{_WORDS})(?![^\W\d_])|[0-9])"
_POINT = r"(?:[ ]?(?:dot|point|punkt|punto)[ ]|[ ]?\.[ ]?)"
_OCTET = rf"{_TOKEN}(?:(?:[ -]{{1,2}}|(?<=[0-9])(?=[0-9])){_TOKEN}){{0,2}}"
#: Two digits or more, spelled or figures, with what may stand between them, or four with three dots.
_SPELLED = re.compile(rf"(?<![^\W_])(?=[(+0-9p{''.join(_FIRST)}])(?=(?:plus[ -]?|\+[ -]?)?[(]?{_TOKEN})(?:(?P<plus>plus|\+)[ -]?)?(?:[(]?{_TOKEN}(?:(?:[ ,()-]{{1,3}}|(?<=[0-9])(?=[0-9])|{_POINT}){_TOKEN})+|{_OCTET}(?:{_POINT}{_OCTET}){{3,}})", re.IGNORECASE)
_WORD = re.compile(rf"(?P<plus>plus)|(?P<dot>dot|point|punkt|punto|\.)|(?P<digit>{_WORDS}|[0-9])", re.IGNORECASE)
_NAME = r"[A-Za-z0-9._%+-]"
_AT = re.compile(rf"(?<={_NAME})[ ]*(?:[(\[{{<][ ]*(?:at|@|arroba|ät|chez)[ ]*[)\]}}>]|[(\[{{<]a[)\]}}>](?=[A-Za-z0-9-]+\.[A-Za-z])|[ ](?:at|arroba)[ ](?=[ ]*[A-Za-z0-9-]+(?:\.|[ ]*[(\[{{<][ ]*(?:dot|punkt|punto|point|\.)|[ ](?:dot|punkt|punto|point)[ ]))|[ ]@[ ]?|@[ ])[ ]*(?=[A-Za-z0-9])", re.IGNORECASE)
_DOT = re.compile(r"(?<=[A-Za-z0-9-])[ ]*(?:[(\[{<][ ]*(?:dot|punkt|punto|point|\.)[ ]*[)\]}>]|[ ](?:dot|punkt|punto|point)[ ])[ ]*(?=[A-Za-z0-9])", re.IGNORECASE)
_NEAR_DIGIT = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][ -]))[oOlI](?=[0-9])|(?<=[0-9]\.)[oOlI](?=\.?[0-9])")
#: Common words that stand before `at` in prose.
BEFORE_AT = frozenset((
    "a", "all", "also", "am", "and", "are", "arrive", "arrived", "available", "back", "be", "been", "being", "but", "come", "daily", "down", "found", "free", "had", "has", "have", "he", "her", "here", "him", "home",
    "hosted", "i", "in", "is", "it", "just", "laugh", "laughed", "live", "lives", "look", "looked", "looking", "looks", "me", "meet", "met", "more", "not", "now", "off", "on", "online", "only", "or", "out", "page", "please",
    "read", "see", "seen", "she", "shop", "site", "start", "started", "stay", "stayed", "still", "stop", "study", "that", "the", "them", "there", "they", "this", "today", "up", "us", "visit", "was", "we", "website", "were",
    "work", "worked", "working", "works", "you",
))
#: Characters before a word for @ that tell whether it is one.
NEAR = 100
_DOTTED = re.compile(r"[A-Za-z0-9-]+(?:[ ]*[(\[{<][ ]*(?:dot|punkt|punto|point|\.)|[ ](?:dot|punkt|punto|point)[ ])", re.IGNORECASE)
_HOST = re.compile(r"(?:[A-Za-z0-9-]+\.)+[a-z]{2,24}(?![A-Za-z0-9-])")
_LAST = re.compile(rf"{_NAME}*$")
_MAIL = re.compile(r"(?<![A-Za-z])(?:e-?mail|mail|correo|courriel|contact|kontakt|contacto)(?: (?:me|us|is|to|an|bei|es|est|à|a))?[ :=(\[<]+[A-Za-z0-9._%+-]+$", re.IGNORECASE)


class _Folds(dict[str, str]):
    """What each character folds to, kept once found."""

    def __missing__(self, c: str) -> str:
        new = c
        if c in _INVISIBLE:
            new = ""
        elif not c.isascii():
            new = _MARKS.get(c) or _LOOKALIKES.get(c) or c
            if not new.isascii():
                form = unicodedata.normalize("NFKC", c)
                digit = unicodedata.digit(c, None)
                new = form if form.isascii() and form else c if digit is None else str(digit)
        self[c] = new
        return new


_FOLDS = _Folds()


class Traced:
    """Text whose characters know their source spans."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = start if start is not None else list(range(len(text)))
        self.end = end if end is not None else list(range(1, len(text) + 1))

    def folded(self) -> Traced:
        if self.text.isascii() or all(_FOLDS[c] == c for c in set(self.text)):
            return self
        chars, start, end = [], [], []
        for c, s, e in zip(self.text, self.start, self.end):
            new = _FOLDS[c]
            for x in new:
                chars.append(x)
                start.append(s)
                end.append(e)
        return Traced("".join(chars), start, end)

    def replaced(self, pattern: re.Pattern[str], by) -> Traced:
        """by(match): pieces (text, from, to) that stand for the match, or None if it stays; a piece's characters take its whole span."""
        chars, start, end, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            if (pieces := by(m)) is None:
                continue
            chars.append(self.text[done : m.start()])
            start += self.start[done : m.start()]
            end += self.end[done : m.start()]
            for piece, a, b in pieces:
                chars.append(piece)
                start += [self.start[a]] * len(piece)
                end += [self.end[b - 1]] * len(piece)
            done = m.end()
        if not done:
            return self
        chars.append(self.text[done:])
        return Traced("".join(chars), start + self.start[done:], end + self.end[done:])


def _as_digits(m: re.Match[str]) -> Iterator[tuple[str, int, int]]:
    base = m.start()
    for w in _WORD.finditer(m[0]):
        a, b = base + w.start(), base + w.end()
        if w["digit"]:
            yield DIGIT_WORDS.get(w["digit"].lower(), w["digit"]), a, b
        elif w["plus"]:
            yield "+", a, b
        else:
            yield ".", a, b


def _spelled(m: re.Match[str]) -> list[tuple[str, int, int]] | None:
    body, at = m[0], m.start()
    if not any(c.isalpha() for c in body.replace("plus", "")):
        return None  # figures only
    return [("+", at, at + 1)] * body.startswith("+") + list(_as_digits(m))


def _as_at(m: re.Match[str]) -> list[tuple[str, int, int]] | None:
    """A bare `at` counts only beside a disguised dot, after a word for mail or a name with a digit or sign, or between a name that isn't a common word and a host in small letters: prose has it too."""
    body, text = m[0], m.string
    if body.strip().lower() == "at" and not _DOTTED.match(text, m.end()):
        before = text[max(0, m.start() - NEAR) : m.start()]
        name = _LAST.search(before)[0]
        plain = not any(c in "0123456789._%+" for c in name) and not _MAIL.search(before)
        if plain and (name.lower() in BEFORE_AT or not _HOST.match(text, m.end())):
            return None
    return [("@", m.start(), m.end())]


def normalised(text: str) -> tuple[Traced, Traced] | None:
    """The text after the first transducer, and with all its disguises undone; None if there are none. Every text goes through all transducers."""
    folded = Traced(text).folded()
    t = folded.replaced(_NEAR_DIGIT, lambda m: [("0" if m[0] in "oO" else "1", m.start(), m.end())])
    t = t.replaced(_SPELLED, _spelled)
    t = t.replaced(_AT, _as_at)
    t = t.replaced(_DOT, lambda m: [(".", m.start(), m.end())])
    return None if t.text == text else (folded, t)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text."""
    text = text or ""
    base = detect(text)
    forms = normalised(text)
    if forms is None:
        return base, base
    folded, undone = forms
    added: list[Span] = []
    for form, apart in ((undone, False), (folded, True)):
        if form.text == text or (apart and form.text == undone.text):
            continue
        for kind, a, b in detect(form.text):
            s, e = form.start[a], form.end[b - 1]
            beside = not any(k == kind and x < e and s < y for k, x, y in added) if apart else True
            if beside and not any(k == kind and x <= s and e <= y for k, x, y in base):
                added.append((kind, s, e))
    return base, sorted({*base, *added}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def line(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans: array of (kind, start, end, base, value) of every row's text."""
    for_texts(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, spans = find(text)
                own = set(base)
                out.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in own, "value": text[a:b]} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, item)], names=["key", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean("pii", run), f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,value:string>>")
    return rows.select(F.col("key").alias(key), "spans")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the number of base spans of each kind, base_sha256, spans (all), n_added."""
    rows = scanned(docs, key, text)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k)))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(key, *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with each span replaced by its kind in angle brackets; overlapping spans go together, by the kind of the first."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column(1).to_pylist():
                parts, done = [], 0
                for k, a, b in find(body)[1]:
                    if a >= done:
                        parts += [body[done:a], f"<{k}>"]
                    done = max(done, b)
                out.append(None if body is None else "".join(parts) + body[done:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])

    for_texts(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean("pii", run), f"key {kind}, text string")
    return rows.select(F.col("key").alias(key), F.col("text").alias(text))
