"""Column expressions over text, runs and geometry. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = str | Column


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Markdown and HTML fragments

# Characters with a raised or lowered form, in pairs.
RAISED = ("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ")
LOWERED = ("0123456789+-=()aeoxhklmnpst", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ")


def escape_md(text: ColumnLike) -> Column:
    """Characters that would start an inline construct get a backslash."""
    return F.regexp_replace(col(text), r"([\\`*_~\[\]<>|])", r"\\$1")


def escape_leading(text: ColumnLike) -> Column:
    """A line that would start a block construct gets a backslash before its first sign."""
    return F.regexp_replace(col(text), r"(?m)^(\s*)([#>+\-]|\d+[.)])(\s)", r"$1\\$2$3")


def escape_html(text: ColumnLike, quote: bool = True) -> Column:
    out = F.replace(F.replace(F.replace(col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quote else out


def _scripted(text: Column, table: tuple[str, str], tag: str) -> Column:
    """Every character raised or lowered, else a tag around the text."""
    left = F.translate(text, table[0], "")
    return F.when(left == "", F.translate(text, *table)).otherwise(F.concat(F.lit(f"<{tag}>"), escape_html(text), F.lit(f"</{tag}>")))


def run_fragment(r: Column, html: bool) -> Column:
    """One inline run: script, then italic, bold, strike, underline and link around it."""
    text = r["text"]
    has = lambda mark: F.array_contains(r["marks"], mark)
    out = F.when(has("superscript"), _scripted(text, RAISED, "sup")).when(has("subscript"), _scripted(text, LOWERED, "sub"))
    out = out.otherwise(escape_html(text) if html else escape_md(text))
    around = {"italic": ("<em>", "</em>"), "bold": ("<strong>", "</strong>"), "strike": ("<del>", "</del>")} if html else {"italic": ("*", "*"), "bold": ("**", "**"), "strike": ("~~", "~~")}
    for mark, (a, z) in {**around, "underline": ("<u>", "</u>")}.items():
        out = F.when(has(mark), F.concat(F.lit(a), out, F.lit(z))).otherwise(out)
    if html:
        linked = F.concat(F.lit('<a href="'), escape_html(r["link"]), F.lit('">'), out, F.lit("</a>"))
    else:
        linked = F.concat(F.lit("["), out, F.lit("]("), r["link"], F.lit(")"))
    return F.when(F.coalesce(F.length(r["link"]), F.lit(0)) > 0, linked).otherwise(out)


def inline_fragment(text: ColumnLike, runs: ColumnLike, html: bool = False) -> Column:
    """A block's inline content from its runs, or from its plain text if it has none."""
    plain = escape_html(text) if html else escape_md(text)
    styled = F.array_join(F.transform(col(runs), lambda r: run_fragment(r, html)), "")
    return F.when(F.coalesce(F.size(col(runs)), F.lit(0)) > 0, styled).otherwise(F.coalesce(plain, F.lit("")))


def run_text(runs: ColumnLike) -> Column:
    return F.array_join(F.transform(col(runs), lambda r: r["text"]), "")


def runs_have_marks(runs: ColumnLike) -> Column:
    return F.coalesce(F.exists(col(runs), lambda r: (F.size(r["marks"]) > 0) | (F.coalesce(F.length(r["link"]), F.lit(0)) > 0)), F.lit(False))


def tidy_runs(runs: ColumnLike) -> Column:
    """Empty runs dropped, equal neighbours joined, the outer white space of the first and last run stripped."""
    kind = "array<struct<text:string,marks:array<string>,link:string>>"
    full = F.filter(col(runs), lambda r: F.length(r["text"]) > 0)

    def step(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        same = (F.size(out) > 0) & (last["marks"] == r["marks"]) & last["link"].eqNullSafe(r["link"])
        joined = F.struct(F.concat(last["text"], r["text"]).alias("text"), last["marks"].alias("marks"), last["link"].alias("link"))
        return F.when(same, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(out, F.array(r)))

    merged = F.aggregate(full, F.array().cast(kind), step)
    n = F.size(merged)
    stripped = F.transform(merged, lambda r, i: F.struct(
        F.when(i == n - 1, F.regexp_replace(F.when(i == 0, F.regexp_replace(r["text"], r"(?U)^\s+", "")).otherwise(r["text"]), r"(?U)\s+$", ""))
        .otherwise(F.when(i == 0, F.regexp_replace(r["text"], r"(?U)^\s+", "")).otherwise(r["text"])).alias("text"),
        r["marks"].alias("marks"), r["link"].alias("link")))
    return F.filter(stripped, lambda r: F.length(r["text"]) > 0)


# Text comparison

def collapse(text: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def norm(text: ColumnLike) -> Column:
    """White space collapsed and letter case folded."""
    return F.replace(F.lower(collapse(text)), F.lit("ß"), F.lit("ss"))


def tokens(text: ColumnLike) -> Column:
    """Words of the normalised text without edge punctuation; those without a letter or digit go."""
    words = F.transform(F.split(norm(text), " "), lambda w: F.regexp_replace(w, EDGES, ""))
    return F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]"))


# Fixed value: characters stripped from the edges of a token.
EDGE_CHARS = r""".,;:!?()\[\]{}"'`«»"""
EDGES = f"^[{EDGE_CHARS}]+|[{EDGE_CHARS}]+$"


def criticals(text: ColumnLike) -> Column:
    """Tokens that hold a digit."""
    return F.filter(tokens(text), lambda w: w.rlike(r"\d"))


def let(value: Column, of) -> Column:
    """of(value), with value computed once however often it is used."""
    return F.transform(F.array(value), of)[0]


def _numbered(xs: Column) -> Column:
    """Equal elements told apart by their count, so that multisets meet as sets."""
    return let(F.array_sort(xs), lambda s: F.transform(s, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(s, w)).cast("string"))))


def _shared(need: Column, have: Column) -> Column:
    """Size of the multiset intersection."""
    return F.size(F.array_intersect(_numbered(need), _numbered(have)))


def containment(needle: ColumnLike, hay: ColumnLike) -> Column:
    """Share of the needle's tokens that the hay holds, as multisets; 1 for a needle without tokens."""
    have = tokens(hay)
    return let(tokens(needle), lambda need: F.when(F.size(need) == 0, F.lit(1.0)).otherwise(_shared(need, have) / F.size(need)))


def criticals_fit(needle: ColumnLike, hay: ColumnLike) -> Column:
    """Whether the hay has every token with a digit as often as the needle."""
    have = criticals(hay)
    return let(criticals(needle), lambda need: _shared(need, have) == F.size(need))


# Heading clues

# The patterns of headings, captions and dates.
NUMBERED = r"^\s*(\d+(?:\.\d+)*)[.)]?\s+\S"
ROMAN = r"^\s*([IVXLCDM]+)[.)]\s+\S"
SECTION = r"(?iU)^\s*(chapter|section|part|appendix|b[öo]l[üu]m|k[ıi]s[ıi]m|ek)\b"
CAPTION = r"(?iU)^\s*(figure|fig|table|gambar|tabel|foto|resim|[şs]ekil|tablo)\s*\d"
MONTH = r"(?iU)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|ocak|[şs]ubat|mart|nisan|may[ıi]s|haziran|temmuz|a[ğg]ustos|eyl[üu]l|ekim|kas[ıi]m|aral[ıi]k)"
TIME = r"(?i)\b\d{1,2}[:.]\d{2}\s*(a\.?m\.?|p\.?m\.?|pm|am)?\b"
YEAR = r"\b(19|20)\d{2}\b"
ORDINAL = r"(?i)\b\d{1,2}(st|nd|rd|th)\b"


def words(text: ColumnLike) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def word_count(text: ColumnLike) -> Column:
    return F.size(words(text))


def is_all_caps(text: ColumnLike) -> Column:
    """Two letters or more, all of them upper case."""
    return (F.regexp_count(col(text), F.lit(r"\p{L}")) >= 2) & ~col(text).rlike(r"[\p{L}&&[^\p{Lu}]]")


def is_title_case(text: ColumnLike) -> Column:
    """Two words or more of over three characters that start with a letter, each with an upper-case one; not all caps."""
    long = F.filter(words(text), lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}"))
    return ~is_all_caps(text) & (F.size(long) >= 2) & F.forall(long, lambda w: w.rlike(r"^\p{Lu}"))


def numbering_level(text: ColumnLike, numbered: str = NUMBERED, roman: str = ROMAN, section: str = SECTION) -> Column:
    """Depth of a leading number, 1 for a roman number or section word, else null."""
    number = F.regexp_extract(col(text), numbered, 1)
    depth = F.least(F.regexp_count(number, F.lit(r"\.")) + 1, F.lit(6))
    return F.when(number != "", depth).when(col(text).rlike(roman) | col(text).rlike(section), F.lit(1)).cast("int")


def is_caption(text: ColumnLike, caption: str = CAPTION) -> Column:
    return col(text).rlike(caption)


def looks_like_date(text: ColumnLike, n: Column | None = None, patterns: tuple[str, str, str, str] = (MONTH, TIME, YEAR, ORDINAL)) -> Column:
    """Up to eight words with a month and a year or ordinal, or a time and a year, a month, or little else. n: the number of words, if counted otherwise."""
    t = F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
    n = word_count(t) if n is None else n
    month, time, year, ordinal = (t.rlike(p) for p in patterns)
    return (n > 0) & (n <= 8) & ((month & (year | ordinal)) | (time & (year | month | (n <= 3))))


# Files

# Formats by priority with their file endings and media types.
FORMATS = (
    ("markdown", (".md", ".markdown"), ("text/markdown", "text/x-markdown")),
    ("html", (".html", ".htm", ".xhtml"), ("text/html", "application/xhtml+xml")),
    ("xlsx", (".xlsx",), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",)),
    ("docx", (".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    ("pptx", (".pptx",), ("application/vnd.openxmlformats-officedocument.presentationml.presentation",)),
    ("pdf", (".pdf",), ("application/pdf",)),
)


def suffix(path: ColumnLike) -> Column:
    """Lower-cased ending of the file name; a leading dot starts none."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def format_of(path: ColumnLike, mimetype: ColumnLike | None = None, formats: tuple = FORMATS) -> Column:
    """The first format whose endings or media types fit; null if none does."""
    out = F.lit(None).cast("string")
    for name, endings, types in reversed(formats):
        fits = suffix(path).isin(*endings)
        if mimetype is not None:
            fits = fits | F.coalesce(col(mimetype).isin(*types), F.lit(False))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def sha256(content: ColumnLike) -> Column:
    return F.sha2(col(content), 256)
