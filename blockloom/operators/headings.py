"""Headings by their looks: weighted clues, a gate, and levels, as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


@dataclass(frozen=True)
class Weights:
    """What each clue adds, and the gate. A null weight leaves its clue out."""

    threshold: float
    max_words: int
    default_level: int
    bold: float
    number: float
    caps: float
    titlecase: float
    short: float
    very_short: float
    center: float
    isolation: float
    underline: float
    no_punct: float
    large_font: float
    xlarge_font: float
    sentence: float
    italic: float
    keep_next: float = 0.0
    titlecase_words: int = 7
    large_ratio: float = 1.15
    xlarge_ratio: float = 1.40
    date_gate: bool = True
    use_font: bool = True
    needs_following: bool = False


#: The calibrated weights of documents and of slides.
DOCUMENT = Weights(7.0, 20, 2, bold=3, number=3, caps=2, titlecase=1.5, short=2, very_short=1, center=2, isolation=1.5, underline=1, no_punct=1, large_font=2, xlarge_font=3, sentence=-3, italic=-2, keep_next=1, needs_following=True)
SLIDE = Weights(6.0, 14, 1, bold=3, number=2, caps=2, titlecase=1.5, short=2, very_short=1, center=1.5, isolation=1, underline=1, no_punct=1, large_font=2, xlarge_font=3, sentence=-3, italic=-2)


def clues(text: str = "text") -> dict[str, Column]:
    """Clues that follow from the text alone."""
    t = F.col(text)
    last = F.right(F.regexp_replace(t, r"(?U)\s+$", ""), F.lit(1))
    return {
        "wc": C.word_count(t), "caps": C.is_all_caps(t), "is_titlecase": C.is_title_case(t), "num": C.numbering_level(t), "is_date": C.looks_like_date(t), "is_caption": C.is_caption(t),
        "ends_sentence": last.isin(".", "?", "!"), "no_terminal": (last != "") & ~last.isin(".", "?", "!", ",", ";", ":"), "sentences": F.regexp_count(t, F.lit("[.?!]")),
    }


def score(w: Weights) -> Column:
    """Score of a row with the columns of clues() and bold, italic, underline, center, keep_next, font_ratio, blank_before, blank_after, followed; null if gated out."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if isinstance(c, str) else F.coalesce(c, F.lit(False))
    adds = [
        (flag("bold"), w.bold), (F.col("num").isNotNull(), w.number), (flag("caps"), w.caps), (flag("is_titlecase") & (F.col("wc") <= w.titlecase_words), w.titlecase),
        (flag("center"), w.center), (flag("italic"), w.italic), (F.col("wc") <= 4, w.short + w.very_short), ((F.col("wc") > 4) & (F.col("wc") <= 7), w.short),
        (flag("blank_before") & flag("blank_after"), w.isolation), (flag("underline"), w.underline), (flag("ends_sentence"), w.sentence), (~flag("ends_sentence") & flag("no_terminal"), w.no_punct),
    ]
    if w.keep_next:
        adds.append((flag("keep_next"), w.keep_next))
    if w.use_font:
        ratio = F.coalesce("font_ratio", F.lit(0.0))
        adds += [(ratio >= w.xlarge_ratio, w.xlarge_font), ((ratio >= w.large_ratio) & (ratio < w.xlarge_ratio), w.large_font)]
    total = F.lit(0.0)
    for clue, weight in adds:
        total = total + F.when(clue, F.lit(float(weight))).otherwise(F.lit(0.0))
    gate = (F.col("wc") > 0) & (F.col("sentences") < 2) & ~F.col("is_caption") & (F.col("num").isNotNull() | (F.col("wc") <= w.max_words))
    if w.date_gate:
        gate = gate & ~F.col("is_date")
    if w.needs_following:
        gate = gate & flag("followed")
    return F.when(gate, total)


def level(w: Weights) -> Column:
    """Numbering depth, else 1 for very large letters, else the default."""
    large = (F.coalesce("font_ratio", F.lit(0.0)) >= w.xlarge_ratio) if w.use_font else F.lit(False)
    return F.coalesce(F.col("num"), F.when(large, F.lit(1)), F.lit(w.default_level)).cast("int")


def classified(rows: DataFrame, w: Weights = DOCUMENT) -> DataFrame:
    """Adds is_heading and heading_level: an outline level or a heading style decide, else the score."""
    rows = rows.withColumns(clues())
    passed = F.coalesce(score(w) >= w.threshold - 1e-9, F.lit(False))
    known = F.coalesce(F.col("outline"), F.col("style_level"))
    return rows.withColumn("score", score(w)).withColumn("is_heading", known.isNotNull() | passed).withColumn("heading_level", F.when(known.isNotNull(), known).when(passed, level(w)))


def slide_titles(rows: DataFrame, w: Weights = SLIDE) -> DataFrame:
    """The best-scored row of each slide (doc_id, slide, ordinal) that has no title: strictly best, the first of equals."""
    rows = rows.withColumns(clues()).withColumn("score", score(w)).where("score is not null")
    best = rows.groupBy("doc_id", "slide").agg(F.max_by(F.struct(*rows.columns), F.struct(F.col("score"), -F.col("ordinal"))).alias("x")).select("x.*")
    return best.where(F.col("score") >= w.threshold - 1e-9).withColumn("heading_level", level(w))


def isolation(rows: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds blank_before and blank_after: the neighbours have no text, or there are none."""
    order = Window.partitionBy(*by).orderBy("ordinal")
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return rows.withColumn("blank_before", empty(F.lag("text").over(order))).withColumn("blank_after", empty(F.lead("text").over(order)))


_DOCUMENT_SIGNALS = "outline int, style string, center boolean, keep_next boolean, bold boolean, underline boolean, italic boolean, font_ratio double, blank_before boolean, blank_after boolean, followed boolean"
_SLIDE_SIGNALS = "slide int, size double, place int, fixed boolean, center boolean, bold boolean, underline boolean, italic boolean, blank_before boolean, blank_after boolean"
#: Fixed value: paragraph styles that mean a heading.
TITLE_STYLE = r"(?iU)title|subtitle|heading|head|ba[şs]l[ıi]k"
MARKER = r"<image\d+>"


def _as_heading(blocks: DataFrame, chosen: Column, level_of: Column) -> DataFrame:
    """Chosen paragraphs become headings; image markers go from their text and runs."""
    bare = F.regexp_replace(F.regexp_replace("text", MARKER, ""), r"(?U)^\s+|\s+$", "")
    kept = C.tidy_runs(F.filter("runs", lambda r: ~r["text"].rlike(f"^{MARKER}$")))
    return blocks.withColumns({
        "type": F.when(chosen, "heading").otherwise(F.col("type")),
        "level": F.when(chosen, level_of).otherwise(F.col("level")),
        "runs": F.when(chosen, F.when(C.runs_have_marks("runs"), kept)).otherwise(F.col("runs")),
        "text": F.when(chosen, bare).otherwise(F.col("text")),
    })


def promote_documents(blocks: DataFrame, w: Weights = DOCUMENT) -> DataFrame:
    """Paragraphs of documents that look like headings become headings; signals are used up."""
    names = blocks.columns
    s = F.from_json("signals", _DOCUMENT_SIGNALS)
    rows = blocks.withColumn("_s", s).select(*names, "_s.*")
    style = F.when(F.coalesce("style", F.lit("")).rlike(TITLE_STYLE), F.when(F.lower("style").contains("sub"), 2).otherwise(1))
    rows = rows.withColumn("style_level", style)
    judged = classified(rows, w)
    chosen = F.col("signals").isNotNull() & F.col("is_heading")
    return _as_heading(judged, chosen, F.col("heading_level")).withColumn("signals", F.lit(None).cast("string")).select(*names)


def promote_slides(blocks: DataFrame, w: Weights = SLIDE) -> DataFrame:
    """On slides without a title, the best text box paragraph becomes the title if it reaches the threshold: strictly best, the first of equals.

    All that a row needs of others lies within its document, so blocks are made once, dealt out once, and looked at by windows.
    """
    names = blocks.columns
    rows = blocks.withColumn("_s", F.from_json("signals", _SLIDE_SIGNALS)).select(*names, "_s.*")
    # the baseline: the most frequent size (rounded to 0.1) of paragraphs with text, the first seen of equals
    worded = F.col("signals").isNotNull() & (F.trim("text") != "")
    rows = rows.withColumn("_size", F.when(worded, F.bround("size", 1)))
    alike = Window.partitionBy("doc_id", "_size")
    rows = rows.withColumns({"_n": F.count("*").over(alike), "_seen": F.min("place").over(alike)})
    base = F.min_by("_size", F.when(F.col("_size").isNotNull(), F.struct(-F.col("_n"), F.col("_seen")))).over(Window.partitionBy("doc_id"))
    titled = F.max((F.col("type") == "heading").cast("int")).over(Window.partitionBy("doc_id", "span.page"))
    rows = rows.withColumns({"font_ratio": F.coalesce(F.col("size") / base, F.lit(0.0)), "_titled": titled})
    rows = rows.withColumn("_free", F.coalesce(F.col("signals").isNotNull() & ~F.col("fixed") & (F.col("_titled") == 0), F.lit(False)))
    rows = rows.withColumns({k: F.when(F.col("_free"), v) for k, v in clues().items()}).withColumn("_score", F.when(F.col("_free"), score(w)))
    first = F.when(F.col("_score").isNotNull(), F.struct(F.col("_score"), -F.col("ordinal")))
    best = F.max_by("uid", first).over(Window.partitionBy("doc_id", "slide"))
    judged = rows.withColumn("_best", (F.col("_score") >= w.threshold - 1e-9) & (F.col("uid") == best))
    return _as_heading(judged, F.coalesce("_best", F.lit(False)), F.lit(w.default_level)).withColumn("signals", F.lit(None).cast("string")).select(*names)
