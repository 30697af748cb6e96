"""Jobs from end to end: files to blocks, enriched blocks, JSON and Markdown."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ir
from ..operators import blocks as B
from ..operators import enrich, headings, page_models, pdf_layout, render
from ..sources import decode, pdf

OFFICE = ("docx", "pptx", "xlsx")


def pdf_blocks(docs: DataFrame, models: page_models.Models | None = None, store: Callable[[DataFrame], None] | None = None, with_errors: bool = False) -> DataFrame:
    """Block rows of PDF documents (doc_id, content), with section paths. Pages are laid out from their own text; with models,
    hybrid pages and scans are read by them, and store gets the audit crops (sha256, mime, ending, content)."""
    parts = pdf.extract(docs)
    if not with_errors and (bad := parts["errors"].first()):
        raise ValueError(f"document {bad['doc_id']!r}: {bad['error']}")
    words, pages, pictures, cells = (parts[k] for k in ("words", "pages", "pictures", "cells"))
    routes = pdf_layout.triage(words, pages, pictures, pdf_layout.table_boxes(cells))
    own, kept = (routes.where(F.col("route").isin(*r)).select(*pdf_layout.PAGE) for r in (("code", "hybrid"), ("scanned",)))
    if models is not None:
        read, crops = page_models.model_blocks(docs, words, pages, pictures, cells, routes, models)
        taken = read.select(*pdf_layout.PAGE).distinct()
        own, kept = (x.join(taken, pdf_layout.PAGE, "left_anti") for x in (own, kept))
    rows = pdf_layout.laid_out(words, pages, pictures, cells, routes, own, kept)
    if models is not None:
        rows = rows.unionByName(read)
        if store is not None:
            store(crops.dropDuplicates(["sha256"]).select("sha256", F.lit("image/png").alias("mime"), F.lit(".png").alias("ending"), "content"))
    out = as_blocks(pdf_layout.numbered_blocks(rows))
    return out.withColumn("error", F.lit(None).cast("string")).unionByName(parts["errors"], allowMissingColumns=True) if with_errors else out


def as_blocks(laid: DataFrame) -> DataFrame:
    """Numbered page rows as block rows, the cells of tables as rows of their own."""
    span = F.from_json(F.to_json(F.struct(F.col("page"))), ir.SPAN)
    full = lambda rows: rows.select(*[F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in ir.COLUMNS.items()])
    covered = B.occupancy(F.col("merges"))
    top = laid.withColumns({"uid": F.col("id"), "span": span, "null_slots": F.when(F.col("type") == "table", F.coalesce(covered, F.array()))})
    cells = laid.where("type = 'table'").select("doc_id", F.col("id").alias("parent_uid"), F.explode("slots").alias("s"), F.col("ordinal"))
    cells = cells.where("s.text <> ''").select("doc_id", "parent_uid", "ordinal", F.col("s.row").alias("cell_row"), F.col("s.col").alias("cell_col"), F.col("s.text").alias("text"))
    cells = cells.withColumns({"cell_pos": F.lit(0), "id": F.lit(""), "type": F.lit("paragraph"), "uid": F.concat("parent_uid", F.lit("/"), F.col("cell_row").cast("string"), F.lit("."), F.col("cell_col").cast("string"), F.lit(".0"))})
    return B.with_heading_path(full(top)).unionByName(full(cells))


FORMATS = ("html", "markdown", "xlsx", "docx", "pptx", "pdf")


def blocks(
    docs: DataFrame, formats: tuple[str, ...] = FORMATS, document_weights: headings.Weights = headings.DOCUMENT, slide_weights: headings.Weights = headings.SLIDE,
    with_errors: bool = False, models: page_models.Models | None = None, store: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Block rows of docs (doc_id, fmt, content); headings by looks are decided per format. formats: those that can occur; fewer give a smaller plan.

    with_errors adds a column error, null but for rows that stand for a failed document; without it a failed document ends the job.
    models and store: see pdf_blocks.
    """
    plain = [f for f in formats if f not in ("docx", "pptx", "pdf")]
    of = lambda *fmt: decode.blocks(docs.where(F.col("fmt").isin(*fmt)), with_errors=with_errors)
    parts = [of(*plain)] if plain else []
    if "docx" in formats:
        parts.append(headings.promote_documents(of("docx"), document_weights))
    if "pptx" in formats:
        parts.append(headings.promote_slides(of("pptx"), slide_weights))
    if "pdf" in formats:
        parts.append(pdf_blocks(docs.where("fmt = 'pdf'"), models, store, with_errors))
    return reduce(DataFrame.unionByName, parts)


def resolved_images(found: DataFrame, docs: DataFrame, files: DataFrame | None = None, renderer: Callable | None = None) -> DataFrame:
    """Images of blocks with their bytes, by the kind of their locator."""
    todo = enrich.unresolved(found).join(docs.select("doc_id", "fmt"), "doc_id")
    sources = [enrich.from_source_attribute(todo.where("fmt in ('html', 'markdown')")), enrich.from_packages(todo.where(F.col("fmt").isin(*OFFICE)), docs)]
    if files is not None:
        sources.append(enrich.from_files(todo.where("fmt in ('html', 'markdown')"), docs, files))
    if renderer is not None:
        sources.append(enrich.from_pages(todo.where("fmt = 'pdf'"), docs, renderer))
    return enrich.identified(reduce(DataFrame.unionByName, [s.select("doc_id", "uid", "mime", "found_mime", "data") for s in sources]))


def stored(docs: DataFrame, path: str, key: str) -> DataFrame | None:
    """What a store of an earlier job holds under path; None if there is none."""
    try:
        return docs.sparkSession.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def convert(
    docs: DataFrame, out: str, vision: Callable | None = None, text: Callable | None = None, renderer: Callable | None = None, describe: bool = False,
    files: DataFrame | None = None, models: page_models.Models | None = None, formats: tuple[str, ...] = FORMATS,
) -> dict[str, DataFrame]:
    """Converts docs (doc_id, source_path, fmt, content, raw_sha256) and writes blocks, errors, JSON and Markdown below out, and
    appends blobs that are new to out/blobs. Files that can't be decoded have a row in errors and no document; calls to
    models that fail leave their slots empty. Nothing else ends the job."""
    spark = docs.sparkSession

    def keep(blobs: DataFrame) -> None:
        have = stored(docs, f"{out}/blobs", "sha256")
        (blobs if have is None else blobs.join(have, "sha256", "left_anti")).write.mode("append").parquet(f"{out}/blobs")

    blocks(docs, formats, with_errors=True, models=models, store=keep).write.mode("overwrite").parquet(f"{out}/decoded")
    decoded = spark.read.parquet(f"{out}/decoded")
    errors = decoded.where("error is not null").select("doc_id", "error")
    fine = docs.join(errors, "doc_id", "left_anti")
    found = decoded.where("error is null").drop("error")
    resolved_images(found, fine, files, renderer).write.mode("overwrite").parquet(f"{out}/images")
    images = spark.read.parquet(f"{out}/images")
    read = enrich.read_images(images, vision, text) if vision else None
    found = enrich.with_images(found, images, read)
    if describe and text:
        found = enrich.described(found, text)
    found.write.mode("overwrite").parquet(f"{out}/blocks")
    found = spark.read.parquet(f"{out}/blocks")
    keep(enrich.new_blobs(images).select("sha256", "mime", "ending", "content"))
    made = {"blocks": found, "errors": errors, "json": B.documents_json(fine.select("doc_id", "source_path", "fmt", "raw_sha256"), found), "markdown": render.to_markdown(found)}
    for name in ("errors", "json", "markdown"):
        made[name].write.mode("overwrite").parquet(f"{out}/{name}")
        made[name] = spark.read.parquet(f"{out}/{name}")
    return made


def paired(docs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each source file with its output, by document."""
    return docs.join(outputs, "doc_id")


def convert_folder(spark: SparkSession, source: str, out: str, recursive: bool = True, **more: object) -> DataFrame:
    """Converts every file below a folder into out (see convert) and writes what became of it, one row a file, to out/summary.

    Rows: doc_id, source_path, fmt, status (converted, failed or unsupported), reason. Files that fail end nothing.
    """
    files = decode.read_files(spark, source, recursive)
    known = files.where("fmt is not null")
    made = convert(known, out, **more)
    failed = made["errors"].groupBy("doc_id").agg(F.min("error").alias("reason"))
    done = known.select("doc_id", "source_path", "fmt").join(failed, "doc_id", "left")
    done = done.select("doc_id", "source_path", "fmt", F.when(F.col("reason").isNull(), "converted").otherwise("failed").alias("status"), "reason")
    others = decode.unsupported(files).select("doc_id", "source_path", F.lit(None).cast("string").alias("fmt"), F.lit("unsupported").alias("status"), "reason")
    done.unionByName(others).write.mode("overwrite").parquet(f"{out}/summary")
    return spark.read.parquet(f"{out}/summary")
