"""Images to a content-addressed store and to text; tables to descriptions.

What needs bytes or a model runs per partition (mapInPandas) on the rows that need it
and nothing else; keys, skips, dedup and verdicts are DataFrame operations. Rows that are
done already are left out by filters, so running again adds only what is new.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.clients import ModelError, TextClient, VisionClient
from . import blocks as B
from . import render

# File endings of stored images, and media types by ending.
ENDINGS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/webp": ".webp", "image/svg+xml": ".svg"}
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "svg": "image/svg+xml"}

THREADS = 4


def _choice(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def file_ending(mime: str | Column) -> Column:
    return F.coalesce(_choice(C.col(mime), ENDINGS), F.lit(".bin"))


def type_by_name(path: Column) -> Column:
    return _choice(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), TYPES)


def unresolved(blocks: DataFrame) -> DataFrame:
    """Images without a stored blob, nested ones included."""
    return blocks.where("type = 'image' and image_id is null")


def from_source_attribute(images: DataFrame) -> DataFrame:
    """Images of HTML and Markdown with inline data: bytes and type. Remote addresses stay as they are."""
    src = F.get_json_object("locator", "$.src")
    head = F.regexp_extract(src, r"(?s)^data:([^,]*),", 1)
    data = F.try_to_binary(F.regexp_replace(F.regexp_extract(src, r"(?s)^data:[^,]*,(.*)$", 1), r"\s", ""), F.lit("base64"))
    inline = src.startswith("data:") & head.contains(";base64")
    mime = F.nullif(F.split(head, ";")[0], F.lit(""))
    return images.withColumn("data", F.when(inline, data)).withColumn("found_mime", F.when(inline, mime)).where("data is not null")


def local_paths(images: DataFrame, docs: DataFrame) -> DataFrame:
    """Images that name a local file: the path, resolved beside their document. Join it with a scan of files for the bytes."""
    src = F.get_json_object("locator", "$.src")
    plain = images.where(src.isNotNull() & (src != "") & ~src.rlike(r"^(?i)(data:|https?:)"))
    folder = F.regexp_replace("source_path", r"[^/]*$", "")
    joined = plain.join(docs.select("doc_id", "source_path"), "doc_id")
    return joined.withColumn("path", F.when(src.startswith("/"), src).otherwise(F.concat(folder, src))).withColumn("found_mime", type_by_name(src))


def from_files(images: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of local files from files (path, content)."""
    return local_paths(images, docs).join(files.select("path", F.col("content").alias("data")), "path").drop("path", "source_path")


def from_packages(images: DataFrame, docs: DataFrame) -> DataFrame:
    """Bytes of package members: each document is opened once for all of its parts."""
    named = images.withColumn("_part", F.ltrim(F.get_json_object("locator", "$.part"))).where("_part is not null and _part <> ''")
    wanted = named.groupBy("doc_id").agg(F.collect_set("_part").alias("parts")).join(docs.select("doc_id", "content"), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, parts, content in zip(frame["doc_id"], frame["parts"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        have = set(z.namelist())
                        out += [(doc_id, p, z.read(p.lstrip("/"))) for p in parts if p.lstrip("/") in have]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["doc_id", "_part", "data"])

    bytes_ = wanted.mapInPandas(run, "doc_id string, _part string, data binary")
    return named.join(bytes_, ["doc_id", "_part"]).withColumn("found_mime", type_by_name(F.col("_part"))).drop("_part")


Renderer = Callable[[bytes, int, list[float] | None], bytes | None]


def from_pages(images: DataFrame, docs: DataFrame, renderer: Callable[[], Renderer]) -> DataFrame:
    """Regions of pages, through a renderer: render(content, page, box in points, or None for the page) gives a PNG. Regions of one document are rendered together."""
    box = F.from_json(F.get_json_object("locator", "$.bbox"), "array<double>")
    named = images.withColumn("_page", F.get_json_object("locator", "$.page").cast("int")).withColumn("_box", box).where("_page is not null and _box is not null")
    wanted = named.groupBy("doc_id").agg(F.collect_list(F.struct("uid", "_page", "_box")).alias("regions")).join(docs.select("doc_id", "content"), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render_region = renderer()
        for frame in frames:
            out = []
            for doc_id, regions, content in zip(frame["doc_id"], frame["regions"], frame["content"]):
                for r in sorted(regions, key=lambda r: r["_page"]):
                    png = render_region(content, int(r["_page"]), [float(v) for v in r["_box"]])
                    if png:
                        out.append((doc_id, r["uid"], png))
            yield pd.DataFrame(out, columns=["doc_id", "uid", "data"])

    bytes_ = wanted.mapInPandas(run, "doc_id string, uid string, data binary")
    return named.join(bytes_, ["doc_id", "uid"]).withColumn("found_mime", F.lit("image/png")).drop("_page", "_box")


def image_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from the head of a PNG, GIF, BMP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None, None


def identified(fetched: DataFrame) -> DataFrame:
    """doc_id, uid, image_id (sha256), mime, width, height, data."""

    @F.pandas_udf("struct<width:int,height:int>")
    def size(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(x) for x in data], columns=["width", "height"]).astype("Int32")

    return fetched.select("doc_id", "uid", F.sha2("data", 256).alias("image_id"), F.coalesce("found_mime", "mime").alias("mime"), size("data").alias("_size"), "data").select("doc_id", "uid", "image_id", "mime", "_size.*", "data")


def new_blobs(found: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """sha256, mime, ending, content: each blob once, without those that are stored."""
    blobs = found.groupBy(F.col("image_id").alias("sha256")).agg(F.first("mime").alias("mime"), F.first("data").alias("content")).withColumn("ending", file_ending("mime"))
    return blobs if stored is None else blobs.join(stored.select("sha256"), "sha256", "left_anti")


def ocr_verdict(raw: str | Column) -> Column:
    """A checker's reply as (meaningful, cleaned): its first JSON object; anything unusable counts as not meaningful."""
    v = F.from_json(F.regexp_extract(C.col(raw), r"(?s)\{.*\}", 0), "meaningful boolean, cleaned_text string")
    text = F.trim(F.coalesce(v["cleaned_text"], F.lit("")))
    good = F.coalesce(v["meaningful"], F.lit(False)) & (text != "")
    return F.struct(good.alias("meaningful"), F.when(good, text).otherwise(F.lit("")).alias("cleaned"))


# Own wording; the shapes of the answers are the contract.
READ_IMAGE = "Write down the text in this image as it stands, line by line. If there is none that can be read, answer NO_TEXT only."
CHECK_TEXT = 'Is this text, read from an image, content or noise? If it is content, correct reading errors and add nothing. Answer with JSON only: {"meaningful": true or false, "cleaned_text": "..."}'
DESCRIBE = "Say in one or two sentences what this table shows, without repeating its cells."
CHECK_DESCRIPTION = 'Does the description fit the table, and does it keep to one or two sentences? Answer with JSON only: {"content_ok": true or false, "format_ok": true or false, "reason": "..."}'


def read_images(found: DataFrame, vision: Callable[[], VisionClient], text: Callable[[], TextClient] | None = None, threads: int = THREADS) -> DataFrame:
    """image_id, ocr_meaningful, ocr_text. Each blob is read once, however many blocks show it; a failed call leaves both null."""
    blobs = found.dropDuplicates(["image_id"]).select("image_id", "mime", "data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        see, check = vision(), text() if text else None

        def one(image_id: str, mime: str | None, data: bytes) -> tuple:
            try:
                seen = see.complete_vision(system=READ_IMAGE, user="Read this image.", images=[(mime or "image/png", data)], max_tokens=1024).strip()
            except ModelError:
                return image_id, None, None
            if seen in ("", "NO_TEXT"):
                return image_id, "", None
            if check is None:
                return image_id, seen, None
            try:
                return image_id, seen, check.complete(system=CHECK_TEXT, user=seen, max_tokens=500)
            except ModelError:  # what can't be checked doesn't count
                return image_id, seen, ""

        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                yield pd.DataFrame(list(pool.map(one, frame["image_id"], frame["mime"], frame["data"])), columns=["image_id", "seen", "reply"])

    replies = blobs.mapInPandas(run, "image_id string, seen string, reply string")
    verdict = ocr_verdict(F.coalesce("reply", F.lit("")))
    meaningful = F.when(F.col("seen") == "", F.lit(False)).when(F.col("reply").isNotNull(), verdict["meaningful"])
    return replies.select("image_id", meaningful.alias("ocr_meaningful"), F.when(meaningful, verdict["cleaned"]).alias("ocr_text"))


def with_images(blocks: DataFrame, found: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Blocks with the slots of their images filled; text and spans stay as they were."""
    names = blocks.columns
    new = found.select("doc_id", "uid", *(F.col(c).alias(f"_{c}") for c in ("image_id", "mime", "width", "height")))
    if read is not None:
        new = new.join(read.select(F.col("image_id").alias("_image_id"), F.col("ocr_meaningful").alias("_ocr_meaningful"), F.col("ocr_text").alias("_ocr_text")), "_image_id", "left")
    joined = blocks.join(new, ["doc_id", "uid"], "left")
    filled = [c for c in ("image_id", "mime", "width", "height", "ocr_meaningful", "ocr_text") if f"_{c}" in new.columns]
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in filled}).select(*names)


def described(blocks: DataFrame, client: Callable[[], TextClient], check: bool = False, attempts: int = 3, context: bool = True, max_chars: int = 400, before: int = 1, after: int = 1, threads: int = THREADS) -> DataFrame:
    """Blocks with descriptions of their top-level tables. Tables that show nothing are `empty`; with check, a
    description is `ok` or, after all attempts, `flagged`, and each attempt is told what was wrong with the last.
    A table whose call fails stays as it was."""
    names = blocks.columns
    tables = render.with_tables(blocks).where("type = 'table' and parent_uid is null")
    tables = tables.select("doc_id", "uid", "table_plain", B.is_empty_table().alias("is_empty"))
    if context:
        tables = tables.join(B.table_context(blocks, max_chars, before, after).select("doc_id", "uid", "context"), ["doc_id", "uid"], "left")
    else:
        tables = tables.withColumn("context", F.lit(""))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()

        def one(doc_id: str, uid: str, table: str, around: str | None) -> tuple:
            try:
                return asked(doc_id, uid, table, around)
            except ModelError:
                return doc_id, uid, None, None, None

        def asked(doc_id: str, uid: str, table: str, around: str | None) -> tuple:
            base, hint = f"{around}\n\n{table}" if around else table, ""
            for turn in range(1, attempts + 1 if check else 2):
                text = model.complete(system=DESCRIBE, user=f"{base}\n\nAvoid: {hint}" if hint else base, max_tokens=300).strip()
                if not check:
                    return doc_id, uid, text, None, None
                reply = model.complete(system=CHECK_DESCRIPTION, user=f"{base}\n\nDescription: {text}", max_tokens=200)
                fine, hint = verdict_of(reply)
                if fine:
                    return doc_id, uid, text, "ok", turn
            return doc_id, uid, text, "flagged", attempts

        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                rows = list(pool.map(one, frame["doc_id"], frame["uid"], frame["table_plain"], frame["context"]))
                yield pd.DataFrame(rows, columns=["doc_id", "uid", "_text", "_status", "_attempts"]).astype({"_attempts": "Int32"})

    done = tables.where("not is_empty").select("doc_id", "uid", "table_plain", "context").mapInPandas(run, "doc_id string, uid string, _text string, _status string, _attempts int")
    empty = tables.where("is_empty").select("doc_id", "uid", F.lit(None).cast("string").alias("_text"), F.lit("empty").alias("_status"), F.lit(0).alias("_attempts"))
    joined = blocks.join(done.unionByName(empty), ["doc_id", "uid"], "left")
    of = {"table_description": "_text", "describe_status": "_status", "describe_attempts": "_attempts"}
    return joined.withColumns({k: F.coalesce(v, k) for k, v in of.items()}).select(*names)


def verdict_of(reply: str) -> tuple[bool, str]:
    import json
    import re

    try:
        v = json.loads(re.search(r"\{.*\}", reply, re.DOTALL)[0])
        return bool(v.get("content_ok")) and bool(v.get("format_ok")), str(v.get("reason") or "").strip()
    except (TypeError, ValueError, AttributeError):
        return False, ""
