"""Chains over whole pages: render, encode, recognise, and bind into documents.

A page is (id, session, ord, w, h, data, corners, settings, ocr): ocr is null or a struct with
words (boxes in pixels of the image that was read) and that image's size imgW, imgH.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import images
from . import pdf, raster, text

OCR_LONGEST = 2400
PRINT_LONGEST = 3000
PRINT_QUALITY = 0.94


def rendered(pages: DataFrame, longest: float = math.inf) -> DataFrame:
    """(id, w, h, data) of pages under their settings."""
    return raster.render_pages(pages.select("id", "w", "h", "data", "corners", "settings"), longest)


def export_images(pages: DataFrame, stamp: Column, kind: str = "png", quality: float = 0.9) -> DataFrame:
    """(id, name, w, h, file, n_bytes): every page at full size as a file, with its name."""
    names = pages.select("id", F.concat(F.lit("scan-"), F.date_format(stamp, "yyyyMMdd-HHmmss"), F.lit("-p"), (F.col("ord") + 1).cast("string"), F.lit(f".{images.EXTENSIONS[kind]}")).alias("name"))
    return images.encode(rendered(pages), kind, quality).join(names, "id").select("id", "name", "w", "h", "file", "n_bytes")


def print_images(pages: DataFrame, longest: int = PRINT_LONGEST) -> DataFrame:
    """(id, w, h, file, n_bytes): every page rendered in full, fitted for paper, as JPEG."""
    return images.encode(raster.fit_images(rendered(pages), longest), "jpeg", PRINT_QUALITY)


def thumbnails(pages: DataFrame, render: int = 420, longest: int = 160, quality: float = 0.7) -> DataFrame:
    """(id, w, h, url): small renderings as JPEG data addresses."""
    small = images.encode(raster.fit_images(rendered(pages, render), longest), "jpeg", quality)
    return small.select("id", "w", "h", F.concat(F.lit("data:image/jpeg;base64,"), F.base64("file")).alias("url"))


def export_pdf(pages: DataFrame, size: str = "auto", title: str = "Scan", quality: float = 0.9, searchable: bool = True, created: str | None = None) -> DataFrame:
    """(session, n_pages, pdf): every page rendered at full size, as JPEG, its words moved from
    the pixels that were read to those of the rendering."""
    files = images.encode(rendered(pages), "jpeg", quality).select("id", F.col("w").alias("fw"), F.col("h").alias("fh"), "file")
    j = pages.select("id", "session", "ord", "ocr").join(files, "id")
    moved = text.rescaled(F.col("ocr.words"), F.col("fw") / F.col("ocr.imgW"), F.col("fh") / F.col("ocr.imgH"))
    body = j.select("session", "ord", F.col("file").alias("jpeg"), F.col("fw").alias("w"), F.col("fh").alias("h"), (moved if searchable else F.lit(None)).alias("words"))
    return pdf.build_documents(body, "session", size, title, created, searchable)


def recognised(pages: DataFrame, engine: Callable, lang: str = "eng", psm: int = text.SEGMENTATION[0], longest: int = OCR_LONGEST) -> DataFrame:
    """(id, ocr): every page rendered for reading and read by engine(PNG bytes, lang, psm); ocr
    also tells the language and the size of the image that was read."""
    files = images.encode(rendered(pages, longest), "png")
    out = text.recognise(files, engine, "file", lang, psm)
    return out.select("id", F.col("ocr").withField("lang", F.lit(lang)).withField("imgW", F.col("w")).withField("imgH", F.col("h")).alias("ocr"))
