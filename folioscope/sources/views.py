"""Image-shaped views of plain tables.

Tall form: one row a pixel, (image_id, x, y, v) or with r, g, b.  The test tables hold
no images, so rasters are derived from vectors, colours from order lines, motion from
events, recognised words from texts and page lists from conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixel import clamp8

#: The presets in the order that doc_id % 8 picks from.
PRESET_NAMES = ("original", "auto", "color", "gray", "bw", "whiteboard", "ink", "photo")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 luma raster of each 64-vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
    return e.select("image_id", (F.col("p") % 8).alias("x"), F.expr("cast(p div 8 as int)").alias("y"), clamp8(F.lit(128.0) + F.lit(256.0) * F.col("e").cast("double")).cast("int").alias("v"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One coloured pixel of each order line; its supplier is the image."""
    li = table(spark, sf_dir, "lineitem")
    level = lambda c, top: clamp8(F.col(c) / F.lit(top) * 255).cast("int")
    return li.select(F.col("l_suppkey").alias("image_id"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), level("l_quantity", 50.0).alias("r"), level("l_discount", 0.1).alias("g"), level("l_tax", 0.08).alias("b"))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion samples 0..1 of each event type as a camera, in order of time."""
    w = W.partitionBy("camera").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    m = F.least(F.lit(1.0), F.abs(F.col("value") - F.lag("value").over(w)) / 500)
    return e.select("camera", "ts", "event_id", F.coalesce(m, F.lit(0.0)).alias("m"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of texts with made-up boxes and confidences."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "i", "word", (F.coalesce("quality", F.lit(0)) * 40 + F.col("i") % 60).cast("double").alias("conf"),
        ((F.col("i") % 10) * 100).cast("double").alias("x0"), (F.floor(F.col("i") / 10) * 20).cast("double").alias("y0"),
        ((F.col("i") % 10) * 100 + F.length("word") * 9).cast("double").alias("x1"), (F.floor(F.col("i") / 10) * 20 + 16).cast("double").alias("y1"),
    )


def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as the pages of a session."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").alias("ord"), F.col("role"), F.col("text"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preset name, and geometry choices, for every document."""
    d = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(n) for n in PRESET_NAMES])
    return d.select(F.col("doc_id").alias("id"), F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int")).alias("filter"), ((F.col("doc_id") % 4) * 90).cast("double").alias("rotate"), (F.col("doc_id") % 3 == 0).alias("flipH"), (F.col("n_chars") % 31 - 15).cast("double").alias("straighten"), F.col("n_chars").alias("n"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A normalised quadrilateral (x0, y0, ... y3: top left, clockwise) and a frame size of each customer."""
    c = table(spark, sf_dir, "customer")
    part = lambda m, d: F.col("c_custkey") % m / F.lit(float(d))
    return c.select(
        F.col("c_custkey").alias("id"), part(23, 100).alias("x0"), part(29, 100).alias("y0"), (1 - part(31, 100)).alias("x1"), part(37, 100).alias("y1"),
        (1 - part(41, 100)).alias("x2"), (1 - part(43, 100)).alias("y2"), part(47, 100).alias("x3"), (1 - part(19, 100)).alias("y3"),
        (F.col("c_custkey") % 800 + 200).cast("int").alias("w"), (F.col("c_custkey") % 700 + 300).cast("int").alias("h"),
    )
