"""Neighbourhood operators on gray rasters in tall form (image_id, x, y, v).

Frames over one row or column of an image; windows partition by image and line, so a
task never holds more than a line at a time.  For real frames use the packed forms in
operators.raster; these are for statistics and for checking those.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixel import clamp8, shoulder


def _line(by: str, along: str, r: int):
    return W.partitionBy("image_id", by).orderBy(along).rangeBetween(-r, r)


def dilate(pixels: DataFrame, r: int, value: str = "v") -> DataFrame:
    """The maximum within r along rows, then columns; cut off at the border."""
    once = pixels.withColumn(value, F.max(value).over(_line("y", "x", r)))
    return once.withColumn(value, F.max(value).over(_line("x", "y", r)))


def integral(pixels: DataFrame, value: Column | str = "v") -> DataFrame:
    """Sums of all pixels up to and including each place, as `total`."""
    rows = W.partitionBy("image_id", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    columns = W.partitionBy("image_id", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    return pixels.withColumn("_s", F.sum(value).over(rows)).withColumn("total", F.sum("_s").over(columns)).drop("_s")


def adaptive_threshold(pixels: DataFrame, w: int, h: int, bias: float = 0.0, window_pct: float = 100.0) -> DataFrame:
    """0 or 255 by comparison with the mean of a window, cut off at the border."""
    r = int(min(w, h) / 16 * (window_pct / 100) / 2 + 0.5)
    r = min(max(r, 3), min(w, h) // 2 - 1) if min(w, h) // 2 - 1 >= 3 else min(w, h) // 2 - 1
    k = min(0.6, max(0.005, 0.13 - bias / 500))
    p = pixels.withColumn("_s", F.sum("v").over(_line("y", "x", r))).withColumn("_n", F.count("*").over(_line("y", "x", r)))
    p = p.withColumn("_s", F.sum("_s").over(_line("x", "y", r))).withColumn("_n", F.sum("_n").over(_line("x", "y", r)))
    return p.withColumn("v", F.when(F.col("v") * F.col("_n") < F.col("_s") * F.lit(1 - k), 0).otherwise(255)).drop("_s", "_n")


def _edge_sum(value: Column, by: str, along: str, size: int, r: int) -> Column:
    """The sum of 2r+1 neighbours, places past an edge taking the edge's value."""
    whole = W.partitionBy("image_id", by).orderBy(along).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    a, place = F.col(along), F.sum(value).over(_line(by, along, r))
    before, after = F.greatest(F.lit(0), F.lit(r) - a), F.greatest(F.lit(0), a + r - (size - 1))
    return place + before * F.first(value).over(whole) + after * F.last(value).over(whole)


def box_blur(pixels: DataFrame, w: int, h: int, r: int = 1) -> DataFrame:
    """Separable mean with edges repeated; adds `blur`."""
    p = pixels.withColumn("_s", _edge_sum(F.col("v"), "y", "x", w, r))  # whole numbers until the one division
    return p.withColumn("blur", _edge_sum(F.col("_s"), "x", "y", h, r) / ((2 * r + 1) * (2 * r + 1))).drop("_s")


def sharpen(pixels: DataFrame, w: int, h: int, amount: float, r: int = 1) -> DataFrame:
    """Unsharp mask, its overshoot rolled off."""
    p = box_blur(pixels, w, h, r)
    v = F.col("v")
    return p.withColumn("v", clamp8(shoulder(v + (v - F.col("blur")) * F.lit(amount / 100))).cast("int")).drop("blur")


def median3(pixels: DataFrame, w: int, h: int, strength: float = 100.0) -> DataFrame:
    """The true median of 3x3 neighbours, edges repeated, blended by strength."""
    rows, columns = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    v = F.col("v")
    p = pixels.withColumn("_a", F.array(F.coalesce(F.lag(v).over(rows), v), v, F.coalesce(F.lead(v).over(rows), v)))
    a = F.col("_a")
    p = p.withColumn("_b", F.concat(F.coalesce(F.lag(a).over(columns), a), a, F.coalesce(F.lead(a).over(columns), a)))
    m = F.element_at(F.array_sort("_b"), 5)
    return p.withColumn("v", clamp8(v + (m - v) * F.lit(strength / 100)).cast("int")).drop("_a", "_b")


def illumination_blocks(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """The brightest luma of each block of the illumination grid, blocks without a pixel left out."""
    grid = lambda n: min(88, max(10, int(n / 14 + 0.5)))
    block = lambda c, n: F.least(F.lit(grid(n) - 1), F.floor(F.col(c) * grid(n) / n)).cast("int")
    return pixels.groupBy("image_id", block("x", w).alias("bx"), block("y", h).alias("by")).agg(F.max("v").alias("level"))


def components(pixels: DataFrame) -> DataFrame:
    """Labels of 4-connected set pixels (v > 0): the least place y * 2**32 + x reachable, for an
    image of any width.  Minima spread along rows and columns by turns until nothing changes,
    however long that takes.  Every round ends in a checkpoint (spark.checkpoint.dir).  Whole
    frames go through detect.largest_component, one task an image."""
    spark = pixels.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        held = spark.conf.get("spark.checkpoint.dir", "")
        if not held and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(held or tempfile.mkdtemp(prefix="folioscope-"))
    p = pixels.filter("v > 0").select("image_id", "x", "y", (F.col("y").cast("long") * F.lit(1 << 32) + F.col("x")).alias("label"))
    for by, along in (("y", "x"), ("x", "y")):  # a run of neighbours in a line is found once
        p = p.withColumn(f"run_{along}", F.col(along) - F.row_number().over(W.partitionBy("image_id", by).orderBy(along)))
    p, same = p.withColumn("moved", F.lit(True)).checkpoint(), False
    while not same:
        new = p.withColumn("old", F.col("label"))
        for by, along in (("y", "x"), ("x", "y")):
            new = new.withColumn("label", F.min("label").over(W.partitionBy("image_id", by, f"run_{along}")))
        p = new.withColumn("moved", F.col("label") != F.col("old")).drop("old").checkpoint()
        same = p.filter("moved").isEmpty()
    return p.select("image_id", "x", "y", "label")
