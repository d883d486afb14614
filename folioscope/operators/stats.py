"""Statistics of rasters: histograms, thresholds, paper levels, white balance, similarity.

Everything is an aggregate with a map-side part followed by windows over at most 256
bins an image; pixels are never sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixel import clamp, clamp8, luma709


def histogram(pixels: DataFrame, value: Column, name: str = "v") -> DataFrame:
    return pixels.groupBy("image_id", value.alias(name)).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """(image_id, threshold): the level that best splits the histogram (image_id, v, n).
    The lowest of equal levels wins; an image of one level has 128."""
    upto = W.partitionBy("image_id").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("image_id")
    h = hist.select(
        "image_id", "v", F.sum("n").over(upto).cast("double").alias("wb"), F.sum(F.col("n") * F.col("v")).over(upto).cast("double").alias("sb"),
        F.sum("n").over(whole).cast("double").alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).cast("double").alias("s"),
    )
    d = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.col("wf")
    between = h.withColumn("wf", F.col("w") - F.col("wb")).withColumn("between", F.when(F.col("wf") > 0, F.col("wb") * F.col("wf") * d * d))
    best = F.max_by("v", F.when(F.col("between").isNotNull(), F.struct("between", -F.col("v"))))
    return between.groupBy("image_id").agg(F.coalesce(best, F.lit(128)).alias("threshold"))


def percentile_level(hist: DataFrame, p: float, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The first level of (keys, v, n) at which the running count reaches the share p."""
    upto = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    h = hist.withColumn("acc", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    return h.filter(F.col("acc") >= F.col("total") * F.lit(p)).groupBy(*keys).agg(F.min("v").alias("level"))


def luma_level(r: Column, g: Column, b: Column) -> Column:
    return F.least(F.lit(255), luma709(r, g, b).cast("int"))


def paper_level(pixels: DataFrame) -> DataFrame:
    """Where the paper lies: the 90 % level of luma."""
    return percentile_level(histogram(pixels, luma_level(F.col("r"), F.col("g"), F.col("b"))), 0.9)


def gray_gains(pixels: DataFrame, least: int = 32) -> DataFrame:
    """Channel gains that make the mean of the lighter pixels gray; 1 where too few are light.
    Sums and counts by level of luma come first, so pixels are read once and at most a few
    hundred rows an image are shuffled."""
    lum = luma709(F.col("r"), F.col("g"), F.col("b"))
    level = luma_level(F.col("r"), F.col("g"), F.col("b"))
    # `reach`: the highest paper level at whose bound, 0.55 of it, the pixel still counts as light
    near = F.least(F.lit(255), F.floor(lum / F.lit(0.55)).cast("int") + 1)
    reach = F.when(lum >= near * F.lit(0.55), near).when(lum >= (near - 1) * F.lit(0.55), near - 1).otherwise(near - 2)
    sums = pixels.groupBy("image_id", level.alias("v"), F.when(lum >= 24.0, reach).otherwise(-1).alias("reach"))
    sums = sums.agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(c) for c in "rgb"])
    upto, whole = W.partitionBy("image_id").orderBy("v").rangeBetween(W.unboundedPreceding, 0), W.partitionBy("image_id")
    h = sums.withColumn("acc", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    h = h.withColumn("paper", F.min(F.when(F.col("acc") >= F.col("total") * F.lit(0.9), F.col("v"))).over(whole))
    light = F.col("reach") >= F.col("paper")
    m = h.groupBy("image_id").agg(*[F.sum(F.when(light, F.col(c))).alias(c) for c in ("n", "r", "g", "b")])
    m = m.select("image_id", "n", *[(F.col(c) / F.col("n")).alias(c) for c in "rgb"]).withColumn("mean", (F.col("r") + F.col("g") + F.col("b")) / 3)
    gain = lambda c: F.when(F.coalesce(F.col("n"), F.lit(0)) < least, F.lit(1.0)).otherwise(clamp(F.col("mean") / F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.col(c)), 0.55, 1.9))
    return m.select("image_id", *[gain(c).alias(f"g{c}") for c in "rgb"])


def white_gains(pixels: DataFrame) -> DataFrame:
    """Channel gains that bring the 97 % level of each channel to 248."""
    one = pixels.select("image_id", F.expr("stack(3, 'r', r, 'g', g, 'b', b) as (channel, v)"))
    levels = percentile_level(one.groupBy("image_id", "channel", "v").agg(F.count("*").alias("n")), 0.97, ("image_id", "channel"))
    gain = clamp(F.lit(248.0) / F.greatest(F.col("level"), F.lit(1)), 0.55, 1.9)
    return levels.groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == c, gain)).alias(f"g{c}") for c in "rgb"])


def apply_gains(pixels: DataFrame, gains: DataFrame) -> DataFrame:
    """White-balanced pixels; Spark broadcasts the gains only while they are small."""
    return pixels.join(gains, "image_id").withColumns({c: clamp8(F.col(c) * F.col(f"g{c}")).cast("int") for c in "rgb"}).drop("gr", "gg", "gb")


def polarity(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """Whether the middle of each gray raster is at least as bright as its border."""
    m = max(2, int(min(w, h) * 0.04 + 0.5))
    x, y = F.col("x"), F.col("y")
    border = (x < m) | (y < m) | (x >= w - m) | (y >= h - m)
    centre = ~border & (x > w * 0.35) & (x < w * 0.65) & (y > h * 0.35) & (y < h * 0.65)
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("v"))), F.lit(0.0))
    return pixels.groupBy("image_id").agg((mean(centre) >= mean(border)).alias("bright"))


def contrast_gate(pixels: DataFrame, thresholds: DataFrame, least: float = 12.0) -> DataFrame:
    """Mean inside and outside of the bright mask, and whether they differ enough."""
    j = pixels.join(thresholds, "image_id")
    inside = F.col("v") > F.col("threshold")
    a = j.groupBy("image_id").agg(F.sum(F.when(inside, F.col("v"))).alias("si"), F.count(F.when(inside, 1)).alias("ni"), F.sum(F.when(~inside, F.col("v"))).alias("so"), F.count(F.when(~inside, 1)).alias("no"))
    gap = F.abs(F.col("si") / F.col("ni") - F.col("so") / F.col("no"))
    return a.select("image_id", F.col("ni").alias("n_inside"), F.coalesce((F.col("ni") > 0) & (F.col("no") > 0) & (gap >= least), F.lit(False)).alias("stands_out"))


def size_gate(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Whether the bright mask covers 5 to 98.5 % of a raster."""
    a = pixels.join(thresholds, "image_id").groupBy("image_id").agg(F.count(F.when(F.col("v") > F.col("threshold"), 1)).alias("n_mask"), F.count("*").alias("n"))
    return a.select("image_id", "n_mask", ((F.col("n_mask") >= F.col("n") * F.lit(0.05)) & (F.col("n_mask") <= F.col("n") * F.lit(0.985))).alias("passes"))


def view_match(pixels: DataFrame) -> DataFrame:
    """Correlation, at least 0, of each gray raster with the one of the next id."""
    a = pixels.select("image_id", "x", "y", F.col("v").alias("a"))
    b = pixels.select((F.col("image_id") - 1).alias("image_id"), "x", "y", F.col("v").alias("b"))
    j = a.join(b, ["image_id", "x", "y"]).groupBy("image_id").agg(
        F.count("*").cast("double").alias("n"), *[F.sum(e).cast("double").alias(k) for k, e in (("sa", F.col("a")), ("sb", F.col("b")), ("saa", F.col("a") * F.col("a")), ("sbb", F.col("b") * F.col("b")), ("sab", F.col("a") * F.col("b")))]
    )
    n = F.col("n")
    va, vb = F.col("saa") / n - (F.col("sa") / n) * (F.col("sa") / n), F.col("sbb") / n - (F.col("sb") / n) * (F.col("sb") / n)
    cov, den = F.col("sab") / n - (F.col("sa") / n) * (F.col("sb") / n), F.sqrt(F.greatest(va * vb, F.lit(0.0)))
    return j.select("image_id", F.when(den <= 1e-6, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), cov / den)).alias("match"))


def centre_level(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """The 90 % level of the middle half of each gray raster."""
    nx, ny = (F.col("x") + 0.5) / w, (F.col("y") + 0.5) / h
    return percentile_level(histogram(pixels.filter(nx.between(0.25, 0.75) & ny.between(0.25, 0.75)), F.col("v")), 0.9)


def page_counts(pages: DataFrame, key: str, blob: str) -> DataFrame:
    return pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.sum(F.octet_length(blob)).alias("n_bytes"))


def systematic(pixels: DataFrame, order: list[str], target: int) -> DataFrame:
    """Every k-th pixel of an image, k = n div target but 1 at least; not a random sample."""
    w = W.partitionBy("image_id")
    p = pixels.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count("*").over(w))
    return p.filter(F.col("pos") % F.greatest(F.lit(1), F.floor(F.col("total") / target)) == 0).drop("pos", "total")
