"""Page settings: defaults, presets and edits, as columns and a small join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The settings of a page before a preset is laid over them.
DEFAULTS = {
    "mode": "color", "flatten": 65.0, "wb": "gray", "temp": 0.0, "tint": 0.0, "exposure": 0.0, "contrast": 0.0, "gamma": 1.0, "highlights": 0.0,
    "shadows": 0.0, "saturation": 0.0, "vibrance": 0.0, "denoise": 0.0, "sharpen": 16.0, "threshold": 0.0, "window": 100.0,
}
#: The geometry of a page as it is taken.
GEOMETRY = {"rotate": 0.0, "straighten": 0.0, "flipH": False, "flipV": False}
#: What each preset sets.
PRESETS = {
    "original": {"mode": "color", "flatten": 0, "wb": "off", "contrast": 0, "gamma": 1, "saturation": 0, "vibrance": 0, "sharpen": 0, "denoise": 0, "exposure": 0, "highlights": 0, "shadows": 0, "temp": 0, "tint": 0},
    "auto": {"mode": "color", "flatten": 95, "wb": "gray", "contrast": 18, "gamma": 1, "saturation": 6, "vibrance": 10, "sharpen": 16, "denoise": 0, "exposure": 0, "highlights": 0, "shadows": 0},
    "color": {"mode": "color", "flatten": 95, "wb": "white", "contrast": 26, "gamma": 1.05, "saturation": 14, "vibrance": 18, "sharpen": 20, "denoise": 4, "exposure": 2, "highlights": -6, "shadows": 4},
    "gray": {"mode": "gray", "flatten": 95, "wb": "gray", "contrast": 22, "gamma": 1, "saturation": 0, "vibrance": 0, "sharpen": 18, "denoise": 4, "exposure": 0, "highlights": 0, "shadows": 0},
    "bw": {"mode": "bw", "flatten": 100, "wb": "gray", "contrast": 10, "gamma": 1, "saturation": 0, "vibrance": 0, "sharpen": 12, "denoise": 8, "exposure": 0, "highlights": 0, "shadows": 0, "threshold": 0, "window": 100},
    "whiteboard": {"mode": "color", "flatten": 100, "wb": "white", "contrast": 42, "gamma": 1.1, "saturation": 45, "vibrance": 25, "sharpen": 14, "denoise": 10, "exposure": 4, "highlights": -10, "shadows": 0},
    "ink": {"mode": "gray", "flatten": 100, "wb": "gray", "contrast": 56, "gamma": 0.82, "saturation": 0, "vibrance": 0, "sharpen": 26, "denoise": 6, "exposure": -2, "highlights": 0, "shadows": -12},
    "photo": {"mode": "color", "flatten": 0, "wb": "off", "contrast": 8, "gamma": 1, "saturation": 8, "vibrance": 12, "sharpen": 8, "denoise": 0, "exposure": 0, "highlights": 0, "shadows": 0},
}
#: The least and greatest setting of each control.
RANGES = {
    "straighten": (-15, 15), "flatten": (0, 100), "temp": (-100, 100), "tint": (-100, 100), "exposure": (-100, 100), "contrast": (-100, 100), "highlights": (-100, 100),
    "shadows": (-100, 100), "saturation": (-100, 100), "vibrance": (-100, 100), "gamma": (0.3, 3), "denoise": (0, 100), "sharpen": (0, 150), "threshold": (-50, 50), "window": (20, 300),
}


def preset_record(name: str) -> dict:
    """All fields of a preset: its own over the defaults."""
    own = {k: (float(v) if isinstance(v, int | float) else v) for k, v in PRESETS[name].items()}
    return DEFAULTS | own


def preset_table(spark: SparkSession) -> DataFrame:
    rows = [(n, *[preset_record(n)[k] for k in DEFAULTS]) for n in PRESETS]
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in DEFAULTS.items())
    return spark.createDataFrame(rows, f"filter string, {kinds}")


def apply_preset(pages: DataFrame, name: Column) -> DataFrame:
    """pages with the fields of the preset that `name` gives.  Geometry, size and inversion
    stay; an unknown name leaves a page as it is.  The table has eight rows."""
    t = preset_table(pages.sparkSession)
    t = t.select(*[F.col(c).alias(f"_{c}") for c in t.columns])
    j = pages.withColumn("_name", name).join(F.broadcast(t), F.col("_name") == F.col("_filter"), "left")
    held = set(pages.columns)
    return j.select(*[F.col(c) for c in pages.columns if c not in DEFAULTS and c != "filter"], (F.coalesce("_filter", "filter") if "filter" in held else F.col("_filter")).alias("filter"), *[(F.coalesce(f"_{c}", c) if c in held else F.col(f"_{c}")).alias(c) for c in DEFAULTS])


def with_defaults(pages: DataFrame) -> DataFrame:
    """Settings read back from a store: fields that are missing or null take their default."""
    return pages.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in pages.columns else F.lit(v) for k, v in (DEFAULTS | {"filter": "auto"}).items()})


def edit(pages: DataFrame, field: str, value: Column) -> DataFrame:
    """A slider moved: the value, kept in its range, and the preset becomes `custom`."""
    low, high = RANGES[field]
    return pages.withColumns({field: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value)), "filter": F.lit("custom")})


def reset_field(pages: DataFrame, field: str) -> DataFrame:
    """A slider put back to what the page's present preset says, or else the default: a page
    whose sliders were moved is `custom`, which is no preset."""
    value = F.lit(DEFAULTS[field])
    for n in PRESETS:
        value = F.when(F.col("filter") == n, F.lit(preset_record(n)[field])).otherwise(value)
    return pages.withColumn(field, value)


def reset_all(pages: DataFrame, chosen: Column) -> DataFrame:
    """The chosen pages as a new one begins: defaults with the `auto` preset, no turn, flip or inversion."""
    fresh = preset_record("auto") | {"filter": "auto"} | GEOMETRY | {"outSize": "detected", "invert": False}
    return pages.withColumns({k: F.when(chosen, F.lit(v)).otherwise(F.col(k)) for k, v in fresh.items() if k in pages.columns})


def choose(pages: DataFrame, field: str, value: Column) -> DataFrame:
    """White balance, inversion or size chosen: the preset's name stays."""
    if field not in ("wb", "invert", "outSize"):
        raise ValueError(f"{field} is not a choice")
    return pages.withColumn(field, value)


def flip(pages: DataFrame, field: str, chosen: Column) -> DataFrame:
    """flipH or flipV turned over on the chosen pages."""
    return pages.withColumn(field, F.when(chosen, ~F.col(field)).otherwise(F.col(field)))


def neutral(pages: DataFrame) -> DataFrame:
    """The `before` view: every correction off, geometry kept."""
    off = preset_record("original")
    return pages.withColumns({k: F.lit(off[k]) for k in DEFAULTS} | {"filter": F.lit("original")})


def apply_to_all(pages: DataFrame, chosen: Column, order: str = "id") -> DataFrame:
    """The settings of the chosen page on all pages; each keeps its geometry.  Of several
    chosen pages the first by `order` counts; if none is chosen, all stay as they are."""
    fields = [c for c in pages.columns if c in DEFAULTS or c in ("filter", "outSize", "invert")]
    one = pages.filter(chosen).orderBy(order).limit(1).select(F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in fields])
    j = pages.join(F.broadcast(one), F.lit(True), "left")  # a single row
    return j.select(*[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in pages.columns])


def inherit(pages: DataFrame, key: str, order: str, own: Column) -> DataFrame:
    """Settings of pages in the order they were taken: one that brings its own (`own` holds)
    keeps all its fields, another takes those of the nearest page before that does, without
    its turns and flips; one before which there is none keeps its own."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    fields = [c for c in pages.columns if c in DEFAULTS or c in ("filter", "outSize", "invert")]
    held = F.last(F.when(own, F.struct(*[F.col(c) for c in fields])), ignorenulls=True).over(w)
    j = pages.withColumn("_held", held).withColumn("_takes", F.coalesce(~own, F.lit(True)) & F.col("_held").isNotNull())
    taken = {c: F.when(F.col("_takes"), F.col("_held")[c]).otherwise(F.col(c)) for c in fields}
    level = {c: F.when(F.col("_takes"), F.lit(v)).otherwise(F.col(c)) for c, v in GEOMETRY.items() if c in pages.columns}
    return j.select(*[(taken | level).get(c, F.col(c)).alias(c) for c in pages.columns])


def changed(field: Column, default: float) -> Column:
    return F.abs(field - F.lit(float(default))) > 1e-9


def in_range(pages: DataFrame) -> Column:
    """Whether all settings of a page lie within their controls."""
    out = F.lit(True)
    for k, (low, high) in RANGES.items():
        if k in pages.columns:
            out = out & F.col(k).between(float(low), float(high))
    return out


def turn(rotate: Column, by: float) -> Column:
    return F.pmod(rotate + F.lit(float(by)), F.lit(360.0))
