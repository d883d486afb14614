"""Pointwise pixel expressions.  A stored pixel is clamped to 0..255 and rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNEE = 232.0


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))


def clamp8(v: Column) -> Column:
    return F.rint(clamp(v, 0, 255))


def luma601(r: Column, g: Column, b: Column) -> Column:
    """Integer luma, as detection and motion use."""
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def luma709(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.2126) + g * F.lit(0.7152) + b * F.lit(0.0722)


def shoulder(v: Column) -> Column:
    """Rolls highlights off above the knee instead of clipping them."""
    span = F.lit(255.0 - KNEE)
    return F.when(v <= KNEE, F.greatest(v, F.lit(0.0))).otherwise(F.lit(KNEE) + span * F.tanh((v - KNEE) / span))


def temp_tint(r: Column, g: Column, b: Column, temp: float, tint: float) -> list[Column]:
    t, ti = temp / 300, tint / 300
    return [clamp8(r * F.lit((1 + t) * (1 - ti * 0.5))), clamp8(g * F.lit(1 + ti)), clamp8(b * F.lit((1 - t) * (1 - ti * 0.5)))]


def tone(i: Column, exposure: Column, contrast: Column, gamma: Column, highlights: Column, shadows: Column) -> Column:
    """The tone curve at input level i: exposure, contrast, gamma, shadows, highlights, shoulder."""
    c = clamp(contrast, -100, 100) * F.lit(2.55)
    factor = (F.lit(259.0) * (c + 255)) / (F.lit(255.0) * (F.lit(259.0) - c))
    v = factor * ((i + exposure * F.lit(1.28)) - 128) + 128
    v = F.lit(255.0) * F.pow(clamp(v, 0, 255) / 255, F.lit(1.0) / clamp(gamma, 0.05, 10))
    n = v / 255
    v = v + shadows * F.lit(1.15) * F.pow(F.lit(1.0) - n, F.lit(2.2)) + highlights * F.lit(1.15) * F.pow(n, F.lit(2.2))
    span = F.lit(255.0 - KNEE)
    v = F.when(v > KNEE, F.lit(KNEE) + span * F.tanh((v - KNEE) / span)).otherwise(v)
    return clamp(F.floor(v + 0.5), 0, 255).cast("int")


def saturate(r: Column, g: Column, b: Column, saturation: float, vibrance: float) -> list[Column]:
    lum = luma709(r, g, b)
    amount = F.lit(1 + saturation / 100)
    if vibrance:
        amount = amount + F.lit(vibrance / 100) * (F.lit(1.0) - (F.greatest(r, g, b) - F.least(r, g, b)) / 255)
    return [clamp8(lum + (c - lum) * amount) for c in (r, g, b)]


def grayscale(r: Column, g: Column, b: Column) -> Column:
    return clamp8(luma709(r, g, b))


def size_text(n: Column) -> Column:
    """A byte count for people: B, KB without and MB with a decimal below 10."""
    kb, mb = n / 1024, n / 1048576
    whole = lambda c: F.floor(c + 0.5).cast("long").cast("string")
    tenth = F.format_string("%.1f", F.floor(mb * 10 + 0.5) / 10)
    return (
        F.when(n.isNull() | F.isnan(n.cast("double")), F.lit("—"))
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(whole(kb), F.lit(" KB")))
        .when(n < 10485760, F.concat(tenth, F.lit(" MB")))
        .otherwise(F.concat(whole(mb), F.lit(" MB")))
    )

