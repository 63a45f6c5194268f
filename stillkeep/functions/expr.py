"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """x limited to [0, 1]; null stays null, which greatest and least alone would hide."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def linear_score(x: Column, low: float, high: float) -> Column:
    return clamp01((x - F.lit(low)) / F.lit(high - low))


def weighted_average(pairs: list[tuple[Column, float]]) -> Column:
    """Mean of the scores that are there; a null score drops out with its weight. No weight left is an error."""
    total = sum((F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0) for s, w in pairs), F.lit(0.0))
    value = sum((F.coalesce(s * F.lit(float(w)), F.lit(0.0)) for s, w in pairs), F.lit(0.0))
    return F.when(total > 0, value / total).otherwise(F.raise_error("the sum of weights must be positive").cast("double"))


def valid_preview(width: Column, height: Column, rgb: Column) -> Column:
    return F.coalesce((width > 0) & (height > 0) & (F.octet_length(rgb) == width * height * 3), F.lit(False))


def preview_dims(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size of a preview at most ``most`` wide; the height is rounded half to even."""
    wide = width > most
    scaled = F.bround(height * F.lit(float(most)) / width, 0).cast("int")
    return F.when(wide, F.lit(most)).otherwise(width), F.when(wide, scaled).otherwise(height)
