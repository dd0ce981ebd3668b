"""Colour to gray and value ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# BT.601 luma weights of blue, green and red.
BLUE, GREEN, RED = 0.114, 0.587, 0.299


def luma(b: Column, g: Column, r: Column) -> Column:
    """Gray value of a BGR pixel, rounded to a whole number."""
    return F.floor(b * BLUE + g * GREEN + r * RED + 0.5).cast("int")


def stretch(v: Column, low: Column, high: Column) -> Column:
    """Linear map of [low, high] to 0..255, truncated; 0 for a constant image."""
    return F.when(high > low, F.floor((v - low) * 255.0 / (high - low))).otherwise(0).cast("int")


def blend(top: Column, bottom: Column, alpha: float) -> Column:
    """Weighted mean of two byte values, rounded half to even and kept in 0..255."""
    a = min(1.0, max(0.0, float(alpha)))
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(top * a + bottom * (1.0 - a)))).cast("int")
