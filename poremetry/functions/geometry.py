"""Crop rectangles as column expressions; x1 and y1 are exclusive, NULL stands for an unusable rectangle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rect(x0, y0, x1, y1) -> Column:
    """Rectangle struct, NULL when it is empty."""
    return F.when((x1 > x0) & (y1 > y0), F.struct(
        x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1")))


def clamp_rect(x0: Column, y0: Column, x1: Column, y1: Column, height: Column, width: Column) -> Column:
    """Rectangle moved into the frame; one that lies fully outside shrinks to a corner pixel."""
    zero, one = F.lit(0), F.lit(1)
    return rect(
        F.greatest(zero, F.least(x0, width - 1)), F.greatest(zero, F.least(y0, height - 1)),
        F.greatest(one, F.least(x1, width)), F.greatest(one, F.least(y1, height)))


def rect_to_margins(x0: Column, y0: Column, x1: Column, y1: Column, height: Column, width: Column) -> Column:
    """Distances of a rectangle to the frame sides, never negative."""
    cut = lambda c: F.greatest(F.lit(0), c).cast("int")
    return F.struct(cut(x0).alias("left"), cut(y0).alias("top"), cut(width - x1).alias("right"), cut(height - y1).alias("bottom"))


def margins_to_rect(left: Column, top: Column, right: Column, bottom: Column, height: Column, width: Column) -> Column:
    """Rectangle that keeps the margins; negative margins count as 0, NULL when nothing is left."""
    zero = F.lit(0)
    return rect(F.greatest(zero, left), F.greatest(zero, top), width - F.greatest(zero, right), height - F.greatest(zero, bottom))
