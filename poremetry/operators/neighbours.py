"""Vertical neighbourhoods: every scanline together with the scanlines around it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from poremetry.functions.rows import clamped, mirrored

# Upper bound of the pixels one band (a task-sized group of scanlines) holds.
BAND_PIXELS = 1 << 20

EDGES = {"replicate": clamped, "reflect": mirrored}


def band_rows(height: Column, width: Column, at_least: int = 1, pixels: int | None = None) -> Column:
    """Scanlines per band, so that a band holds at most ``pixels`` pixels (or ``at_least`` rows)."""
    rows = F.floor(F.lit(float(pixels or BAND_PIXELS)) / width).cast("int")
    return F.greatest(F.lit(at_least), rows)


def bundle(pixels: int | None = None) -> Column:
    """Number of the group of neighbouring image ids that fit ``pixels`` pixels together; an image of that size or more has its own.

    Grouping by (height, width, bundle, band) gives as many groups as the pixels need, not as many as there are images.
    """
    area = F.col("height").cast("double") * F.col("width")
    images = F.greatest(F.lit(1), F.floor(F.lit(float(pixels or BAND_PIXELS)) / area)).cast("bigint")
    return F.col("image_id") - F.pmod(F.col("image_id"), images)


def by_size(rows: DataFrame, small: Callable[[DataFrame], DataFrame], tall: Callable[[DataFrame], DataFrame], band_pixels: int | None = None) -> DataFrame:
    """``small`` of the images of one band and ``tall`` of the others, if there are any, in a written table."""
    one = F.col("height") <= band_rows(F.col("height"), F.col("width"), pixels=band_pixels)
    if rows.where(~one).isEmpty():
        return small(rows)
    return small(rows.where(one)).unionByName(tall(rows.where(~one)))


def stacked(rows: DataFrame, column: str, radius: int, edge: str = "clip", below: int | None = None) -> DataFrame:
    """Adds ``stack``: ``column`` of the rows y-radius .. y+below, in order.

    Rows are grouped in bands of bounded size and only ``radius`` rows per seam are copied, so one image of any size
    is spread over many tasks. At the frame, ``edge`` repeats ("replicate") or mirrors ("reflect") rows; "clip"
    leaves them out and the stack is shorter there.
    """
    below = radius if below is None else below
    reach = max(radius, below)
    y, height = F.col("y"), F.col("height")
    band = band_rows(height, F.col("width"), at_least=max(1, 4 * reach))
    bands = F.greatest(F.lit(1), F.ceil(height / band)).cast("int")
    targets = F.array(y)
    if edge != "clip" and reach:
        outside = F.concat(F.sequence(F.lit(-reach), F.lit(-1)), F.sequence(height, height + reach - 1))
        targets = F.concat(targets, F.filter(outside, lambda t: EDGES[edge](t, height) == y))
    touched = F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("at") - reach) / band).cast("int")),
        F.least(bands - 1, F.floor((F.col("at") + reach) / band).cast("int")),
    )
    kept = [c for c in rows.columns]
    around = Window.partitionBy("image_id", "band").orderBy("at").rowsBetween(-radius, below)
    return (
        rows.withColumn("at", F.explode(targets))
        .withColumn("band", F.explode(touched))
        .withColumn("stack", F.collect_list(column).over(around))
        .where((F.col("at") >= 0) & (F.col("at") < height) & (F.floor(F.col("at") / band) == F.col("band")))
        .drop("at", "band")
        .select(*kept, "stack")
    )
