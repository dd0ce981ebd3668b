"""Coloured pixel tables (image_id, y, x, b, g, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from poremetry.functions.gray import blend
from poremetry.functions.rows import bits_of_runs, labels_of_runs
from poremetry.workspace import attach, materialize

# Overlay strength, mask tint (BGR), hue range, saturation and value of label colours.
ALPHA = 0.45
MASK_TINT = (255, 80, 255)
HUES, SATURATION, VALUE = 179, 200, 255

CHANNELS = ("b", "g", "r")


def palette(label: Column, channel: str) -> Column:
    """Colour of a label, spread by a multiplicative hash; label 0 is black."""
    factor = {"b": 40503, "g": 30011, "r": 20021}[channel]
    return F.when(label > 0, (label.cast("bigint") * factor) % 256).otherwise(0).cast("int")


def label_rows(scan: DataFrame, label_runs: DataFrame) -> DataFrame:
    """Scanlines with a ``label`` array beside ``v``."""
    lists = label_runs.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "label"))).alias("l"))
    empty = F.array().cast("array<struct<x0:int,x1:int,label:int>>")
    return scan.join(lists, ["image_id", "y"], "left").select(
        "image_id", "height", "width", "y", "v", labels_of_runs(F.coalesce("l", empty), F.col("width")).alias("label"))


def _pixels(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", "y", F.posexplode(F.arrays_zip("v", "label")).alias("x", "p")).select(
        "image_id", "y", "x", F.col("p.v").alias("v"), F.col("p.label").alias("label"))


def colour_labels(scan: DataFrame, label_runs: DataFrame, on_gray: bool = True, alpha: float = ALPHA) -> DataFrame:
    """Palette colours; over gray the whole frame is blended (background darkens). Images without labels stay gray."""
    pixels = _pixels(label_rows(scan, label_runs))
    if not on_gray:
        return pixels.select("image_id", "y", "x", *[palette(F.col("label"), c).alias(c) for c in CHANNELS])
    labelled = materialize(label_runs.select("image_id").distinct().withColumn("any", F.lit(True)))
    pixels = attach(pixels, labelled, ["image_id"], "left")
    return pixels.select("image_id", "y", "x", *[
        F.when(F.col("any"), blend(palette(F.col("label"), c), F.col("v"), alpha)).otherwise(F.col("v")).alias(c) for c in CHANNELS])


def scrambled(image: Column, label: Column, seed: int) -> Column:
    """Multiplicative hash of (image, label, seed) below 2^32."""
    start = (F.pmod(image, F.lit(2 ** 31)) + seed) * 40503
    return (label.cast("bigint") * 2654435761 + start) % 2 ** 32


def hue_colours(label_runs: DataFrame, seed: int = 123) -> DataFrame:
    """(image_id, label, b, g, r): evenly spaced hues handed to the labels of an image in a seeded hash order."""
    labels = label_runs.select("image_id", "label").distinct()
    # Ranks come from hash slices, so that the labels of one image are not sorted in one task.
    sliced = labels.withColumn("h", scrambled(F.col("image_id"), F.col("label"), seed)).withColumn("slice", F.shiftright("h", 24))
    sizes = sliced.groupBy("image_id", "slice").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("image_id").orderBy("slice")
    sizes = sizes.select("image_id", "slice", F.coalesce(F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                         F.sum("k").over(Window.partitionBy("image_id")).alias("n"))
    ranked = sliced.withColumn("i", F.row_number().over(Window.partitionBy("image_id", "slice").orderBy("h", "label")) - 1)
    hue = F.floor((F.col("i") + F.col("before")) * F.lit(float(HUES)) / F.col("n"))
    sixth = ranked.join(sizes, ["image_id", "slice"]).withColumn("hue", hue).withColumn("s", F.floor(F.col("hue") / 30)).withColumn("f", F.col("hue") / 30 - F.floor(F.col("hue") / 30))
    low = F.lit(VALUE * (1 - SATURATION / 255))
    fall, rise = VALUE * (1 - SATURATION / 255 * F.col("f")), VALUE * (1 - SATURATION / 255 * (1 - F.col("f")))
    top = F.lit(float(VALUE))
    # Fixed values: (r, g, b) of the six hue sectors.
    sectors = [(top, rise, low), (fall, top, low), (low, top, rise), (low, fall, top), (rise, low, top), (top, low, fall)]

    def channel(k: int) -> Column:
        out = sectors[5][k]
        for s in range(4, -1, -1):
            out = F.when(F.col("s") == s, sectors[s][k]).otherwise(out)
        return F.rint(out).cast("int")

    return sixth.select("image_id", "label", channel(2).alias("b"), channel(1).alias("g"), channel(0).alias("r"))


def colour_hues(scan: DataFrame, label_runs: DataFrame, seed: int = 123, on_gray: bool = False, alpha: float = ALPHA) -> DataFrame:
    """Hue colours; over gray only labelled pixels are blended.

    A run carries its colour as one positive number in the list of its scanline, so pixels are made only for the result.
    """
    packed = (F.col("b") + F.col("g") * 256 + F.col("r") * 65536 + 2 ** 24).cast("int")
    colours = materialize(hue_colours(label_runs, seed).select("image_id", "label", packed.alias("colour")))
    runs = attach(label_runs, colours, ["image_id", "label"]).select("image_id", "y", "x0", "x1", F.col("colour").alias("label"))
    pixels = _pixels(label_rows(scan, runs))
    ground = F.col("v") if on_gray else F.lit(0)
    a = alpha if on_gray else 1.0
    tint = lambda k: F.shiftright("label", 8 * k).bitwiseAND(255)
    return pixels.select("image_id", "y", "x", *[
        F.when(F.col("label") == 0, ground).otherwise(blend(tint(k), ground, a)).alias(c) for k, c in enumerate(CHANNELS)])


def mask_overlay(scan: DataFrame, mask: DataFrame, alpha: float = ALPHA, style: str = "raise") -> DataFrame:
    """Mask over gray: "raise" lifts green and red to 255 before blending, "tint" blends the whole frame with a tint."""
    rows = scan.join(mask.select("image_id", "y", "runs"), ["image_id", "y"]).select(
        "image_id", "y", "v", bits_of_runs(F.col("runs"), F.col("width")).alias("label"))
    pixels = _pixels(rows)
    on, v = F.col("label") == 1, F.col("v")
    if style == "raise":
        tops = {"b": v, "g": F.when(on, 255).otherwise(v), "r": F.when(on, 255).otherwise(v)}
        return pixels.select("image_id", "y", "x", *[blend(tops[c], v, alpha).alias(c) for c in CHANNELS])
    used = materialize(mask.where(F.size("runs") > 0).select("image_id").distinct().withColumn("any", F.lit(True)))
    pixels = attach(pixels, used, ["image_id"], "left")
    return pixels.select("image_id", "y", "x", *[
        F.when(F.col("any"), blend(F.when(on, t).otherwise(0), v, alpha)).otherwise(v).alias(c) for c, t in zip(CHANNELS, MASK_TINT)])
