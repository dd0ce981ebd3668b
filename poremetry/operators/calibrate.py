"""Pixel scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unit_or_mm(unit: Column) -> Column:
    trimmed = F.trim(F.coalesce(unit, F.lit("")))
    return F.when(trimmed == "", "mm").otherwise(trimmed)


def two_point_scales(calibrations: DataFrame) -> DataFrame:
    """Scales from (image_id, x1, x2, real_length, unit): length over horizontal pixel distance.

    A length that is not positive gives a NULL scale.
    """
    pixels = F.abs(F.col("x2") - F.col("x1")).cast("double")
    return calibrations.select(
        "image_id", F.when(F.col("real_length") > 0, F.col("real_length") / F.greatest(pixels, F.lit(1e-9))).alias("units_per_px"),
        unit_or_mm(F.col("unit")).alias("unit_name"))


def manual_scales(entries: DataFrame) -> DataFrame:
    """Scales from (image_id, mode, value, unit) with mode "unitsPerPx" or "pxPerUnit"; value must be positive."""
    value = F.col("value").cast("double")
    scale = F.when(value > 0, F.when(F.col("mode") == "unitsPerPx", value).otherwise(1.0 / value))
    return entries.select("image_id", scale.alias("units_per_px"), unit_or_mm(F.col("unit")).alias("unit_name"))


def current_scales(images: DataFrame, events: DataFrame) -> DataFrame:
    """Scale of every image after an event log (seq, image_id, units_per_px, unit_name); the last writer wins.

    An event without image_id sets all images; only the latest of those matters, so it is one row.
    """
    fact = F.struct("seq", "units_per_px", "unit_name")
    own = events.where("image_id is not null").groupBy("image_id").agg(F.max_by(fact, "seq").alias("own"))
    shared = events.where("image_id is null").agg(F.max_by(fact, "seq").alias("shared"))
    joined = images.select("image_id").distinct().join(own, "image_id", "left").join(F.broadcast(shared), how="left")
    last = F.when(F.col("shared").isNotNull() & (F.col("own").isNull() | (F.col("shared.seq") > F.col("own.seq"))), F.col("shared")).otherwise(F.col("own"))
    return joined.select("image_id", last.alias("s")).where("s is not null").select(
        "image_id", F.col("s.units_per_px").alias("units_per_px"), F.col("s.unit_name").alias("unit_name"))


def common_unit(scales: DataFrame) -> DataFrame:
    """One row (unit_name): the unit all scaled images share, "" allowed, NULL when they differ or none is scaled."""
    name = F.coalesce("unit_name", F.lit(""))
    return scales.agg(F.min(name).alias("low"), F.max(name).alias("high")).select(
        F.when(F.col("low") == F.col("high"), F.col("low")).alias("unit_name"))
