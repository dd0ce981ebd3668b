"""Filters, metric values, histograms and the report table over pores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poremetry.operators.calibrate import common_unit

# Pixel and unit column of every metric.
METRICS = {
    "eq_diam": ("eq_diam_px", "eq_diam_units"),
    "area": ("area_px", "area_units2"),
    "circularity": ("circularity", None),
    "feret_max": ("feret_max_px", "feret_max_units"),
    "feret_min": ("feret_min_px", "feret_min_units"),
    "major_axis": ("major_axis_px", "major_axis_units"),
    "minor_axis": ("minor_axis_px", "minor_axis_units"),
}


def scope(pores: DataFrame, image_index: int | None = None) -> DataFrame:
    """Pores of one image, or of all."""
    return pores if image_index is None else pores.where(F.col("image_index") == image_index)


def exclude_border(pores: DataFrame) -> DataFrame:
    return pores.where(~F.col("touches_border"))


def units_available(scales: DataFrame) -> bool:
    """Whether all scaled images share one unit, the condition for values in units."""
    return common_unit(scales).first()["unit_name"] is not None


def in_units(px: str, units: str | None, scales: DataFrame | None) -> Column:
    """The value in units where all scaled images share one unit and the pore has a scale, else in pixels."""
    value = F.col(px).cast("double")
    return F.when(F.col("_common"), F.coalesce(F.col(units), value)).otherwise(value) if units and scales is not None else value


def with_common(pores: DataFrame, scales: DataFrame | None) -> DataFrame:
    """Adds whether values in units are comparable: one row of facts, joined without a driver read."""
    if scales is None:
        return pores
    return pores.join(F.broadcast(common_unit(scales).select(F.col("unit_name").isNotNull().alias("_common"))), F.lit(True))


def area_range(pores: DataFrame, smallest: float = 0.0, largest: float = 0.0, scales: DataFrame | None = None) -> DataFrame:
    """Pores with an area inside inclusive bounds; 0 means no bound.

    With ``scales`` bounds are in units if these share one unit; else, and for a pore without scaled area, in pixels.
    """
    pores = with_common(pores, scales)
    area = in_units("area_px", "area_units2", scales)
    if smallest > 0:
        pores = pores.where(area >= smallest)
    if largest > 0:
        pores = pores.where(area <= largest)
    return pores.drop("_common")


def select_pores(pores: DataFrame, image_index: int | None = None, border: bool = True, smallest: float = 0.0,
                 largest: float = 0.0, scales: DataFrame | None = None) -> DataFrame:
    chosen = scope(pores, image_index)
    return area_range(chosen if border else exclude_border(chosen), smallest, largest, scales)


def metric_values(pores: DataFrame, scales: DataFrame | None = None, metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """(image_index, label, metric, value) for every known metric asked for; missing values are left out."""
    known = [m for m in metrics if m in METRICS]
    if not known:
        return pores.select("image_index", "label", F.lit("").alias("metric"), F.lit(0.0).alias("value")).where(F.lit(False))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), in_units(*METRICS[m], scales).alias("value")) for m in known])
    missing = F.col("value").isNull() | (F.isnan("value") & F.col("metric").isin("eq_diam", "circularity"))
    return with_common(pores, scales).select("image_index", "label", F.inline(pairs)).where(~missing)


def histogram(values: DataFrame, bins: int = 40) -> DataFrame:
    """(metric, bin, lo, hi, n, log_n): equal bins between the extremes, the last one closed, empty bins kept.

    Values are counted in one pass after the extremes; a metric with one distinct value gets a range of +-0.5.
    """
    bins = max(5, min(400, int(bins)))
    low, high = F.min("value"), F.max("value")
    extremes = values.groupBy("metric").agg(low.alias("low"), high.alias("high")).select(
        "metric", F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    # At most one row per metric, so at most seven rows.
    index = F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(bins - 1)).cast("int")
    counts = values.join(F.broadcast(extremes), "metric").groupBy("metric", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = extremes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return grid.join(counts, ["metric", "bin"], "left").select(
        "metric", "bin", (F.col("low") + F.col("bin") * width).alias("lo"), (F.col("low") + (F.col("bin") + 1) * width).alias("hi"),
        n.alias("n"), F.when(n > 0, F.log10(n)).alias("log_n"))


def pore_table(pores: DataFrame) -> DataFrame:
    """Report rows: three decimals (one for the angle), missing values as empty text, frame contact as yes/no."""
    def text(name: str, digits: int = 3) -> Column:
        shown = F.when(F.isnan(name), "nan").otherwise(F.format_string(f"%.{digits}f", name))
        return F.when(F.col(name).isNull(), "").otherwise(shown).alias(name)

    return pores.select(
        "image_index", "label", "area_px", *[text(c) for c in (
            "eq_diam_px", "circularity", "feret_max_px", "feret_min_px", "major_axis_px", "minor_axis_px", "aspect_ratio")],
        text("orientation_deg", 1), F.when(F.col("touches_border"), "yes").otherwise("no").alias("border"))


def labelled_count(frames: DataFrame, label_runs: DataFrame) -> DataFrame:
    """(labelled, total): how many images carry labels."""
    labelled = label_runs.select("image_id").distinct().withColumn("has", F.lit(1))
    return frames.select("image_id").distinct().join(labelled, "image_id", "left").agg(
        F.count("has").alias("labelled"), F.count(F.lit(1)).alias("total"))
