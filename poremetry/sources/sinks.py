"""Written results: measurement CSV, mask and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poremetry.operators.measure import PORE_COLUMNS
from poremetry.sources.rasters import stem
from poremetry.workspace import attach, materialize


def csv_rows(pores: DataFrame) -> DataFrame:
    """The pore table in export order; missing values become empty cells."""
    return pores.select(*PORE_COLUMNS)


def write_csv(pores: DataFrame, folder: str) -> None:
    """CSV with a header in every part, also when there are no pores."""
    csv_rows(pores).write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(folder)


def _named(rows: DataFrame, paths: DataFrame | None, suffix: str) -> DataFrame:
    if paths is None:
        return rows.withColumn("name", F.concat(F.lit("image_"), F.col("image_id"), F.lit(suffix)))
    names = paths.select("image_id", F.concat(stem(F.col("path")), F.lit(suffix)).alias("name"))
    return attach(rows, materialize(names), ["image_id"])


def mask_rows(mask: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Foreground runs of a mask under the name ``<stem>_mask``."""
    return _named(mask.select("image_id", "y", F.inline("runs")), paths, "_mask")


def label_rows(label_runs: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Label runs under the name ``<stem>_labels``."""
    return _named(label_runs.select("image_id", "y", "x0", "x1", "label"), paths, "_labels")


def write_masks(mask: DataFrame, folder: str, paths: DataFrame | None = None) -> None:
    """Parquet runs clustered by image, so that reading one image prunes row groups."""
    mask_rows(mask, paths).repartitionByRange("image_id", "y").sortWithinPartitions("image_id", "y").write.parquet(folder)


def write_labels(label_runs: DataFrame, folder: str, paths: DataFrame | None = None) -> None:
    label_rows(label_runs, paths).repartitionByRange("image_id", "y").sortWithinPartitions("image_id", "y").write.parquet(folder)
