"""Whole studies: thresholding, separation and measurement of any number of images as one set of Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from poremetry.operators import measure as measuring, separate as separating
from poremetry.operators.masks import fill_holes
from poremetry.operators.separate import SeparationParams
from poremetry.operators.threshold import ThresholdParams, mask_of, prepared, threshold, threshold_meta
from poremetry.sources.rasters import decode_once, image_files, rasters_of_images
from poremetry.workspace import attach, materialize


@dataclass(frozen=True)
class Segmentation:
    """Mask, label runs (None without separation), threshold metadata and pores (None unless measured)."""

    mask: DataFrame
    labels: DataFrame | None
    meta: DataFrame
    pores: DataFrame | None = None


def segment(scan: DataFrame, thresholds: ThresholdParams = ThresholdParams(),
            separation: SeparationParams = SeparationParams(method="none", min_area_px=0)) -> Segmentation:
    """Threshold, fill holes, drop specks, clear the border, separate, clean labels."""
    filtered = prepared(scan, thresholds)
    mask = materialize(separating.clean_mask(mask_of(filtered, thresholds), separation))
    meta = threshold_meta(filtered, replace(thresholds, median_k=0, gaussian_k=0, use_clahe=False))
    return Segmentation(mask, separating.separate(mask, separation), meta)


def process_batch(scan: DataFrame, thresholds: ThresholdParams = ThresholdParams(),
                  separation: SeparationParams = SeparationParams(), scales: DataFrame | None = None,
                  measure: bool = True) -> Segmentation:
    """Segment and measure all images; image_id carries the order, so results never depend on scheduling.

    The number of workers is the cluster's affair: a sequential run is the same job.
    """
    done = segment(scan, thresholds, separation)
    if done.labels is None or not measure:
        return done
    labels = materialize(done.labels)
    return replace(done, labels=labels, pores=measuring.measure(labels, scales))


def threshold_batch(scan: DataFrame, method: str = "otsu", polarity: str = "auto", **settings) -> DataFrame:
    """Masks only; holes are filled as in the full pipeline."""
    return fill_holes(threshold(scan, ThresholdParams(method=method, polarity=polarity, **settings)))


def process_rasters(rasters: DataFrame, thresholds: ThresholdParams = ThresholdParams(),
                    separation: SeparationParams = SeparationParams(), scales: DataFrame | None = None,
                    measure: bool = True) -> tuple[Segmentation, DataFrame]:
    """(results, rejects): unusable rasters are reported and never stop the others. Every raster is decoded once."""
    scan, files = decode_once(rasters)
    return process_batch(scan, thresholds, separation, scales, measure), files.where("error IS NOT NULL").select("image_id", "error")


def process_folder(spark: SparkSession, folder: str, thresholds: ThresholdParams = ThresholdParams(),
                   separation: SeparationParams = SeparationParams(), scales: DataFrame | None = None,
                   measure: bool = True) -> tuple[Segmentation, DataFrame]:
    """(results, files) of the image files below a folder; ``files`` lists every file (image_id, path, height, width, error)."""
    scan, files = decode_once(rasters_of_images(image_files(spark, folder)))
    return process_batch(scan, thresholds, separation, scales, measure), files


def label_mask(mask: DataFrame, separation: SeparationParams = SeparationParams()) -> DataFrame | None:
    """Labels of an edited mask: the pipeline from hole filling onwards."""
    return separating.separate(separating.clean_mask(mask, separation), separation)


def apply_scope(previous: DataFrame, fresh: DataFrame, image_id: int | None = None) -> DataFrame:
    """Results after applying ``fresh`` to one image, or to every image it holds."""
    if image_id is not None:
        fresh = fresh.where(F.col("image_id") == image_id)
        return previous.where(F.col("image_id") != image_id).unionByName(fresh)
    return attach(previous, materialize(fresh.select("image_id").distinct()), ["image_id"], "left_anti").unionByName(fresh)


def with_progress(rows: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Attach a counter of finished scanlines and images to a stage; read it with ``observation.get``."""
    watch = Observation(name)
    counted = rows.observe(watch, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("y") == 0, 1)).alias("images"))
    return counted, watch
