"""Named queries over the driver tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from poremetry.functions.geometry import clamp_rect, margins_to_rect, rect_to_margins
from poremetry.operators import (
    analyse, calibrate, components as cc, edits, filters, geometry, masks, measure, render, separate, threshold as th)
from poremetry.operators.separate import SeparationParams
from poremetry.operators.threshold import ThresholdParams
from poremetry.plans import study
from poremetry.sources import rasters, sinks, tables
from poremetry.workspace import materialize, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Inputs ------------------------------------------------------------------------------------------------------------

BRIGHT = ThresholdParams(polarity="poresBrighter", median_k=0)
SPLIT = SeparationParams(min_area_px=3, peak_min_distance=3, fill_holes=True)


def line(spark, folder):
    return tables.lineitem_density(spark, folder)


def event(spark, folder):
    return tables.event_density(spark, folder)


def tiles(spark, folder):
    return tables.embedding_tiles(spark, folder)


def line_mask(spark, folder):
    return th.threshold(line(spark, folder), BRIGHT)


def solid_mask(spark, folder):
    """Dark phase of the density rasters: large connected areas with bright specks."""
    return th.threshold(line(spark, folder), ThresholdParams(polarity="poresDarker", median_k=0))


def line_labels(spark, folder):
    return cc.components(line_mask(spark, folder), 8)


def image_scales(spark, folder):
    """Every third image has no scale, every seventh a zero one; two unit names occur."""
    k = F.col("s_suppkey")
    return tables.table(spark, folder, "supplier").where(k % 3 != 0).select(
        k.alias("image_id"), F.when(k % 7 == 0, 0.0).otherwise((k % 5 + 1) / F.lit(100.0)).alias("units_per_px"),
        F.when(k % 2 == 0, "mm").otherwise("um").alias("unit_name"))


def seeds(spark, folder):
    """One seed per order line, spread over the frames by its keys."""
    return tables.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") % 84).cast("int").alias("x"), (F.col("l_partkey") % 50).cast("int").alias("y"))


def brush_log(spark, folder):
    """Edit log of the event rasters: one edit per event, in event order."""
    e = F.col("event_id")
    kind = F.col("event_type")
    op = F.when(kind == "view", "paint").when(kind == "click", "erase").when(kind == "purchase", "paint_line").when(
        kind == "signup", "erase_line").otherwise(F.when(e % 50 == 0, "reset").otherwise("paint"))
    return tables.table(spark, folder, "events").select(
        F.col("user_id").alias("image_id"), e.alias("seq"), op.alias("op"), (e % 37 - 3).cast("int").alias("x"), (e % 29 - 2).cast("int").alias("y"),
        (e % 41 - 5).cast("int").alias("x2"), (e % 23).cast("int").alias("y2"), (e % 5).cast("int").alias("radius"))


def frame_rects(spark, folder):
    """Rectangles around and partly outside 50 x 84 frames, one per order."""
    k = F.col("o_orderkey")
    part = lambda a, b: (k % a - b).cast("int")
    return tables.table(spark, folder, "orders").select(
        k.alias("rect_id"), F.lit(50).alias("height"), F.lit(84).alias("width"),
        part(97, 8).alias("x0"), part(61, 6).alias("y0"), part(103, 4).alias("x1"), part(67, 5).alias("y1"))


def runs_of(mask):
    return cc.explode_runs(mask).select("image_id", "y", "x0", "x1")


def pixels_of(scan):
    return rasters.explode_pixels(scan)


def flat(struct: str, names) -> list:
    return [F.col(f"{struct}.{n}").alias(n) for n in names]


# Sources and sinks -------------------------------------------------------------------------------------------------


@query
def explode_pixels(spark, folder):
    rows = rasters.byte_rows(tables.colour_rasters(spark, folder))
    return rows.select("image_id", "y", F.posexplode("bytes").alias("pos", "v"))


@query
def text_raster_rows(spark, folder):
    scan = tables.text_rasters(spark, folder)
    return scan.select("image_id", "height", "y", F.aggregate(
        F.transform("v", lambda v, x: v * (x + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("weighted"))


@query
def to_gray(spark, folder):
    return pixels_of(rasters.gray_scanlines(tables.colour_rasters(spark, folder)))


@query
def minmax_normalise(spark, folder):
    scan = tables.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(1).alias("height"), F.lit(64).alias("width"), F.lit(0).alias("y"),
        F.transform("embedding", lambda e: e.cast("double")).alias("v"))
    return pixels_of(rasters.minmax_normalise(scan))


@query
def raster_rejects(spark, folder):
    """Rasters with some broken rows: missing data, wrong size, odd channel counts."""
    k = F.col("image_id")
    broken = tables.colour_rasters(spark, folder).withColumn("data", F.when(k % 5 != 0, F.col("data"))).withColumn(
        "height", F.when(k % 7 == 0, 6).otherwise(F.col("height"))).withColumn("n_channels", F.when(k % 11 == 0, 2).otherwise(F.col("n_channels")))
    usable, rejects = rasters.split_valid(broken)
    return usable.select("image_id", F.lit("ok").alias("error")).unionByName(rejects)


@query
def mask_sink(spark, folder):
    paths = tables.colour_rasters(spark, folder).select("image_id", "path")
    return sinks.mask_rows(th.pick_mask(tiles(spark, folder), 150, 60), paths)


@query
def label_sink(spark, folder):
    paths = tables.colour_rasters(spark, folder).select("image_id", "path")
    return sinks.label_rows(cc.components(th.pick_mask(tiles(spark, folder), 150, 60), 4), paths)


# Geometry ----------------------------------------------------------------------------------------------------------


@query
def clamp_rects(spark, folder):
    r = frame_rects(spark, folder)
    return r.select("rect_id", clamp_rect(*map(F.col, ("x0", "y0", "x1", "y1", "height", "width"))).alias("r")).select(
        "rect_id", *flat("r", ("x0", "y0", "x1", "y1")))


@query
def rects_to_margins(spark, folder):
    r = frame_rects(spark, folder)
    return r.select("rect_id", rect_to_margins(*map(F.col, ("x0", "y0", "x1", "y1", "height", "width"))).alias("m")).select("rect_id", "m.*")


@query
def margins_to_rects(spark, folder):
    r = frame_rects(spark, folder)
    return r.select("rect_id", margins_to_rect(*map(F.col, ("x0", "y0", "x1", "y1", "height", "width"))).alias("r")).select(
        "rect_id", *flat("r", ("x0", "y0", "x1", "y1")))


@query
def crop_rect(spark, folder):
    """Each image cropped to its own clamped rectangle; some are unusable."""
    scan = line(spark, folder)
    k = F.col("image_id")
    rects = geometry.frames(scan).select("image_id", clamp_rect(
        (k % 90 - 10).cast("int"), (k % 40).cast("int"), (k % 90 + k % 13).cast("int"), (k % 40 + 9).cast("int"), F.col("height"), F.col("width")).alias("rect"))
    return pixels_of(geometry.crop(scan, rects))


@query
def crop_mask(spark, folder):
    mask = line_mask(spark, folder)
    return runs_of(geometry.crop(mask, geometry.clamped_rects(geometry.frames(mask), 7, 5, 60, 41)))


def _sums(scan):
    weighted = F.aggregate(F.transform("v", lambda v, x: (v * (x + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return scan.groupBy("image_id", "height", "width").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(weighted * (F.col("y") + 1)).alias("weighted"))


@query
def crop_margins(spark, folder):
    scan = tables.text_rasters(spark, folder)
    return _sums(geometry.crop(scan, geometry.margin_rects(geometry.frames(scan), 5, 9, 3, 6)))


@query
def crop_batch_margins(spark, folder):
    return _sums(geometry.crop_batch(tables.text_rasters(spark, folder), rect=(4, 2, 60, 500), use_margins=True))


@query
def crop_batch_clamp(spark, folder):
    return _sums(geometry.crop_batch(tables.text_rasters(spark, folder), rect=(4, 2, 60, 12), use_margins=False))


@query
def crop_apply_all(spark, folder):
    return _sums(geometry.apply_crop(tables.text_rasters(spark, folder), (10, 20, 40, 30)))


@query
def preview_downscale(spark, folder):
    return pixels_of(geometry.preview(event(spark, folder), 100))


@query
def resize_nearest(spark, folder):
    return pixels_of(geometry.resize_nearest(event(spark, folder), 37, 20))


def _small_values(spark, folder):
    """Tiles whose values are 0/1 for two thirds of the images."""
    k = F.col("image_id")
    return tiles(spark, folder).withColumn("v", F.transform("v", lambda v: F.when(k % 3 == 0, v).otherwise((v > 127).cast("int"))))


@query
def mask_normalise(spark, folder):
    return pixels_of(masks.normalise_mask(_small_values(spark, folder), "uint8"))


@query
def bool_mask(spark, folder):
    return runs_of(masks.bool_mask(_small_values(spark, folder)))


@query
def label_normalise(spark, folder):
    signed = tiles(spark, folder).withColumn("v", F.transform("v", lambda v: (v - 128) * 2.75))
    return pixels_of(masks.normalise_labels(signed))


# Filters -----------------------------------------------------------------------------------------------------------


@query
def median_filter(spark, folder):
    return pixels_of(filters.median(event(spark, folder), 3))


@query
def median_filter_wide(spark, folder):
    return pixels_of(filters.median(tiles(spark, folder), 5))


@query
def gaussian_filter(spark, folder):
    return pixels_of(filters.gaussian(event(spark, folder), 5))


@query
def clahe(spark, folder):
    return pixels_of(filters.clahe(event(spark, folder), 2.0, 8))


@query
def local_maxima(spark, folder):
    return runs_of(th.mask_where(filters.local_maxima(line(spark, folder), "v", 5, F.lit(60)), F.col("bits")))


@query
def morph_open(spark, folder):
    return runs_of(masks.opened(solid_mask(spark, folder), 3))


@query
def morph_close(spark, folder):
    return runs_of(masks.closed(line_mask(spark, folder), 3))


@query
def morph_open_close(spark, folder):
    dark = th.threshold(line(spark, folder), ThresholdParams(polarity="poresDarker", median_k=0))
    return runs_of(masks.open_close(dark, 3))


# Thresholds --------------------------------------------------------------------------------------------------------


@query
def gray_histogram(spark, folder):
    return th.gray_histogram(line(spark, folder))


@query
def otsu_threshold(spark, folder):
    return th.otsu_thresholds(th.gray_histogram(line(spark, folder)))


@query
def percentile_threshold(spark, folder):
    found = th.percentile_thresholds(th.gray_histogram(tiles(spark, folder)), 97.5)
    return found.select("image_id", F.round("thresh", 6).alias("thresh"))


@query
def pick_mask(spark, folder):
    return runs_of(th.pick_mask(line(spark, folder), 60, 40))


@query
def polarity_choice(spark, folder):
    """Decision and contrast of every polarity mode, for the Otsu threshold of the embedding tiles."""
    hist = th.gray_histogram(tiles(spark, folder))
    facts = materialize(th.polarity_facts(hist, th.otsu_thresholds(hist)))
    picked = [th.choose_polarity(facts, p).select(
        "image_id", F.lit(p).alias("polarity"), "invert", *[F.round(c, 6).alias(c) for c in ("gap", "fg_mean", "bg_mean")]) for p in th.POLARITIES]
    return picked[0].unionByName(picked[1]).unionByName(picked[2])


@query
def otsu_mask(spark, folder):
    return runs_of(th.threshold(line(spark, folder), ThresholdParams(median_k=0)))


@query
def percentile_mask(spark, folder):
    return runs_of(th.threshold(line(spark, folder), ThresholdParams(method="percentile", percentile=93.0, polarity="poresBrighter", median_k=0)))


@query
def adaptive_mask(spark, folder):
    return runs_of(th.threshold(event(spark, folder), ThresholdParams(method="adaptive", adaptive_block=11, adaptive_c=2, median_k=0)))


@query
def eyedropper(spark, folder):
    e = F.col("event_id")
    picks = tables.table(spark, folder, "events").select(
        F.col("user_id").alias("image_id"), (e % 40 - 4).cast("int").alias("x"), (F.floor(e / 7) % 24).cast("int").alias("y"))
    return th.picked_values(event(spark, folder), picks)


@query
def threshold_meta(spark, folder):
    meta = th.threshold_meta(tiles(spark, folder), ThresholdParams(method="percentile", percentile=40.0))
    return meta.withColumn("thresh", F.round("thresh", 6))


@query
def threshold_batch(spark, folder):
    return runs_of(study.threshold_batch(line(spark, folder), "otsu", "poresDarker", median_k=0))


# Masks and components ----------------------------------------------------------------------------------------------


@query
def runs(spark, folder):
    return runs_of(line_mask(spark, folder))


@query
def components4(spark, folder):
    return cc.components(line_mask(spark, folder), 4).select("image_id", "y", "x0", "x1", "label")


@query
def components8(spark, folder):
    return line_labels(spark, folder).select("image_id", "y", "x0", "x1", "label")


@query
def fill_holes(spark, folder):
    return runs_of(masks.fill_holes(solid_mask(spark, folder)))


@query
def remove_small(spark, folder):
    return runs_of(masks.remove_small(line_mask(spark, folder), 4, 8))


@query
def clear_border(spark, folder):
    return runs_of(masks.clear_border(line_mask(spark, folder), 4))


@query
def islands(spark, folder):
    return runs_of(masks.remove_islands(line_mask(spark, folder), 3, 8, spare_border=True))


@query
def small_holes(spark, folder):
    return runs_of(masks.fill_small_holes(solid_mask(spark, folder), 5, 4))


@query
def flood_add(spark, folder):
    return runs_of(masks.flood(masks.dilate(line_mask(spark, folder), 3), seeds(spark, folder), True, 4))


@query
def flood_remove(spark, folder):
    return runs_of(masks.flood(line_mask(spark, folder), seeds(spark, folder), False, 8))


@query
def brush_stamps(spark, folder):
    log = brush_log(spark, folder)
    frame = geometry.frames(event(spark, folder))
    return edits.stamp_runs(edits.stamps(log), frame)


@query
def replay_edits(spark, folder):
    mask = th.pick_mask(event(spark, folder), 200, 55)
    return runs_of(edits.replay(mask, brush_log(spark, folder)))


@query
def replay_edits_as_of(spark, folder):
    mask = th.pick_mask(event(spark, folder), 200, 55)
    return runs_of(edits.replay(mask, brush_log(spark, folder), as_of_seq=4000))


@query
def mask_from_labels(spark, folder):
    scan = line(spark, folder)
    mask = th.pick_mask(scan, 60, 40)
    return runs_of(masks.mask_from_labels(cc.components(mask, 4), mask))


# Separation --------------------------------------------------------------------------------------------------------


@query
def distance_exact(spark, folder):
    return separate.distance_squared(solid_mask(spark, folder)).select("image_id", "y", F.posexplode("d2").alias("x", "d2"))


@query
def distance_blur(spark, folder):
    rows = separate.smoothed(separate.distance(solid_mask(spark, folder)), 3)
    return rows.select("image_id", "y", F.posexplode("d").alias("x", "d")).withColumn("d", F.round("d", 6))


@query
def distance_norm(spark, folder):
    rows = materialize(separate.distance(solid_mask(spark, folder)))
    norm = separate.normalised(rows, materialize(separate.distance_maximum(rows)))
    return norm.select("image_id", "y", F.posexplode("norm").alias("x", "n")).withColumn("n", F.round("n", 6))


@query
def markers(spark, folder):
    """Markers from the unsmoothed distance, cleared outside the foreground."""
    mask = materialize(solid_mask(spark, folder))
    found = separate.marker_runs(mask, SeparationParams(distance_blur_k=0, peak_min_distance=5, peak_rel_threshold=0.5))
    return found.select("image_id", "y", "x0", "x1", "label")


@query
def no_peak_fallback(spark, folder):
    """Markers are values of 230 and more; images without any take the components of their mask."""
    scan = tiles(spark, folder)
    found = cc.components(th.pick_mask(scan, 255, 25), 8)
    return separate.markers_or_components(found, th.pick_mask(scan, 200, 30), 8).select("image_id", "y", "x0", "x1", "label")


@query
def watershed(spark, folder):
    return separate.watershed(line_mask(spark, folder), SPLIT).select("image_id", "y", "x0", "x1", "label")


@query
def watershed_without_lines(spark, folder):
    return separate.watershed(line_mask(spark, folder), SPLIT, lines=False, frame=False).select("image_id", "y", "x0", "x1", "label")


@query
def post_cleanup(spark, folder):
    return separate.relabel(line_labels(spark, folder), 2, True).select("image_id", "y", "x0", "x1", "label")


@query
def pipeline_segment(spark, folder):
    done = study.segment(line(spark, folder), ThresholdParams(polarity="poresBrighter"), SPLIT)
    return done.labels.select("image_id", "y", "x0", "x1", "label")


@query
def pipeline_mask(spark, folder):
    """The pipeline without separation: threshold, holes, specks, border."""
    settings = SeparationParams(method="none", min_area_px=3, clear_border=True)
    return runs_of(study.segment(line(spark, folder), BRIGHT, settings).mask)


# Measurements ------------------------------------------------------------------------------------------------------


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


@query
def areas(spark, folder):
    found = measure.basic_measures(line_labels(spark, folder)).select("image_id", "label", "area_px")
    return rounded(found.withColumn("eq_diam_px", measure.eq_diameter(F.col("area_px"))), "eq_diam_px")


@query
def bbox_centroid(spark, folder):
    return rounded(measure.basic_measures(line_labels(spark, folder)), "centroid_x", "centroid_y")


@query
def perimeter(spark, folder):
    return rounded(measure.perimeters(measure.pore_steps(written(line_labels(spark, folder)))), "perimeter_px")


@query
def circularity(spark, folder):
    labels = written(line_labels(spark, folder))
    both = measure.basic_measures(labels).join(measure.perimeters(measure.pore_steps(labels)), ["image_id", "label"])
    c = measure.circularity(F.col("area_px"), F.col("perimeter_px"))
    # NaN (pores of one pixel) is shown as -1.
    return both.select("image_id", "label", F.round(F.when(F.isnan(c), -1.0).otherwise(c), 6).alias("circularity"))


@query
def outline_points(spark, folder):
    return measure.pore_points(written(line_labels(spark, folder))).select("image_id", "label", "y", "x", F.col("visits").cast("int").alias("visits"))


@query
def pca_axes(spark, folder):
    """Axes of pores with at most four outline points."""
    found = measure.pore_moments(written(line_labels(spark, folder))).where("m00 <= 4")
    return rounded(measure.axes(found, fit=False), "major_axis_px", "minor_axis_px", "orientation_deg")


@query
def ellipse_axes(spark, folder):
    found = measure.pore_moments(written(line_labels(spark, folder))).where("m00 >= 5")
    return rounded(measure.axes(found), "major_axis_px", "minor_axis_px", "orientation_deg")


@query
def feret_max(spark, folder):
    return rounded(measure.pore_ferets(written(line_labels(spark, folder))).drop("feret_min_px"), "feret_max_px")


@query
def feret_min(spark, folder):
    return rounded(measure.pore_ferets(written(line_labels(spark, folder))).drop("feret_max_px"), "feret_min_px")


@query
def scaled_measures(spark, folder):
    pores = measure.basic_measures(line_labels(spark, folder)).select(
        "image_id", "label", "area_px", measure.eq_diameter(F.col("area_px")).alias("eq_diam_px"),
        *[(F.col("bbox_x1") - F.col("bbox_x0") - 1).cast("double").alias(f"{n}_px") for n in ("major_axis", "minor_axis", "feret_max", "feret_min")])
    found = measure.scaled(pores, image_scales(spark, folder))
    return rounded(found.select("image_id", "label", "units_per_px", "unit_name", "area_units2", "eq_diam_units", "major_axis_units", "feret_min_units"),
                   "area_units2", "eq_diam_units", "major_axis_units", "feret_min_units")


def measured(spark, folder):
    return measure.measure(line_labels(spark, folder), image_scales(spark, folder))


@query
def measure_dataset(spark, folder):
    return measured(spark, folder)


@query
def process_batch(spark, folder):
    return study.process_batch(line(spark, folder), ThresholdParams(polarity="poresBrighter"), SPLIT, image_scales(spark, folder)).pores


@query
def measurements_csv(spark, folder):
    return sinks.csv_rows(measured(spark, folder)).select("image_index", "label", "area_px", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1", "touches_border", "unit_name")


# Calibration -------------------------------------------------------------------------------------------------------


@query
def calibrate_two_point(spark, folder):
    k = F.col("s_suppkey")
    marks = tables.table(spark, folder, "supplier").select(
        k.alias("image_id"), (k % 40).cast("int").alias("x1"), (k * 7 % 53).cast("int").alias("x2"),
        (F.col("s_acctbal") / 100).alias("real_length"), F.when(k % 4 == 0, "  ").when(k % 4 == 1, " um ").alias("unit"))
    return rounded(calibrate.two_point_scales(marks), "units_per_px")


@query
def manual_scale(spark, folder):
    k = F.col("s_suppkey")
    entries = tables.table(spark, folder, "supplier").select(
        k.alias("image_id"), F.when(k % 2 == 0, "unitsPerPx").otherwise("pxPerUnit").alias("mode"), F.col("s_acctbal").alias("value"), F.lit("um").alias("unit"))
    return rounded(calibrate.manual_scales(entries), "units_per_px")


def scale_events(spark, folder):
    e = F.col("o_orderkey")
    return tables.table(spark, folder, "orders").select(
        e.alias("seq"), F.when(e % 97 != 0, F.col("o_custkey")).alias("image_id"), (e % 9 + 1).cast("double").alias("units_per_px"),
        F.when(e % 2 == 0, "mm").otherwise("um").alias("unit_name"))


@query
def set_scale(spark, folder):
    images = tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("image_id"))
    return calibrate.current_scales(images, scale_events(spark, folder))


@query
def common_unit(spark, folder):
    scales = image_scales(spark, folder)
    even = calibrate.common_unit(scales.where("image_id % 2 = 0")).withColumn("scope", F.lit("even"))
    return even.unionByName(calibrate.common_unit(scales).withColumn("scope", F.lit("all")))


# Analysis ----------------------------------------------------------------------------------------------------------


def one_unit(spark, folder):
    """The scales in millimetres only."""
    return image_scales(spark, folder).where("unit_name = 'mm'")


def simple_pores(spark, folder, scales=image_scales):
    """Pores with the measures that follow from areas and boxes, with units."""
    base = measure.basic_measures(line_labels(spark, folder)).select(
        "image_id", "label", "area_px", "touches_border", measure.eq_diameter(F.col("area_px")).alias("eq_diam_px"),
        F.when(F.col("area_px") > 1, (F.col("bbox_x1") - F.col("bbox_x0")) / (F.col("bbox_y1") - F.col("bbox_y0"))).otherwise(F.lit(float("nan"))).alias("circularity"),
        *[F.when(F.col("area_px") > 1, (F.col(b) - F.col(a)).cast("double")).alias(f"{n}_px") for n, a, b in (
            ("major_axis", "bbox_x0", "bbox_x1"), ("minor_axis", "bbox_y0", "bbox_y1"), ("feret_max", "bbox_x0", "bbox_x1"), ("feret_min", "bbox_y0", "bbox_y1"))],
        F.lit(None).cast("double").alias("aspect_ratio"), (F.col("area_px") * 0.25).alias("orientation_deg"))
    return measure.scaled(base, scales(spark, folder)).withColumnRenamed("image_id", "image_index")


@query
def pore_filter(spark, folder):
    """Scales in two units: bounds are in pixels."""
    chosen = analyse.select_pores(simple_pores(spark, folder), border=False, smallest=2.0, largest=6.0, scales=image_scales(spark, folder))
    return chosen.select("image_index", "label", "area_px")


@query
def pore_filter_units(spark, folder):
    """Scales in one unit: bounds are in units, for pores without a scale in pixels."""
    chosen = analyse.select_pores(simple_pores(spark, folder, one_unit), border=False, smallest=0.0004, largest=6.0, scales=one_unit(spark, folder))
    return chosen.select("image_index", "label", "area_px")


@query
def pore_scope(spark, folder):
    return analyse.select_pores(simple_pores(spark, folder), image_index=7, smallest=2).select("image_index", "label", "area_px")


@query
def metric_values(spark, folder):
    return rounded(analyse.metric_values(simple_pores(spark, folder), image_scales(spark, folder)), "value")


@query
def metric_values_units(spark, folder):
    return rounded(analyse.metric_values(simple_pores(spark, folder, one_unit), one_unit(spark, folder)), "value")


@query
def histogram(spark, folder):
    found = analyse.histogram(analyse.metric_values(simple_pores(spark, folder), metrics=("area", "circularity", "feret_max")), 12)
    return rounded(found, "lo", "hi", "log_n")


@query
def pore_table(spark, folder):
    return analyse.pore_table(simple_pores(spark, folder))


@query
def labelled_count(spark, folder):
    mask = th.pick_mask(tiles(spark, folder), 255, 25)
    return analyse.labelled_count(geometry.frames(mask), cc.components(mask, 8))


# Rendering ---------------------------------------------------------------------------------------------------------


def tile_labels(spark, folder):
    scan = tiles(spark, folder)
    return scan, cc.components(th.pick_mask(scan, 150, 60), 4)


@query
def colour_labels(spark, folder):
    return render.colour_labels(*tile_labels(spark, folder))


@query
def colour_labels_plain(spark, folder):
    return render.colour_labels(*tile_labels(spark, folder), on_gray=False)


@query
def colour_hues(spark, folder):
    return render.colour_hues(*tile_labels(spark, folder), on_gray=True)


@query
def mask_overlay(spark, folder):
    scan = tiles(spark, folder)
    return render.mask_overlay(scan, th.pick_mask(scan, 150, 60))


@query
def mask_overlay_tint(spark, folder):
    scan = tiles(spark, folder)
    return render.mask_overlay(scan, th.pick_mask(scan, 230, 5), style="tint")


# Orchestration -----------------------------------------------------------------------------------------------------


@query
def apply_scope(spark, folder):
    """Masks of one threshold, replaced for one image by another threshold."""
    scan = tiles(spark, folder)
    return runs_of(study.apply_scope(th.pick_mask(scan, 150, 60), th.pick_mask(scan, 220, 30), image_id=17))


@query
def apply_to_all(spark, folder):
    """Masks of all images, replaced where a newer result exists."""
    scan = tiles(spark, folder)
    fresh = th.pick_mask(scan.where("image_id % 3 = 1"), 220, 30)
    return runs_of(study.apply_scope(th.pick_mask(scan, 150, 60), fresh))


@query
def pore_size_distribution(spark, folder):
    """Flagship: pores of every density raster, then the distribution of their equivalent diameters."""
    pores = measure.basic_measures(line_labels(spark, folder)).select(
        F.col("image_id").alias("image_index"), "label", measure.eq_diameter(F.col("area_px")).alias("eq_diam_px"))
    found = analyse.histogram(analyse.metric_values(pores, metrics=("eq_diam",)), 20)
    return rounded(found.select("metric", "bin", "lo", "hi", "n"), "lo", "hi")
