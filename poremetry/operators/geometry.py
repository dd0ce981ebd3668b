"""Cropping and resampling of scanlines and masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poremetry.functions.geometry import clamp_rect, margins_to_rect, rect_to_margins
from poremetry.functions.rows import bind, run, touching_merged
from poremetry.workspace import attach, materialize, row_slices


def frames(scan: DataFrame) -> DataFrame:
    """(image_id, height, width) of scanlines or masks: one narrow row per image, read off the first scanline."""
    return scan.where("y = 0").select("image_id", "height", "width")


def _cols(struct: str, names: tuple[str, ...]) -> list:
    return [F.col(f"{struct}.{n}") for n in names]


RECT, MARGINS = ("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom")


def crop(scan: DataFrame, rects: DataFrame) -> DataFrame:
    """Crop each image to its row of ``rects`` (image_id, rect); images without a usable rectangle give no rows.

    Works on scanlines (``v``) and masks (``runs``); coordinates restart at the corner.
    """
    usable = materialize(rects.where("rect is not null").select("image_id", F.col("rect").alias("r")))
    inside = attach(scan, usable, ["image_id"], slices=row_slices(F.col("r.y0"), F.col("r.y1") - 1)).where(
        (F.col("y") >= F.col("r.y0")) & (F.col("y") < F.col("r.y1")))
    width = F.col("r.x1") - F.col("r.x0")
    if "v" in scan.columns:
        body = F.slice("v", F.col("r.x0") + 1, width).alias("v")
    else:
        moved = F.transform("runs", lambda r: F.struct(
            (F.greatest(r["x0"], F.col("r.x0")) - F.col("r.x0")).alias("x0"), (F.least(r["x1"], F.col("r.x1")) - F.col("r.x0")).alias("x1")))
        body = F.filter(moved, lambda r: r["x0"] < r["x1"]).alias("runs")
    return inside.select("image_id", (F.col("r.y1") - F.col("r.y0")).alias("height"), width.alias("width"),
                         (F.col("y") - F.col("r.y0")).alias("y"), body)


def clamped_rects(frames_: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return frames_.select("image_id", clamp_rect(*map(F.lit, (x0, y0, x1, y1)), F.col("height"), F.col("width")).alias("rect"))


def margin_rects(frames_: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    return frames_.select("image_id", margins_to_rect(*map(F.lit, (left, top, right, bottom)), F.col("height"), F.col("width")).alias("rect"))


def batch_rects(frames_: DataFrame, rect: tuple[int, int, int, int] | None = None,
                margins: tuple[int, int, int, int] | None = None, use_margins: bool = True) -> DataFrame:
    """(image_id, rect) for a whole set of images.

    With ``use_margins`` a rectangle is first clamped to the image with the smallest id, and its margins there apply
    to every image; if that rectangle is unusable, so is every other. Otherwise it is clamped per image.
    """
    if rect is None and margins is None:
        raise ValueError("either rect or margins must be given")
    if margins is not None and (use_margins or rect is None):
        return margin_rects(frames_, *margins)
    if not use_margins:
        return clamped_rects(frames_, *rect)
    first = frames_.agg(F.min_by(F.struct("height", "width"), "image_id").alias("f")).select("f.*")
    base = first.select("height", "width", clamp_rect(*map(F.lit, rect), F.col("height"), F.col("width")).alias("r"))
    shared = base.select(rect_to_margins(*_cols("r", RECT), F.col("height"), F.col("width")).alias("m"), F.col("r").isNull().alias("none"))
    # ``shared`` is one row by construction.
    joined = frames_.join(F.broadcast(shared), how="left")
    kept = margins_to_rect(*_cols("m", MARGINS), F.col("height"), F.col("width"))
    return joined.select("image_id", F.when(~F.col("none"), kept).alias("rect"))


def crop_batch(scan: DataFrame, rect=None, margins=None, use_margins: bool = True) -> DataFrame:
    return crop(scan, batch_rects(frames(scan), rect, margins, use_margins))


def apply_crop(scan: DataFrame, rect: tuple[int, int, int, int], image_id: int | None = None, use_margins: bool = True) -> DataFrame:
    """Replace images by their crop: one image, or all of them where images without a usable crop stay whole."""
    sizes = frames(scan)
    if image_id is None:
        rects = batch_rects(sizes, rect, None, use_margins)
    else:
        rects = clamped_rects(sizes.where(F.col("image_id") == image_id), *rect)
    whole = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    chosen = sizes.join(rects, "image_id", "left").select("image_id", F.coalesce("rect", whole).alias("rect"))
    return crop(scan, chosen)


def resize_nearest(scan: DataFrame, height: int, width: int) -> DataFrame:
    """Nearest-neighbour resize of scanlines (``v``) or masks (``runs``); every target row picks its source row, so source rows are only
    copied as needed. A run's ends move to the target columns whose source columns lie in it; runs without any vanish, others may meet."""
    # Target rows whose source row is y: floor(t * h / height) = y.
    low = F.ceil(F.col("y") * height / F.col("height")).cast("int")
    high = F.ceil((F.col("y") + 1) * height / F.col("height")).cast("int") - 1
    rows = scan.where(low <= high).withColumn("ty", F.explode(F.sequence(low, high)))
    if "v" not in scan.columns:
        target = lambda x: F.ceil(x * width / F.col("width")).cast("int")
        moved = F.filter(F.transform("runs", lambda r: run(target(r["x0"]), target(r["x1"]))), lambda r: r["x0"] < r["x1"])
        rows = rows.select("image_id", "ty", bind(moved, touching_merged).alias("runs"))
        return rows.select("image_id", F.lit(height).alias("height"), F.lit(width).alias("width"), F.col("ty").alias("y"), "runs")
    picked = bind(F.col("v"), lambda v: F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.get(v, F.floor(x * F.col("width") / width).cast("int"))))
    # Two steps, so that "width" inside the lambda is the old width and not the new column.
    return rows.select("image_id", "ty", picked.alias("v")).select(
        "image_id", F.lit(height).alias("height"), F.lit(width).alias("width"), F.col("ty").alias("y"), "v")


PREVIEW_PIXELS = 1_200_000


def _partial_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted cell sums of scanlines: one row per (image, target row) of a batch, not one per source row."""
    for batch in batches:
        image, height, width, new_h, new_w, y = (batch.column(c).to_numpy() for c in ("image_id", "height", "width", "new_h", "new_w", "y"))
        sums: dict[tuple, np.ndarray] = {}
        for i in range(batch.num_rows):
            step_x, step_y = width[i] / new_w[i], height[i] / new_h[i]
            # area below x of the row as a step function; a cell is the difference of its two ends
            below = np.append(0.0, np.cumsum(batch.column("v")[i].values.to_numpy().astype(float)))
            cells = np.diff(np.interp(np.minimum(np.arange(new_w[i] + 1) * step_x, width[i]), np.arange(width[i] + 1), below))
            for ty in range(int(y[i] / step_y), min(int(np.ceil((y[i] + 1) / step_y)), new_h[i])):
                share = min(y[i] + 1.0, (ty + 1) * step_y) - max(float(y[i]), ty * step_y)
                key = (image[i], new_h[i], new_w[i], ty)
                if share > 0:
                    sums[key] = sums.get(key, 0.0) + cells * (share / (step_x * step_y))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[j] for k in sums], kind) for j, kind in enumerate(kinds)), pa.array(list(sums.values()), pa.list_(pa.float64()))],
            names=["image_id", "new_h", "new_w", "ty", "sums"])


def preview(scan: DataFrame, max_pixels: int = PREVIEW_PIXELS) -> DataFrame:
    """Downscale images above ``max_pixels`` by area averaging; smaller images pass unchanged.

    Scanlines are averaged along x and added up per target row before the shuffle, which then carries about as many rows as the preview has;
    a target row gathers one array of cells per batch that holds some of its source rows.
    """
    pixels = F.col("height").cast("bigint") * F.col("width")
    scale = F.sqrt(F.lit(float(max_pixels)) / pixels)
    new_h = F.greatest(F.lit(1), F.floor(F.col("height") * scale)).cast("int")
    new_w = F.greatest(F.lit(1), F.floor(F.col("width") * scale)).cast("int")
    large = scan.where(pixels > max_pixels).select(
        F.col("image_id").cast("bigint"), F.col("height").cast("int"), F.col("width").cast("int"), new_h.alias("new_h"), new_w.alias("new_w"),
        F.col("y").cast("int"), "v")
    partial = large.mapInArrow(_partial_cells, "image_id bigint, new_h int, new_w int, ty int, sums array<double>")
    rows = partial.groupBy("image_id", "new_h", "new_w", "ty").agg(F.collect_list("sums").alias("parts"))
    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b))
    small = scan.where(pixels <= max_pixels).select("image_id", "height", "width", "y", "v")
    return small.unionByName(rows.select(
        "image_id", F.col("new_h").alias("height"), F.col("new_w").alias("width"), F.col("ty").alias("y"),
        F.transform(whole, lambda m: F.rint(m).cast("int")).alias("v")))
