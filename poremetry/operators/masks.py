"""Operators on masks: cleaning, filling, flooding, morphology, normalising."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from poremetry.functions.rows import RUNS_TYPE, bind, complement_runs, merge_segments, runs_of_bits
from poremetry.operators.components import NODE, complement, explode_runs, label_runs, parts_where, root_facts, roots_of, rows_with_runs, sorted_rows
from poremetry.operators.filters import odd_kernel
from poremetry.operators.neighbours import band_rows, bundle
from poremetry.workspace import attach, materialize

FG, BG = 1, 0


def segments(mask: DataFrame, layers: tuple[int, ...] = (FG, BG)) -> DataFrame:
    """Foreground and background runs that together cover every scanline; ``layer`` is 1 or 0."""
    def tagged(runs: Column, layer: int) -> Column:
        return F.transform(runs, lambda r: F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"), F.lit(layer).cast("bigint").alias("layer")))

    return mask.select("image_id", "height", "width", "y", F.inline(F.concat(
        tagged(F.col("runs"), FG), tagged(complement_runs(F.col("runs"), F.col("width")), BG))))


def mask_of_segments(rows: DataFrame, fg: Column) -> DataFrame:
    """Gather covering segments back to mask rows; a group is one scanline."""
    segment = F.struct("x0", "x1", fg.alias("fg"))
    return rows.groupBy("image_id", "y").agg(
        F.first("height").alias("height"), F.first("width").alias("width"), F.sort_array(F.collect_list(segment)).alias("s"),
    ).select("image_id", "height", "width", "y", merge_segments(F.col("s")).alias("runs"))


def flip_components(mask: DataFrame, layer: int, connectivity: int, condition, band_pixels: int | None = None) -> DataFrame:
    """Turn the components of one layer that meet ``condition(area, touches_border)`` into the other layer."""
    return flip_in_turn(mask, [(layer, connectivity, condition)], band_pixels)


def flip_in_turn(mask: DataFrame, flips: list[tuple], band_pixels: int | None = None) -> DataFrame:
    """Several flips (layer, connectivity, condition) one after the other; a condition is written for columns and arrays alike.

    Images of one band are solved in one grouped step that does all flips and returns whole rows; only taller ones are labelled across bands
    and gathered again for every flip.
    """
    one = F.col("height") <= band_rows(F.col("height"), F.col("width"), pixels=band_pixels)
    mask = materialize(mask.select(F.col("image_id").cast("bigint"), *[F.col(c).cast("int") for c in ("height", "width", "y")], "runs"), tall=F.max(~one))
    small = _per_bundle(mask.where(one) if mask.metrics["tall"] else mask, lambda table: _flipped(table, flips), band_pixels)
    if not mask.metrics["tall"]:
        return small
    tall = mask.where(~one)
    for i, (layer, connectivity, condition) in enumerate(flips):
        tall = _flipped_across(materialize(tall) if i else tall, layer, connectivity, condition, band_pixels)
    return small.unionByName(tall)


def _per_bundle(mask: DataFrame, step, band_pixels: int | None) -> DataFrame:
    """Mask rows of images of one band, several of one size at a time, through ``step``."""
    return mask.select("image_id", "height", "width", "y", "runs", bundle(band_pixels).alias("_bundle")).groupBy("height", "width", "_bundle").applyInArrow(
        lambda key, table: step(table), f"image_id bigint, height int, width int, y int, runs {RUNS_TYPE}")


def _flipped(table: pa.Table, flips: list[tuple]) -> pa.Table:
    """``flip_in_turn`` of several small images, all of one size."""
    table, row, x0, x1 = sorted_rows(table)
    image, y = table.column("image_id").to_numpy(), table.column("y").to_numpy().astype(np.int64)
    height, width, rows = table.column("height")[0].as_py(), table.column("width")[0].as_py(), np.arange(table.num_rows)
    for layer, connectivity, condition in flips:
        if layer == BG:
            row, x0, x1 = complement(row, x0, x1, rows, width)
        root = roots_of(image[row], y[row], x0, x1, int(connectivity == 8))
        kept = ~condition(*root_facts(root, y[row], x0, x1, height, width))
        row, x0, x1 = row[kept], x0[kept], x1[kept]
        if layer == BG:
            row, x0, x1 = complement(row, x0, x1, rows, width)
    return rows_with_runs(table, row, x0, x1)


def _flipped_across(mask: DataFrame, layer: int, connectivity: int, condition, band_pixels: int | None) -> DataFrame:
    """``flip_components`` of images with several bands."""
    labelled = label_runs(segments(mask).where(F.col("layer") == layer), connectivity, band_pixels)
    flips = parts_where(labelled, condition(F.col("area"), F.col("touches_border"))).withColumn("flip", F.lit(True))
    return _swapped(mask, labelled, flips, layer)


def _swapped(mask: DataFrame, labelled: DataFrame, flips: DataFrame, layer: int) -> DataFrame:
    """The mask with the parts in ``flips`` of its labelled layer turned into the other layer."""
    marked = labelled.join(flips, [*NODE, "part"], "left").select(
        "image_id", "height", "width", "y", "x0", "x1",
        (F.col("flip").isNull() == F.lit(layer == FG)).alias("fg"))
    other = segments(mask).where(F.col("layer") != layer).select(
        "image_id", "height", "width", "y", "x0", "x1", F.lit(layer != FG).alias("fg"))
    return mask_of_segments(marked.unionByName(other), F.col("fg"))


HOLES = (BG, 4, lambda area, edge: ~edge)


def fill_holes(mask: DataFrame, band_pixels: int | None = None) -> DataFrame:
    """Background that is not 4-connected to the frame becomes foreground."""
    return flip_in_turn(mask, [HOLES], band_pixels)


def remove_small(mask: DataFrame, min_area: int, connectivity: int = 8, band_pixels: int | None = None) -> DataFrame:
    """Drop components with fewer than ``min_area`` pixels; no-op for ``min_area`` <= 1."""
    if min_area <= 1:
        return mask
    return flip_components(mask, FG, connectivity, lambda area, edge: area < min_area, band_pixels)


def clear_border(mask: DataFrame, connectivity: int = 8, band_pixels: int | None = None) -> DataFrame:
    """Drop components that touch the frame."""
    return flip_components(mask, FG, connectivity, lambda area, edge: edge, band_pixels)


def clean(mask: DataFrame, min_area: int, border: bool, connectivity: int = 8, band_pixels: int | None = None, holes: bool = False) -> DataFrame:
    """``remove_small`` then ``clear_border`` with one labelling: neither step splits or joins other components. ``holes`` are filled ahead of them."""
    def drop(area, edge):
        if min_area > 1:
            return (area < min_area) | edge if border else area < min_area
        return edge

    flips = ([HOLES] if holes else []) + ([(FG, connectivity, drop)] if min_area > 1 or border else [])
    return flip_in_turn(mask, flips, band_pixels) if flips else mask


def remove_islands(mask: DataFrame, min_island: int, connectivity: int = 8, spare_border: bool = False) -> DataFrame:
    """Drop foreground islands smaller than ``min_island``, optionally sparing those at the frame."""
    if min_island <= 0:
        return mask
    return flip_components(mask, FG, connectivity, lambda area, edge: (area < min_island) & ~edge if spare_border else area < min_island)


def fill_small_holes(mask: DataFrame, max_hole: int, connectivity: int = 8) -> DataFrame:
    """Background components away from the frame and smaller than ``max_hole`` become foreground."""
    if max_hole <= 0:
        return mask
    return flip_components(mask, BG, connectivity, lambda area, edge: ~edge & (area < max_hole))


def process_islands(mask: DataFrame, min_island: int, max_hole: int, connectivity: int = 8, spare_border: bool = False) -> DataFrame:
    """Remove small islands, then fill small holes, with one connectivity."""
    return fill_small_holes(remove_islands(mask, min_island, connectivity, spare_border), max_hole, connectivity)


def flood(mask: DataFrame, seeds: DataFrame, add: bool, connectivity: int = 8, band_pixels: int | None = None) -> DataFrame:
    """Add (or remove) the background (foreground) component under each seed (image_id, x, y).

    Seeds on the other side have no effect; floods of one side never touch each other's components, so all seeds of a call are applied
    together. Images of one band meet their distinct seeds in one grouped step; in taller ones a seed finds its run by (image, row).
    """
    layer = BG if add else FG
    one = F.col("height") <= band_rows(F.col("height"), F.col("width"), pixels=band_pixels)
    mask = materialize(mask.select(F.col("image_id").cast("bigint"), *[F.col(c).cast("int") for c in ("height", "width", "y")], "runs"), tall=F.max(~one))
    small = mask.where(one) if mask.metrics["tall"] else mask
    frames = materialize(small.where("y = 0").select("image_id", "height", "width"))
    points = attach(seeds.select("image_id", "x", "y"), frames, ["image_id"]).where("x >= 0 AND x < width AND y >= 0 AND y < height")
    points = points.select("image_id", "height", "width", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    keys = ["height", "width", "_bundle"]
    rows, points = (t.withColumn("_bundle", bundle(band_pixels)).groupBy(*keys) for t in (small, points))
    found = rows.cogroup(points).applyInArrow(
        lambda key, rows, seeds: _under_seeds(rows, seeds, layer, int(connectivity == 8)), f"image_id bigint, height int, width int, y int, runs {RUNS_TYPE}")
    return found.unionByName(_flooded_across(mask.where(~one), seeds, layer, connectivity, band_pixels)) if mask.metrics["tall"] else found


def _under_seeds(table: pa.Table, seeds: pa.Table, layer: int, reach: int) -> pa.Table:
    """``flood`` of several small images, all of one size; ``seeds`` lie inside the frame."""
    table, row, x0, x1 = sorted_rows(table)
    image, y = table.column("image_id").to_numpy(), table.column("y").to_numpy().astype(np.int64)
    height, width, rows = table.column("height")[0].as_py(), table.column("width")[0].as_py(), np.arange(table.num_rows)
    if layer == BG:
        row, x0, x1 = complement(row, x0, x1, rows, width)
    root = roots_of(image[row], y[row], x0, x1, reach)
    seed_image, seed_y, seed_x = (seeds.column(c).to_numpy().astype(np.int64) for c in ("image_id", "y", "x"))
    names = np.unique(image)
    seed_row = np.searchsorted(np.searchsorted(names, image) * height + y, np.searchsorted(names, seed_image) * height + seed_y)
    run = np.searchsorted(row * width + x0, seed_row * width + seed_x, "right") - 1
    hit = run[(run >= 0) & (row[run] == seed_row) & (seed_x < x1[run])] if len(row) else run[:0]
    kept = ~np.isin(root, root[hit])
    row, x0, x1 = row[kept], x0[kept], x1[kept]
    if layer == BG:
        row, x0, x1 = complement(row, x0, x1, rows, width)
    return rows_with_runs(table, row, x0, x1)


def _flooded_across(mask: DataFrame, seeds: DataFrame, layer: int, connectivity: int, band_pixels: int | None) -> DataFrame:
    """``flood`` of images with several bands."""
    labelled = label_runs(segments(mask).where(F.col("layer") == layer), connectivity, band_pixels)
    points = seeds.select("image_id", "y", F.col("x").alias("seed_x")).distinct()
    hit = (
        labelled.join(points, ["image_id", "y"])
        .where((F.col("x0") <= F.col("seed_x")) & (F.col("seed_x") < F.col("x1")))
        .select(*NODE, "comp").distinct()
    )
    parts = labelled.select(*NODE, "part", "comp").distinct().join(hit, [*NODE, "comp"], "left_semi")
    flips = parts.select(*NODE, "part").withColumn("flip", F.lit(True))
    return _swapped(mask, labelled, flips, layer)


def merged_runs(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals per row, as sorted runs that do not touch: one sort and one running maximum over all rows."""
    wide = width + 1
    order = np.argsort(row * wide + x0, kind="stable")
    row, x0 = row[order], x0[order]
    reach = np.maximum.accumulate(row * wide + x1[order])
    new = np.append(True, row[1:] * wide + x0[1:] > reach[:-1])[:len(row)]
    last = np.append(new[1:], True)[:len(row)]
    return row[new], x0[new], reach[last] - row[new] * wide


def _grown(row, x0, x1, r: int, width: int):
    """Union of the rows y - r .. y + r of runs widened by r; windows of rows double until they have the height of the box."""
    row, x0, x1 = merged_runs(row, np.maximum(x0 - r, 0), np.minimum(x1 + r, width), width)
    tall = 1
    while tall < 2 * r + 1:
        step = min(tall, 2 * r + 1 - tall)
        row, x0, x1 = merged_runs(np.append(row, row - step), np.append(x0, x0), np.append(x1, x1), width)
        tall += step
    return row + r, x0, x1


def _box_band(table: pa.Table, steps: list[tuple[bool, int]], reach: int) -> pa.Table:
    """Boxes one after the other on a band with ``reach`` more rows on either side, or on several small images."""
    table = table.take(pa.array(np.lexsort((table.column("y").to_numpy(), table.column("image_id").to_numpy()))))
    image, y, width = table.column("image_id").to_numpy(), table.column("y").to_numpy().astype(np.int64), table.column("width")[0].as_py()
    # images stand apart by more rows than any box reaches
    rows = y + np.append(0, np.cumsum(image[1:] != image[:-1])) * (table.column("height")[0].as_py() + 2 * reach + 2)
    runs = table.column("runs").combine_chunks()
    flat = runs.flatten()
    row = np.repeat(rows, pc.list_value_length(runs).to_numpy(zero_copy_only=False))
    x0, x1 = (flat.field(c).to_numpy().astype(np.int64) for c in ("x0", "x1"))
    for grow, r in steps:
        if not grow:
            row, x0, x1 = complement(row, x0, x1, rows, width)
        row, x0, x1 = _grown(row, x0, x1, r, width)
        place = np.minimum(np.searchsorted(rows, row), len(rows) - 1)
        known = rows[place] == row
        row, x0, x1 = row[known], x0[known], x1[known]
        if not grow:
            row, x0, x1 = complement(row, x0, x1, rows, width)
    pairs = pa.StructArray.from_arrays([pa.array(x0.astype(np.int32)), pa.array(x1.astype(np.int32))], names=["x0", "x1"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.append(rows, rows[-1] + 1)).astype(np.int32)), pairs)
    out = table.select(["image_id", "height", "width", "y"]).append_column("runs", lists)
    return out.filter(table.column("core"))


def _boxes(mask: DataFrame, steps: list[tuple[bool, int]], band_pixels: int | None = None) -> DataFrame:
    """k x k maxima (True, k) and minima (False, k) of a mask one after the other; positions outside the frame are ignored.

    All steps run on run lists in one grouped pass: a band takes as many further rows along as the steps reach together.
    """
    radii = [(grow, odd_kernel(k) // 2) for grow, k in steps]
    reach = sum(r for _, r in radii)
    band = band_rows(F.col("height"), F.col("width"), at_least=max(1, 4 * reach), pixels=band_pixels)
    bands = F.greatest(F.lit(1), F.ceil(F.col("height") / band)).cast("int")
    touched = F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - reach) / band).cast("int")),
                         F.least(bands - 1, F.floor((F.col("y") + reach) / band).cast("int")))
    spread = mask.select("image_id", "height", "width", "y", "runs", F.explode(touched).alias("_band"), bundle(band_pixels).alias("_bundle"))
    spread = spread.withColumn("core", F.floor(F.col("y") / band) == F.col("_band"))
    return spread.groupBy("height", "width", "_bundle", "_band").applyInArrow(
        lambda key, table: _box_band(table, radii, reach), f"image_id bigint, height int, width int, y int, runs {RUNS_TYPE}")


def dilate(mask: DataFrame, k: int) -> DataFrame:
    return _boxes(mask, [(True, k)])


def erode(mask: DataFrame, k: int) -> DataFrame:
    return _boxes(mask, [(False, k)])


def opened(mask: DataFrame, k: int) -> DataFrame:
    return _boxes(mask, [(False, k), (True, k)])


def closed(mask: DataFrame, k: int) -> DataFrame:
    return _boxes(mask, [(True, k), (False, k)])


def open_close(mask: DataFrame, k: int, band_pixels: int | None = None) -> DataFrame:
    """Open then close; the two middle dilations are one dilation with a box of 2k - 1."""
    k = odd_kernel(k)
    return _boxes(mask, [(False, k), (True, 2 * k - 1), (False, k)], band_pixels)


def mask_from_labels(label_runs_: DataFrame, frames: DataFrame) -> DataFrame:
    """Mask of all labelled pixels; ``frames`` (image_id, height, width, y) supplies the empty scanlines."""
    lists = label_runs_.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("pieces"))
    joined = frames.select("image_id", "height", "width", "y").join(lists, ["image_id", "y"], "left")
    pieces = F.coalesce("pieces", F.array().cast("array<struct<x0:int,x1:int>>"))
    starts = bind(pieces, lambda p: F.zip_with(
        F.filter(F.sequence(F.lit(0), F.size(p)), lambda i: (i < F.size(p)) & ((i == 0) | (F.get(p, i - 1)["x1"] < F.get(p, i)["x0"]))),
        F.filter(F.sequence(F.lit(0), F.size(p)), lambda i: (i < F.size(p)) & ((i == F.size(p) - 1) | (F.get(p, i)["x1"] < F.get(p, i + 1)["x0"]))),
        lambda a, b: F.struct(F.get(p, a)["x0"].alias("x0"), F.get(p, b)["x1"].alias("x1"))))
    return joined.select("image_id", "height", "width", "y", starts.alias("runs"))


def _largest(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("image_id").agg(F.max(F.array_max("v")).alias("top")))


def normalise_mask(rows: DataFrame, kind: str) -> DataFrame:
    """Value arrays to 0..255 mask values. ``kind``: "bool", "uint8" or anything else (nonzero is foreground).

    A uint8 mask whose largest value is at most 1 is scaled to 0/255, any other uint8 mask is kept as it is.
    """
    if kind == "uint8":
        return attach(rows, _largest(rows), ["image_id"]).withColumn(
            "v", F.transform("v", lambda v: F.when(F.col("top") <= 1, v * 255).otherwise(v))).drop("top")
    return rows.withColumn("v", F.transform("v", lambda v: F.when(v.cast("double") != 0, 255).otherwise(0)))


def bool_mask(rows: DataFrame, kind: str = "uint8") -> DataFrame:
    """Mask rows from value arrays: uint8 values use the cut 128 (or > 0 when none exceeds 1), other kinds != 0."""
    if kind == "uint8":
        rows = attach(rows, _largest(rows), ["image_id"])
        bits = F.transform("v", lambda v: F.when(F.col("top") > 1, v >= 128).otherwise(v > 0).cast("int"))
    else:
        bits = F.transform("v", lambda v: (v != 0).cast("int"))
    return rows.select("image_id", "height", "width", "y", runs_of_bits(bits).alias("runs"))


def normalise_labels(rows: DataFrame) -> DataFrame:
    """Label arrays as whole numbers, negative ones (watershed lines) as background."""
    return rows.withColumn("v", F.transform("v", lambda v: F.greatest(v.cast("int"), F.lit(0))))


def mask_pixels(mask: DataFrame) -> DataFrame:
    """Foreground pixels (image_id, y, x)."""
    return explode_runs(mask).select("image_id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
