"""Neighbourhood filters on scanlines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from poremetry.functions.rows import bind, mirrored, padded, positions
from poremetry.operators.neighbours import band_rows, bundle, stacked
from poremetry.workspace import attach, materialize, row_slices

# Binomial-like weights of the small Gaussian kernels (sigma derived from the kernel size).
SMALL_GAUSSIANS = {
    1: [1.0],
    3: [0.25, 0.5, 0.25],
    5: [0.0625, 0.25, 0.375, 0.25, 0.0625],
    7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125],
}


def odd_kernel(k: int, smallest: int = 1) -> int:
    k = max(smallest, int(k))
    return k if k % 2 else k + 1


def gaussian_weights(k: int) -> list[float]:
    if k in SMALL_GAUSSIANS:
        return SMALL_GAUSSIANS[k]
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (k - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [w / sum(raw) for w in raw]


def median(scan: DataFrame, k: int = 3) -> DataFrame:
    """k x k median, edges replicated."""
    k = odd_kernel(k)
    r = k // 2
    # The stack of k padded rows is flattened once; column x of row i then sits at i * (width + 2r) + x.
    rows = stacked(scan.withColumn("v", padded(F.col("v"), r, r)), "v", r, "replicate")
    middle, stride = k * k // 2, F.col("width") + 2 * r

    def at(flat):
        def window(x):
            cells = [F.get(flat, i * stride + x + j) for i in range(k) for j in range(k)] if k == 3 else None
            if cells:
                return F.get(F.sort_array(F.array(*cells)), F.lit(middle))
            parts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice(flat, i * stride + x + 1, k))
            return F.get(F.sort_array(F.flatten(parts)), F.lit(middle))

        return F.transform(positions(F.col("width")), window)

    return rows.withColumn("v", bind(F.flatten("stack"), at)).drop("stack")


def weighted_sum(values: Column, first: Column, weights: list[float]) -> Column:
    """Sum of ``weights[i] * values[first + i]``, left to right."""
    acc = F.get(values, first) * weights[0]
    for i, w in enumerate(weights[1:], 1):
        acc = acc + F.get(values, first + i) * w
    return acc


def places_inside(index: np.ndarray, size: int, edge: str) -> np.ndarray:
    """Places inside a line of ``size`` that stand for places outside of it."""
    if edge == "replicate":
        return np.clip(index, 0, size - 1)
    period = max(2 * (size - 1), 1)
    folded = index % period
    return np.where(folded < size, folded, period - folded) if size > 1 else np.zeros_like(index)


def _blur_band(table: pa.Table, column: str, weights: list[float], edge: str, out: str) -> pa.Table:
    """Separable sums over a band with its halo, or over several small images: one pass per weight over all pixels of an image."""
    table = table.take(pa.array(np.lexsort((table.column("y").to_numpy(), table.column("image_id").to_numpy()))))
    image, y = table.column("image_id").to_numpy(), table.column("y").to_numpy()
    height, width, r = table.column("height")[0].as_py(), table.column("width")[0].as_py(), len(weights) // 2
    values = table.column(column).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width)
    core = table.column("_core").to_numpy(zero_copy_only=False).astype(bool)
    wide = places_inside(np.arange(-r, width + r), width, edge)
    starts = np.append(np.flatnonzero(np.append(True, image[1:] != image[:-1])), len(image))
    blurred = []
    for first, end in zip(starts[:-1], starts[1:]):
        lines = values[first:end, wide]
        along = sum(lines[:, i:i + width] * w for i, w in enumerate(weights))
        own = y[first:end][core[first:end]]
        near = places_inside(own[:, None] + np.arange(-r, r + 1), height, edge) - y[first]
        blurred.append(sum(along[near[:, i]] * w for i, w in enumerate(weights)))
    flat = np.concatenate(blurred).ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))
    kept = table.filter(pa.array(core)).drop_columns([c for c in (out, "_core", "_band", "_bundle") if c in table.column_names])
    return kept.append_column(out, lists)


def _wide_blur(rows: DataFrame, column: str, weights: list[float], edge: str, out: str, band_pixels: int | None = None) -> DataFrame:
    """``blur`` with a long kernel: bands of bounded size take ``radius`` more rows along on either side, so no row is copied per weight."""
    reach = len(weights) // 2
    band = band_rows(F.col("height"), F.col("width"), at_least=max(1, 4 * reach), pixels=band_pixels)
    bands = F.greatest(F.lit(1), F.ceil(F.col("height") / band)).cast("int")
    touched = F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - reach) / band).cast("int")),
                         F.least(bands - 1, F.floor((F.col("y") + reach) / band).cast("int")))
    spread = rows.withColumn("_band", F.explode(touched)).withColumn("_bundle", bundle(band_pixels)).withColumn(
        "_core", F.floor(F.col("y") / band) == F.col("_band"))
    schema = T.StructType([f for f in rows.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    return spread.groupBy("height", "width", "_bundle", "_band").applyInArrow(
        lambda key, table: _blur_band(table, column, weights, edge, out), schema)


def blur(rows: DataFrame, column: str, k: int, edge: str, out: str) -> DataFrame:
    """Separable Gaussian of ``column`` as doubles in ``out``: along the row first, then across rows."""
    weights = gaussian_weights(k)
    if k > 9:
        return _wide_blur(rows, column, weights, edge, out)
    r = k // 2
    width = F.col("width")
    if edge == "replicate":
        extended = bind(F.col(column), lambda values: padded(values, r, r))
    else:
        extended = bind(F.col(column), lambda values: F.transform(
            F.sequence(F.lit(-r), width - 1 + r), lambda x: F.get(values, mirrored(x, width))))
    extended = F.transform(extended, lambda v: v.cast("double"))
    along = bind(extended, lambda e: F.transform(positions(width), lambda x: weighted_sum(e, x, weights)))
    tall = stacked(rows.withColumn(out, along), out, r, edge)
    across = F.transform(positions(width), lambda x: sum(
        (F.get(F.get("stack", F.lit(i)), x) * w for i, w in enumerate(weights[1:], 1)),
        F.get(F.get("stack", F.lit(0)), x) * weights[0]))
    return tall.withColumn(out, across).drop("stack")


def gaussian(scan: DataFrame, k: int) -> DataFrame:
    """k x k Gaussian rounded to whole gray values, edges mirrored."""
    blurred = blur(scan, "v", odd_kernel(k), "reflect", "_blur")
    return blurred.withColumn("v", F.transform("_blur", lambda b: F.floor(b + 0.5).cast("int"))).drop("_blur")


def local_means(scan: DataFrame, block: int) -> DataFrame:
    """Adds ``mean``: Gaussian-weighted local mean rounded to whole gray values, edges replicated."""
    blurred = blur(scan, "v", block, "replicate", "_blur")
    return blurred.withColumn("mean", F.transform("_blur", lambda b: F.rint(b).cast("int"))).drop("_blur")


def clahe(scan: DataFrame, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """Contrast-limited adaptive equalisation on a ``tiles`` x ``tiles`` grid.

    The frame is extended by mirroring to a multiple of the grid. Tile histograms are pre-aggregated counts; the lookup table of a tile is
    kept as the running sum at the values that occur in it, so tables take no more than the pixels do; each pixel blends the tables of its four tiles.
    """
    t = int(tiles)
    scan = scan.withColumn("tile_h", F.ceil(F.col("height") / t).cast("int")).withColumn(
        "tile_w", F.ceil(F.col("width") / t).cast("int"))
    luts = materialize(_clahe_luts(scan, float(clip), t))
    rows = scan.withColumn("ty", F.floor(F.col("y") / F.col("tile_h") - 0.5).cast("int"))
    up = luts.select("image_id", F.col("ty").alias("ty_up"), F.col("tile_h").alias("up_h"), F.col("strip").alias("up"))
    down = luts.select("image_id", F.col("ty").alias("ty_down"), F.col("tile_h").alias("down_h"), F.col("strip").alias("down"))
    rows = rows.withColumn("ty_up", F.greatest(F.col("ty"), F.lit(0))).withColumn(
        "ty_down", F.least(F.col("ty") + 1, F.lit(t - 1)))
    # A strip serves rows of its own tiles and of the tiles above and below.
    near = lambda ty, h: row_slices(F.greatest((F.col(ty) - 1) * F.col(h), F.lit(0)), (F.col(ty) + 2) * F.col(h))
    rows = attach(rows, up, ["image_id", "ty_up"], slices=near("ty_up", "up_h"))
    rows = attach(rows, down, ["image_id", "ty_down"], slices=near("ty_down", "down_h"))
    return rows.select(
        F.col("image_id").cast("bigint"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("y").cast("int"), "tile_h", "tile_w",
        F.col("v").cast("array<int>"), "up", "down",
    ).mapInArrow(lambda batches: (_blended(batch, t) for batch in batches), "image_id bigint, height int, width int, y int, v array<int>")


def _looked_up(strips: pa.ListArray, row: np.ndarray, tile: np.ndarray, v: np.ndarray, t: int, area: np.ndarray) -> np.ndarray:
    """Entry ``v`` of the lookup table of ``tile`` in the strip of every ``row``: the running sum up to v and its share of the excess."""
    flat = strips.flatten()
    field = lambda name: flat.field(name).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(strips)), np.diff(strips.offsets.to_numpy()))
    table, total, excess = owner * t + field("tx"), field("cum"), field("excess")
    keys, wanted = table * 256 + field("v"), row * t + tile
    at = np.searchsorted(keys, wanted * 256 + v, "right") - 1
    found = (at >= 0) & (table[at] == wanted)
    excess = excess[np.searchsorted(keys, wanted * 256)]
    rest = excess % 256
    # The clipped-off excess is dealt out evenly: excess div 256 to every bin, and one more to every "step"-th bin.
    step = np.maximum(256 // np.maximum(rest, 1), 1)
    dealt = np.where(found, total[at], 0) + excess // 256 * (v + 1) + np.minimum(rest, v // step + 1)
    return np.minimum(255, np.rint(dealt * (255.0 / area)).astype(np.int64))


def _blended(batch: pa.RecordBatch, t: int) -> pa.RecordBatch:
    """Scanlines whose values are blended from the strips of tables above (``up``) and below (``down``)."""
    lines = batch.column("v")
    sizes = np.diff(lines.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), sizes)
    x, v = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), lines.flatten().to_numpy().astype(np.int64)
    tile_h, tile_w, y = (batch.column(c).to_numpy().astype(np.int64) for c in ("tile_h", "tile_w", "y"))
    fy, fx = y / tile_h - 0.5, x / tile_w[row] - 0.5
    wy, tx = (fy - np.floor(fy))[row], np.floor(fx).astype(np.int64)
    wx, left, right, area = fx - tx, np.maximum(tx, 0), np.minimum(tx + 1, t - 1), (tile_h * tile_w)[row]
    top, bottom = (_looked_up(batch.column(c), row, left, v, t, area) * (1 - wx) + _looked_up(batch.column(c), row, right, v, t, area) * wx
                   for c in ("up", "down"))
    out = np.floor(top * (1 - wy) + bottom * wy + 0.5).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(out))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "height", "width", "y")), lists],
                                      names=["image_id", "height", "width", "y", "v"])


def _clahe_luts(scan: DataFrame, clip: float, t: int) -> DataFrame:
    """(image_id, ty, tile_h, strip): the lookup tables of one row of tiles as entries (tx, v, cum, excess), one per value that occurs in a
    tile: the clipped counts up to that value, and what was clipped off in the whole tile."""
    height, width, y = F.col("height"), F.col("width"), F.col("y")
    full_h, full_w = F.col("tile_h") * t, F.col("tile_w") * t
    beyond = F.when(full_h > height, F.sequence(height, full_h - 1)).otherwise(F.array().cast("array<int>"))
    targets = F.concat(F.array(y), F.filter(beyond, lambda r: mirrored(r, height) == y))
    wide = bind(F.col("v"), lambda values: F.transform(F.sequence(F.lit(0), full_w - 1), lambda x: F.struct(
        F.floor(x / F.col("tile_w")).cast("int").alias("tx"), F.get(values, mirrored(x, width)).alias("v"))))
    area = F.col("tile_h") * F.col("tile_w")
    counts = (
        scan.withColumn("at", F.explode(targets)).withColumn("area", area)
        .select("image_id", "area", "tile_h", F.floor(F.col("at") / F.col("tile_h")).cast("int").alias("ty"), F.explode(wide).alias("c"))
        .groupBy("image_id", "area", "tile_h", "ty", "c.tx", "c.v").agg(F.count(F.lit(1)).alias("n"))
    )
    tile = Window.partitionBy("image_id", "ty", "tx")
    upto = tile.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if clip > 0:
        limit = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(clip) * F.col("area") / 256).cast("bigint"))
        counts = counts.withColumn("kept", F.least("n", limit))
    else:
        counts = counts.withColumn("kept", F.col("n"))
    entry = F.struct(
        "tx", "v", F.sum("kept").over(upto).alias("cum"), (F.sum("n").over(tile) - F.sum("kept").over(tile)).alias("excess"))
    return (
        counts.select("image_id", "ty", "tile_h", entry.alias("e"))
        .groupBy("image_id", "ty", "tile_h").agg(F.sort_array(F.collect_list("e")).alias("strip"))
    )


def ellipse_reach(k: int) -> list[tuple[int, int, int]]:
    """(dy, first dx, last dx) of a k x k elliptical neighbourhood anchored at k // 2."""
    c = k // 2
    spans = []
    for dy in range(-c, k - c):
        half = round(c * math.sqrt(1 - dy * dy / (c * c))) if c and abs(dy) <= c else (0 if not c else None)
        if half is not None:
            spans.append((dy, max(-half, -c), min(half, k - 1 - c)))
    return spans


def dilate_ellipse(rows: DataFrame, column: str, k: int, out: str) -> DataFrame:
    """Largest value of ``column`` in the elliptical k x k neighbourhood (inside the frame) as ``out``."""
    k = max(1, int(k))
    if k == 1:
        return rows.withColumn(out, F.col(column))
    spans = ellipse_reach(k)
    reaches = sorted({(lo, hi) for _, lo, hi in spans})
    width = F.col("width")

    def along(values, lo, hi):
        """Running maximum over x + lo .. x + hi of one row."""
        def at(x):
            if hi - lo <= 16:
                near = [F.get(values, F.when(x + i >= 0, x + i) if i < 0 else x + i) for i in range(lo, hi + 1)]
                return F.greatest(*near) if len(near) > 1 else near[0]
            first = F.greatest(x + lo, F.lit(0))
            return F.array_max(F.slice(values, first + 1, F.least(x + hi, width - 1) - first + 1))

        return F.transform(positions(width), at)

    wide = bind(F.col(column), lambda values: F.array(*[along(values, lo, hi) for lo, hi in reaches]))
    # Clipped stacks are shorter at the frame: entry i of the stack is row y - above + i.
    tall = stacked(rows.withColumn("_wide", wide), "_wide", k // 2, "clip", below=k - 1 - k // 2)
    above = F.least(F.col("y"), F.lit(k // 2))
    picked = F.array(*[F.get(F.when(above + dy >= 0, F.get("stack", above + dy)), F.lit(reaches.index((lo, hi)))) for dy, lo, hi in spans])
    down = bind(picked, lambda p: F.transform(positions(width), lambda x: F.greatest(
        *[F.get(F.get(p, F.lit(i)), x) for i in range(len(spans))]))) if len(spans) > 1 else F.get(picked, F.lit(0))
    return tall.withColumn(out, down).drop("stack", "_wide")


def local_maxima(rows: DataFrame, column: str, k: int, min_value: Column) -> DataFrame:
    """Adds ``bits``: 1 where the value equals the neighbourhood maximum and reaches ``min_value``."""
    dilated = dilate_ellipse(rows, column, k, "_dil")
    return dilated.withColumn(
        "bits", F.zip_with(column, "_dil", lambda d, m: ((d == m) & (d >= min_value)).cast("int"))).drop("_dil")
