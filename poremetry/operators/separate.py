"""Splitting touching pores: distance map, markers, flooding, boundary lines, label clean-up."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from poremetry.functions.rows import bind, bits_of_runs, label_runs_of, labels_of_runs, positions, runs_of_bits
from poremetry.operators import components as cc, filters, masks
from poremetry.operators.neighbours import BAND_PIXELS, band_rows, bundle, by_size, stacked
from poremetry.workspace import attach, materialize, row_count

SEPARATIONS = ("none", "watershed")
# Stands for "no background in this row".
FAR = 1 << 24


@dataclass(frozen=True)
class SeparationParams:
    """Settings of hole filling, speck removal and separation."""

    method: str = "watershed"
    fill_holes: bool = True
    min_area_px: int = 30
    distance_blur_k: int = 3
    peak_min_distance: int = 9
    peak_rel_threshold: float = 0.2
    connectivity: int = 8
    clear_border: bool = False

    def __post_init__(self):
        if self.method not in SEPARATIONS:
            raise ValueError(f"unknown separation method: {self.method}")


def nearest_in_columns(start: np.ndarray) -> np.ndarray:
    """Smallest ``start[i] + (y - i)^2`` over the rows i of every column, for every row y.

    The lower envelope of each column's parabolas is built downwards and read off upwards, all columns side by side, so the time does
    not depend on how far the nearest row is.
    """
    height, columns = start.shape
    owner, since = np.zeros((height, columns), np.int32), np.zeros((height, columns), np.int32)
    top, everywhere = np.zeros(columns, np.int64), np.arange(columns)
    for y in range(1, height):
        at = everywhere
        while at.size:
            i, x = owner[top[at], at].astype(np.int64), since[top[at], at].astype(np.int64)
            at = at[start[i, at] + (x - i) ** 2 > start[y, at] + (x - y) ** 2]
            top[at] -= 1
            at = at[top[at] >= 0]
        below = np.maximum(top, 0)
        i = owner[below, everywhere].astype(np.int64)
        # the first row where the new parabola is lower than the one on top
        turn = np.where(top < 0, 0, 1 + (y * y - i * i + start[y] - start[i, everywhere]) // np.maximum(2 * (y - i), 1))
        at = np.flatnonzero(turn < height)
        top[at] += 1
        owner[top[at], at], since[top[at], at] = y, turn[at]
    best = np.empty_like(start)
    for y in range(height - 1, -1, -1):
        i = owner[top, everywhere].astype(np.int64)
        best[y] = start[i, everywhere] + (y - i) ** 2
        top -= (since[top, everywhere] == y) & (y > 0)
    return best


def _nearest_of_block(table: pa.Table) -> pa.Table:
    """Squared distances of one block of columns, of one or several images of one size, from the distances along the rows."""
    table = table.take(pa.array(np.lexsort((table.column("y").to_numpy(), table.column("image_id").to_numpy()))))
    height = table.column("height")[0].as_py()
    images = table.num_rows // height
    along = table.column("gap").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(images, height, -1)
    width = along.shape[2]
    best = nearest_in_columns((along * along).transpose(1, 0, 2).reshape(height, -1))
    best = best.reshape(height, images, width).transpose(1, 0, 2)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(table.num_rows + 1, dtype=np.int32) * width), pa.array(best.ravel()))
    return table.drop_columns(["gap", "_bundle"]).append_column("d2", lists)


def distance_squared(mask: DataFrame, block_pixels: int = BAND_PIXELS) -> DataFrame:
    """Scanlines ``d2``: exact squared Euclidean distance of every pixel to the nearest background pixel.

    Along the row it follows from the runs; across rows, blocks of columns of bounded size are solved independently, small images together.
    An image without background gets (height + width) squared everywhere.
    """
    width = F.col("width")

    def gaps(runs):
        def piece(r, i):
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["x1"])
            return F.concat(F.array_repeat(F.lit(0), r["x0"] - start), inside(r))

        last = F.coalesce(F.get(runs, F.size(runs) - 1)["x1"], F.lit(0))
        return F.concat(F.flatten(F.transform(runs, piece)), F.array_repeat(F.lit(0), width - last))

    def inside(r):
        left = lambda i: F.when(r["x0"] > 0, i + 1).otherwise(FAR)
        right = lambda i: F.when(r["x1"] < width, r["x1"] - r["x0"] - i).otherwise(FAR)
        return F.transform(F.sequence(F.lit(0), r["x1"] - r["x0"] - 1), lambda i: F.least(left(i), right(i), F.lit(FAR)))

    size = F.greatest(F.lit(1), F.floor(F.lit(float(block_pixels)) / F.col("height")).cast("int"))
    index = F.sequence(F.lit(0), F.ceil(width / size).cast("int") - 1)
    blocks = bind(bind(F.col("runs"), gaps), lambda g: F.transform(index, lambda b: F.slice(g, b * size + 1, size)))
    cut = mask.select("image_id", "height", "width", "y", F.posexplode(blocks).alias("block", "gap"))
    solved = cut.withColumn("_bundle", bundle(block_pixels)).groupBy("height", "width", "_bundle", "block").applyInArrow(
        lambda key, table: _nearest_of_block(table),
        "image_id bigint, height int, width int, y int, block int, d2 array<bigint>")
    whole = solved.groupBy("image_id", "y").agg(
        F.first("height").alias("height"), F.first("width").alias("width"),
        F.sort_array(F.collect_list(F.struct("block", "d2"))).alias("parts"))
    limit = F.pow(F.col("height") + F.col("width"), 2).cast("bigint")
    return whole.select("image_id", "height", "width", "y", F.transform(
        F.flatten(F.transform("parts", lambda p: p["d2"])), lambda d: F.least(d, limit)).alias("d2"))


def distance(mask: DataFrame) -> DataFrame:
    """Scanlines ``d``: exact Euclidean distance to the nearest background pixel."""
    return distance_squared(mask).withColumn("d", F.transform("d2", lambda d: F.sqrt(d.cast("double")))).drop("d2")


def smoothed(rows: DataFrame, k: int) -> DataFrame:
    """Gaussian of ``d`` when k >= 3; values that are not finite become 0."""
    if k and k >= 3:
        rows = filters.blur(rows, "d", filters.odd_kernel(k), "reflect", "d")
    finite = lambda d: F.when(F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)
    return rows.withColumn("d", F.transform("d", finite))


def distance_maximum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("image_id").agg(F.max(F.array_max("d")).alias("d_max"))


def normalised(rows: DataFrame, maxima: DataFrame) -> DataFrame:
    """``d`` divided by the image maximum, zero where that is at most 1e-9; ``maxima`` is a written table."""
    scaled = F.transform("d", lambda d: F.when(F.col("d_max") > 1e-9, d / F.col("d_max")).otherwise(0.0))
    return attach(rows, maxima, ["image_id"]).withColumn("norm", scaled)


def peak_mask(rows: DataFrame, maxima: DataFrame, min_distance: int, rel_threshold: float) -> DataFrame:
    """Mask of local maxima of ``d`` that reach ``rel_threshold`` of the image maximum."""
    rel = min(1.0, max(0.0, float(rel_threshold)))
    with_max = attach(rows, maxima, ["image_id"])
    least = F.lit(rel) * F.greatest(F.col("d_max"), F.lit(1e-9))
    peaks = filters.local_maxima(with_max, "d", max(1, int(min_distance)), least)
    return peaks.select("image_id", "height", "width", "y", runs_of_bits(F.col("bits")).alias("runs"))


def markers_or_components(markers: DataFrame, mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """Marker label runs; images without any marker get the components of their foreground instead."""
    lacking = attach(mask, materialize(markers.select("image_id").distinct()), ["image_id"], "left_anti")
    return markers.unionByName(cc.components(lacking, connectivity))


def flood_rows(rows: DataFrame, markers: DataFrame, mask: DataFrame) -> DataFrame:
    """Input of ``flood``: scanlines with ``cost`` (0..255, low at pore centres) and ``seed`` (marker label or 0).

    ``rows`` carries ``norm``. Markers outside the foreground are cleared.
    """
    width = F.col("width")
    lists = markers.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "label"))).alias("m"))
    fg = mask.select("image_id", "y", "runs")
    empty = F.array().cast("array<struct<x0:int,x1:int,label:int>>")
    joined = rows.join(fg, ["image_id", "y"]).join(lists, ["image_id", "y"], "left")
    seeds = F.zip_with(
        labels_of_runs(F.coalesce("m", empty), width), bits_of_runs(F.col("runs"), width), lambda label, bit: label * bit)
    return joined.select(
        "image_id", "height", "width", "y",
        F.transform("norm", lambda n: (255 - F.floor(n * 255)).cast("int")).alias("cost"), seeds.alias("seed"))


# A flood key packs (level, steps since the level last rose, label) so that keys compare in that order.
LEVEL, STEP = np.int64(1) << 55, np.int64(1) << 31
UNREACHED = np.iinfo(np.int64).max


def settle(cost, key, start, changed, inside, stride):
    """Keys of every inside pixel when nothing moves any more; arrays are flat frames with a closed margin.

    A pixel takes the best of its start and its four neighbours' keys carried over to it: a cost above the level
    raises the level and restarts the steps, otherwise one step is added. Only neighbours of ``changed`` pixels are
    recomputed, so the work follows the flood front.
    """
    moves = np.array([-stride, -1, 1, stride])
    while changed.size:
        near = np.unique((changed[:, None] + moves).ravel())
        near = near[inside[near]]
        best, level = start[near], cost[near]
        for move in moves:
            other = key[near + move]
            rises = level > other // LEVEL
            carried = np.where(rises, level * LEVEL + STEP + other % STEP, other + STEP)
            best = np.where(other != UNREACHED, np.minimum(best, carried), best)
        moved = best != key[near]
        changed = near[moved]
        key[changed] = best[moved]
    return key


def _flood_bands(table: pa.Table) -> pa.Table:
    """Settles a band, or several images of one band each. Rows that are not ``core`` are a neighbour's edge and stay as they are.

    Without such rows the flood starts from the seeds, with them from the edges, on top of the keys the band has.
    """
    table = table.take(pa.array(np.lexsort((table.column("y").to_numpy(), table.column("image_id").to_numpy()))))
    width = table.column("width")[0].as_py()
    column = lambda name: table.column(name).to_numpy(zero_copy_only=False)
    image, core = column("image_id"), column("core").astype(bool)
    # one closed row before every image and one at the end
    place = np.arange(len(image)) + 1 + np.append(0, np.cumsum(image[1:] != image[:-1]))
    shape = (place[-1] + 2, width + 2)
    cells = lambda name: table.column(name).combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, width)

    def frame(values, fill):
        out = np.full(shape, fill, dtype=np.asarray(values).dtype)
        out[place, 1:-1] = values
        return out.ravel()

    given, seed = cells("key"), cells("seed")
    cost, key = frame(cells("cost"), 0), frame(given, UNREACHED)
    inside = frame(np.repeat(core[:, None], width, axis=1), False)
    start = np.where(frame(seed, 0) > 0, cost * LEVEL + frame(seed, 0), UNREACHED)
    if core.all():
        key = start.copy()
        front = np.flatnonzero(key != UNREACHED)
    else:
        front = np.flatnonzero(~inside & (key != UNREACHED))
    settled = settle(cost, key, start, front, inside, width + 2).reshape(shape)[place, 1:-1]
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * width), pa.array(v.ravel()))
    # what the band's edges were before, for the neighbours
    edge = core & (np.append(True, (image[1:] != image[:-1]) | ~core[:-1]) | np.append((image[1:] != image[:-1]) | ~core[1:], True))
    n = np.cumsum(edge)
    before = pa.ListArray.from_arrays(
        pa.array(np.append(0, n).astype(np.int32) * width, mask=np.append(~edge, False)), pa.array(given[edge].ravel()))
    out = table.select(["image_id", "height", "width", "y", "band", "cost", "seed"])
    return out.append_column("key", lists(settled)).append_column("before", before).filter(pa.array(core))


def _crosses(edge_key, edge_before, cost, key):
    """Whether a changed edge can change the row that faces it: some pixel gets a better key, or has lost the one it stands on."""
    none, level, step = F.lit(int(UNREACHED)), F.lit(int(LEVEL)), F.lit(int(STEP))

    def carried(k, c):
        return F.when(c.cast("bigint") > F.floor(k / level), c * level + step + k % step).otherwise(k + step)

    def matters(s):
        better = (s["new"] != none) & (carried(s["new"], s["c"]) < s["k"])
        lost = (s["old"] != none) & (s["old"] != s["new"]) & (carried(s["old"], s["c"]) == s["k"])
        return better | lost

    return F.exists(F.arrays_zip(edge_key.alias("new"), edge_before.alias("old"), cost.alias("c"), key.alias("k")), matters)


def flood(rows: DataFrame, band_pixels: int | None = None) -> DataFrame:
    """Scanlines with ``key`` for every pixel: the flood of the whole frame from the seeds.

    Bands of bounded size are solved on their own, small images several at a time. Then only the bands are solved again that a neighbour's
    changed edge row can change, on top of the keys they have, until there are none; a round writes those bands and the last
    written version of a band counts. The result does not depend on the bands, because keys have one fixed point.
    """
    band = band_rows(F.col("height"), F.col("width"), pixels=band_pixels)
    names = ("image_id bigint, height int, width int, y int, band int, cost array<int>, seed array<int>, key array<bigint>, "
             "before array<bigint>")
    frame = ["image_id", "height", "width", "y", "band", "cost", "seed", "key"]

    def solve(bands: DataFrame, version: int) -> DataFrame:
        solved = bands.withColumn("_bundle", bundle(band_pixels)).groupBy("height", "width", "_bundle", "band").applyInArrow(
            lambda key, table: _flood_bands(table), names)
        return materialize(solved.withColumn("version", F.lit(version)), tall=F.max(F.col("height") > band))

    unreached = F.transform("cost", lambda c: F.lit(int(UNREACHED)).cast("bigint"))
    versions = [solve(rows.select(
        "image_id", "height", "width", "y", F.floor(F.col("y") / band).cast("int").alias("band"), "cost", "seed",
        unreached.alias("key"), F.lit(True).alias("core")), 0)]
    if not versions[0].metrics["tall"]:
        return versions[0].select("image_id", "height", "width", "y", "cost", "key")
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    edges, again = [], []
    while True:
        edges.append(materialize(versions[-1].where((F.col("height") > band) & F.col("before").isNotNull())))
        latest = union(edges).groupBy("image_id", "y").agg(F.max_by(F.struct(*frame[1:3], *frame[4:]), "version").alias("e")).select(
            "image_id", "y", "e.*")
        y = F.col("y")
        faced = F.filter(F.array(F.when(y % band == 0, y - 1), F.when((y + 1) % band == 0, y + 1)), lambda f: (f >= 0) & (f < F.col("height")))
        changed = edges[-1].where("key <> before").select(
            "image_id", F.explode(faced).alias("y"), F.col("key").alias("edge_key"), F.col("before").alias("edge_before"))
        work = materialize(changed.join(latest, ["image_id", "y"]).where(_crosses(F.col("edge_key"), F.col("edge_before"), F.col("cost"), F.col("key")))
                           .select("image_id", "band").distinct().withColumn("version", F.lit(len(versions))))
        if not row_count(work):
            break
        last = F.lit(0) if not again else F.coalesce("last", F.lit(0))
        known = work.select("image_id", "band")
        if again:
            known = known.join(union(again).groupBy("image_id", "band").agg(F.max("version").alias("last")), ["image_id", "band"], "left")
        known = materialize(known.select("image_id", "band", last.alias("last")))
        again.append(work)
        core = attach(union(versions), known, ["image_id", "band"]).where("version = last").select(*frame, F.lit(True).alias("core"))
        beside = F.filter(F.array(F.when(y % band == 0, F.col("band") - 1), F.when((y + 1) % band == 0, F.col("band") + 1)), lambda b: b >= 0)
        facing = latest.select("image_id", "height", "width", "y", F.explode(beside).alias("band"), "cost", "seed", "key", F.lit(False).alias("core"))
        versions.append(solve(core.unionByName(attach(facing, known.drop("last"), ["image_id", "band"])), len(versions)))
    newest = materialize(union(again).groupBy("image_id", "band").agg(F.max("version").alias("last"))) if again else None
    whole = union(versions)
    if newest is not None:
        whole = attach(whole, newest, ["image_id", "band"], "left").where(F.col("version") == F.coalesce("last", F.lit(0)))
    return whole.select("image_id", "height", "width", "y", "cost", "key")


def watershed_labels(flooded: DataFrame, lines: bool = True, frame: bool = True) -> DataFrame:
    """Scanlines ``label`` from flood keys.

    ``lines``: a pixel reached later than a 4-neighbour with another label becomes background. ``frame``: the outermost
    pixels of the frame never carry a label.
    """
    rows = stacked(flooded, "key", 1)
    width, y = F.col("width"), F.col("y")
    up = F.when(y > 0, F.get("stack", F.lit(0)))
    down = F.when(y < F.col("height") - 1, F.get("stack", F.size("stack") - 1))
    label = lambda k: k % F.lit(int(STEP))

    def at(x):
        key = F.get("key", x)
        keep = key != F.lit(int(UNREACHED))
        if lines:
            for other in (F.get("key", F.when(x > 0, x - 1)), F.get("key", x + 1), F.get(up, x), F.get(down, x)):
                keep = keep & ~F.coalesce((other < key) & (label(other) != label(key)), F.lit(False))
        if frame:
            keep = keep & (x > 0) & (x < width - 1) & (y > 0) & (y < F.col("height") - 1)
        return F.when(keep, label(key)).otherwise(0).cast("int")

    rows = rows.withColumn("up", up).withColumn("down", down)
    return rows.select("image_id", "height", "width", "y", F.transform(positions(width), at).alias("label"))


def foreground_labels(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """Label runs of the labelled scanlines, kept only inside the mask."""
    joined = labels.join(mask.select("image_id", "y", "runs"), ["image_id", "y"])
    inside = F.zip_with("label", bits_of_runs(F.col("runs"), F.col("width")), lambda label, bit: label * bit)
    return joined.select("image_id", "height", "width", "y", F.inline(label_runs_of(inside)))


def markers(mask: DataFrame, params: SeparationParams = SeparationParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distance scanlines, their maxima, marker label runs inside the whole frame)."""
    rows = materialize(smoothed(distance(mask), params.distance_blur_k))
    maxima = materialize(distance_maximum(rows))
    peaks = peak_mask(rows, maxima, params.peak_min_distance, params.peak_rel_threshold)
    return rows, maxima, cc.components(peaks, params.connectivity)


# Images of one band: several are separated in one grouped Arrow step. Arrays are (image, y, x).


def _images(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(image ids, foreground) of the mask rows of images of one size."""
    table = table.take(pa.array(np.lexsort((table.column("y").to_numpy(), table.column("image_id").to_numpy()))))
    height, width = (table.column(c)[0].as_py() for c in ("height", "width"))
    runs = table.column("runs").combine_chunks()
    flat = runs.flatten()
    row = np.repeat(np.arange(table.num_rows), np.diff(runs.offsets.to_numpy()))
    turns = np.zeros((table.num_rows, width + 1), np.int32)
    np.add.at(turns, (row, flat.field("x0").to_numpy()), 1)
    np.add.at(turns, (row, flat.field("x1").to_numpy()), -1)
    return table.column("image_id").to_numpy()[::height], (np.cumsum(turns, axis=1)[:, :width] > 0).reshape(-1, height, width)


def _distances(inside: np.ndarray, blur_k: int) -> np.ndarray:
    """``smoothed(distance(mask))``."""
    n, height, width = inside.shape
    x = np.arange(width)
    left = x - np.maximum.accumulate(np.where(inside, -FAR, x), axis=2)
    right = np.minimum.accumulate(np.where(inside, width + FAR, x)[:, :, ::-1], axis=2)[:, :, ::-1] - x
    along = np.minimum(np.minimum(left, right), FAR).astype(np.int64)
    best = nearest_in_columns((along * along).transpose(1, 0, 2).reshape(height, -1)).reshape(height, n, width).transpose(1, 0, 2)
    d = np.sqrt(np.minimum(best, (height + width) ** 2).astype(np.float64))
    if blur_k and blur_k >= 3:
        weights = filters.gaussian_weights(filters.odd_kernel(blur_k))
        reach = len(weights) // 2
        for axis, size in ((2, width), (1, height)):
            wide = np.take(d, filters.places_inside(np.arange(-reach, size + reach), size, "reflect"), axis)
            d = sum(np.take(wide, np.arange(i, i + size), axis) * w for i, w in enumerate(weights))
    return d


def _widest(d: np.ndarray, k: int) -> np.ndarray:
    """Largest value in the elliptical k x k neighbourhood inside the frame, as ``filters.dilate_ellipse``."""
    if k == 1:
        return d
    height, width = d.shape[1:]
    spans, c = filters.ellipse_reach(k), k // 2
    out, along = np.full(d.shape, -np.inf), {}
    for dy, lo, hi in spans:
        if (lo, hi) not in along:
            v, have, size = np.pad(d, ((0, 0), (0, 0), (c, k)), constant_values=-np.inf), 1, hi - lo + 1
            while have < size:
                more = min(have, size - have)
                v = np.maximum(v[:, :, :-more], v[:, :, more:])
                have += more
            along[lo, hi] = v[:, :, c + lo:c + lo + width]
        first, end = max(0, -dy), height - max(0, dy)
        if first < end:
            out[:, first:end] = np.maximum(out[:, first:end], along[lo, hi][:, first + dy:end + dy])
    return out


def _marked(d: np.ndarray, params: SeparationParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, x0, x1, label) of the runs of the peaks of ``d``, numbered per image in raster order; rows count through all images."""
    rel = min(1.0, max(0.0, float(params.peak_rel_threshold)))
    least = rel * np.maximum(d.max(axis=(1, 2)), 1e-9)
    peaks = (d == _widest(d, max(1, int(params.peak_min_distance)))) & (d >= least[:, None, None])
    height, width = d.shape[1:]
    edge = np.diff(np.pad(peaks.reshape(-1, width), ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, x0), x1 = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    if not len(row):
        return row, x0, x1, row
    image = row // height
    root = cc.smallest_reachable(len(row), *cc.touching_runs(image, row % height, x0, x1, int(params.connectivity == 8)))
    heads = np.cumsum(root == np.arange(len(root)))
    return row, x0, x1, heads[root] - heads[np.searchsorted(image, image)] + 1


def _flooded(cost: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Keys of whole images, as ``flood``; a closed row stands before every image."""
    n, height, width = cost.shape
    place = (np.arange(n)[:, None] * (height + 1) + 1 + np.arange(height)).ravel()

    def frame(values, fill):
        out = np.full((n * (height + 1) + 1, width + 2), fill, dtype=values.dtype)
        out[place, 1:-1] = values.reshape(-1, width)
        return out.ravel()

    start = frame(np.where(seed > 0, cost * LEVEL + seed, UNREACHED), UNREACHED)
    key = settle(frame(cost, 0), start.copy(), start, np.flatnonzero(start != UNREACHED), frame(np.ones(cost.shape, bool), False), width + 2)
    return key.reshape(-1, width + 2)[place, 1:-1].reshape(cost.shape)


def _separated(table: pa.Table, params: SeparationParams, lines: bool, frame: bool) -> pa.Table:
    """Label runs of several small images, all of one size."""
    ids, inside = _images(table)
    n, height, width = inside.shape
    d = _distances(inside, params.distance_blur_k)
    row, x0, x1, number = _marked(d, params)
    seed = np.zeros((n * height, width), np.int64)
    size = x1 - x0
    seed[np.repeat(row, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - x0, size)] = np.repeat(number, size)
    top = d.max(axis=(1, 2))[:, None, None]
    norm = np.where(top > 1e-9, d / np.where(top > 1e-9, top, 1.0), 0.0)
    key = _flooded(255 - np.floor(norm * 255).astype(np.int64), seed.reshape(inside.shape) * inside)
    label, keep = key % STEP, (key != UNREACHED) & inside
    if lines:
        for axis in (1, 2):
            one, two = [slice(None)] * 3, [slice(None)] * 3
            one[axis], two[axis] = slice(None, -1), slice(1, None)
            for here, other in ((tuple(one), tuple(two)), (tuple(two), tuple(one))):
                keep[here] &= ~((key[other] < key[here]) & (label[other] != label[here]))
    if frame:
        keep[:, [0, -1]] = keep[:, :, [0, -1]] = False
    label = np.pad((label * keep).reshape(-1, width), ((0, 0), (1, 1)))
    turn = label[:, 1:] != label[:, :-1]
    (row, x0), x1 = np.nonzero(turn[:, :-1] & (label[:, 1:-1] > 0)), np.nonzero(turn[:, 1:] & (label[:, 1:-1] > 0))[1] + 1
    return _label_table(ids, height, width, row, x0, x1, label[row, x0 + 1])


def _label_table(ids: np.ndarray, height: int, width: int, row: np.ndarray, x0: np.ndarray, x1: np.ndarray, label: np.ndarray) -> pa.Table:
    short = lambda v: pa.array(v.astype(np.int32))
    same = lambda v: short(np.full(len(row), v))
    return pa.table({"image_id": ids[row // height], "height": same(height), "width": same(width), "y": short(row % height),
                     "x0": short(x0), "x1": short(x1), "label": short(label)})


def _per_bundle(mask: DataFrame, step, band_pixels: int | None) -> DataFrame:
    rows = mask.select("image_id", "height", "width", "y", "runs", bundle(band_pixels).alias("_bundle"))
    return rows.groupBy("height", "width", "_bundle").applyInArrow(
        lambda key, table: step(table), "image_id bigint, height int, width int, y int, x0 int, x1 int, label int")


def marker_runs(mask: DataFrame, params: SeparationParams = SeparationParams(), band_pixels: int | None = None) -> DataFrame:
    """Marker label runs of a written mask, inside the whole frame."""
    def step(table: pa.Table) -> pa.Table:
        ids, inside = _images(table)
        return _label_table(ids, *inside.shape[1:], *_marked(_distances(inside, params.distance_blur_k), params))

    return by_size(mask, lambda m: _per_bundle(m, step, band_pixels), lambda m: markers(m, params)[2], band_pixels)


def watershed(mask: DataFrame, params: SeparationParams = SeparationParams(), lines: bool = True, frame: bool = True,
              band_pixels: int | None = None) -> DataFrame:
    """Label runs of separated pores.

    Markers flood the whole frame, so background is no barrier and a pore without a marker takes the label of a
    neighbour. A mask with any foreground has a marker, since its largest distance always reaches the peak threshold.
    Images of one band are separated in one grouped step, several at a time; only taller ones pass through bands.
    """
    def tall(mask: DataFrame) -> DataFrame:
        rows, maxima, found = markers(mask, params)
        flooded = flood(flood_rows(normalised(rows, maxima), found, mask), band_pixels)
        return foreground_labels(watershed_labels(flooded, lines, frame), mask)

    return by_size(materialize(mask), lambda m: _per_bundle(m, lambda table: _separated(table, params, lines, frame), band_pixels), tall, band_pixels)


def relabel(label_runs: DataFrame, min_area: int = 0, clear_border: bool = False) -> DataFrame:
    """Drop small or frame-touching labels and number the rest 1..K per image in old-label order.

    Numbers come from two levels: the rank inside a range of 65 536 old labels plus the count of earlier ranges.
    """
    touches = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("width"))
    slices = label_runs.withColumn("slab", F.floor(F.col("y") / 256))
    per_slab = slices.groupBy("image_id", "label", "slab").agg(
        F.sum((F.col("x1") - F.col("x0")).cast("bigint")).alias("area"), F.max(touches).alias("touches_border"))
    facts = per_slab.groupBy("image_id", "label").agg(F.sum("area").alias("area"), F.max("touches_border").alias("touches_border"))
    if min_area > 1:
        facts = facts.where(F.col("area") >= min_area)
    if clear_border:
        facts = facts.where(~F.col("touches_border"))
    facts = facts.select("image_id", "label", F.floor(F.col("label") / 65536).alias("block"))
    earlier = facts.groupBy("image_id", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "image_id", "block", F.coalesce(F.sum("n").over(Window.partitionBy("image_id").orderBy("block").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = facts.withColumn("rank", F.row_number().over(Window.partitionBy("image_id", "block").orderBy("label")))
    names = ranked.join(earlier, ["image_id", "block"]).select(
        "image_id", "label", (F.col("rank") + F.col("before")).cast("int").alias("new_label"))
    # Rows meet their new label by (image, label, slab), so a label that owns most rows is not one hot key.
    keys = per_slab.select("image_id", "label", "slab").join(names, ["image_id", "label"])
    return slices.join(keys, ["image_id", "label", "slab"]).select(
        "image_id", "height", "width", "y", "x0", "x1", F.col("new_label").alias("label"))


def clean_mask(mask: DataFrame, params: SeparationParams) -> DataFrame:
    """Hole filling, speck removal and border clearing ahead of the separation."""
    return masks.clean(mask, params.min_area_px, params.clear_border, params.connectivity, holes=params.fill_holes)


def separate(mask: DataFrame, params: SeparationParams = SeparationParams()) -> DataFrame | None:
    """Label runs of a cleaned mask, or None when the method is "none"."""
    if params.method == "none":
        return None
    return relabel(watershed(mask, params), params.min_area_px, params.clear_border)
