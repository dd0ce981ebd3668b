"""Per-pore measurements from label runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from poremetry.functions.rows import bind, bits_of_runs
from poremetry.operators.components import label_runs as label_components, smallest_reachable, touching_runs
from poremetry.operators.neighbours import BAND_PIXELS, bundle, by_size
from poremetry.workspace import attach, materialize, written

# The columns of the pore table, in export order.
PORE_COLUMNS = {
    "image_index": "bigint", "label": "int",
    "area_px": "bigint", "perimeter_px": "double", "centroid_x": "double", "centroid_y": "double",
    "bbox_x0": "int", "bbox_y0": "int", "bbox_x1": "int", "bbox_y1": "int", "touches_border": "boolean",
    "eq_diam_px": "double", "circularity": "double", "major_axis_px": "double", "minor_axis_px": "double",
    "aspect_ratio": "double", "orientation_deg": "double", "feret_max_px": "double", "feret_min_px": "double",
    "units_per_px": "double", "area_units2": "double", "eq_diam_units": "double", "major_axis_units": "double",
    "minor_axis_units": "double", "feret_max_units": "double", "feret_min_units": "double", "unit_name": "string",
}

PORE = ["image_id", "label"]
ROW = [*PORE, "y"]
FRAME = ["height", "width"]


def basic_measures(runs: DataFrame) -> DataFrame:
    """Area, centroid, box and frame contact; closed forms over runs, pre-aggregated before the shuffle."""
    n = (F.col("x1") - F.col("x0")).cast("bigint")
    return runs.groupBy(*PORE, *FRAME).agg(
        F.sum(n).alias("area_px"),
        F.sum((F.col("x0") + F.col("x1") - 1) * n).alias("twice_sum_x"), F.sum(F.col("y") * n).alias("sum_y"),
        F.min("x0").alias("bbox_x0"), F.min("y").alias("bbox_y0"), F.max("x1").alias("bbox_x1"), (F.max("y") + 1).alias("bbox_y1"),
    ).select(*PORE, *_from_sums())


def _from_sums() -> list[Column]:
    return [
        F.col("area_px"),
        (F.col("twice_sum_x") / 2 / F.col("area_px")).alias("centroid_x"), (F.col("sum_y") / F.col("area_px")).alias("centroid_y"),
        *[F.col(c) for c in ("bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1")],
        ((F.col("bbox_x0") == 0) | (F.col("bbox_y0") == 0) | (F.col("bbox_x1") >= F.col("width"))
         | (F.col("bbox_y1") >= F.col("height"))).alias("touches_border")]


def label_rows(runs: DataFrame) -> DataFrame:
    """One row per (image, label, y) with the sorted run list."""
    return runs.groupBy(*ROW).agg(
        F.first("height").alias("height"), F.first("width").alias("width"),
        F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("runs"))


def filled_rows(runs: DataFrame) -> DataFrame:
    """Label rows whose enclosed background is filled, label by label.

    A hole pixel lies between two runs of its label on its row, so only those gaps are candidates. A gap leaks when a
    pixel above or below it lies outside the label's span there; components of gaps without a leak are holes.
    """
    rows = label_rows(runs)
    inner = F.zip_with(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.slice("runs", 1, F.greatest(F.size("runs") - 1, F.lit(0))),
                       lambda b, a: F.struct(a["x1"].alias("x0"), b["x0"].alias("x1")))
    gaps = rows.where(F.size("runs") > 1).select(*ROW, *FRAME, F.inline(inner))
    spans = runs.groupBy(*ROW).agg(F.min("x0").alias("s0"), F.max("x1").alias("s1"))
    # Spans are looked up for the rows next to a gap; the key holds y, so a large label is spread out.
    needed = gaps.select(*ROW, "x0", "x1", F.explode(F.array(F.lit(-1), F.lit(1))).alias("dy"))
    beside = needed.withColumn("gap_y", F.col("y")).withColumn("y", F.col("y") + F.col("dy")).join(spans, ROW, "left")
    leaks = beside.groupBy(*PORE, F.col("gap_y").alias("y"), "x0", "x1").agg(
        F.max(F.coalesce((F.col("s0") > F.col("x0")) | (F.col("s1") < F.col("x1")), F.lit(True))).alias("leak"))
    candidates = gaps.join(leaks, [*ROW, "x0", "x1"]).withColumn("layer", F.col("label").cast("bigint"))
    labelled = label_components(candidates, 4)
    parts = labelled.groupBy("image_id", "layer", "part", "comp").agg(F.max("leak").alias("leak"))
    closed = parts.groupBy("image_id", "layer", "comp").agg(F.max("leak").alias("leak")).where("not leak").select("image_id", "layer", "comp")
    holes = labelled.join(parts.join(closed, ["image_id", "layer", "comp"], "left_semi").select("image_id", "layer", "part"),
                          ["image_id", "layer", "part"], "left_semi").select(*ROW, F.struct("x0", "x1").alias("hole"))
    by_row = holes.groupBy(*ROW).agg(F.collect_list("hole").alias("holes"))
    merged = bind(F.sort_array(F.concat("runs", F.coalesce("holes", F.array().cast("array<struct<x0:int,x1:int>>")))), _joined)
    return rows.join(by_row, ROW, "left").select(*ROW, *FRAME, F.when(F.col("holes").isNull(), F.col("runs")).otherwise(merged).alias("runs"))


def _joined(pieces: Column) -> Column:
    """Touching sorted runs merged."""
    index = F.sequence(F.lit(0), F.size(pieces) - 1)
    starts = F.filter(index, lambda i: (i == 0) | (F.get(pieces, F.greatest(i - 1, F.lit(0)))["x1"] < F.get(pieces, i)["x0"]))
    ends = F.filter(index, lambda i: (i == F.size(pieces) - 1) | (F.get(pieces, i)["x1"] < F.coalesce(F.get(pieces, i + 1)["x0"], F.lit(1 << 30))))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(pieces, a)["x0"].alias("x0"), F.get(pieces, b)["x1"].alias("x1")))


def outline_steps(filled: DataFrame) -> DataFrame:
    """(image_id, label, straight, slanted): outline steps of length 1 and of length sqrt(2).

    Follows from counting 2 x 2 windows, which in turn follow from how runs on neighbouring rows overlap: every run
    finds the latest run, in x order, of the row on the other side; each overlapping or corner-touching pair is
    found once.
    """
    runs = filled.select(*ROW, F.inline("runs"))
    both = runs.select(*PORE, "x0", "x1", F.col("y").alias("seam"), F.lit(False).alias("above")).unionByName(
        runs.select(*PORE, "x0", "x1", (F.col("y") + 1).alias("seam"), F.lit(True).alias("above")))
    order = Window.partitionBy(*PORE, "seam").orderBy("x0", "above").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = F.when(F.col("above"), F.last(F.when(~F.col("above"), F.struct("x0", "x1")), ignorenulls=True).over(order)).otherwise(
        F.last(F.when(F.col("above"), F.struct("x0", "x1")), ignorenulls=True).over(order))
    seen = both.withColumn("o", other)
    shared = F.when(F.col("o").isNotNull(), F.least("x1", F.col("o.x1")) - F.greatest("x0", F.col("o.x0")))
    ends = (F.col("x0") != F.col("o.x0")).cast("int") + (F.col("x1") != F.col("o.x1")).cast("int")
    zero = F.lit(0)
    counts = seen.withColumn("shared", shared).groupBy(*PORE).agg(
        # Every run occurs twice, which is what the two seams beside it ask for.
        F.sum(F.col("x1") - F.col("x0") - 1).alias("pairs_along"),
        F.sum(F.when(F.col("shared") > 0, F.col("shared")).otherwise(zero)).alias("pairs_across"),
        F.sum(F.when(F.col("shared") > 0, F.col("shared") - 1).otherwise(zero)).alias("full"),
        F.sum(F.when(F.col("shared") > 0, ends).otherwise(zero)).alias("three"),
        F.sum(F.when(F.col("shared") == 0, 1).otherwise(zero)).alias("corner"))
    return counts.select(
        *PORE, (F.col("pairs_along") + 2 * F.col("pairs_across") - 4 * F.col("full") - 2 * F.col("three")).alias("straight"),
        (F.col("three") + 2 * F.col("corner")).alias("slanted"))


def perimeters(steps: DataFrame) -> DataFrame:
    return steps.select(*PORE, (F.col("straight") + F.lit(sqrt(2)) * F.col("slanted")).alias("perimeter_px"))


def outline_points(filled: DataFrame) -> DataFrame:
    """(image_id, label, y, x, visits): outline pixels and how often the closed outline passes them.

    Every label row meets the rows above and below by key (one shuffle, at most three rows a group); the three bit
    rows decide which steps start or end at a pixel.
    """
    near = filled.select(*PORE, "y", "runs", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("dy"))
    pick = lambda d: F.max(F.when(F.col("dy") == d, F.col("runs")))
    three = near.groupBy(*PORE, (F.col("y") + F.col("dy")).alias("y")).agg(
        pick(1).alias("up"), pick(0).alias("here"), pick(-1).alias("down")).where("here is not null")
    empty = F.array().cast("array<struct<x0:int,x1:int>>")
    origin = F.get("here", F.lit(0))["x0"] - 1
    limit = F.get("here", F.size("here") - 1)["x1"] + 1
    span = three.withColumn("origin", origin).withColumn("span", limit - origin)

    def local(runs: Column) -> Column:
        shifted = F.transform(F.coalesce(runs, empty), lambda r: F.struct(
            F.greatest(r["x0"] - F.col("origin"), F.lit(0)).alias("x0"), F.least(r["x1"] - F.col("origin"), F.col("span")).alias("x1")))
        return bits_of_runs(F.filter(shifted, lambda r: r["x0"] < r["x1"]), F.col("span"))

    def points(rows: Column) -> Column:
        bit = lambda dy, x: F.get(F.get(rows, F.lit(dy + 1)), x) == 1

        def visits(x):
            ends = F.lit(0)
            for sy in (-1, 1):
                for sx in (-1, 1):
                    h, v, d = bit(0, x + sx), bit(sy, x), bit(sy, x + sx)
                    ends = ends + F.when((h != v) | (h & v), F.when(h & v, 0).otherwise(1)).otherwise(F.when(d, 2).otherwise(0))
            return ends

        def alone(x):
            return ~(bit(-1, x - 1) | bit(-1, x) | bit(-1, x + 1) | bit(0, x - 1) | bit(0, x + 1) | bit(1, x - 1) | bit(1, x) | bit(1, x + 1))

        inside = F.filter(F.sequence(F.lit(1), F.col("span") - 2), lambda x: bit(0, x))
        marked = F.transform(inside, lambda x: F.struct(
            (x + F.col("origin")).alias("x"), F.when(alone(x), 2).otherwise(visits(x)).alias("ends")))
        return F.filter(marked, lambda p: p["ends"] > 0)

    rows = F.array(local(F.col("up")), local(F.col("here")), local(F.col("down")))
    return span.select(*PORE, "y", F.inline(bind(rows, points))).select(*ROW, "x", F.expr("ends div 2").alias("visits"))


POWERS = [(i, j) for order in range(5) for i in range(order, -1, -1) for j in (order - i,)]
TILE = 256


def outline_moments(points: DataFrame) -> DataFrame:
    """Sums of visits * x^i * y^j, i + j <= 4, per label around the origin (ox, oy).

    Sums are first taken per 256 x 256 tile around the tile's centre, where they are small exact integers, and then
    moved to the label's origin. A label touches few tiles, so nothing large is gathered.
    """
    tx, ty = F.floor(F.col("x") / TILE).cast("int"), F.floor(F.col("y") / TILE).cast("int")
    local = points.select(*PORE, tx.alias("tx"), ty.alias("ty"), F.col("visits").cast("double").alias("w"),
                          (F.col("x") - tx * TILE - TILE // 2).cast("double").alias("u"),
                          (F.col("y") - ty * TILE - TILE // 2).cast("double").alias("v"))

    per_tile = local.groupBy(*PORE, "tx", "ty").agg(
        *[F.expr("sum(" + " * ".join(["w"] + ["u"] * i + ["v"] * j) + f") AS m{i}{j}") for i, j in POWERS])
    gathered = per_tile.groupBy(*PORE).agg(F.collect_list(F.struct("tx", "ty", *[f"m{i}{j}" for i, j in POWERS])).alias("tiles"))
    gathered = gathered.withColumn("ox", F.array_min("tiles.tx")).withColumn("oy", F.array_min("tiles.ty"))

    def moved(i: int, j: int) -> str:
        terms = [" * ".join([f"{comb(i, a) * comb(j, b)} * t.m{a}{b}"] + [f"(t.tx - ox) * {TILE}D"] * (i - a) + [f"(t.ty - oy) * {TILE}D"] * (j - b))
                 for a in range(i + 1) for b in range(j + 1)]
        return f"CASE WHEN size(tiles) = 1 THEN tiles[0].m{i}{j} ELSE aggregate(tiles, 0D, (acc, t) -> acc + {' + '.join(terms)}) END AS m{i}{j}"

    return gathered.select(
        *PORE, (F.col("ox") * TILE + TILE // 2).alias("ox"), (F.col("oy") * TILE + TILE // 2).alias("oy"),
        *[F.expr(moved(i, j)) for i, j in POWERS])


def spread_axes(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """Axes from the 2 x 2 covariance of few outline points: 4 standard deviations and the main direction."""
    a, b, c = sxx / n - (sx / n) * (sx / n), sxy / n - (sx / n) * (sy / n), syy / n - (sy / n) * (sy / n)
    middle, radius = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    angle = F.degrees(F.atan2(2 * b, a - c) / 2)
    return F.struct(
        (4 * F.sqrt(F.greatest(middle + radius, F.lit(0.0)))).alias("major"),
        (4 * F.sqrt(F.greatest(middle - radius, F.lit(0.0)))).alias("minor"),
        F.pmod(angle + 360.0, F.lit(180.0)).alias("angle"))


def fit_ellipses(moments: np.ndarray) -> np.ndarray:
    """(major, minor, angle) of least-squares ellipses for many outlines; ``moments`` is (n, 15) in POWERS order.

    Solves a x^2 + b y^2 + c xy + d x + e y = 1 around the mean, moves to its centre, solves a, b, c again there.
    Outlines without a proper ellipse give NaN.
    """
    m = {p: moments[:, k] for k, p in enumerate(POWERS)}

    def shifted(m, dx, dy):
        return {(i, j): sum(comb(i, a) * comb(j, b) * (-dx) ** (i - a) * (-dy) ** (j - b) * m[a, b]
                            for a in range(i + 1) for b in range(j + 1)) for i, j in POWERS}

    def solve(m, basis):
        left = np.stack([np.stack([m[p[0] + q[0], p[1] + q[1]] for q in basis], -1) for p in basis], -2)
        right = np.stack([m[p] for p in basis], -1)
        good = np.isfinite(left).all((1, 2)) & (np.linalg.cond(np.where(np.isfinite(left), left, 0)) < 1e12)
        out = np.full(right.shape, np.nan)
        if good.any():
            out[good] = np.linalg.solve(left[good], right[good][..., None])[..., 0]
        return out

    with np.errstate(all="ignore"):
        n = m[0, 0]
        m = shifted(m, m[1, 0] / n, m[0, 1] / n)
        scale = np.sqrt((m[2, 0] + m[0, 2]) / n)
        m = {p: v / scale ** (p[0] + p[1]) for p, v in m.items()}
        a, b, c, d, e = solve(m, [(2, 0), (0, 2), (1, 1), (1, 0), (0, 1)]).T
        det = 4 * a * b - c * c
        m = shifted(m, (c * e - 2 * b * d) / det, (c * d - 2 * a * e) / det)
        a, b, c = solve(m, [(2, 0), (0, 2), (1, 1)]).T
        middle, radius = (a + b) / 2, np.hypot((a - b) / 2, c / 2)
        small, large = middle - radius, middle + radius
        major, minor = 2 * scale / np.sqrt(small), 2 * scale / np.sqrt(large)
        # The major axis lies along the eigenvector of the smaller eigenvalue.
        angle = np.degrees(0.5 * np.arctan2(-c, b - a)) % 180.0
    return np.stack([major, minor, angle], -1)


def axes(moments: DataFrame, keep: list[str] = PORE, fit: bool = True) -> DataFrame:
    """(image_id, label, major_axis_px, minor_axis_px, orientation_deg); columns named in ``keep`` stay.

    Five or more outline points: least-squares ellipse. Two to four, or no proper ellipse: covariance of the points.
    One point: NULL. Without ``fit``, for outlines of at most four points, no ellipse is tried and nothing goes through Python.
    """
    @F.pandas_udf("major double, minor double, angle double")
    def ellipse(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.to_numpy(dtype=float)
        found, enough = np.full((len(values), 3), np.nan), values[:, 0] >= 5
        found[enough] = fit_ellipses(values[enough])
        return pd.DataFrame(found, columns=["major", "minor", "angle"])

    names = [f"m{i}{j}" for i, j in POWERS]
    n = F.col("m00")
    few = spread_axes(n, *[F.col(c) for c in ("m10", "m01", "m20", "m11", "m02")])
    fitted = moments.withColumn("few", few)
    best = lambda name: F.col(f"few.{name}")
    if fit:
        fitted = fitted.withColumn("fit", ellipse(F.struct(*names)))
        use_fit = (n >= 5) & F.col("fit.major").isNotNull() & ~F.isnan("fit.major") & ~F.isnan("fit.minor")
        best = lambda name: F.when(use_fit, F.col(f"fit.{name}")).otherwise(F.col(f"few.{name}"))
    part = lambda name: F.when(n >= 2, best(name))
    return fitted.select(*keep, part("major").alias("major_axis_px"), part("minor").alias("minor_axis_px"),
                         part("angle").alias("orientation_deg"))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of points sorted by (y, x), as a closed loop without collinear points."""
    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    seq = [tuple(p) for p in points.tolist()]
    if len(seq) < 3:
        return np.array(seq, dtype=float)
    return np.array(half(seq)[:-1] + half(seq[::-1])[:-1], dtype=float)


SLAB = 2048  # image rows whose outline points one partial hull takes in
FEW_ROWS = 64  # row extremes that go on as they are


def extreme(ring: np.ndarray, angles: np.ndarray, at: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Largest projection of a convex ring onto every direction, by where the direction's normal lies among the edge angles.

    The neighbours of the corner found are looked at as well, as angles are rounded; projections of whole numbers are exact.
    """
    corner = np.searchsorted(angles, at)
    near = ring[(corner[:, None] + np.arange(-1, 2)) % len(ring)]
    return np.einsum("ijk,ik->ij", near, direction).max(axis=1)


def calipers(ring: np.ndarray) -> tuple[float, float]:
    """(largest distance, shorter side of the smallest-area rectangle) of a convex ring of whole numbers (y, x).

    Calipers turn along the edges: a corner's farthest corner is opposite one of its edges. Of rectangles of one area the
    one with the smallest side counts. Linear but for the sort of the edges.
    """
    if len(ring) < 2:
        return 0.0, 0.0
    edge = np.roll(ring, -1, axis=0) - ring
    angles = np.arctan2(edge[:, 1], edge[:, 0])
    first = int(angles.argmin())
    ring, edge, angles = (np.roll(v, -first, axis=0) for v in (ring, edge, angles))
    turned = lambda quarter: (angles + quarter * np.pi / 2 + np.pi) % (2 * np.pi) - np.pi
    normal = np.stack([-edge[:, 1], edge[:, 0]], axis=1)
    # corner i lies before edge i: the farthest in direction of angle a is where edges turn past a + 90 degrees
    opposite = (np.searchsorted(angles, turned(2))[:, None] + np.arange(-1, 2)) % len(ring)
    apart = np.concatenate([ring[opposite] - ring[:, None], ring[opposite] - np.roll(ring, -1, axis=0)[:, None]], axis=1)
    longest = float(np.sqrt((apart ** 2).sum(axis=2).max()))
    here = (normal * ring).sum(axis=1)
    across = extreme(ring, angles, turned(2), normal) - here
    along = extreme(ring, angles, turned(1), edge) + extreme(ring, angles, turned(3), -edge)
    square = (edge ** 2).sum(axis=1)
    shorter = np.minimum(along, across) / np.sqrt(square)
    best = np.lexsort((shorter, along * across / square))[0]
    return longest, float(shorter[best])


def row_hull(ys: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Convex hull of pixels given by their row extremes."""
    return hull(np.unique(np.concatenate([np.stack([ys, left], 1), np.stack([ys, right], 1)]), axis=0))


def ferets(runs: DataFrame, slab: int = SLAB) -> DataFrame:
    """(image_id, label, feret_max_px, feret_min_px); NULL for one-pixel pores.

    Only the leftmost and rightmost pixel of each row can be a hull corner. Slabs of rows make partial hulls, which are small whatever
    the size of the pore; the hull of a pore is the hull of its slabs' corners.
    """
    points = "array<struct<y:int,x:int>>"

    @F.pandas_udf(points)
    def partial(ys: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([[{"y": int(y), "x": int(x)} for y, x in row_hull(*each)] if len(each[0]) else [] for each in zip(ys, left, right)])

    @F.pandas_udf("longest double, shortest double")
    def measure(ys: pd.Series, xs: pd.Series) -> pd.DataFrame:
        rings = (hull(np.unique(np.stack(each, 1), axis=0)) for each in zip(ys, xs))
        return pd.DataFrame([calipers(ring) for ring in rings], columns=["longest", "shortest"])

    extremes = runs.groupBy(*ROW).agg(F.min("x0").alias("lo"), (F.max("x1") - 1).alias("hi"))
    slabs = extremes.groupBy(*PORE, F.floor(F.col("y") / slab).alias("slab")).agg(F.collect_list(F.struct("y", "lo", "hi")).alias("e"))
    tall = F.size("e") > FEW_ROWS
    column = lambda c: F.when(tall, F.col(f"e.{c}")).otherwise(F.array().cast("array<int>"))
    ends = F.concat(*[F.transform("e", lambda r: F.struct(r["y"].alias("y"), r[c].alias("x"))) for c in ("lo", "hi")])
    corners = slabs.select(*PORE, F.when(tall, partial(column("y"), column("lo"), column("hi"))).otherwise(ends).alias("p"))
    pores = corners.groupBy(*PORE).agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("p")).where(F.size("p") > 1)
    measured = pores.select(*PORE, measure("p.y", "p.x").alias("f"))
    return measured.select(*PORE, F.col("f.longest").alias("feret_max_px"), F.col("f.shortest").alias("feret_min_px"))


# Images of one band: the pores of several images are measured in one grouped Arrow step.

MOMENTS = [f"m{i}{j}" for i, j in POWERS]
FACTS = {
    "sums": "height int, width int, area_px bigint, twice_sum_x bigint, sum_y bigint, bbox_x0 int, bbox_y0 int, bbox_x1 int, bbox_y1 int",
    "steps": "straight bigint, slanted bigint",
    "moments": "ox int, oy int, " + ", ".join(f"{m} double" for m in MOMENTS),
    "ferets": "feret_max_px double, feret_min_px double",
}


def _in_bundles(runs: DataFrame, step: Callable[[pa.Table], pa.Table], schema: str, band_pixels: int | None) -> DataFrame:
    grouped = runs.select("image_id", "label", "y", "x0", "x1", *FRAME, bundle(band_pixels).alias("_bundle")).groupBy(*FRAME, "_bundle")
    kind = runs.schema["label"].dataType.simpleString()
    return grouped.applyInArrow(lambda key, table: step(table), f"image_id bigint, label {kind}, {schema}")


def _sorted_runs(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image_id, label, height and width of every pore; first run of every pore; pore, y, x0, x1 of the runs in order)."""
    image, label, y, x0, x1 = (table.column(c).to_numpy() for c in ("image_id", "label", "y", "x0", "x1"))
    order = np.lexsort((x0, y, label, image))
    image, label = image[order], label[order]
    y, x0, x1 = (v[order].astype(np.int64) for v in (y, x0, x1))
    new = np.append(True, (image[1:] != image[:-1]) | (label[1:] != label[:-1]))
    head = np.flatnonzero(new)
    return table.select([*PORE, *FRAME]).take(pa.array(order[head])), head, np.cumsum(new) - 1, y, x0, x1


def without_holes(pore: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted runs with enclosed background filled, pore by pore; the same gaps as in ``filled_rows``."""
    new = np.append(True, (pore[1:] != pore[:-1]) | (y[1:] != y[:-1]))
    gap = np.flatnonzero(~new)  # gaps are numbered by the run behind them
    if len(gap):
        heads = np.flatnonzero(new)
        first, last = x0[heads], x1[np.append(heads[1:], len(y)) - 1]
        row, g0, g1 = (np.cumsum(new) - 1)[gap], x1[gap - 1], x0[gap]
        leak = np.zeros(len(gap), bool)
        for step in (-1, 1):
            near = (row + step).clip(0, len(heads) - 1)
            leak |= (pore[heads[near]] != pore[gap]) | (y[heads[near]] != y[gap] + step) | (first[near] > g0) | (last[near] < g1)
        root = smallest_reachable(len(gap), *touching_runs(pore[gap], y[gap], g0, g1, 0))
        leaks = np.zeros(len(gap), bool)
        leaks[root[leak]] = True
        new[gap] = leaks[root]
    start = np.flatnonzero(new)
    return pore[start], y[start], x0[start], x1[np.append(start[1:], len(y)) - 1]


def step_counts(pores: int, pore: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(straight, slanted) of every pore, from the pairs of runs on neighbouring rows that overlap or touch at a corner."""
    i, j = touching_runs(pore, y, x0, x1, 1)
    shared = np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j])
    over = shared > 0
    count = lambda at, n: np.bincount(at, n, pores).astype(np.int64)
    three = count(pore[i], np.where(over, (x0[i] != x0[j]).astype(np.int64) + (x1[i] != x1[j]), 0))
    straight = count(pore, 2 * (x1 - x0 - 1)) + count(pore[i], np.where(over, 2 * shared - 4 * (shared - 1), 0)) - 2 * three
    return straight, three + 2 * count(pore[i], ~over)


def points_of_runs(pore: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pore, y, x, visits) of the outline pixels of filled pores, as in ``outline_points``; some pores at a time.

    Every pore is drawn in a box of its own with an empty frame; boxes of about BAND_PIXELS cells are laid end to end.
    """
    head = np.flatnonzero(np.append(True, pore[1:] != pore[:-1]))
    tail = np.append(head[1:], len(pore))
    top, left = y[head], np.minimum.reduceat(x0, head)
    stride = np.maximum.reduceat(x1, head) - left + 2
    cells = (y[tail - 1] - top + 3) * stride
    part = (np.cumsum(cells) - cells) // BAND_PIXELS
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(head))):
        mine = slice(head[lo], tail[hi - 1])
        box = np.repeat(np.arange(lo, hi), (tail - head)[lo:hi])
        base = np.append(0, np.cumsum(cells[lo:hi]))
        n = x1[mine] - x0[mine]
        first = base[box - lo] + (y[mine] - top[box] + 1) * stride[box] + x0[mine] - left[box] + 1
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, s = np.repeat(first, n) + within, np.repeat(stride[box], n)
        bits = np.zeros(base[-1], bool)
        bits[at] = True
        beside, ends, near = {}, np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        for sy in (-1, 0, 1):
            for sx in (-1, 0, 1):
                beside[sy, sx] = bits[at + sy * s + sx]
                if sy or sx:
                    near |= beside[sy, sx]
        for sy in (-1, 1):
            for sx in (-1, 1):
                h, v = beside[0, sx], beside[sy, 0]
                ends += (h != v) + 2 * (~h & ~v & beside[sy, sx])
        ends[~near] = 2
        seen = np.flatnonzero(ends)
        yield np.repeat(pore[mine], n)[seen], np.repeat(y[mine], n)[seen], (np.repeat(x0[mine], n) + within)[seen], ends[seen] // 2


def moments_of(pores: int, points: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """``outline_moments`` of every pore: sums of visits * x^i * y^j around the tiles' centres, moved to the pore's origin."""
    keys, sums = [], []
    for pore, y, x, visits in points:
        tx, ty = x // TILE, y // TILE
        order = np.lexsort((ty, tx, pore))
        pore, tx, ty = pore[order], tx[order], ty[order]
        u, v, w = (a[order].astype(float) for a in (x - x // TILE * TILE - TILE // 2, y - y // TILE * TILE - TILE // 2, visits))
        head = np.flatnonzero(np.append(True, (pore[1:] != pore[:-1]) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])))
        keys.append((pore[head], tx[head], ty[head]))
        sums.append([np.add.reduceat(w * u ** i * v ** j, head) for i, j in POWERS])
    pore, tx, ty = (np.concatenate(c) for c in zip(*keys))
    tile = {p: np.concatenate(c) for p, c in zip(POWERS, zip(*sums))}
    first, count = np.searchsorted(pore, np.arange(pores)), np.bincount(pore, minlength=pores)
    ox, oy = np.minimum.reduceat(tx, first), np.minimum.reduceat(ty, first)
    several = np.flatnonzero(count > 1)
    moved = {p: np.where(count > 1, 0.0, m[first]) for p, m in tile.items()}
    for k in range(count.max()):
        mine = several[count[several] > k]
        at = first[mine] + k
        dx, dy = (tx[at] - ox[mine]) * float(TILE), (ty[at] - oy[mine]) * float(TILE)
        for i, j in POWERS if len(mine) else ():
            for a in range(i + 1):
                for b in range(j + 1):
                    term = comb(i, a) * comb(j, b) * tile[a, b][at]
                    for shift in [dx] * (i - a) + [dy] * (j - b):
                        term = term * shift
                    moved[i, j][mine] += term
    short = lambda o: (o * TILE + TILE // 2).astype(np.int32)
    return {"ox": short(ox), "oy": short(oy)} | {f"m{i}{j}": moved[i, j] for i, j in POWERS}


@lru_cache(maxsize=1 << 16)
def _shape_ferets(rows: int, shape: bytes) -> tuple[float, float]:
    return calipers(row_hull(*np.frombuffer(shape, np.int32).reshape(3, rows).astype(np.int64)))


def shape_ferets(pore: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest, shorter side) of every pore by the extremes of its rows; NaN for one pixel.

    Small pores have few different shapes: one that was measured before, wherever it lay, is not measured again.
    """
    head = np.flatnonzero(np.append(True, pore[1:] != pore[:-1]))
    rows = np.diff(np.append(head, len(pore)))
    left = np.repeat(np.minimum.reduceat(lo, head), rows)
    lines = np.stack([y - np.repeat(y[head], rows), lo - left, hi - left]).astype(np.int32)
    found = np.full((len(head), 2), np.nan)
    for count in np.unique(rows):
        mine = np.flatnonzero(rows == count)
        shapes = np.ascontiguousarray(lines[:, head[mine][:, None] + np.arange(count)].transpose(1, 0, 2).reshape(len(mine), 3 * count))
        kinds, which = np.unique(shapes.view(f"V{shapes.itemsize * shapes.shape[1]}").ravel(), return_inverse=True)
        known = [(np.nan, np.nan) if count == 1 and not any(k.tobytes()) else _shape_ferets(int(count), k.tobytes()) for k in kinds]
        found[mine] = np.array(known)[which]
    return found[:, 0], found[:, 1]


def _facts(table: pa.Table, want: tuple[str, ...]) -> pa.Table:
    """The wanted columns of FACTS for the pores of several small images."""
    pores, head, pore, y, x0, x1 = _sorted_runs(table)
    tail = np.append(head[1:], len(y)) - 1
    out = {c: pores.column(c) for c in PORE}
    if "sums" in want:
        n = x1 - x0
        whole = lambda values: np.add.reduceat(values, head)
        short = lambda values: pa.array(values.astype(np.int32))
        out |= {c: pores.column(c) for c in FRAME}
        out |= {"area_px": whole(n), "twice_sum_x": whole((x0 + x1 - 1) * n), "sum_y": whole(y * n),
                "bbox_x0": short(np.minimum.reduceat(x0, head)), "bbox_y0": short(y[head]),
                "bbox_x1": short(np.maximum.reduceat(x1, head)), "bbox_y1": short(y[tail] + 1)}
    if "steps" in want or "moments" in want:
        filled = without_holes(pore, y, x0, x1)
        if "steps" in want:
            out["straight"], out["slanted"] = step_counts(len(head), *filled)
        if "moments" in want:
            out |= moments_of(len(head), points_of_runs(*filled))
    if "ferets" in want:
        row = np.flatnonzero(np.append(True, (pore[1:] != pore[:-1]) | (y[1:] != y[:-1])))
        longest, shortest = shape_ferets(pore[row], y[row], x0[row], x1[np.append(row[1:], len(y)) - 1] - 1)
        none = np.isnan(longest)
        out |= {"feret_max_px": pa.array(longest, mask=none), "feret_min_px": pa.array(shortest, mask=none)}
    return pa.table(out)


def pore_facts(runs: DataFrame, want: list[str], band_pixels: int | None = None) -> DataFrame:
    """Columns of FACTS for the pores of images of one band, from their label runs."""
    wanted = tuple(k for k in FACTS if k in want)
    return _in_bundles(runs, lambda table: _facts(table, wanted), ", ".join(FACTS[k] for k in wanted), band_pixels)


def pore_steps(runs: DataFrame, band_pixels: int | None = None) -> DataFrame:
    """``outline_steps`` of the filled pores of written label runs."""
    return by_size(runs, lambda r: pore_facts(r, ["steps"], band_pixels), lambda r: outline_steps(materialize(filled_rows(r))), band_pixels)


def pore_moments(runs: DataFrame, band_pixels: int | None = None) -> DataFrame:
    """``outline_moments`` of the filled pores of written label runs."""
    return by_size(runs, lambda r: pore_facts(r, ["moments"], band_pixels),
                   lambda r: outline_moments(outline_points(materialize(filled_rows(r)))), band_pixels)


def pore_points(runs: DataFrame, band_pixels: int | None = None) -> DataFrame:
    """``outline_points`` of the filled pores of written label runs."""
    def step(table: pa.Table) -> pa.Table:
        pores, _, *sorted_runs = _sorted_runs(table)
        pore, y, x, visits = (np.concatenate(c) for c in zip(*points_of_runs(*without_holes(*sorted_runs))))
        keys = pores.select(PORE).take(pa.array(pore))
        return keys.append_column("y", pa.array(y.astype(np.int32))).append_column("x", pa.array(x.astype(np.int32))).append_column("visits", pa.array(visits))

    return by_size(runs, lambda r: _in_bundles(r, step, "y int, x int, visits bigint", band_pixels),
                   lambda r: outline_points(materialize(filled_rows(r))), band_pixels)


def pore_ferets(runs: DataFrame, band_pixels: int | None = None) -> DataFrame:
    """``ferets`` of written label runs."""
    return by_size(runs, lambda r: pore_facts(r, ["ferets"], band_pixels).where("feret_max_px is not null"), ferets, band_pixels)


def eq_diameter(area: Column) -> Column:
    return F.sqrt(4.0 * area / F.lit(pi))


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P^2, NaN without a perimeter."""
    return F.when(perimeter > 0, 4.0 * F.lit(pi) * area / (perimeter * perimeter)).otherwise(F.lit(float("nan")))


def aspect_ratio(major: Column, minor: Column) -> Column:
    return F.when((major != 0) & (minor > 0), major / minor)


def scaled(pores: DataFrame, scales: DataFrame | None) -> DataFrame:
    """Adds the unit columns; images without a scale keep NULLs, a scale that is not positive scales nothing."""
    if scales is None:
        pores = pores.withColumn("units_per_px", F.lit(None).cast("double")).withColumn("unit_name", F.lit(None).cast("string"))
    else:
        per_image = scales.select("image_id", F.col("units_per_px").try_cast("double").alias("units_per_px"),
                                  F.coalesce("unit_name", F.lit("")).alias("unit_name"))
        pores = attach(pores, materialize(per_image), ["image_id"], "left", spread="label")
    u = F.col("units_per_px")
    pores = pores.withColumn("area_units2", F.when(u > 0, F.col("area_px") * (u * u)))
    pores = pores.withColumn("eq_diam_units", F.when(u > 0, F.col("eq_diam_px") * u))
    for name in ("major_axis", "minor_axis", "feret_max", "feret_min"):
        px = F.col(f"{name}_px")
        pores = pores.withColumn(f"{name}_units", F.when((u > 0) & (px != 0), px * u))
    return pores


def measure(runs: DataFrame, scales: DataFrame | None = None, band_pixels: int | None = None) -> DataFrame:
    """The pore table: one row per (image, label) with every measurement."""
    shape = [*PORE, "area_px", "centroid_x", "centroid_y", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1", "touches_border", "perimeter_px", "feret_max_px", "feret_min_px"]

    def small(runs: DataFrame) -> DataFrame:
        facts = pore_facts(runs, list(FACTS), band_pixels)
        length = (F.col("straight") + F.lit(sqrt(2)) * F.col("slanted")).alias("perimeter_px")
        return axes(facts.select(*PORE, *_from_sums(), length, "feret_max_px", "feret_min_px", *MOMENTS), shape)

    def tall(runs: DataFrame) -> DataFrame:
        filled = materialize(filled_rows(runs))
        pores = basic_measures(runs)
        pores = pores.join(perimeters(outline_steps(filled)), PORE, "left")
        pores = pores.join(axes(outline_moments(outline_points(filled))), PORE, "left")
        return pores.join(ferets(runs), PORE, "left")

    pores = by_size(written(runs), small, tall, band_pixels)
    pores = (
        pores.withColumn("eq_diam_px", eq_diameter(F.col("area_px")))
        .withColumn("circularity", circularity(F.col("area_px"), F.col("perimeter_px")))
        .withColumn("aspect_ratio", aspect_ratio(F.col("major_axis_px"), F.col("minor_axis_px"))))
    pores = scaled(pores, scales).withColumnRenamed("image_id", "image_index")
    return pores.select(*[F.col(c).cast(t).alias(c) for c, t in PORE_COLUMNS.items()])
