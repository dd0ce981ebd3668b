import heapq
import math

import numpy as np
import pytest
from conftest import arrays, bits, brute_components, disk, label_arrays, noise

from poremetry import workspace
from poremetry.operators import components as cc, measure, separate
from poremetry.operators.separate import SeparationParams

SHAPE = (100, 100)


def brute_distance(image):
    by, bx = np.nonzero(~image)
    out = np.zeros(image.shape, dtype=int)
    for y, x in zip(*np.nonzero(image)):
        out[y, x] = ((by - y) ** 2 + (bx - x) ** 2).min() if len(by) else sum(image.shape) ** 2
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_distance_is_exact(mask, block):
    images = {0: noise(1, (20, 23), 0.8), 1: disk(SHAPE, 50, 50, 20), 2: np.ones((4, 6), bool), 3: np.zeros((3, 4), bool)}
    found = arrays(separate.distance_squared(mask(images), block), "d2")
    assert all((found[i] == brute_distance(a)).all() for i, a in images.items())


def test_nearest_in_columns_of_any_reach():
    rng = np.random.default_rng(3)
    far = separate.FAR ** 2
    for height, share in ((1, 0.5), (2, 0.5), (40, 0.9), (300, 0.002)):
        start = np.where(rng.random((height, 30)) < share, rng.integers(0, 50, (height, 30)) ** 2, far)
        y = np.arange(height)
        best = np.array([(start + ((y - k) ** 2)[:, None]).min(axis=0) for k in y])
        assert (separate.nearest_in_columns(start) == best).all()


def brute_flood(cost, seed):
    """Best-first flood with keys (level, steps since the level rose, label)."""
    best, heap = {}, [(int(cost[p]), 0, int(seed[p]), p) for p in zip(*np.nonzero(seed))]
    heapq.heapify(heap)
    while heap:
        level, steps, label, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = (level, steps, label)
        for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            q = (p[0] + a, p[1] + b)
            if 0 <= q[0] < cost.shape[0] and 0 <= q[1] < cost.shape[1] and q not in best:
                c = int(cost[q])
                heapq.heappush(heap, (c, 1, label, q) if c > level else (level, steps + 1, label, q))
    return best


@pytest.mark.parametrize("band_pixels", [None, 50])
def test_flood_matches_best_first_search(spark, band_pixels):
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for i, shape in enumerate([(18, 14), (25, 9), (6, 30)]):
        cost = np.repeat(np.repeat(rng.integers(0, 6, (shape[0] // 2 + 1, shape[1] // 2 + 1)), 2, 0), 2, 1)[:shape[0], :shape[1]]
        seed = np.zeros(shape, dtype=int)
        for label in range(1, 6):
            seed[rng.integers(shape[0]), rng.integers(shape[1])] = label
        expected[i] = brute_flood(cost, seed)
        rows += [(i, *shape, y, cost[y].tolist(), seed[y].tolist()) for y in range(shape[0])]
    frame = spark.createDataFrame(rows, "image_id bigint, height int, width int, y int, cost array<int>, seed array<int>")
    for r in separate.flood(frame, band_pixels).collect():
        for x, key in enumerate(r.key):
            assert (key >> 55, (key >> 31) % (1 << 24), key % (1 << 31)) == expected[r.image_id][r.y, x]


def test_flood_over_many_bands_writes_only_what_changes(spark, monkeypatch):
    """A winding corridor takes the flood through 16 bands one by one; a second image is done in the first rounds. Joins are sliced."""
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", 0)
    wall, shape = 200, (32, 21)
    cost = np.full(shape, wall)
    cost[::2, :] = 1  # rows of low cost, joined at alternating ends
    cost[1::4, -1] = cost[3::4, 0] = 1
    seed = np.zeros(shape, dtype=int)
    seed[0, 0], seed[9, 10] = 3, 8
    cost[9:], seed[11::2, 4] = 3, np.arange(10, 21)
    easy = np.random.default_rng(5).integers(0, 3, shape)
    spots = (np.arange(shape[0])[:, None] % 4 == 1) & (np.arange(shape[1]) % 5 == 2)
    images = {0: (cost, seed), 1: (easy, np.where(spots, np.arange(1, spots.size + 1).reshape(shape), 0))}
    rows = [(i, *shape, y, c[y].tolist(), s[y].tolist()) for i, (c, s) in images.items() for y in range(shape[0])]
    frame = spark.createDataFrame(rows, "image_id bigint, height int, width int, y int, cost array<int>, seed array<int>")
    written, real = [], separate.materialize

    def counted(df, **metrics):
        out = real(df, **metrics)
        if "tall" in metrics:
            written.append((out.metrics["rows"], {r.image_id for r in out.select("image_id").distinct().collect()}))
        return out

    monkeypatch.setattr(separate, "materialize", counted)
    found = {(r.image_id, r.y): r.key for r in separate.flood(frame, 2 * shape[1]).collect()}
    assert len(found) == len(rows)
    for i, (c, s) in images.items():
        best = brute_flood(c, s)
        for (y, x), key in best.items():
            k = found[i, y][x]
            assert (k >> 55, (k >> 31) % (1 << 24), k % (1 << 31)) == key
    assert written[0] == (64, {0, 1}) and len(written) > 5
    assert all(n <= 4 for n, _ in written[5:]) and written[-1][1] == {0}


def test_two_disks_are_split_and_one_is_not(mask):
    images = {0: disk(SHAPE, 35, 50, 20) | disk(SHAPE, 65, 50, 20), 1: disk(SHAPE, 50, 50, 20), 2: np.zeros(SHAPE, bool)}
    rows = separate.watershed(mask(images), SeparationParams())
    found = label_arrays(rows, {i: a.shape for i, a in images.items()})
    assert set(np.unique(found[0])) == {0, 1, 2} and set(np.unique(found[1])) == {0, 1} and not found[2].any()
    one, two = (found[0] == 1), (found[0] == 2)
    assert not (one[:, 1:] & two[:, :-1]).any() and not (one[:, :-1] & two[:, 1:]).any()
    assert not (one[1:] & two[:-1]).any() and not (one[:-1] & two[1:]).any()
    whole = label_arrays(separate.watershed(mask(images), lines=False, frame=False, band_pixels=700), {i: a.shape for i, a in images.items()})
    assert ((whole[0] > 0) == images[0]).all() and ((whole[0] == found[0]) | (found[0] == 0)).all()


def test_relabel(labelled):
    image = np.zeros((50, 50), dtype=int)
    image[5:25, 5:25], image[30:40, 30:40], image[45:47, 45:47], image[0:9, 30:39] = 5, 10, 2, 7
    found = label_arrays(separate.relabel(labelled({0: image}), 50, True), {0: image.shape})[0]
    assert (found == np.where(image == 5, 1, np.where(image == 10, 2, 0))).all()


def test_unknown_settings():
    with pytest.raises(ValueError):
        SeparationParams(method="cut")


def outline(image):
    """(perimeter, outline points) by walking every outer border."""
    filled = brute_components(~np.pad(image, 1), 4) != 1
    length, points = 0.0, []
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    parts = brute_components(filled, 8)
    for n in range(1, parts.max() + 1):
        part = np.pad(parts == n, 1)
        start = tuple(np.argwhere(part)[0])
        here, back, first = start, 4, None
        while True:
            for k in range(1, 9):
                d = (back + k) % 8
                nxt = (here[0] + around[d][0], here[1] + around[d][1])
                if part[nxt]:
                    break
            else:
                points.append((here[1] - 2, here[0] - 2))
                break
            if first == (here, d):
                break
            first = first or (here, d)
            points.append((here[1] - 2, here[0] - 2))
            length += math.hypot(*around[d])
            here, back = nxt, (d + 4) % 8
    return length, points


def test_measures_match_a_border_walk(mask):
    images = {i: noise(20 + i, (24, 28), 0.25 + 0.15 * i) for i in range(3)}
    images[3] = disk(SHAPE, 50, 50, 30) & ~disk(SHAPE, 50, 50, 10) | disk(SHAPE, 50, 50, 4)
    runs = cc.components(mask(images), 8)
    found = {(r.image_index, r.label): r for r in measure.measure(runs).collect()}
    visits = {}
    for r in measure.outline_points(measure.filled_rows(runs)).collect():
        visits.setdefault((r.image_id, r.label), []).extend([(r.x, r.y)] * r.visits)
    count = 0
    for i, image in images.items():
        labels = brute_components(image, 8)
        for n in range(1, labels.max() + 1):
            part, r = labels == n, found[i, n]
            ys, xs = np.nonzero(part)
            length, points = outline(part)
            assert r.area_px == part.sum() and r.centroid_x == pytest.approx(xs.mean()) and r.centroid_y == pytest.approx(ys.mean())
            assert (r.bbox_x0, r.bbox_y0, r.bbox_x1, r.bbox_y1) == (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)
            assert r.perimeter_px == pytest.approx(length)
            assert sorted(visits[i, n]) == sorted(points)
            assert math.isnan(r.circularity) == (part.sum() == 1)
            p = np.array(sorted(set(points)))
            if len(points) == 1:
                assert r.feret_max_px is None and r.major_axis_px is None and r.aspect_ratio is None
            else:
                far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)).max()
                assert r.feret_max_px == pytest.approx(far) and r.feret_min_px <= r.feret_max_px + 1e-9
            if 2 <= len(points) <= 4:
                values = np.linalg.eigvalsh(np.cov(np.array(points).T, bias=True))
                assert r.major_axis_px == pytest.approx(4 * math.sqrt(values[1])) and r.minor_axis_px == pytest.approx(4 * math.sqrt(max(values[0], 0)), abs=1e-6)
            count += 1
    assert count == len(found)


def test_disk_and_scale(spark, labelled):
    scales = spark.createDataFrame([(0, 0.01, "mm"), (1, 0.0, None), (2, -1.0, "um")], "image_id bigint, units_per_px double, unit_name string")
    d = disk(SHAPE, 50, 50, 20).astype(int)
    found = {r.image_index: r for r in measure.measure(labelled({i: d for i in range(4)}), scales).collect()}
    r = found[0]
    assert 1200 < r.area_px < 1300 and abs(r.centroid_x - 50) < 1 and 0.9 < r.circularity <= 1 and 38 < r.eq_diam_px < 42
    assert r.area_units2 == pytest.approx(r.area_px * 1e-4) and r.unit_name == "mm" and r.feret_max_px == pytest.approx(40)
    assert r.major_axis_px == pytest.approx(r.minor_axis_px) and r.major_axis_px == pytest.approx(39.5, abs=0.7)
    assert found[1].area_units2 is None and found[1].unit_name == "" and found[1].units_per_px == 0
    assert found[2].area_units2 is None and found[3].units_per_px is None and found[3].unit_name is None
    assert list(measure.PORE_COLUMNS) == measure.measure(labelled({0: d})).columns


def test_lines_points_and_tilted_ellipse(labelled):
    line = np.zeros((50, 100), dtype=int)
    line[25, 10:90] = 1
    point = np.zeros((50, 50), dtype=int)
    point[10, 10] = 1
    y, x = np.mgrid[:400, :700]
    u, v = (x - 350) * math.cos(0.5) + (y - 200) * math.sin(0.5), -(x - 350) * math.sin(0.5) + (y - 200) * math.cos(0.5)
    tilted = ((u / 280) ** 2 + (v / 60) ** 2 <= 1).astype(int)
    found = {r.image_index: r for r in measure.measure(labelled({0: line, 1: point, 2: tilted})).collect()}
    assert found[0].area_px == 80 and found[0].circularity < 0.5 and found[0].feret_max_px == 79 and found[0].feret_min_px == 0
    assert found[1].area_px == 1 and found[1].perimeter_px == 0 and found[1].feret_min_px is None
    r = found[2]
    assert r.major_axis_px == pytest.approx(560, abs=2) and r.minor_axis_px == pytest.approx(120, abs=2)
    assert r.orientation_deg == pytest.approx(math.degrees(0.5), abs=0.5) and r.aspect_ratio == pytest.approx(560 / 120, abs=0.1)
    assert r.feret_min_px == pytest.approx(119, abs=3)


def test_label_in_two_pieces(labelled):
    image = np.zeros((20, 20), dtype=int)
    image[2:6, 2:6] = image[10:14, 10:16] = 1
    r = measure.measure(labelled({0: image})).first()
    assert r.area_px == 40 and r.perimeter_px == pytest.approx(12 + 16) and (r.bbox_x0, r.bbox_x1) == (2, 16)


def test_fallback_to_components(mask):
    images = {0: disk((30, 30), 8, 8, 4) | disk((30, 30), 22, 22, 4), 1: disk((30, 30), 15, 15, 6)}
    marked = cc.components(mask({1: images[1]}), 8)
    found = label_arrays(separate.markers_or_components(marked, mask(images)), {i: a.shape for i, a in images.items()})
    assert found[0].max() == 2 and found[1].max() == 1


def test_empty_labels(spark, labelled):
    assert measure.measure(labelled({0: np.zeros((5, 5), dtype=int)})).count() == 0
    assert bits(spark.createDataFrame([], "image_id bigint, height int, width int, y int, runs array<struct<x0:int,x1:int>>")) == {}


def test_ferets_of_any_slab_height(labelled):
    """Hulls merged from slabs of a few rows give what all pairs of pixels and all hull edges give."""
    rng = np.random.default_rng(6)
    tall = np.zeros((150, 40), int)
    tall[disk((150, 40), 75, 20, 19)] = 1
    tall[np.arange(150), rng.integers(0, 5, 150)] = 2
    tall[5:9, 33:38] = 3
    tall[140, 39] = 4
    tall[120:140:2, 36] = 5
    expected = {}
    for label in range(1, 6):
        pts = np.argwhere(tall == label)
        if len(pts) < 2:
            continue
        apart = ((pts[:, None] - pts[None]) ** 2).sum(-1)
        best = min(((np.ptp(pts @ e) * np.ptp(pts @ n) / (e @ e), min(np.ptp(pts @ e), np.ptp(pts @ n)) / math.sqrt(e @ e))
                    for e, n in _edges(pts)))
        expected[label] = (math.sqrt(apart.max()), best[1])
    for slab in (7, measure.SLAB):
        found = {r.label: (r.feret_max_px, r.feret_min_px) for r in measure.ferets(labelled({0: tall}), slab).collect()}
        assert found.keys() == expected.keys()
        np.testing.assert_allclose([found[k] for k in sorted(found)], [expected[k] for k in sorted(expected)], rtol=1e-12)


def _edges(pts):
    """Edges of the hull and their normals: differences of points with all points on one side."""
    outer = np.array([p for y in np.unique(pts[:, 0]) for p in {(y, pts[pts[:, 0] == y, 1].min()), (y, pts[pts[:, 0] == y, 1].max())}])
    for a in outer:
        for b in outer:
            e = b - a
            n = np.array([-e[1], e[0]])
            if e.any() and ((pts - a) @ n >= 0).all():
                yield e, n


@pytest.mark.parametrize("seed", [1])
def test_pores_of_small_images_are_measured_like_those_of_tall_ones(mask, seed):
    ring = np.zeros((30, 300), bool)
    ring[3:27, 4:290] = True
    ring[6:20, 8:280] = False
    ring[10:14, 100:200] = True  # a pore inside the hole of another
    ring[16, 30:33] = ring[17, 33:36] = True
    images = {i: noise(seed * 10 + i, (14, 19), 0.35 + 0.1 * i) for i in range(4)} | {7: ring, 9: np.zeros((4, 5), bool)}
    runs = workspace.materialize(cc.components(mask(images), 8))
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    for find in (measure.pore_steps, measure.pore_moments, measure.pore_ferets, measure.pore_points):
        small, tall = find(runs), find(runs, band_pixels=1)
        assert small.columns == tall.columns and rows(small) == rows(tall), find.__name__
    small, tall = measure.measure(runs), measure.measure(runs, band_pixels=1)
    assert small.schema == tall.schema and rows(small) == rows(tall)
    assert "Join" not in small._jdf.queryExecution().optimizedPlan().toString()  # one grouped step makes all measures of small images


def test_small_images_are_separated_like_tall_ones(mask):
    images = {i: noise(50 + i, (9, 13), 0.6 + 0.1 * i) for i in range(3)} | {5: disk((30, 40), 15, 12, 9) | disk((30, 40), 15, 26, 8), 6: np.ones((30, 40), bool),
                                                                            8: np.zeros((30, 40), bool), 9: noise(60, (1, 13), 0.7)}
    rows = workspace.materialize(mask(images))
    found = lambda df: sorted(map(tuple, df.select("image_id", "y", "x0", "x1", "label").collect()))
    smooth = SeparationParams(peak_min_distance=4)
    assert found(separate.marker_runs(rows, smooth)) == found(separate.marker_runs(rows, smooth, band_pixels=1))
    for params, lines in ((smooth, True), (SeparationParams(distance_blur_k=0, peak_min_distance=3, peak_rel_threshold=0.0, connectivity=4), False)):
        small, tall = (separate.watershed(rows, params, lines, lines, pixels) for pixels in (None, 400))
        assert small.columns == tall.columns and found(small) == found(tall)
    assert "Window" not in small._jdf.queryExecution().optimizedPlan().toString()  # one grouped step, no row meets its neighbours by a shuffle


def test_axes_of_few_points_need_no_fit(mask):
    """labels of small images are written once, their moments come whole from the grouped step, and outlines of at most four points are not fitted."""
    images = {i: noise(70 + i, (14, 19), 0.2 + 0.1 * i) for i in range(4)} | {5: np.zeros((4, 5), bool), 6: noise(80, (3, 700), 0.8)}
    runs = cc.components(mask(images), 8)
    assert workspace.written(runs) is runs and workspace.row_count(runs) == runs.count()
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    found = measure.pore_moments(runs)
    assert rows(found) == rows(measure.pore_moments(runs, band_pixels=1))
    few = found.where("m00 <= 4")
    assert few.count() > 20 and rows(measure.axes(few, fit=False)) == rows(measure.axes(few))
    plan = measure.axes(few, fit=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "aggregate(" not in plan
