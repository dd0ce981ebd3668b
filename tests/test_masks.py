import numpy as np
import pytest
from conftest import bits, brute_components, disk, label_arrays, noise
from pyspark.sql import functions as F

from poremetry import workspace
from poremetry.operators import components as cc, edits, geometry, masks

SHAPE = (100, 100)


def shapes(images):
    return {i: a.shape for i, a in images.items()}


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("band_pixels", [None, 40, 7])
def test_components_match_search(mask, connectivity, band_pixels):
    images = {i: noise(i, (23, 19 + i), 0.35 + 0.1 * i) for i in range(4)}
    images[9] = np.zeros((5, 5), dtype=bool)
    snake = np.zeros((21, 21), dtype=bool)
    snake[::2] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True
    images[10] = snake
    found = label_arrays(cc.components(mask(images), connectivity, band_pixels), shapes(images))
    for i, image in images.items():
        assert (found[i] == brute_components(image, connectivity)).all()


@pytest.mark.parametrize("band_pixels", [None, 60])
def test_fill_holes_matches_flood(mask, band_pixels):
    images = {0: noise(1, (30, 34), 0.6), 1: disk(SHAPE, 50, 50, 30) & ~disk(SHAPE, 50, 50, 10), 2: disk(SHAPE, 50, 50, 20), 3: np.zeros((3, 3), bool)}
    found = bits(masks.fill_holes(mask(images), band_pixels))
    for i, image in images.items():
        ground = brute_components(~np.pad(image, 1), 4)
        assert (found[i] == (ground != 1)[1:-1, 1:-1]).all()
    assert (found[1] == disk(SHAPE, 50, 50, 30)).all()


def test_remove_small_and_diagonal(mask):
    diagonal = np.zeros((10, 10), dtype=bool)
    diagonal[[3, 4, 5], [3, 4, 5]] = True
    two = disk(SHAPE, 30, 30, 20) | disk(SHAPE, 80, 80, 3)
    assert (bits(masks.remove_small(mask({0: two}), 50))[0] == disk(SHAPE, 30, 30, 20)).all()
    assert not bits(masks.remove_small(mask({0: diagonal}), 2, 4))[0].any()
    assert (bits(masks.remove_small(mask({0: diagonal}), 2, 8))[0] == diagonal).all()
    same = mask({0: diagonal})
    assert masks.remove_small(same, 1) is same


def test_clear_border(mask):
    both = disk(SHAPE, 50, 50, 15) | disk(SHAPE, 0, 50, 10)
    assert (bits(masks.clear_border(mask({0: both})))[0] == disk(SHAPE, 50, 50, 15)).all()


def test_clean_equals_two_steps(mask):
    images = {i: noise(i, (25, 30), 0.4) for i in range(3)}
    once = bits(masks.clean(mask(images), 4, True))
    twice = bits(masks.clear_border(masks.remove_small(mask(images), 4)))
    assert all((once[i] == twice[i]).all() for i in images)


def test_islands_and_small_holes(mask):
    image = np.zeros((20, 20), dtype=bool)
    image[5:15, 5:15] = True
    image[9, 9] = False
    image[7:9, 11:14] = False
    image[0, 0] = image[18, 18] = True
    out = bits(masks.process_islands(mask({0: image}), 3, 4, 8, spare_border=True))[0]
    assert out[0, 0] and not out[18, 18] and out[9, 9] and not out[7, 11]
    assert not bits(masks.process_islands(mask({0: image}), 3, 0, 8))[0][0, 0]


def test_flood(spark, mask):
    ring = disk((40, 40), 20, 20, 12) & ~disk((40, 40), 20, 20, 6)
    seeds = spark.createDataFrame([(0, 20, 20)], "image_id bigint, x int, y int")
    assert (bits(masks.flood(mask({0: ring}), seeds, True))[0] == disk((40, 40), 20, 20, 12)).all()
    assert (bits(masks.flood(mask({0: ring}), seeds, False))[0] == ring).all()
    on_ring = spark.createDataFrame([(0, 29, 20)], "image_id bigint, x int, y int")
    assert not bits(masks.flood(mask({0: ring}), on_ring, False))[0].any()
    assert (bits(masks.flood(mask({0: ring}), on_ring, True))[0] == ring).all()


def box(image, r, fold):
    out = np.empty_like(image)
    for y, x in np.ndindex(image.shape):
        out[y, x] = fold(image[max(0, y - r):y + r + 1, max(0, x - r):x + r + 1])
    return out


def test_morphology(mask):
    images = {i: noise(i, (17, 21), 0.6) for i in range(2)}
    opened = {i: box(box(a, 1, np.all), 1, np.any) for i, a in images.items()}
    both = {i: box(box(a, 1, np.any), 1, np.all) for i, a in opened.items()}
    found, found_both = bits(masks.opened(mask(images), 3)), bits(masks.open_close(mask(images), 3))
    wide = bits(masks.dilate(mask(images), 5))
    for i, a in images.items():
        assert (found[i] == opened[i]).all() and (found_both[i] == both[i]).all() and (wide[i] == box(a, 2, np.any)).all()


@pytest.mark.parametrize("band_pixels", [None, 60])
def test_boxes_in_one_pass(mask, band_pixels):
    """Several boxes on bands with halos, on sizes next to the box, on empty and full rows: the same as one after the other on the whole frame."""
    images = {0: noise(8, (47, 9), 0.6), 1: noise(9, (47, 9), 0.1), 2: np.ones((5, 30), bool), 3: np.zeros((3, 2), bool), 4: noise(10, (1, 40), 0.5), 5: noise(11, (40, 1), 0.5)}

    def box(a, r, fold):
        return np.array([[fold(a[max(0, y - r):y + r + 1, max(0, x - r):x + r + 1]) for x in range(a.shape[1])] for y in range(a.shape[0])])

    steps = [(False, 3), (True, 5), (True, 3), (False, 7)]
    found = bits(masks._boxes(mask(images), steps, band_pixels))
    for i, a in images.items():
        for grow, k in steps:
            a = box(a, k // 2, np.any if grow else np.all)
        assert (found[i] == a).all(), i


def test_mask_from_labels(mask):
    images = {0: noise(3, (12, 15), 0.5), 1: np.zeros((4, 4), dtype=bool)}
    rows = mask(images)
    back = bits(masks.mask_from_labels(cc.components(rows, 4), rows))
    assert all((back[i] == images[i]).all() for i in images)


def stamp(image, x, y, r, paint):
    r = max(1, r)
    image[disk(image.shape, x, y, r)] = paint


def test_replay(spark, mask):
    base = noise(5, (30, 40), 0.3)
    rng = np.random.default_rng(2)
    log, kinds = [], ["paint", "erase", "paint_line", "erase_line"]
    for seq in range(30):
        x, y, x2, y2 = (int(v) for v in rng.integers(-3, 43, 4))
        log.append((0, seq, kinds[seq % 4] if seq != 11 else "reset", x, y, x2, y2, int(rng.integers(0, 5))))

    def replayed(until):
        image = base.copy()
        for _, seq, op, x, y, x2, y2, r in log[:until]:
            if op == "reset":
                image[:] = False
            elif op.endswith("line"):
                n = max(1, int(max(1.0, np.hypot(x2 - x, y2 - y)) / max(1, r // 2)))
                for px, py in zip(np.linspace(x, x2, n + 1, dtype=int), np.linspace(y, y2, n + 1, dtype=int)):
                    stamp(image, px, py, r, op.startswith("paint"))
            else:
                stamp(image, x, y, r, op == "paint")
        return image

    events = spark.createDataFrame(log, "image_id bigint, seq bigint, op string, x int, y int, x2 int, y2 int, radius int")
    assert (bits(edits.replay(mask({0: base}), events))[0] == replayed(30)).all()
    assert (bits(edits.replay(mask({0: base}), events, as_of_seq=8))[0] == replayed(9)).all()
    with pytest.raises(Exception, match="unknown edit operation: smear"):
        edits.replay(mask({0: base}), events.withColumn("op", F.lit("smear"))).collect()


def test_many_edits_of_one_spot(spark, mask):
    base = noise(7, (12, 70), 0.4)
    rng = np.random.default_rng(9)
    log = [(0, seq, ("paint", "erase")[int(rng.integers(2))], int(rng.integers(-4, 75)), int(rng.integers(3, 9)), int(rng.integers(0, 12))) for seq in range(400)]
    want = base.copy()
    for _, seq, op, x, y, r in log:
        stamp(want, x, y, r, op == "paint")
    events = spark.createDataFrame([(*e[:5], 0, 0, e[5]) for e in log] + [(9, 0, "paint", 1, 1, 0, 0, 2)],
                                   "image_id bigint, seq bigint, op string, x int, y int, x2 int, y2 int, radius int")
    after = edits.replay(mask({0: base, 1: base}), events)
    assert (bits(after)[0] == want).all() and (bits(after)[1] == base).all()
    for r in after.collect():
        assert all(a.x1 < b.x0 for a, b in zip(r.runs, r.runs[1:]))
    gathered = edits.decided_rows(edits.stamp_runs(edits.stamps(events), spark.createDataFrame([(0, 12, 70)], "image_id bigint, height int, width int"), width=True))
    assert max(len(r.decided) for r in gathered.collect()) <= 70
    assert (bits(edits.replay(mask({0: base}), events.where("seq < 0")))[0] == base).all()


def test_small_images_are_gathered_once(mask, monkeypatch):
    """Images of one band are flipped and numbered in the step that labels them; beside a tall image they still are."""
    images = {i: noise(i, (14, 11), 0.55) for i in range(4)} | {9: noise(9, (60, 11), 0.55)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    only_small = {i: images[i] for i in range(4)}
    for got in (masks.fill_holes(mask(only_small)), masks.clear_border(mask(only_small)), cc.components(mask(only_small), 8)):
        assert "Join" not in plan(got)
    for pixels in (14 * 11, 14 * 11 * 2, None):
        filled, cleared = bits(masks.fill_holes(mask(images), pixels)), bits(masks.clear_border(mask(images), 4, pixels))
        found = label_arrays(cc.components(mask(images), 8, pixels), {i: a.shape for i, a in images.items()})
        for i, image in images.items():
            edge = lambda labels: set(labels[0]) | set(labels[-1]) | set(labels[:, 0]) | set(labels[:, -1])
            outside, pores = brute_components(~image, 4), brute_components(image, 4)
            assert (filled[i] == ~np.isin(outside, list(edge(outside) - {0}))).all()
            assert (cleared.get(i, image & False) == (image & ~np.isin(pores, list(edge(pores) - {0})))).all()
            assert (found[i] == brute_components(image, 8)).all()


def test_sliced_join_equals_broadcast(mask, monkeypatch):
    images = {i: noise(i, (20, 20), 0.5) for i in range(3)}
    whole = bits(geometry.crop_batch(mask(images), rect=(3, 2, 15, 11)))
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", 0)
    sliced = bits(geometry.crop_batch(mask(images), rect=(3, 2, 15, 11)))
    assert all((whole[i] == images[i][2:11, 3:15]).all() and (sliced[i] == whole[i]).all() for i in images)


def test_written_tables(spark):
    written = workspace.materialize(spark.range(7), top=F.max("id"))
    assert written.metrics == {"rows": 7, "top": 6} and workspace.row_count(written) == 7
    assert workspace.row_count(written.where("id > 2")) == 4


@pytest.mark.parametrize("band_pixels", [None, 14 * 11])
def test_holes_and_specks_in_one_step(mask, band_pixels):
    """holes, specks and border go through one grouped step where images have one band, with the result of the single steps."""
    images = {i: noise(i, (14, 11), 0.45 + 0.05 * i) for i in range(5)} | {8: np.ones((14, 11), bool), 9: np.zeros((14, 11), bool), 10: noise(10, (40, 11), 0.6)}
    rows = mask(images)
    single = bits(masks.clean(masks.fill_holes(rows, band_pixels), 3, True, 8, band_pixels))
    once = masks.clean(rows, 3, True, 8, band_pixels, holes=True)
    together = bits(once)
    assert all((together[i] == single[i]).all() for i in images)
    if band_pixels is None:
        assert once._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1


@pytest.mark.parametrize("log_slice", [1 << 16, 7])
def test_covered_strokes_are_not_shuffled(spark, monkeypatch, log_slice):
    """F16: strokes that a later one covers are dropped before the shuffle, whose maxima are hashed; what is decided stays the same, in slices of a log as well."""
    monkeypatch.setattr(edits, "LOG_SLICE", log_slice)
    rng = np.random.default_rng(6)
    ops = ("paint", "erase", "paint_line", "erase_line")
    log = [(int(rng.integers(3)), seq // 2, ops[int(rng.integers(4))], *(int(v) for v in rng.integers(-4, 34, 4)), int(rng.integers(0, 8))) for seq in range(240)]
    log += [(0, 500, "paint", None, 3, 1, 1, 2), (1, 501, "erase_line", 4, 4, None, 9, 2), (1, 502, "paint", 4, None, 1, 1, 2), (2, None, "paint", 9, 9, 0, 0, None), (7, 1, "paint", 1, 1, 1, 1, 1)]
    events = spark.createDataFrame(log, "image_id bigint, seq bigint, op string, x int, y int, x2 int, y2 int, radius int")
    frames = spark.createDataFrame([(0, 20, 31), (1, 24, 30), (2, 9, 33)], "image_id bigint, height int, width int")
    facts = workspace.materialize(frames.join(events.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_edits")), "image_id").withColumn("reset_seq", F.lit(None).cast("bigint")))
    all_runs, seen = edits.stamp_runs(edits.stamps(events), frames, width=True), edits.drawn_runs(events, facts)
    decided = lambda drawn: {(r.image_id, r.y): r.decided for r in edits.decided_rows(drawn).collect()}
    assert decided(seen) == decided(all_runs)
    assert 4 * seen.count() < all_runs.count()
    plan = edits.decided_rows(seen)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.parametrize("add", [False, True])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_seeds_of_small_images_in_one_step(spark, mask, add, connectivity):
    """small images meet their seeds in one grouped step, beside tall ones too; seeds outside, on the other side or of no image change nothing."""
    images = {i: noise(i, (14, 11), 0.45 + 0.05 * i) for i in range(4)} | {5: np.zeros((14, 11), bool), 6: np.ones((14, 11), bool), 9: noise(9, (60, 11), 0.5)}
    rng = np.random.default_rng(8)
    points = [(int(i), int(x), int(y)) for i, x, y in zip(rng.integers(0, 11, 60), rng.integers(-3, 15, 60), rng.integers(-3, 62, 60))] * 2 + [(0, None, 3), (1, 3, None)]
    seeds = spark.createDataFrame(points, "image_id bigint, x int, y int")

    def flooded(image, of):
        side = brute_components(~image if add else image, connectivity)
        under = {side[y, x] for i, x, y in points if i == of and x is not None and y is not None and 0 <= y < image.shape[0] and 0 <= x < 11} - {0}
        return image ^ np.isin(side, list(under))

    for pixels in (14 * 11, 14 * 11 * 3, None):
        found = bits(masks.flood(mask(images), seeds, add, connectivity, pixels))
        assert all((found[i] == flooded(image, i)).all() for i, image in images.items()), pixels
    plan = masks.flood(mask(images), seeds, add, connectivity)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
