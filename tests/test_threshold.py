import numpy as np
import pytest
from conftest import arrays, bits, disk
from pyspark.sql import functions as F

from poremetry import workspace
from poremetry.operators import filters, threshold as th
from poremetry.operators.filters import gaussian_weights
from poremetry.operators.threshold import ThresholdParams
from poremetry.plans import study

SHAPE = (100, 100)


def random_images():
    rng = np.random.default_rng(7)
    return {i: rng.integers(0, 256, (11 + i, 17)) for i in range(3)}


def brute_otsu(image):
    best, choice = 0.0, 0
    for t in np.unique(image)[:-1]:
        low, high = image[image <= t], image[image > t]
        sigma = len(low) * len(high) * (low.mean() - high.mean()) ** 2
        if sigma > best * (1 + 1e-12):
            best, choice = sigma, t
    return choice


def test_otsu_and_percentile(scan):
    images = {**random_images(), 7: np.full((4, 4), 9), 8: np.arange(100).reshape(10, 10)}
    hist = th.gray_histogram(scan(images))
    found = {r.image_id: r.thresh for r in th.otsu_thresholds(hist).collect()}
    assert found == {i: brute_otsu(a) for i, a in images.items()}
    for p in (0, 12.5, 50, 99.1, 100, 140):
        found = {r.image_id: r.thresh for r in th.percentile_thresholds(hist, p).collect()}
        assert all(found[i] == pytest.approx(np.percentile(a, min(p, 100))) for i, a in images.items())


@pytest.mark.parametrize("polarity", th.POLARITIES)
def test_polarity(scan, polarity):
    images = {0: np.zeros((5, 5), int), 1: np.full((5, 5), 255), 2: disk(SHAPE, 50, 50, 20) * 200, 3: np.array([[128]])}
    out = bits(th.threshold(scan(images), ThresholdParams(polarity=polarity, median_k=0)))
    for i, image in images.items():
        a = image > brute_otsu(image)
        both = a.any() and not a.all()
        dark = both and image[a].mean() < image[~a].mean()
        want = {"auto": ~a if both and not dark else a, "poresDarker": a if dark else ~a, "poresBrighter": ~a if dark else a}[polarity]
        assert (out[i] == want).all()


def test_pick(scan):
    image = disk(SHAPE, 50, 50, 20) * 200
    found = bits(th.threshold(scan({0: image}), ThresholdParams(method="pick", pick_value=200, median_k=3)))[0]
    assert found.any() and (found <= (image > 0)).all()
    assert not bits(th.pick_mask(scan({0: image}), 150, -4))[0].any()
    with pytest.raises(ValueError):
        ThresholdParams(method="pick")
    with pytest.raises(ValueError):
        ThresholdParams(method="magic")


@pytest.mark.parametrize("k", [3, 4, 7])
def test_median(scan, k):
    images = random_images()
    k_odd = k + 1 - k % 2
    found = arrays(filters.median(scan(images), k))
    for i, a in images.items():
        wide = np.pad(a, k_odd // 2, mode="edge")
        want = np.median(np.lib.stride_tricks.sliding_window_view(wide, (k_odd, k_odd)), axis=(2, 3))
        assert (found[i] == want).all()


@pytest.mark.parametrize("k", [3, 7, 13])
def test_gaussian(scan, k):
    images = random_images()
    found = arrays(filters.gaussian(scan(images), k))
    w = np.array(gaussian_weights(k))
    for i, a in images.items():
        wide = np.pad(a.astype(float), k // 2, mode="reflect")
        want = (np.lib.stride_tricks.sliding_window_view(wide, (k, k)) * np.outer(w, w)).sum((2, 3))
        assert np.abs(found[i] - np.floor(want + 0.5)).max() <= (0 if k <= 7 else 1)


def test_filters_do_not_depend_on_bands(scan, monkeypatch):
    from poremetry.operators import neighbours

    images = {0: np.random.default_rng(1).integers(0, 256, (60, 9))}
    whole = [arrays(filters.median(scan(images), 5)), arrays(filters.dilate_ellipse(scan(images), "v", 4, "d"), "d")]
    monkeypatch.setattr(neighbours, "BAND_PIXELS", 20)
    split = [arrays(filters.median(scan(images), 5)), arrays(filters.dilate_ellipse(scan(images), "v", 4, "d"), "d")]
    assert all((a[0] == b[0]).all() for a, b in zip(whole, split))


@pytest.mark.parametrize("k", [1, 2, 5, 9, 40])
def test_ellipse_dilation(scan, k):
    images = random_images()
    found = arrays(filters.dilate_ellipse(scan(images), "v", k, "d"), "d")
    cells = [(dy, dx) for dy, lo, hi in filters.ellipse_reach(k) for dx in range(lo, hi + 1)]
    for i, a in images.items():
        for y, x in np.ndindex(a.shape):
            near = [a[y + dy, x + dx] for dy, dx in cells if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1]]
            assert found[i][y, x] == max(near)


@pytest.mark.parametrize("edge,mode", [("replicate", "edge"), ("reflect", "reflect")])
@pytest.mark.parametrize("k", [11, 51])
def test_wide_blur_in_bands(scan, k, edge, mode):
    images = {i: np.random.default_rng(i).integers(0, 256, (150, 9)) for i in range(3)}
    w = gaussian_weights(k)
    rows = scan(images).withColumn("more", F.col("y") + 1)
    for pixels in (1, 700, None):
        found = filters._wide_blur(rows, "v", w, edge, "g", pixels)
        assert found.where("more <> y + 1").count() == 0 and found.columns == [*rows.columns, "g"]
        for i, got in arrays(found, "g").items():
            p = np.pad(images[i].astype(float), k // 2, mode)
            along = sum(p[:, d:d + 9] * w[d] for d in range(k))
            assert np.allclose(got, sum(along[d:d + 150] * w[d] for d in range(k)), atol=1e-9)


def test_adaptive_and_clahe_run_on_small_images(scan):
    images = {0: np.full((1, 1), 128), 1: np.random.default_rng(3).integers(0, 256, (20, 24))}
    out = bits(th.threshold(scan(images), ThresholdParams(method="adaptive", adaptive_block=1, use_clahe=True, clahe_tile=2)))
    assert out[0].shape == (1, 1) and out[1].any() and not out[1].all()
    flat = arrays(filters.clahe(scan({0: np.tile(np.arange(0, 64, 4), (16, 1))}), 40.0, 1))[0]
    assert (np.diff(flat[0]) > 0).all() and flat.max() == 255


def brute_clahe(image, clip, t):
    """Whole lookup tables of 256 entries per tile, pixel by pixel."""
    h, w = image.shape
    th_, tw = -(-h // t), -(-w // t)
    wide = np.pad(image, ((0, th_ * t - h), (0, tw * t - w)), "reflect")
    luts = {}
    for ty in range(t):
        for tx in range(t):
            n = np.bincount(wide[ty * th_:(ty + 1) * th_, tx * tw:(tx + 1) * tw].ravel(), minlength=256)
            kept = np.minimum(n, max(1, int(clip * th_ * tw / 256)))
            excess = int((n - kept).sum())
            rest, step = excess % 256, max(256 // max(excess % 256, 1), 1)
            v = np.arange(256)
            luts[ty, tx] = np.minimum(255, np.rint((np.cumsum(kept) + excess // 256 * (v + 1) + np.minimum(rest, v // step + 1)) * (255.0 / (th_ * tw))))
    out = np.zeros_like(image)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th_ - 0.5, x / tw - 0.5
            ty, tx = int(np.floor(fy)), int(np.floor(fx))
            at = lambda a, b: luts[min(max(a, 0), t - 1), min(max(b, 0), t - 1)][image[y, x]]
            rows = [at(a, tx) * (1 - (fx - tx)) + at(a, tx + 1) * (fx - tx) for a in (ty, ty + 1)]
            out[y, x] = int(np.floor(rows[0] * (1 - (fy - ty)) + rows[1] * (fy - ty) + 0.5))
    return out


def test_clahe_tables_take_no_more_than_the_pixels(scan, monkeypatch):
    """Lookup tables hold the values that occur in a tile only, and in a sliced join a small image takes one copy of them."""
    rng = np.random.default_rng(8)
    images = {i: rng.integers(0, 256, (24, 31)) ** (i + 1) % 256 for i in range(2)} | {2: np.full((24, 31), 9), 3: rng.integers(0, 4, (17, 40)) * 80}
    sizes, real = [], filters.materialize

    def sized(df, **metrics):
        out = real(df, **metrics)
        sizes.append(workspace.table_bytes(out))
        return out

    monkeypatch.setattr(filters, "materialize", sized)
    for limit, step in ((None, None), (0, 4096), (0, 5)):
        if limit is not None:
            monkeypatch.setattr(workspace, "BROADCAST_BYTES", limit)
            monkeypatch.setattr(workspace, "SLICE_ROWS", step)
        for i, got in arrays(filters.clahe(scan(images), 2.0, 4)).items():
            assert (got == brute_clahe(images[i], 2.0, 4)).all()
    assert sizes[0] < 4 * (24 * 32 * 32 + 4 * 64)


def test_meta_and_picks(spark, scan):
    rows = scan(random_images())
    assert th.threshold_meta(rows, ThresholdParams()).columns == ["image_id", "method", "polarity"]
    adaptive = th.threshold_meta(rows, ThresholdParams(method="adaptive", adaptive_block=50)).first()
    assert (adaptive.block, adaptive.C) == (51, 2)
    picks = spark.createDataFrame([(0, 3, 2), (0, 99, 2), (1, 0, 0)], "image_id bigint, x int, y int")
    found = {(r.image_id, r.x, r.y): r.pick_value for r in th.picked_values(rows, picks).collect()}
    images = random_images()
    assert found == {(0, 3, 2): images[0][2, 3], (1, 0, 0): images[1][0, 0]}


def test_batch_keeps_images_apart(scan):
    images = {i: disk(SHAPE, 30 + 10 * i, 50, 20) * 255 for i in range(3)}
    done = study.process_batch(scan(images), ThresholdParams(polarity="poresBrighter"))
    pores = {r.image_index: r for r in done.pores.collect()}
    alone = study.process_batch(scan({1: images[1]}), ThresholdParams(polarity="poresBrighter")).pores.first()
    assert sorted(pores) == [0, 1, 2] and pores[1] == alone
    assert all(abs(pores[i].centroid_x - (30 + 10 * i)) < 1 for i in images)
    only = study.process_batch(scan(images), separation=study.SeparationParams(method="none"), measure=True)
    assert only.labels is None and only.pores is None
    filled = bits(study.threshold_batch(scan({0: np.where(disk(SHAPE, 50, 50, 10), 0, disk(SHAPE, 50, 50, 30) * 255)}), "otsu", "poresBrighter"))
    assert filled[0].sum() == disk(SHAPE, 50, 50, 30).sum() or abs(int(filled[0].sum()) - int(disk(SHAPE, 50, 50, 30).sum())) < 20


def test_progress(scan):
    rows, watch = study.with_progress(scan(random_images()))
    rows.select(F.size("v")).collect()
    assert watch.get["images"] == 3
