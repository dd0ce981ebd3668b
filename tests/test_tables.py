import csv
import glob
import os
import struct
import zlib

import duckdb
import numpy as np
import pytest
from conftest import arrays, bits, disk
from pyspark.sql import functions as F

import __spark_entry__ as contract
from poremetry import workspace
from poremetry.functions.geometry import clamp_rect, margins_to_rect, rect_to_margins
from poremetry.operators import analyse, calibrate, geometry, measure, render, threshold as th
from poremetry.plans import study
from poremetry.sources import rasters, sinks, tables

DATA = "/root/testdata/sf0.001"


# Files -------------------------------------------------------------------------------------------------------------


def png(path, image):
    """Minimal PNG writer: 8-bit gray, 16-bit gray or 8-bit RGB."""
    kind, depth = (2, 8) if image.ndim == 3 else (0, 16 if image.dtype == np.uint16 else 8)
    body = image.astype(">u2") if depth == 16 else image.astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in body)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, kind, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    gray, deep, colour = rng.integers(0, 256, (50, 60)), rng.integers(0, 256, (7, 5)), rng.integers(0, 256, (6, 9, 3))
    png(tmp_path / "a.png", gray)
    png(tmp_path / "b.png", (deep * 257).astype(np.uint16))
    png(tmp_path / "c.PNG", colour)
    (tmp_path / "bad.jpg").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_text("ignored")
    found, rejects = rasters.scan_images(spark, str(tmp_path))
    names = {r.image_id: os.path.basename(r.path) for r in found.collect()}
    lines = {names[i]: a for i, a in arrays(rasters.gray_scanlines(found)).items()}
    assert (lines["a.png"] == gray).all() and (lines["b.png"] == deep).all()
    luma = np.floor(colour[..., 2] * 0.114 + colour[..., 1] * 0.587 + colour[..., 0] * 0.299 + 0.5)
    assert np.abs(lines["c.PNG"] - luma).max() <= 1
    assert [r.error for r in rejects.collect()] == ["bad.jpg: could not read image"]


def test_a_large_raster(spark):
    side = 8000
    big = spark.range(1).select(F.col("id").alias("image_id"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(1).alias("n_channels"),
                                F.repeat(F.lit("ab"), side * side // 2).cast("binary").alias("data"))
    sums = rasters.gray_scanlines(big).agg(F.count("*"), F.sum(F.get("v", F.lit(0))), F.sum(F.get("v", F.lit(side - 1)))).first()
    assert tuple(sums) == (side, side * ord("a"), side * ord("b"))


def test_watching_a_folder(spark, tmp_path):
    from poremetry.streaming.watch import watch_folder

    os.makedirs(tmp_path / "in")
    png(tmp_path / "in" / "one.png", disk((40, 40), 20, 20, 10) * 255)
    seen = []
    for expected in (1, 2):
        watch_folder(spark, str(tmp_path / "in"), lambda pores, batch: seen.extend(pores.collect()), str(tmp_path / "state"),
                     th.ThresholdParams(polarity="poresBrighter", median_k=0)).awaitTermination()
        assert len(seen) == expected
        png(tmp_path / "in" / "two.png", disk((50, 50), 25, 25, 12) * 255)
    assert {r.area_px for r in seen} == {int(disk((40, 40), 20, 20, 10).sum()), int(disk((50, 50), 25, 25, 12).sum())}


def test_watching_reports_bad_files_and_leaves_no_tables(spark, tmp_path):
    from poremetry.streaming.watch import watch_folder

    os.makedirs(tmp_path / "in")
    png(tmp_path / "in" / "one.png", disk((40, 40), 20, 20, 10) * 255)
    (tmp_path / "in" / "broken.PNG").write_bytes(b"no image")
    (tmp_path / "in" / "notes.txt").write_text("other")
    seen, bad, before = [], [], set(workspace._paths(spark))
    watch_folder(spark, str(tmp_path / "in"), lambda pores, batch: seen.extend(pores.collect()), str(tmp_path / "state"),
                 th.ThresholdParams(polarity="poresBrighter", median_k=0), report=lambda rejects, batch: bad.extend(rejects.collect())).awaitTermination()
    assert len(seen) == 1 and [r.error for r in bad] == ["broken.PNG: could not read image"] and bad[0].path.endswith("broken.PNG")
    assert set(workspace._paths(spark)) == before


def test_one_decode_serves_scanlines_and_rejects(spark, tmp_path):
    image = np.random.default_rng(8).integers(0, 256, (30, 20))
    png(tmp_path / "a.png", image)
    (tmp_path / "b.tif").write_bytes(b"II*")
    (tmp_path / "c.csv").write_text("x")
    images = rasters.rasters_of_images(rasters.image_files(spark, str(tmp_path)))
    lines, files = rasters.decode_once(images)
    assert [(a == image).all() for a in arrays(lines).values()] == [True]
    assert sorted((r.path[-5:], r.error) for r in files.collect()) == [("a.png", None), ("b.tif", "b.tif: could not read image")]
    assert all(f.endswith(".parquet") for f in [*lines.inputFiles(), *files.inputFiles()])
    rows = [(0, 2, 2, 1, bytearray(b"\x00\x80\xff\x01")), (1, 2, 2, 1, None), (2, 2, 2, 1, bytearray(b"\x00")), (3, -1, -1, 1, bytearray()), (4, None, 1, 1, None)]
    lines, files = rasters.decode_once(spark.createDataFrame(rows, "image_id bigint, height int, width int, n_channels int, data binary"))
    assert arrays(lines)[0].tolist() == [[0, 128], [255, 1]]
    assert {r.image_id: r.error for r in files.collect()} == {0: None, 1: "no data", 2: "data does not fit the frame", 3: "could not read image", 4: "no data"}


def test_bad_rasters_are_reported(spark):
    rows = [(0, 2, 2, 1, bytearray(b"\x00\x80\xff\x01")), (1, 2, 2, 1, None), (2, 2, 2, 1, bytearray(b"\x00")), (3, 1, 1, 2, bytearray(b"ab"))]
    frame = spark.createDataFrame(rows, "image_id bigint, height int, width int, n_channels int, data binary")
    usable, rejects = rasters.split_valid(frame)
    assert arrays(rasters.gray_scanlines(usable))[0].tolist() == [[0, 128], [255, 1]]
    assert {r.image_id: r.error for r in rejects.collect()} == {1: "no data", 2: "data does not fit the frame", 3: "unsupported channels"}


def test_csv_has_a_header_even_when_empty(labelled, tmp_path):
    pores = measure.measure(labelled({0: disk((30, 30), 15, 15, 5).astype(int)}))
    for name, rows in (("some", pores), ("none", pores.where("label > 99"))):
        sinks.write_csv(rows, str(tmp_path / name))
        lines = [line for f in glob.glob(str(tmp_path / name / "*.csv")) for line in csv.reader(open(f))]
        assert lines[0] == list(measure.PORE_COLUMNS)
        assert len(lines) == (2 if name == "some" else 1)
    sinks.write_labels(labelled({0: np.eye(3, dtype=int)}), str(tmp_path / "labels"))
    assert pores.sparkSession.read.parquet(str(tmp_path / "labels")).count() == 3


def test_file_stem(spark):
    frame = spark.createDataFrame([("/a/b.c/img.one.png",), ("plain",), (".hidden",)], "p string")
    assert [r[0] for r in frame.select(rasters.stem(F.col("p"))).collect()] == ["img.one", "plain", ".hidden"]


# Geometry ----------------------------------------------------------------------------------------------------------


def test_rectangles(spark):
    rng = np.random.default_rng(1)
    rects = [tuple(int(v) for v in rng.integers(-20, 130, 4)) for _ in range(60)] + [(200, 200, 300, 300), (10, 10, 90, 90)]
    h, w = 100, 80
    frame = spark.createDataFrame([(i, *r, h, w) for i, r in enumerate(rects)], "i int, x0 int, y0 int, x1 int, y1 int, h int, w int")
    c = [F.col(n) for n in ("x0", "y0", "x1", "y1", "h", "w")]
    rows = frame.select("i", clamp_rect(*c).alias("r"), rect_to_margins(*c).alias("m"), margins_to_rect(*c).alias("b")).collect()
    for row in rows:
        x0, y0, x1, y1 = rects[row.i]
        want = (max(0, min(x0, w - 1)), max(0, min(y0, h - 1)), max(1, min(x1, w)), max(1, min(y1, h)))
        assert (tuple(row.r) if row.r else None) == (want if want[2] > want[0] and want[3] > want[1] else None)
        assert tuple(row.m) == (max(0, x0), max(0, y0), max(0, w - x1), max(0, h - y1))
    corner = rows[60]
    assert tuple(corner.r) == (79, 99, 80, 100)
    inside = frame.select("i", clamp_rect(*c).alias("r"), "h", "w").where("r is not null")
    m = inside.select("r", "h", "w", rect_to_margins(*[F.col(f"r.{n}") for n in ("x0", "y0", "x1", "y1")], F.col("h"), F.col("w")).alias("m"))
    back = m.select("r", margins_to_rect(*[F.col(f"m.{n}") for n in ("left", "top", "right", "bottom")], F.col("h"), F.col("w")).alias("back"))
    assert back.where(~F.col("r").eqNullSafe(F.col("back"))).isEmpty()


def test_crop_batch(scan):
    images = {0: np.arange(10000).reshape(100, 100) % 251, 1: np.arange(40000).reshape(200, 200) % 251, 2: np.arange(2500).reshape(50, 50) % 251}
    rows = scan(images)
    by_margin = arrays(geometry.crop_batch(rows, rect=(10, 10, 90, 90)))
    assert {i: a.shape for i, a in by_margin.items()} == {0: (80, 80), 1: (180, 180), 2: (30, 30)}
    by_rect = arrays(geometry.crop_batch(rows, rect=(10, 10, 90, 90), use_margins=False))
    assert {i: a.shape for i, a in by_rect.items()} == {0: (80, 80), 1: (80, 80), 2: (40, 40)}
    assert (by_rect[2] == images[2][10:, 10:]).all()
    kept = arrays(geometry.apply_crop(rows, (60, 60, 65, 65)))
    assert kept[0].shape == (5, 5) and kept[2].shape == (50, 50)
    one = arrays(geometry.apply_crop(rows, (10, 10, 20, 25), image_id=1))
    assert one[1].shape == (15, 10) and one[0].shape == (100, 100)
    with pytest.raises(ValueError):
        geometry.crop_batch(rows)


def test_resampling(scan):
    image = np.random.default_rng(2).integers(0, 256, (20, 30))
    small = arrays(geometry.preview(scan({0: image}), 150))[0]
    assert small.shape == (10, 15) and np.abs(small - image.reshape(10, 2, 15, 2).mean((1, 3))).max() <= 0.5
    assert (arrays(geometry.preview(scan({0: image}), 600))[0] == image).all()
    big = np.random.default_rng(3).integers(0, 256, (61, 47))
    h, w = int(61 * (500 / (61 * 47)) ** 0.5), int(47 * (500 / (61 * 47)) ** 0.5)
    share = lambda n, m: np.array([[max(0, min(i + 1, (t + 1) * n / m) - max(i, t * n / m)) for i in range(n)] for t in range(m)])
    want = share(61, h) @ big @ share(47, w).T / (61 / h * 47 / w)
    assert np.abs(arrays(geometry.preview(scan({4: big, 5: 255 - big}).repartition(3), 500))[4] - want).max() <= 0.5 + 1e-9
    doubled = arrays(geometry.resize_nearest(scan({0: image}), 40, 60))[0]
    assert (doubled == image.repeat(2, 0).repeat(2, 1)).all()


def test_resized_masks(mask, scan):
    image = np.random.default_rng(6).random((23, 31)) < 0.5
    image[4], image[5] = False, True
    for h, w in ((23, 31), (46, 93), (9, 7), (40, 5), (1, 1)):
        got = bits(geometry.resize_nearest(mask({2: image}), h, w))[2]
        assert (got == (arrays(geometry.resize_nearest(scan({2: image.astype(int)}), h, w))[2] > 0)).all()


# Calibration, analysis, rendering ----------------------------------------------------------------------------------


def test_scales(spark):
    events = spark.createDataFrame([(1, 5, 0.1, "mm"), (2, None, 0.2, "um"), (3, 7, 0.3, "mm")], "seq bigint, image_id bigint, units_per_px double, unit_name string")
    images = spark.createDataFrame([(5,), (6,), (7,)], "image_id bigint")
    found = {r.image_id: (r.units_per_px, r.unit_name) for r in calibrate.current_scales(images, events).collect()}
    assert found == {5: (0.2, "um"), 6: (0.2, "um"), 7: (0.3, "mm")}
    assert not analyse.units_available(events) and analyse.units_available(events.where("seq = 2"))
    marks = spark.createDataFrame([(0, 10, 60, 5.0, " "), (1, 3, 3, 1.0, "um"), (2, 0, 9, 0.0, "um")], "image_id bigint, x1 int, x2 int, real_length double, unit string")
    two = {r.image_id: r for r in calibrate.two_point_scales(marks).collect()}
    assert two[0].units_per_px == pytest.approx(0.1) and two[0].unit_name == "mm" and two[1].units_per_px == pytest.approx(1e9) and two[2].units_per_px is None


def test_histogram_matches_numpy(spark):
    values = np.random.default_rng(3).gamma(2, 3, 500)
    frame = spark.createDataFrame([("eq_diam", float(v)) for v in values] + [("area", 4.0)] * 3, "metric string, value double")
    rows = sorted(analyse.histogram(frame, 2).collect(), key=lambda r: (r.metric, r.bin))
    assert len(rows) == 10
    counts, edges = np.histogram(values, 5)
    assert [r.n for r in rows[5:]] == counts.tolist() and [r.lo for r in rows[5:]] == pytest.approx(edges[:-1].tolist())
    assert [r.n for r in rows[:5]] == np.histogram([4.0] * 3, 5)[0].tolist() and rows[0].lo == 3.5
    assert all(r.log_n is None for r in rows if r.n == 0)


def test_filters_values_and_report(spark, labelled):
    image = np.zeros((30, 30), dtype=int)
    image[0:3, 0:3], image[10, 10], image[15:20, 15:20] = 1, 2, 3
    scales = spark.createDataFrame([(0, 0.5, "mm")], "image_id bigint, units_per_px double, unit_name string")
    pores = measure.measure(labelled({0: image}), scales)
    assert [r.label for r in analyse.select_pores(pores, border=False).orderBy("label").collect()] == [2, 3]
    assert [r.label for r in analyse.select_pores(pores, smallest=9, largest=9).collect()] == [1]
    assert [r.label for r in analyse.select_pores(pores, smallest=6, scales=scales).collect()] == [3]
    values = {(r.metric, r.label): r.value for r in analyse.metric_values(pores, scales).collect()}
    assert ("circularity", 2) not in values and ("feret_max", 2) not in values and values["area", 3] == 6.25
    mixed = scales.union(spark.createDataFrame([(1, 0.5, "um")], scales.schema))
    assert [r.label for r in analyse.select_pores(pores, smallest=10, scales=mixed).collect()] == [3]
    assert {(r.metric, r.label): r.value for r in analyse.metric_values(pores, mixed).collect()}["area", 3] == 25.0
    assert analyse.metric_values(pores, metrics=("nothing",)).count() == 0
    table = {r.label: r for r in analyse.pore_table(pores).collect()}
    assert table[2].feret_max_px == "" and table[2].circularity == "nan" and table[1].border == "yes" and table[3].eq_diam_px == "5.642"


def test_colours(scan, labelled):
    image, labels = np.full((6, 8), 100), np.zeros((6, 8), dtype=int)
    labels[1:3, 1:4], labels[4, 5] = 1, 2
    rows, runs = scan({0: image, 1: image}), labelled({0: labels, 1: labels * 0})
    plain = {(r.image_id, r.y, r.x): (r.b, r.g, r.r) for r in render.colour_labels(rows, runs).collect()}
    assert plain[1, 0, 0] == (100, 100, 100) and plain[0, 0, 0] == (55, 55, 55) and plain[0, 1, 1] != plain[0, 4, 5]
    hues = {(r.image_id, r.y, r.x): (r.b, r.g, r.r) for r in render.colour_hues(rows, runs, on_gray=True).collect()}
    assert hues[0, 0, 0] == (100, 100, 100) and hues[0, 1, 1] == hues[0, 2, 3] != hues[0, 4, 5]
    pure = [(r.b, r.g, r.r) for r in render.hue_colours(runs).collect()]
    assert len(set(pure)) == 2 and all(max(c) == 255 and min(c) == 55 for c in pure)


def test_scope_merge(scan, monkeypatch):
    old, new = scan({0: np.zeros((2, 2), int), 1: np.zeros((2, 2), int)}), scan({1: np.ones((2, 2), int), 2: np.ones((2, 2), int)})
    everything = arrays(study.apply_scope(old, new))
    assert {i: int(a.sum()) for i, a in everything.items()} == {0: 0, 1: 4, 2: 4}
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", 0)
    assert {i: int(a.sum()) for i, a in arrays(study.apply_scope(old, new)).items()} == {0: 0, 1: 4, 2: 4}
    single = arrays(study.apply_scope(old, new, image_id=2))
    assert {i: int(a.sum()) for i, a in single.items()} == {0: 0, 1: 0, 2: 4}


def test_attach_measures_arrays_before_a_broadcast(spark, monkeypatch):
    rows = spark.range(40).select((F.col("id") % 4).alias("image_id"), F.col("id").alias("y"))
    nested = F.array_repeat(F.array_repeat(F.lit(7), 256), 8)
    facts = workspace.materialize(spark.range(4).select(F.col("id").alias("image_id"), F.when(F.col("id") != 3, nested).alias("strip"), F.lit("ab").alias("s")))
    size = workspace.table_bytes(facts)
    assert 3 * 8 * 256 * 8 < size < 4 * 8 * 256 * 8
    plans = []
    for limit in (size, size - 1):
        monkeypatch.setattr(workspace, "BROADCAST_BYTES", limit)
        joined = workspace.attach(rows, facts, ["image_id"])
        plans.append(joined._jdf.queryExecution().analyzed().toString())
        assert sorted((r.y, r.strip is None, r.s) for r in joined.collect()) == [(y, y % 4 == 3, "ab") for y in range(40)]
    assert "_slice" not in plans[0] and "_slice" in plans[1]
    assert workspace.table_bytes(workspace.materialize(spark.range(5))) == 5 * (16 + 8) and workspace.table_bytes(facts.where("image_id < 0")) == 0


def test_sliced_facts_are_never_broadcast(spark, scan, monkeypatch):
    """Facts that compress well look small on disk: their copies must not be broadcast, and a small image takes one copy of its rectangle."""
    rows = scan({i: np.arange(60).reshape(12, 5) for i in range(6)})
    rects = geometry.clamped_rects(geometry.frames(rows), 1, 2, 4, 9)
    whole = arrays(geometry.crop(rows, rects))
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", 0)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    copies = workspace.attach(rows, workspace.materialize(rects), ["image_id"])
    assert "Broadcast" not in plan(copies) and copies.count() == 72
    for step in (workspace.SLICE_ROWS, 3):
        monkeypatch.setattr(workspace, "SLICE_ROWS", step)
        cropped = geometry.crop(rows, rects)
        assert "Broadcast" not in plan(cropped)
        assert {i: a.tolist() for i, a in arrays(cropped).items()} == {i: a.tolist() for i, a in whole.items()}
    for query, height in ((geometry.crop_batch(rows, rect=(1, 2, 4, 9)), 7), (geometry.crop_batch(rows, rect=(1, 2, 4, 9), use_margins=False), 7),
                          (geometry.apply_crop(rows, (1, 2, 4, 9)), 7)):
        assert "_slice" in query._jdf.queryExecution().analyzed().toString() and "Broadcast" not in plan(query).split("_slice")[-1]
        assert query.count() == 6 * height


# Contract ----------------------------------------------------------------------------------------------------------


def test_entry_and_twins(spark):
    queries, twins = contract.queries(), contract.oracle_sql()
    assert set(twins) <= set(queries)
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert contract.entry(spark).count() == 20
    for name in ("pore_size_distribution", "components8", "fill_holes", "perimeter"):
        ours = queries[name](spark, DATA).toPandas()
        theirs = con.sql(twins[name]).df()[list(ours.columns)]
        order = list(ours.columns)
        ours, theirs = (f.sort_values(order, ignore_index=True) for f in (ours, theirs))
        for c in order:
            assert (ours[c] == theirs[c]).all() if ours[c].dtype == object else np.allclose(ours[c], theirs[c].astype(float))


def test_labels_of_every_image_are_dense(spark):
    runs = contract.queries()["components4"](spark, DATA)
    facts = runs.groupBy("image_id").agg(F.max("label").alias("top"), F.countDistinct("label").alias("n"))
    assert facts.where("top <> n").isEmpty()


@pytest.mark.parametrize("band_pixels", [None, 30, 4])
def test_cells_to_scanlines(spark, band_pixels):
    """cells are gathered by bands or small images; images without a cell in the frame, or without an id, keep their rows, an image stays together."""
    from conftest import arrays

    rng = np.random.default_rng(4)
    cells = [(int(i), int(y), int(x), int(a)) for i, y, x, a in zip(rng.integers(0, 6, 300), rng.integers(-2, 9, 300), rng.integers(-2, 8, 300), rng.integers(0, 90, 300))]
    cells += [(7, -1, 2, 5), (8, None, None, 5), (None, 2, 3, 40)]
    want = {i: np.zeros((7, 6), int) for i in [*range(6), 7, 8, None]}
    for i, y, x, a in cells:
        if y is not None and 0 <= y < 7 and 0 <= x < 6:
            want[i][y, x] += a
    given = spark.createDataFrame(cells, "image_id bigint, y int, x int, amount bigint").repartition(5)
    scan = tables.rasterize(given, 7, 6, F.least(F.lit(255), F.col("amount")), band_pixels)
    assert scan.columns == ["image_id", "height", "width", "y", "v"] and scan.count() == 7 * len(want)
    found = arrays(scan.where("image_id is not null")) | arrays(scan.where("image_id is null").orderBy("y"))
    assert set(found) == set(want) and all((found[i] == np.minimum(want[i], 255)).all() for i in want)
    if band_pixels is None:
        spread = scan.select("image_id", F.spark_partition_id().alias("p")).distinct().groupBy("image_id").count().where("count > 1")
        assert spread.isEmpty()
