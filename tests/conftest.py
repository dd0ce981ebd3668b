import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("poremetry-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scan(spark):
    """Scanlines from {image_id: array}."""
    def build(images, kind="int"):
        rows = [(int(i), a.shape[0], a.shape[1], y, a[y].tolist()) for i, a in images.items() for y in range(a.shape[0])]
        return spark.createDataFrame(rows, f"image_id bigint, height int, width int, y int, v array<{kind}>")

    return build


@pytest.fixture(scope="session")
def mask(scan):
    """Mask rows from {image_id: boolean array}."""
    from poremetry.operators.threshold import mask_where

    def build(images):
        from pyspark.sql import functions as F

        return mask_where(scan({i: a.astype(int) for i, a in images.items()}), F.col("v"))

    return build


@pytest.fixture(scope="session")
def labelled(scan):
    """Label runs from {image_id: label array}."""
    from pyspark.sql import functions as F

    from poremetry.functions.rows import label_runs_of

    def build(images):
        return scan(images).select("image_id", "height", "width", "y", F.inline(label_runs_of(F.col("v"))))

    return build


def arrays(scanlines, column="v"):
    out = {}
    for r in sorted(scanlines.collect(), key=lambda r: (r.image_id, r.y)):
        out.setdefault(r.image_id, []).append(r[column])
    return {i: np.array(rows) for i, rows in out.items()}


def bits(mask_rows):
    out = {}
    for r in mask_rows.collect():
        image = out.setdefault(r.image_id, np.zeros((r.height, r.width), dtype=bool))
        for run in r.runs:
            assert not image[r.y, run.x0:run.x1].any()
            image[r.y, run.x0:run.x1] = True
    return out


def label_arrays(label_runs, shapes):
    out = {i: np.zeros(s, dtype=int) for i, s in shapes.items()}
    for r in label_runs.collect():
        out[r.image_id][r.y, r.x0:r.x1] = r.label
    return out


def disk(shape, cx, cy, radius):
    y, x = np.ogrid[:shape[0], :shape[1]]
    return (x - cx) ** 2 + (y - cy) ** 2 <= radius ** 2


def brute_components(image, connectivity):
    """Labels in raster order of their first pixel, by breadth-first search."""
    labels, n = np.zeros(image.shape, dtype=int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (connectivity == 8 or a == 0 or b == 0)]
    for start in zip(*np.nonzero(image)):
        if labels[start]:
            continue
        n += 1
        labels[start], todo = n, [start]
        while todo:
            y, x = todo.pop()
            for a, b in steps:
                p = (y + a, x + b)
                if 0 <= p[0] < image.shape[0] and 0 <= p[1] < image.shape[1] and image[p] and not labels[p]:
                    labels[p] = n
                    todo.append(p)
    return labels


def noise(seed, shape, share):
    return np.random.default_rng(seed).random(shape) < share
