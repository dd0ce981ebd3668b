"""Image files and byte rasters as scanlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poremetry.functions.gray import BLUE, GREEN, RED, stretch
from poremetry.workspace import attach, materialize

BAND_VALUES = 1 << 20  # numbers that leave a decoding task at once
# The file types an image study reads.
EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
IMAGE_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS) + "}"


def image_key(path: Column) -> Column:
    """Stable id of a file; the sources write the slashes after the scheme differently."""
    return F.xxhash64(F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/"))


def scan_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rasters, rejects) of the image files below a folder. Files that do not decode are listed in ``rejects`` with a reason.

    Decoding happens in the executors, one file per row, and a file that fails stays as a row without pixels, so both results split
    one scan. 16-bit gray arrives scaled to 8 bits, alpha is dropped.
    """
    decoded = rasters_of_images(image_files(spark, folder))
    bad = F.col("height") < 0
    return decoded.where(~bad), decoded.where(bad).select("path", "image_id", unreadable().alias("error"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's image source over the image files of a folder; files of other types are never opened, empty files are skipped."""
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB).load(folder)


def unreadable() -> Column:
    return F.concat(F.element_at(F.split("path", "/"), -1), F.lit(": could not read image"))


def rasters_of_images(images: DataFrame) -> DataFrame:
    """Raster rows of Spark's image source."""
    return images.select(
        image_key(F.col("image.origin")).alias("image_id"), F.col("image.origin").alias("path"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def valid_raster() -> Column:
    """Whether a raster row can be processed."""
    size = F.col("height").cast("bigint") * F.col("width") * F.col("n_channels")
    return F.coalesce((F.length("data") == size) & (size > 0) & F.col("n_channels").isin(1, 3, 4), F.lit(False))


def split_valid(rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rasters, rejects with a reason): one bad raster never stops the others."""
    return rasters.where(valid_raster()), rasters.where(~valid_raster()).select("image_id", reject_reason().alias("error"))


def reject_reason() -> Column:
    return F.when(F.col("data").isNull(), "no data").when(~F.coalesce(F.col("n_channels").isin(1, 3, 4), F.lit(False)), "unsupported channels").otherwise(
        "data does not fit the frame")


def decode_once(rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gray scanlines, files) of raster rows; both read one written table, so every image is decoded once, whatever reads them.

    ``files`` has a row per raster: (image_id, path, height, width, error); ``error`` is null unless the raster cannot be used. Rasters
    that Spark could not decode have a negative height. Without a ``path`` column it is null.
    """
    if "path" not in rasters.columns:
        rasters = rasters.withColumn("path", F.lit(None).cast("string"))
    error = F.when(F.col("height") < 0, F.coalesce(unreadable(), F.lit("could not read image"))).when(~valid_raster(), reject_reason())
    given = rasters.select(
        F.col("image_id").cast("bigint"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("n_channels").cast("int"),
        F.when(error.isNull(), F.col("data")).alias("data"), "path", error.alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = batch.select(["image_id", "path", "height", "width", "error"])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*facts.columns, pa.array(np.full(n, -1), pa.int32()), pa.nulls(n, pa.list_(pa.int32()))], names=[*facts.schema.names, "y", "v"])
            for lines in _bands(batch.filter(batch.column("data").is_valid()), "v", gray_values):
                m = lines.num_rows
                yield pa.RecordBatch.from_arrays(
                    [lines.column("image_id"), pa.nulls(m, pa.string()), lines.column("height"), lines.column("width"), pa.nulls(m, pa.string()),
                     lines.column("y"), lines.column("v")], names=[*facts.schema.names, "y", "v"])

    written = materialize(given.mapInArrow(run, "image_id bigint, path string, height int, width int, error string, y int, v array<int>"))
    return (written.where("y >= 0").select("image_id", "height", "width", "y", "v"),
            written.where("y < 0").select("image_id", "path", "height", "width", "error"))


def _bands(batch: pa.RecordBatch, column: str, to_values) -> Iterator[pa.RecordBatch]:
    """Rows of every raster of a batch, at most BAND_VALUES numbers at a time; the image itself goes no further than this step."""
    for i in range(batch.num_rows):
        image_id, height, width, channels = (batch.column(c)[i].as_py() for c in ("image_id", "height", "width", "n_channels"))
        pixels = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(height, width, channels)
        step = max(1, BAND_VALUES // (width * channels))
        for y in range(0, height, step):
            values = to_values(pixels[y:y + step])
            n, line = values.shape
            same = lambda v, kind: pa.array(np.full(n, v), kind)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * line + 1, line), pa.int32()), pa.array(values.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [same(image_id, pa.int64()), same(height, pa.int32()), same(width, pa.int32()), same(channels, pa.int32()),
                 pa.array(np.arange(y, y + n), pa.int32()), lists], names=["image_id", "height", "width", "n_channels", "y", column])


def _rows(rasters: DataFrame, column: str, to_values) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _bands(batch, column, to_values)

    given = rasters.select(F.col("image_id").cast("bigint"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("n_channels").cast("int"), "data")
    return given.mapInArrow(run, f"image_id bigint, height int, width int, n_channels int, y int, {column} array<int>")


def byte_rows(rasters: DataFrame) -> DataFrame:
    """One row per raster row with ``bytes``: whole numbers 0..255, channels interleaved. Linear in the number of pixels."""
    return _rows(rasters, "bytes", lambda p: p.reshape(len(p), -1).astype(np.int32))


def gray_values(p: np.ndarray) -> np.ndarray:
    """Gray values of some rows of pixels (rows, columns, channels)."""
    if p.shape[2] == 1:
        return p[:, :, 0].astype(np.int32)
    b, g, r = (p[:, :, c].astype(np.float64) for c in range(3))
    return np.floor(b * BLUE + g * GREEN + r * RED + 0.5).astype(np.int32)


def gray_scanlines(rasters: DataFrame) -> DataFrame:
    """Scanlines of rasters; colour becomes luma, alpha is ignored. Needs no shuffle."""
    return _rows(rasters, "v", gray_values).drop("n_channels")


def explode_pixels(scan: DataFrame) -> DataFrame:
    """(image_id, y, x, v) of scanlines."""
    return scan.select("image_id", "y", F.posexplode("v").alias("x", "v"))


def minmax_normalise(scan: DataFrame) -> DataFrame:
    """Values of any numeric type stretched to 0..255 per image; extremes are pre-aggregated, then joined."""
    extremes = materialize(scan.groupBy("image_id").agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")))
    return attach(scan, extremes, ["image_id"]).withColumn(
        "v", F.transform("v", lambda v: stretch(v, F.col("low"), F.col("high")))).drop("low", "high")


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")

