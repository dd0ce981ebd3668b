"""Rasters derived from ordinary tables: cells are summed into a dense grid of 0..255 values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poremetry.functions.rows import bind
from poremetry.operators.neighbours import BAND_PIXELS, bundle


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rasterize(cells: DataFrame, height: int, width: int, value: Column, band_pixels: int | None = None) -> DataFrame:
    """Scanlines from (image_id, y, x, amount) rows; ``value`` maps the summed ``amount`` to 0..255.

    Rows outside the frame are dropped, absent cells are 0. Amounts are pre-summed per cell before anything is
    gathered, so one image, row or cell holding most of the input is no hot spot: a gathered band, or several small images, has as many
    cells as pixels at most. The scanlines of an image stay together, so later steps see it whole or in few batches.
    """
    rows = max(1, (band_pixels or BAND_PIXELS) // width)
    inside = (
        cells.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
        .groupBy("image_id", "y", "x").agg(F.sum(F.col("amount").cast("bigint")).alias("amount"))
        .select(F.col("image_id").cast("bigint"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), value.cast("int").alias("v"))
    )
    # every band of every image is named, also those without a cell
    frame = cells.select("image_id").distinct().select(
        F.col("image_id").cast("bigint"), F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(rows))).alias("y"),
        F.lit(-1).alias("x"), F.lit(0).alias("v"))
    placed = inside.unionByName(frame).withColumn("height", F.lit(height)).withColumn("width", F.lit(width)).withColumn("_bundle", bundle(band_pixels))
    return placed.drop("height", "width").groupBy("_bundle", F.floor(F.col("y") / rows).alias("_band")).applyInArrow(
        lambda key, table: _dense(table, key[1].as_py() * rows, min(height, (key[1].as_py() + 1) * rows), height, width),
        "image_id bigint, height int, width int, y int, v array<int>")


def _dense(table: pa.Table, top: int, end: int, height: int, width: int) -> pa.Table:
    """The scanlines ``top`` .. ``end`` - 1 of the images of a table of (x, y, v) cells, zero elsewhere; x = -1 only names an image."""
    given = table.column("image_id")
    images, at = np.unique(given.fill_null(0).to_numpy(), return_inverse=True)  # a missing id has a bundle of its own
    y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
    here, tall = x >= 0, end - top
    out = np.zeros((len(images) * tall, width), np.int32)
    out[at[here] * tall + y[here] - top, x[here]] = v[here]
    n = len(out)
    same = lambda v: pa.array(np.full(n, v, np.int32))
    ids = pa.nulls(n, pa.int64()) if given.null_count else pa.array(np.repeat(images, tall))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(out.ravel()))
    return pa.table([ids, same(height), same(width), pa.array(np.tile(np.arange(top, end, dtype=np.int32), len(images))), lists],
                    names=["image_id", "height", "width", "y", "v"])


def lineitem_density(spark: SparkSession, folder: str) -> DataFrame:
    """One 50 x 84 image per supplier: revenue by quantity (rows) and ship month since 1995-01 (columns)."""
    cells = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("image_id"),
        (F.col("l_quantity").cast("int") - 1).alias("y"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("x"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"),
    )
    return rasterize(cells, 50, 84, F.least(F.lit(255), F.expr("amount div 50000")))


def event_density(spark: SparkSession, folder: str) -> DataFrame:
    """One 24 x 31 image per user: event value by hour (rows) and day of month (columns)."""
    cells = table(spark, folder, "events").select(
        F.col("user_id").alias("image_id"),
        F.hour("ts").alias("y"),
        (F.dayofmonth("ts") - 1).alias("x"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount"),
    )
    return rasterize(cells, 24, 31, F.least(F.lit(255), F.expr("amount div 100")))


def _byte(e: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.5) * 255))).cast("int")


def embedding_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """One image per embedding, eight values per row, last row padded with 0; needs no shuffle."""
    height = F.ceil(F.size("embedding") / 8).cast("int")
    return (
        table(spark, folder, "embeddings").where(F.size("embedding") > 0)
        .select(F.col("vec_id").alias("image_id"), height.alias("height"),
                F.concat(F.transform("embedding", _byte), F.array_repeat(F.lit(0), height * 8 - F.size("embedding"))).alias("all"),
                F.explode(F.sequence(F.lit(0), height - 1)).alias("y"))
        .select("image_id", "height", F.lit(8).alias("width"), "y", F.slice("all", F.col("y") * 8 + 1, 8).alias("v"))
    )


def text_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """One raster per document: code points modulo 256 of the whole text, 64 per row, last row padded with 0."""
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c) % 256)
    lines = bind(codes, lambda a: F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.slice(a, y * 64 + 1, 64)))
    return (
        table(spark, folder, "documents")
        .where(F.length("text") > 0)
        .select(F.col("doc_id").alias("image_id"),
                F.ceil(F.length("text") / 64).cast("int").alias("height"), F.lit(64).alias("width"), "text")
        .select("image_id", "height", "width", F.posexplode(lines).alias("y", "line"))
        .select("image_id", "height", "width", "y",
                F.concat("line", F.array_repeat(F.lit(0), F.lit(64) - F.size("line"))).alias("v"))
    )


def colour_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """Three-channel rasters five pixels wide, one per embedding: bytes in row-major BGR order, the last row padded with 0."""
    n = F.size("embedding")
    height = F.ceil(n / 15).cast("int")
    byte = F.transform("embedding", lambda e: F.lpad(F.hex(_byte(e).cast("bigint")), 2, "0"))
    return (
        table(spark, folder, "embeddings")
        .select(F.col("vec_id").alias("image_id"), F.concat(F.lit("embedding/"), F.col("vec_id"), F.lit(".png")).alias("path"),
                height.alias("height"), F.lit(5).alias("width"), F.lit(3).alias("n_channels"),
                F.unhex(F.concat(F.array_join(byte, ""), F.repeat(F.lit("00"), height * 15 - n))).alias("data"))
    )
