"""Written intermediate tables and size-checked joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

# A per-image or per-component table is broadcast only below this size.
BROADCAST_BYTES = 32 << 20
# Number of slices of the big side when the small side is too large to broadcast.
SALT_SLICES = 64
# Scanlines of one key that meet one copy of its fact, where the caller says which slices a fact is needed in.
SLICE_ROWS = 4096

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_scopes = threading.local()  # open scopes of a thread, each a list of written tables
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="spark-poremetry-"), "poremetry")
        context.addPyFile(shutil.make_archive(base, "zip", root, "poremetry"))
        _shipped.add(context.applicationId)


def workspace_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="spark-poremetry-")
    return _local_dirs[context.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration() if spark._jsc.sc().isStopped() is False
                         else spark._jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


def _paths(spark: SparkSession) -> list[str]:
    """The written tables of this application; they go when Python ends, at the latest."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_release_quietly, spark, app)
    return _written[app]


def _release_quietly(spark: SparkSession, app: str) -> None:
    for path in _written.pop(app, []):
        try:
            _delete(spark, path)
        except Exception:  # the gateway may be gone already
            return


@contextmanager
def scoped_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread writes inside the block when it ends; results must have been written or collected by then."""
    stack = _scopes.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            _delete(spark, path)
            _paths(spark).remove(path)


def materialize(df: DataFrame, scoped: bool = True, **metrics: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the optimizer true sizes. The row count and any
    further aggregate ``metrics`` are observed during the write and kept in ``.metrics`` of the result. A table that is not
    ``scoped`` outlives the enclosing ``scoped_tables`` block and goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{workspace_dir(spark)}/poremetry/{uuid.uuid4().hex}"
    _paths(spark).append(path)
    stack = getattr(_scopes, "open", [])
    if scoped and stack:
        stack[-1].append(path)
    watch = Observation()
    watched = df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])
    watched.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.metrics = watch.get
    return written


def written(df: DataFrame) -> DataFrame:
    """``df`` itself if it reads a written table already, else ``materialize(df)``."""
    return df if hasattr(df, "metrics") else materialize(df)


def row_count(written: DataFrame) -> int:
    """Rows of a written table: observed while writing, else read from the Parquet footers."""
    known = getattr(written, "metrics", None)
    return known["rows"] if known else written.count()


def _fixed_bytes(kind: T.DataType) -> int | None:
    """Bytes of every value of a type, or None where values differ in size."""
    if isinstance(kind, T.StructType):
        parts = [_fixed_bytes(f.dataType) for f in kind]
        return None if None in parts else sum(parts)
    return None if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 8


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value, nested ones included."""
    known = _fixed_bytes(kind)
    if known is not None:
        return F.lit(known).cast("bigint")
    if isinstance(kind, T.StructType):
        return sum((_value_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
    if isinstance(kind, T.MapType):
        return _value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        each = _fixed_bytes(kind.elementType)
        total = (F.size(value) * F.lit(each).cast("bigint") if each is not None else F.aggregate(
            value, F.lit(0).cast("bigint"), lambda total, x: total + _value_bytes(x, kind.elementType)))
    else:
        total = F.octet_length(value).cast("bigint")
    return F.greatest(F.lit(0), F.coalesce(total, F.lit(0))).cast("bigint") + 16


def table_bytes(written: DataFrame) -> int:
    """Bytes of a written table in memory. Rows of one size are only counted; else the values are measured, if there can be few enough."""
    least = row_count(written) * 16
    fixed = _fixed_bytes(written.schema)
    if fixed is not None or least > BROADCAST_BYTES:
        return least + row_count(written) * (fixed or 0)
    return least + (written.agg(F.sum(_value_bytes(F.struct(*[F.col(c) for c in written.columns]), written.schema))).first()[0] or 0)


def row_slices(first: Column, last: Column) -> Column:
    """The slices that the rows ``first`` .. ``last`` lie in, for ``attach``; a small image has one."""
    return F.sequence(F.floor(first / SLICE_ROWS).cast("int"), F.floor(last / SLICE_ROWS).cast("int"))


def attach(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner", spread: str = "y", slices: Column | None = None) -> DataFrame:
    """Join a written table of facts (one row per key) to many rows.

    Tables whose measured size is small are broadcast. Larger ones are joined on
    (key, slice of ``spread``), so a key that owns a large share of ``rows`` is split over many tasks. ``slices``, an expression
    over the facts, lists the slices of ``SLICE_ROWS`` rows that a fact is needed in; without it a fact is copied to all.
    The sliced join is always a shuffled one: the optimizer knows the written size of the facts only, not that of their copies in memory.
    """
    if table_bytes(facts) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), on, how)
    known = slices is not None
    sliced = facts.withColumn("_slice", F.explode(slices if known else F.sequence(F.lit(0), F.lit(SALT_SLICES - 1))))
    of_row = F.floor(F.col(spread) / SLICE_ROWS) if known else F.pmod(F.col(spread), F.lit(SALT_SLICES))
    return rows.withColumn("_slice", of_row.cast("int")).join(sliced.hint("merge"), [*on, "_slice"], how).drop("_slice")
