"""Small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when ``body`` uses it inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separators: str) -> Column:
    """The non-empty pieces of ``text`` between runs of ``separators`` (a Java character class); null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{separators}+"), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names, made from ``names``, that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


BATCH_ROWS = 1000  # rows that pass between the JVM and Python at once
PIECE_ROWS = 256  # rows of a batch that a Python task turns into objects at once


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small slices, so that a task never holds Python objects for a whole batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(start, PIECE_ROWS)


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over rows with long texts.

    Spark's default of 10,000 rows a batch costs tens of MB of buffers per task on both sides; the session's setting is
    lowered to BATCH_ROWS where it is higher.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


FILTER_BITS = 20  # a hash filter has 2^20 bits, whatever the number of keys


def hash_filter(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that is true for every value of ``keys[key]`` and false for most others.

    A bitmap of the hashes. It has a fixed size, so it may pass the driver and stand in plans as a constant; with very many keys it
    lets more through and stays correct.
    """
    bit = F.xxhash64(key).bitwiseAND(2 ** FILTER_BITS - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))
    found = keys.groupBy(F.call_function("shiftright", bit, F.lit(6)).alias("slot")).agg(F.bit_or(one).alias("bits")).collect()
    bits = {r.slot: r.bits for r in found}
    words = F.split(F.lit(",".join(str(bits.get(i, 0)) for i in range(2 ** (FILTER_BITS - 6)))), ",").cast("array<bigint>")  # folded to a constant

    def known(h: Column) -> Column:
        slot = F.call_function("shiftright", h.bitwiseAND(2 ** FILTER_BITS - 1), F.lit(6)).cast("int")
        return F.getbit(F.get(words, slot), h.bitwiseAND(63).cast("int")) == 1

    return lambda value: let(F.xxhash64(value), known)
