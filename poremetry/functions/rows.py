"""Column expressions over one raster row: value arrays, bit arrays and run lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RUNS_TYPE = "array<struct<x0:int,x1:int>>"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (keeps it from being recomputed per array element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(width: Column) -> Column:
    return F.sequence(F.lit(0), width - 1)


def run(x0: Column, x1: Column) -> Column:
    return F.struct(x0.cast("int").alias("x0"), x1.cast("int").alias("x1"))


def runs_of_bits(bits: Column) -> Column:
    """Maximal runs of ones in a 0/1 array; linear in the width, no shuffle."""

    def build(b):
        def edges(step):
            return F.filter(
                F.sequence(F.lit(0), F.size(b) - 1),
                lambda x: (F.get(b, x) == 1)
                & ((x == 0 if step < 0 else x == F.size(b) - 1) | (F.get(b, x + step) == 0)),
            )

        return F.zip_with(edges(-1), edges(1), lambda s, e: run(s, e + 1))

    return bind(bits, build)


def bits_of_runs(runs: Column, width: Column) -> Column:
    """0/1 array of a run list; linear in the width."""

    def build(r):
        def piece(this, i):
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(r, i - 1)["x1"])
            return F.concat(
                F.array_repeat(F.lit(0), this["x0"] - start), F.array_repeat(F.lit(1), this["x1"] - this["x0"])
            )

        last = F.coalesce(F.get(r, F.size(r) - 1)["x1"], F.lit(0))
        return F.concat(F.flatten(F.transform(r, piece)), F.array_repeat(F.lit(0), width - last))

    return bind(runs, build)


def dense_cells(cells: Column, width: Column) -> Column:
    """Value array of a list of (x, v) structs sorted by x, zero elsewhere; linear in the width."""

    def build(c):
        def piece(cell, i):
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(c, i - 1)["x"] + 1)
            return F.concat(F.array_repeat(F.lit(0), cell["x"] - start), F.array(cell["v"]))

        last = F.coalesce(F.get(c, F.size(c) - 1)["x"] + 1, F.lit(0))
        return F.concat(F.flatten(F.transform(c, piece)), F.array_repeat(F.lit(0), width - last))

    return bind(cells, build)


def complement_runs(runs: Column, width: Column) -> Column:
    """The gaps of a run list inside [0, width)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["x1"]))
    ends = F.concat(F.transform(runs, lambda r: r["x0"]), F.array(width))
    return F.filter(F.zip_with(starts, ends, lambda s, e: run(s, e)), lambda r: r["x0"] < r["x1"])


def merge_segments(segments: Column) -> Column:
    """Runs of the ``fg`` segments among consecutive segments that cover a row, sorted by x0."""

    def build(s):
        fg = lambda i: F.coalesce(F.get(s, i)["fg"], F.lit(False))
        index = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(index, lambda i: fg(i) & ~fg(i - 1))
        ends = F.filter(index, lambda i: fg(i) & ~fg(i + 1))
        return F.zip_with(starts, ends, lambda a, b: run(F.get(s, a)["x0"], F.get(s, b)["x1"]))

    return bind(segments, build)


def overlaid(runs: Column, decided: Column, width: Column) -> Column:
    """``runs`` where nothing is decided, else what ``decided``, disjoint sorted runs (x0, x1, paint), says."""

    def between(d):
        """Runs cut down to the gaps between the decided ones: a gap has index i when i decided runs end before it."""
        def gap(i):
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(d, i - 1)["x1"])
            end = F.coalesce(F.get(d, i)["x0"], width)
            inside = F.filter(runs, lambda r: (r["x0"] < end) & (r["x1"] > start))
            return F.transform(inside, lambda r: segment(F.greatest(r["x0"], start), F.least(r["x1"], end)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), gap))

    def segment(x0, x1):
        return F.struct(x0.cast("int").alias("x0"), x1.cast("int").alias("x1"))

    def build(d):
        painted = F.transform(F.filter(d, lambda r: r["paint"]), lambda r: segment(r["x0"], r["x1"]))
        return bind(F.sort_array(F.concat(between(d), painted)), touching_merged)

    return bind(decided, build)


def touching_merged(runs: Column) -> Column:
    """Runs that meet end to start become one; ``runs`` are sorted and disjoint."""
    index = F.sequence(F.lit(0), F.size(runs) - 1)
    starts = F.filter(index, lambda i: (i == 0) | (F.get(runs, i - 1)["x1"] < F.get(runs, i)["x0"]))
    ends = F.filter(index, lambda i: (i == F.size(runs) - 1) | (F.get(runs, i)["x1"] < F.get(runs, i + 1)["x0"]))
    merged = F.zip_with(starts, ends, lambda s, e: run(F.get(runs, s)["x0"], F.get(runs, e)["x1"]))
    return F.when(F.size(runs) > 0, merged).otherwise(F.array().cast(RUNS_TYPE))


def total(values: Column) -> Column:
    """Exact integer sum of an array."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def padded(values: Column, before: int, after: int) -> Column:
    """Repeat the edge elements of an array."""
    first, last = F.get(values, F.lit(0)), F.get(values, F.size(values) - 1)
    return F.concat(F.array_repeat(first, before), values, F.array_repeat(last, after))


def mirrored(index: Column, size: Column) -> Column:
    """Reflect an index into [0, size) without repeating the edge element."""
    period = F.greatest(2 * (size - 1), F.lit(1))
    m = F.pmod(index, period)
    return F.when(size == 1, F.lit(0)).when(m < size, m).otherwise(period - m)


def clamped(index: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(index, size - 1))


def label_runs_of(labels: Column) -> Column:
    """Runs of equal positive labels in a label array, as structs (x0, x1, label)."""

    def build(a):
        index = F.sequence(F.lit(0), F.size(a) - 1)
        at = lambda x: F.coalesce(F.get(a, x), F.lit(0))
        starts = F.filter(index, lambda x: (at(x) > 0) & ((x == 0) | (at(x - 1) != at(x))))
        ends = F.filter(index, lambda x: (at(x) > 0) & ((x == F.size(a) - 1) | (at(x + 1) != at(x))))
        return F.zip_with(starts, ends, lambda s, e: F.struct(
            s.alias("x0"), (e + 1).alias("x1"), at(s).cast("int").alias("label")))

    return bind(labels, build)


def labels_of_runs(runs: Column, width: Column) -> Column:
    """Label array of sorted (x0, x1, label) structs, 0 elsewhere; linear in the width."""

    def build(r):
        def piece(this, i):
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(r, i - 1)["x1"])
            return F.concat(
                F.array_repeat(F.lit(0), this["x0"] - start), F.array_repeat(this["label"], this["x1"] - this["x0"]))

        last = F.coalesce(F.get(r, F.size(r) - 1)["x1"], F.lit(0))
        return F.concat(F.flatten(F.transform(r, piece)), F.array_repeat(F.lit(0), width - last))

    return bind(runs, build)
