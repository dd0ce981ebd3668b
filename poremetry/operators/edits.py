"""Brush edits replayed from an event log (image_id, seq, op, x, y, x2, y2, radius).

Operations: "paint" and "erase" stamp a disk at (x, y); "paint_line" and "erase_line" stamp disks along the segment
to (x2, y2); "reset" empties the mask. Any other operation is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from poremetry.functions.rows import RUNS_TYPE, overlaid
from poremetry.operators.masks import merged_runs
from poremetry.operators.neighbours import BAND_PIXELS
from poremetry.workspace import attach, materialize, written

PAINTS = ("paint", "paint_line")
ERASES = ("erase", "erase_line")
LINES = ("paint_line", "erase_line")
# Edits of one image that are drawn by one task; a longer log is split by the hash of ``seq``.
LOG_SLICE = 1 << 16


def _strokes(edits: DataFrame) -> DataFrame:
    """Edits other than resets with ``dx``, ``dy`` and ``n``: stamps 0 .. n lie along a line, one of n = 0 at (x, y)."""
    unknown = F.raise_error(F.concat(F.lit("unknown edit operation: "), F.coalesce("op", F.lit("null"))))
    edits = edits.withColumn("op", F.when(F.col("op").isin(*PAINTS, *ERASES, "reset"), F.col("op")).otherwise(unknown))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    step = F.greatest(F.lit(1), F.floor(F.col("radius") / 2))
    length = F.greatest(F.lit(1.0), F.sqrt((dx * dx + dy * dy).cast("double")))
    n = F.greatest(F.lit(1), F.floor(length / step)).cast("int")
    return edits.where(F.col("op") != "reset").withColumn("n", F.when(F.col("op").isin(*LINES), n).otherwise(0)).select(
        "image_id", "seq", F.col("op").isin(*PAINTS).alias("paint"), "x", "y", "n", dx.alias("dx"), dy.alias("dy"),
        F.greatest(F.lit(1), F.col("radius")).cast("int").alias("radius"))


def stamps(edits: DataFrame) -> DataFrame:
    """Disk stamps of edits: lines become stamps every half radius, coordinates rounded down."""
    along = lambda a, d: F.when(F.col("n") == 0, F.col(a)).otherwise(
        F.when(F.col("i") == F.col("n"), F.col(a) + F.col(d)).otherwise(F.floor(F.col(a) + F.col("i") * (F.col(d) / F.col("n"))))).cast("int")
    return _strokes(edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).select(
        "image_id", "seq", "paint", along("x", "dx").alias("cx"), along("y", "dy").alias("cy"), "radius")


def stamp_runs(stamps_: DataFrame, frames: DataFrame, width: bool = False) -> DataFrame:
    """(image_id, seq, paint, y, x0, x1): one run per disk row, clipped to the frame (image_id, height, width); its ``width`` on demand."""
    half = F.floor(F.sqrt((F.col("radius") * F.col("radius") - F.col("dy") * F.col("dy")).cast("double"))).cast("int")
    rows = stamps_.withColumn("dy", F.explode(F.sequence(-F.col("radius"), F.col("radius")))).withColumn("half", half)
    return (
        attach(rows, materialize(frames.select("image_id", "height", "width")), ["image_id"], spread="seq")
        .select("image_id", "seq", "paint", (F.col("cy") + F.col("dy")).alias("y"), "height",
                F.greatest(F.lit(0), F.col("cx") - F.col("half")).alias("x0"),
                F.least(F.col("width"), F.col("cx") + F.col("half") + 1).alias("x1"), *(["width"] if width else []))
        .where((F.col("y") >= 0) & (F.col("y") < F.col("height")) & (F.col("x0") < F.col("x1"))).drop("height"))


def _spread(counts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, number within the owner) of ``counts`` items per owner, ``size`` at a time."""
    ends = np.cumsum(counts)
    for low in range(0, int(ends[-1]) if len(ends) else 0, size):
        place = np.arange(low, min(low + size, int(ends[-1])))
        owner = np.searchsorted(ends, place, "right")
        yield owner, place - (ends[owner] - counts[owner])


def _highest(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, rank: np.ndarray, lines: int, width: int) -> np.ndarray:
    """The largest rank (1 or more) of the runs over every place, 0 where there is none.

    A run is noted as two of the largest power of two in it; from the longest down every noted run is handed to its halves.
    """
    power, above = np.log2(x1 - x0).astype(np.int64), None
    for p in range(power.max(initial=0), -1, -1):
        here, mine, size = np.zeros((lines, width), np.int64), power == p, 1 << p
        for at in (x0[mine], x1[mine] - size):
            np.maximum.at(here.reshape(-1), line[mine] * width + at, rank[mine])
        if above is not None:
            np.maximum(here, above, out=here)
            np.maximum(here[:, size:], above[:, :-size], out=here[:, size:])
        above = here
    return above


def on_top(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(line, x0, x1, rank) of what is seen of runs that cover each other, the largest rank on top; sorted by line and x0."""
    order = np.argsort(line, kind="stable")
    names, at = np.unique(line[order], return_inverse=True)
    x0, x1, rank, per = x0[order], x1[order], rank[order], max(1, BAND_PIXELS // max(1, width))
    parts = [(names[:0], x0[:0], x1[:0], rank[:0])]
    for first in range(0, len(names), per):
        mine = slice(*np.searchsorted(at, (first, first + per)))
        seen = _highest(at[mine] - first, x0[mine], x1[mine], rank[mine], min(per, len(names) - first), width)
        turn = np.diff(np.pad(seen, ((0, 0), (1, 1)))) != 0
        (row, a), b = np.nonzero(turn[:, :-1] & (seen > 0)), np.nonzero(turn[:, 1:] & (seen > 0))[1] + 1
        parts.append((names[first + row], a, b, seen[row, a]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the strokes of a batch that no later stroke of the batch covers."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.take(pc.sort_indices(table, sort_keys=[("seq", "ascending"), ("paint", "ascending")], null_placement="at_start"))
        col = {c: table.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "dx", "dy", "n", "radius", "height", "width")}
        wide, image = table.column("wide").to_numpy(), np.unique(table.column("image_id").to_numpy(), return_inverse=True)[1]
        height, width = (int(col[c].max(initial=1)) for c in ("height", "width"))
        for edit, i in _spread(col["n"] + 1, BAND_PIXELS):
            n, r = col["n"][edit], col["radius"][edit]
            cx, cy = (np.where(i == n, col[a][edit] + np.where(n == 0, 0, col[d][edit]),
                               np.floor(col[a][edit] + i * (col[d][edit] / np.maximum(n, 1))).astype(np.int64)) for a, d in (("x", "dx"), ("y", "dy")))
            top = np.maximum(cy - r, 0)
            for stamp, row in _spread(np.maximum(np.minimum(cy + r + 1, col["height"][edit]) - top, 0), BAND_PIXELS):
                owner, y, middle = edit[stamp], top[stamp] + row, cx[stamp]
                half = np.floor(np.sqrt((r[stamp] ** 2 - (y - cy[stamp]) ** 2).astype(float))).astype(np.int64)
                x0 = np.where(wide[owner], 0, np.maximum(middle - half, 0))
                x1 = np.where(wide[owner], col["width"][owner], np.minimum(middle + half + 1, col["width"][owner]))
                inside = x0 < x1
                if not inside.any():
                    continue
                owner_row, x0, x1 = merged_runs((owner * height + y)[inside], x0[inside], x1[inside], width)
                owner, y = owner_row // height, owner_row % height
                line, x0, x1, rank = on_top(image[owner] * height + y, x0, x1, owner + 1, width)
                whose = table.select(["image_id", "seq", "paint", "width"]).take(pa.array(rank - 1))
                short = lambda v: pa.array(v.astype(np.int32))
                found = {"image_id": whose["image_id"], "seq": whose["seq"], "paint": whose["paint"], "y": short(line % height),
                         "x0": short(x0), "x1": short(x1), "width": whose["width"]}
                yield from pa.table(found).to_batches()


def drawn_runs(edits: DataFrame, facts: DataFrame) -> DataFrame:
    """Runs (image_id, seq, paint, y, x0, x1, width) of the edits after an image's last reset, without most of those that later edits cover.

    ``facts``, a written table, holds (image_id, height, width, reset_seq, n_edits). The edits of an image come together, a long log in several
    slices, and are drawn a batch at a time; what one batch leaves visible may still be covered by another.
    """
    strokes = attach(_strokes(edits), facts, ["image_id"], spread="seq").where(F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq")))
    # a place without x covers whole rows, as in stamp_runs; without y it covers none
    dx, dy = (F.when(F.col("n") == 0, 0).otherwise(F.col(d)) for d in ("dx", "dy"))
    strokes = strokes.withColumn("dx", dx).withColumn("dy", dy).where("y IS NOT NULL AND dy IS NOT NULL").withColumn(
        "wide", F.col("x").isNull() | F.col("dx").isNull()).select(
        "image_id", "seq", "paint", F.coalesce("x", F.lit(0)).alias("x"), "y", F.coalesce("dx", F.lit(0)).alias("dx"), "dy", "n", "radius", "wide",
        F.col("height").cast("int"), F.col("width").cast("int"), F.pmod(F.xxhash64("seq"), F.ceil(F.col("n_edits") / LOG_SLICE)).alias("slice"))
    together = strokes.repartition("image_id", "slice").sortWithinPartitions("image_id", "slice").drop("slice")
    seq = edits.schema["seq"].dataType.simpleString()
    image = edits.schema["image_id"].dataType.simpleString()
    return together.mapInArrow(_drawn, f"image_id {image}, seq {seq}, paint boolean, y int, x0 int, x1 int, width int")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per scanline the runs that its edits decide: stamps are laid down in the order of the log, the last one on top."""
    for batch in batches:
        widths, lists = batch.column("width").to_numpy(), batch.column("stamps")
        flat = lists.flatten()
        x0, x1 = (flat.field(c).to_numpy().astype(np.int64) for c in ("x0", "x1"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        row, x0, x1, rank = on_top(row, x0, x1, np.arange(1, len(x0) + 1), int(widths.max(initial=1)))
        paint = flat.field("paint").to_numpy(zero_copy_only=False).astype(bool)[rank - 1]
        new = np.append(True, (row[1:] != row[:-1]) | (x0[1:] != x1[:-1]) | (paint[1:] != paint[:-1]))[:len(row)]
        runs = pa.StructArray.from_arrays(
            [pa.array(x0[new].astype(np.int32)), pa.array(x1[np.append(new[1:], True)[:len(row)]].astype(np.int32)), pa.array(paint[new])],
            names=["x0", "x1", "paint"])
        ends = pa.array(np.searchsorted(row[new], np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("image_id"), batch.column("y"), pa.ListArray.from_arrays(ends, runs)], names=["image_id", "y", "decided"])


def decided_rows(drawn: DataFrame) -> DataFrame:
    """(image_id, y, decided): disjoint sorted runs (x0, x1, paint) of every scanline with stamp runs (image_id, seq, paint, y, x0, x1, width).

    A run is the union of two runs whose length is the largest power of two in it. The last edit of each such run is found by maxima with
    map-side partials, so a scanline gathers at most width * log2(width) of them, however long the log is. Ties of ``seq`` paint. The maxima are
    plain values, which are hashed; a maximum of structs would have to be sorted for.
    """
    power = F.floor(F.log2((F.col("x1") - F.col("x0")).cast("double"))).cast("int")
    size = F.pow(F.lit(2), F.col("power")).cast("int")
    halves = drawn.withColumn("power", power).withColumn("at", F.explode(F.array_distinct(F.array(F.col("x0"), F.col("x1") - size))))
    last = halves.groupBy("image_id", "y", "width", "power", "at").agg(
        F.max(F.when(F.col("paint"), F.col("seq"))).alias("painted"), F.max(F.when(~F.col("paint"), F.col("seq"))).alias("erased"),
        F.max("paint").alias("any")).withColumn("seq", F.greatest("painted", "erased"))
    paint = F.when(F.col("seq").isNull(), F.col("any")).otherwise(F.coalesce(F.col("painted") == F.col("seq"), F.lit(False)))
    stamp = F.struct("seq", paint.alias("paint"), F.col("at").alias("x0"), (F.col("at") + size).alias("x1"))
    rows = last.groupBy("image_id", "y", "width").agg(F.sort_array(F.collect_list(stamp)).alias("stamps"))
    return rows.mapInArrow(_decided, "image_id bigint, y int, decided array<struct<x0:int,x1:int,paint:boolean>>")


def replay(mask: DataFrame, edits: DataFrame, as_of_seq: int | None = None) -> DataFrame:
    """Mask after the edit log, up to ``as_of_seq`` if given.

    The last edit of a place decides it; edits up to an image's last reset are dropped before they are drawn. Everything happens on runs: a
    scanline's runs and the runs its edits decide are cut at each other's ends and merged. A null ``seq`` counts as earlier than any other.
    """
    if as_of_seq is not None:
        edits = edits.where(F.col("seq") <= as_of_seq)
    mask = written(mask)
    logs = edits.groupBy("image_id").agg(F.max(F.when(F.col("op") == "reset", F.col("seq"))).alias("reset_seq"), F.count(F.lit(1)).alias("n_edits"))
    facts = materialize(mask.where("y = 0").select("image_id", "height", "width").join(logs, "image_id"))
    by_row = decided_rows(drawn_runs(edits, facts))
    rows = attach(mask, materialize(facts.select("image_id", "reset_seq").where("reset_seq IS NOT NULL")), ["image_id"], "left").join(by_row, ["image_id", "y"], "left")
    base = F.when(F.col("reset_seq").isNull(), F.col("runs")).otherwise(F.array().cast(RUNS_TYPE))
    untouched = F.col("decided").isNull()
    rows = rows.select("image_id", "height", "width", "y", base.alias("base"), "decided")
    return rows.select("image_id", "height", "width", "y", F.when(untouched, F.col("base")).otherwise(
        overlaid(F.col("base"), F.col("decided"), F.col("width"))).alias("runs"))
