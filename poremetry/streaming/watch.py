"""New image files processed as they arrive, by the same batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from poremetry.operators.separate import SeparationParams
from poremetry.operators.threshold import ThresholdParams
from poremetry.plans.study import process_batch
from poremetry.sources.rasters import IMAGE_GLOB, decode_once, rasters_of_images
from poremetry.workspace import scoped_tables


def watch_folder(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str,
                 thresholds: ThresholdParams = ThresholdParams(), separation: SeparationParams = SeparationParams(),
                 available_now: bool = True, report: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Measure every new image below ``folder`` and hand each batch's pores to ``sink(pores, batch_id)``.

    Files that cannot be read or used never stop the others: ``report(rejects, batch_id)`` gets (image_id, path, error) of a batch. The
    checkpoint remembers which files were read, so a restart neither skips nor repeats a file. A batch's written tables go when it ends, so
    ``sink`` and ``report`` write or collect what they get.
    """
    schema = spark.read.format("image").load(folder).schema
    files = spark.readStream.format("image").schema(schema).option("dropInvalid", False).option("pathGlobFilter", IMAGE_GLOB).load(folder)

    def handle(batch: DataFrame, batch_id: int) -> None:
        with scoped_tables(batch.sparkSession):
            scan, read = decode_once(rasters_of_images(batch))
            sink(process_batch(scan, thresholds, separation).pores, batch_id)
            if report is not None:
                report(read.where("error IS NOT NULL").select("image_id", "path", "error"), batch_id)

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
