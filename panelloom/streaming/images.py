"""Unbounded detection over an image folder: stateless, so any trigger works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from panelloom.operators.detect import ALERT_ABOVE, analyse_images
from panelloom.sources.images import IMAGE_SCHEMA


TASKS_PER_CORE = 16   # most tasks of a trigger


def stream_images(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Detections above the alert confidence, as a streaming frame.

    Spark counts every file as 4 MB more than it has, so that a task would get some 30 small
    images, and write one file for them; tasks beyond `TASKS_PER_CORE` are put together.
    """
    reader = spark.readStream.format("image").schema(IMAGE_SCHEMA).option("recursiveFileLookup", True)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    images = reader.load(folder).coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return analyse_images(images).where(f"confidence > {ALERT_ABOVE} or confidence is null")


def write_detections(detections: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append detections to a Parquet folder; restart from the checkpoint loses nothing."""
    return (detections.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
