"""Image folders and frame tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

IMAGE_SCHEMA = ("image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


def scan_images(spark: SparkSession, path: str, pattern: str = "*", strict: bool = False) -> DataFrame:
    """Decoded images (BGR). A missing path raises; ``strict`` makes a bad file fail the read."""
    rows = (spark.read.format("image").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(path))
    if strict:
        bad = F.raise_error(F.concat(F.lit("could not read image: "), F.col("image.origin")))
        rows = rows.where(F.when(F.col("image.height") > 0, True).otherwise(bad.cast("boolean")))
    return rows


def bad_images(images: DataFrame) -> DataFrame:
    return images.where("image.height <= 0").select(F.col("image.origin").alias("image_id"))


def frame_sample(frames: DataFrame, every: int = 30, most: int = 100, video: str = "video_id",
                 number: str = "frame_no") -> DataFrame:
    """Every n-th frame of each video, at most ``most`` of them.

    The row-number limit is applied on the map side, so a long video sends at
    most ``most`` frames per task.
    """
    w = Window.partitionBy(video).orderBy(number)
    return (frames.where(F.col(number) % every == 0)
            .withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i"))
