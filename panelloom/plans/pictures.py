"""Queries on image statistics, detections and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import detect, pixels
from panelloom.plans import fixtures
from panelloom.plans.oracle import BLOCK, SIDE, detections, sql
from panelloom.plans.registry import query, show
from panelloom.sources import images, storage
from panelloom.streaming.images import stream_images, write_detections

PIXELS = SIDE * BLOCK


@query("scan_images", f"""
SELECT CAST(vec_id AS VARCHAR) AS image_id, CAST({PIXELS} AS INT) AS height, CAST({PIXELS} AS INT) AS width,
       CAST(3 AS INT) AS channels FROM embeddings""")
def scan_images(spark, sf):
    rows = images.scan_images(spark, fixtures.image_folder(spark, sf), "*.png", strict=True)
    return rows.select(fixtures.image_name(F.col("image.origin")).alias("image_id"), "image.height", "image.width",
                       F.col("image.nChannels").alias("channels"))


_RATIOS = ["smoke_ratio", "brown_ratio", "dark_ratio", "waste_ratio", "green_ratio", "bare_ratio"]


@query("image_color_ratio", sql(
    "SELECT image_id, " + ", ".join(f"round({c}, 7) AS {c}" for c in _RATIOS) + " FROM pixelstats", "pixelstats"))
def image_color_ratio(spark, sf):
    return show(pixels.image_features(fixtures.images(spark, sf)), ["image_id"], _RATIOS)


@query("image_sharpness", sql(
    "SELECT image_id, round(laplacian_var, 6) AS laplacian_var, round(gray_std, 6) AS gray_std FROM pixelstats", "pixelstats"))
def image_sharpness(spark, sf):
    return show(pixels.image_features(fixtures.images(spark, sf)), ["image_id"], ["laplacian_var", "gray_std"], 6)


@query("image_edge_density")
def image_edge_density(spark, sf):
    return show(pixels.image_features(fixtures.images(spark, sf)), ["image_id"], ["edge_density"])


@query("image_entropy", sql("SELECT image_id, round(entropy, 7) AS entropy FROM texture", "texture"))
def image_entropy(spark, sf):
    return show(pixels.image_features(fixtures.images(spark, sf)), ["image_id"], ["entropy"])


_LITERAL = detections("image_features")


def _one_detector(name, detector, issue):
    @query(name, sql(f"SELECT image_id, confidence, severity FROM ({_LITERAL}) WHERE issue = '{issue}'", "image_features"))
    def run(spark, sf):
        out = detect.detect(fixtures.image_statistics(spark, sf), (detector,))
        return out.select("image_id", "confidence", "severity")


_one_detector("detect_smoke", detect.smoke(), "Smoke / Air Pollution")
_one_detector("detect_garbage", detect.garbage(), "Garbage / Illegal Dumping")
_one_detector("detect_deforestation", detect.deforestation(), "Deforestation / Vegetation Loss")


@query("detection_severity", sql(f"SELECT * FROM ({_LITERAL})", "image_features"))
def detection_severity(spark, sf):
    return detect.detect(fixtures.image_statistics(spark, sf))


_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_PLACE = "CASE issue WHEN 'Smoke / Air Pollution' THEN 1 WHEN 'Garbage / Illegal Dumping' THEN 2 ELSE 3 END"
_REPORT = f"""SELECT image_id,
  string_agg(concat(issue, ' ', printf('%.3f', confidence), ' ', severity), '; ' ORDER BY {_PLACE}) AS detections,
  coalesce(string_agg(alert, '; ' ORDER BY {_PLACE}) FILTER (alert <> ''), '') AS alerts,
  CASE max({_RANK}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS highest_severity
  FROM ({_LITERAL}) GROUP BY image_id"""


def _spelled(report):
    """Items and texts of a report in their order, as text."""
    item = lambda d: F.concat_ws(" ", d["issue"], F.format_string("%.3f", d["confidence"]), d["severity"])
    return report.select("image_id", F.array_join(F.transform("detections", item), "; ").alias("detections"),
                         F.array_join("alerts", "; ").alias("alerts"), "highest_severity")


@query("detection_report", sql(_REPORT, "image_features"))
def detection_report(spark, sf):
    return _spelled(detect.report_features(fixtures.image_statistics(spark, sf)))


@query("report_json", sql(_REPORT, "image_features"))
def report_json(spark, sf):
    text = detect.report_json(detect.report_features(fixtures.image_statistics(spark, sf)))
    schema = "detections array<struct<issue:string,confidence:double,severity:string>>, alerts array<string>, highest_severity string"
    return _spelled(text.select("image_id", F.from_json("report", schema).alias("r")).select("image_id", "r.*"))


@query("frame_detections", sql(
    f"""SELECT f.video_id, f.frame_no, d.issue, d.confidence, d.severity FROM ({_LITERAL}) d JOIN (
          SELECT video_id, frame_no, event_id FROM frames WHERE frame_no % 7 = 0
          QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_no) <= 5) f ON f.event_id = d.image_id""",
    "frames", "image_features"))
def frame_detections(spark, sf):
    """The detectors on the sampled frames of every video."""
    sampled = images.frame_sample(fixtures.frames(spark, sf), every=7, most=5)
    found = detect.detect(fixtures.image_statistics(spark, sf).join(sampled, F.col("event_id") == F.col("image_id"), "left_semi"))
    return found.join(sampled, F.col("event_id") == F.col("image_id")).select("video_id", "frame_no", "issue", "confidence", "severity")


@query("unreadable_images", """SELECT CAST(vec_id AS VARCHAR) AS image_id, 'Unreadable image' AS issue FROM embeddings WHERE vec_id % 10 = 0""")
def unreadable_images(spark, sf):
    """Every tenth image is one that the reader could not decode: it comes out as a row."""
    image = F.col("image")
    broken = F.col("image.origin").cast("long") % 10 == 0
    marked = fixtures.images(spark, sf).withColumn("image", F.when(broken, image.withField("height", F.lit(-1)).withField(
        "data", F.lit(b""))).otherwise(image))
    return detect.analyse_images(marked).where("confidence is null").select("image_id", "issue")


# Blocks of one colour have thin edges (below 15 %) and few greys (below 6.5 bits).
_ANALYSED = "SELECT *, 0.0E0 AS edge_density, 0.0E0 AS entropy FROM pixelstats"
_FOUND = detections("analysed")


@query("analyse_images", sql(f"SELECT image_id, issue, confidence, severity FROM ({_FOUND})", "pixelstats", analysed=_ANALYSED))
def analyse_images(spark, sf):
    return detect.analyse_images(fixtures.images(spark, sf)).select("image_id", "issue", "confidence", "severity")


@query("image_regions", sql("SELECT * FROM boxes", "boxes"))
def image_regions(spark, sf):
    return pixels.image_regions(fixtures.images(spark, sf))


@query("stream_images", sql(
    f"SELECT image_id, issue, confidence, severity FROM ({_FOUND}) WHERE confidence > 0.1", "pixelstats", analysed=_ANALYSED))
def stream_images_query(spark, sf):
    found = stream_images(spark, fixtures.image_folder(spark, sf))
    out = storage.scratch_path(spark, "detections")
    write_detections(found, out, storage.scratch_path(spark, "progress")).awaitTermination()
    rows = spark.read.schema(found.schema).parquet(out)
    return rows.select(fixtures.image_name(F.col("image_id")).alias("image_id"), "issue", "confidence", "severity")
