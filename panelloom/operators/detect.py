"""Image detectors and reports as column expressions over the statistics table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from panelloom.operators.pixels import image_features

# Detection severity by confidence, worst first; the detectors' bounds, points and alert texts below.
CONFIDENCE = ((0.75, "critical"), (0.50, "high"), (0.25, "medium"), (None, "low"))
SEVERITIES = ("low", "medium", "high", "critical")
ALERT_ABOVE = 0.1


@dataclass(frozen=True)
class Detector:
    """An issue name, a confidence and the alert text over statistics columns."""

    issue: str
    confidence: Callable[[], Column]
    alert: Callable[[Column], Column]


def _when_sum(*rules: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for condition, points in rules:
        out = out + F.when(condition, points).otherwise(0.0)
    return F.round(F.least(out, F.lit(1.0)), 6)


def _fixed(x: Column, digits: int) -> Column:
    """Number text with fixed digits; far cheaper per row than a format string."""
    return x.cast(f"decimal(20,{digits})").cast("string")


def _percent(x: Column, digits: int) -> Column:
    return F.concat(_fixed(x * 100, digits), F.lit("%"))


def smoke(blur: float = 100.0, haze: float = 0.15) -> Detector:
    def confidence():
        return _when_sum((F.col("laplacian_var") < blur, 0.35), (F.col("smoke_ratio") > 0.30, 0.40),
                         (F.col("gray_std") < 255 * haze, 0.25))
    def alert(c):
        return F.concat(F.lit("⚠️ Smoke/Pollution detected ("), _percent(c, 0), F.lit(" confidence). Laplacian="),
                        _fixed(F.col("laplacian_var"), 1), F.lit(", smoke_pixels="),
                        _percent(F.col("smoke_ratio"), 1))
    return Detector("Smoke / Air Pollution", confidence, alert)


def garbage() -> Detector:
    def confidence():
        return _when_sum((F.col("waste_ratio") > 0.25, 0.40), (F.col("edge_density") > 0.15, 0.35),
                         (F.col("entropy") > 6.5, 0.25))
    def alert(c):
        return F.concat(F.lit("🗑️ Garbage dumping detected ("), _percent(c, 0),
                        F.lit(" confidence). waste_pixels="), _percent(F.col("waste_ratio"), 1),
                        F.lit(", edge_density="), _percent(F.col("edge_density"), 1))
    return Detector("Garbage / Illegal Dumping", confidence, alert)


def deforestation() -> Detector:
    def confidence():
        return _when_sum((F.col("green_ratio") < 0.15, 0.50), (F.col("bare_ratio") > 0.30, 0.50))
    def alert(c):
        return F.concat(F.lit("🌲 Vegetation loss detected ("), _percent(c, 0), F.lit(" confidence). green="),
                        _percent(F.col("green_ratio"), 1), F.lit(", bare="), _percent(F.col("bare_ratio"), 1))
    return Detector("Deforestation / Vegetation Loss", confidence, alert)


def default_detectors() -> tuple[Detector, ...]:
    return smoke(), garbage(), deforestation()


def detection_severity(confidence: Column) -> Column:
    out = None
    for bound, name in CONFIDENCE:
        if bound is None:
            return out.otherwise(name)
        out = F.when(confidence >= bound, name) if out is None else out.when(confidence >= bound, name)


def detection_severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def _detections(detectors: tuple[Detector, ...]) -> Column:
    rows = []
    for d in detectors:
        c = d.confidence()
        rows.append(F.struct(F.lit(d.issue).alias("issue"), c.alias("confidence"),
                             detection_severity(c).alias("severity"),
                             F.when(c > ALERT_ABOVE, d.alert(c)).otherwise("").alias("alert")))
    return F.array(*rows)


def detect(features: DataFrame, detectors: tuple[Detector, ...] | None = None) -> DataFrame:
    """(image_id, issue, confidence, severity, alert): all detectors in one scan."""
    return features.select("image_id", F.inline(_detections(detectors or default_detectors())))


UNREADABLE = "Unreadable image"


def analyse_images(images: DataFrame, detectors: tuple[Detector, ...] | None = None) -> DataFrame:
    """Detections of every image; one that can't be read gives one row that says so, without a confidence.

    Images are read once: a union of the readable and the others would decode every file twice.
    """
    unread = F.array(F.struct(
        F.lit(UNREADABLE).alias("issue"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("severity"), F.lit("could not read the image").alias("alert")))
    found = F.when(F.col("height").isNull(), unread).otherwise(_detections(detectors or default_detectors()))
    return image_features(images, unreadable=True).select("image_id", F.inline(found))


def detection_report(detections: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Per image: detections, non-empty alerts and the highest severity."""
    rows = detections
    if boxes is None:  # not counted, which is not the same as none
        rows = rows.withColumn("bbox_count", F.lit(None).cast("bigint"))
    else:
        counted = boxes.groupBy("image_id", "issue").agg(F.count(F.lit(1)).alias("bbox_count"))
        rows = (rows.join(counted, ["image_id", "issue"], "left")
                .withColumn("bbox_count", F.coalesce("bbox_count", F.lit(0).cast("bigint"))))
    item = F.struct("issue", F.round("confidence", 3).alias("confidence"), "severity", "alert", "bbox_count")
    # One row per detector in a group, put in the detectors' order.
    place = F.array_position(F.array(*[F.lit(d.issue) for d in default_detectors()]), F.col("issue"))
    grouped = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), item.alias("item")))).alias("_items"))
    return _reported(grouped.select("image_id", F.transform("_items", lambda x: x["item"]).alias("detections")))


def report_features(features: DataFrame, detectors: tuple[Detector, ...] | None = None) -> DataFrame:
    """The report straight from the statistics table: row by row, without a shuffle."""
    found = F.transform(_detections(detectors or default_detectors()), lambda d: F.struct(
        d["issue"].alias("issue"), F.round(d["confidence"], 3).alias("confidence"), d["severity"].alias("severity"),
        d["alert"].alias("alert"), F.lit(None).cast("bigint").alias("bbox_count")))
    return _reported(features.select("image_id", found.alias("detections")))


def _reported(grouped: DataFrame) -> DataFrame:
    """Add the non-empty alerts and the highest severity of the detections."""
    alerts = F.filter(F.transform("detections", lambda d: d["alert"]), lambda a: a != "")
    rank = F.array_max(F.transform("detections", lambda d: detection_severity_rank(d["severity"])))
    highest = F.coalesce(F.try_element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int")), F.lit("low"))
    return grouped.select("image_id", "detections", alerts.alias("alerts"), highest.alias("highest_severity"))


def report_json(report: DataFrame, stamp: bool = True) -> DataFrame:
    """(image_id, report): the report as JSON text, with the time it was made."""
    parts = ["detections", "alerts", "highest_severity"]
    if stamp:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        parts = [now.alias("timestamp"), *parts]
    return report.select("image_id", F.to_json(F.struct(*parts)).alias("report"))
