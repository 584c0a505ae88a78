"""Image statistics against known values, regions, bad files, reports, the stream."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelloom.operators import batches, detect, pixels
from panelloom.plans.fixtures import png
from panelloom.sources.images import bad_images, frame_sample, scan_images
from panelloom.streaming import images as streams
from panelloom.streaming.images import stream_images, write_detections

# Scenes of 480 x 640 pixels (BGR): background, then rectangles [rows, columns].
SCENES = {
    "demo": ((200, 200, 200), [(300, 400, 100, 300, (30, 60, 90)), (350, 450, 400, 600, (20, 40, 10))]),
    "smoke": ((195, 200, 200), []),
    "waste": ((0, 0, 0), [(200, 400, 100, 500, (30, 50, 80)), (300, 440, 150, 520, (20, 45, 25))]),
    "deforest": ((40, 80, 30), [(100, 250, 0, 640, (20, 55, 15))]),
}
# Laplacian variance, grey deviation, smoke, waste, entropy, green, bare; then the three scores.
EXPECTED = {
    "demo": (185.59, 51.75, 0.8698, 0.1302, 0.688, 0.0651, 0.0651, (0.40, 0.0, 0.50)),
    "smoke": (0, 0, 1, 0, 0, 0, 0, (1.00, 0.0, 0.50)),
    "waste": (22.10, 22.06, 0, 1, 1.213, 0.1686, 0.1465, (0.60, 0.40, 0.0)),
    "deforest": (3.67, 9.73, 0, 1, 0.896, 1, 0, (0.60, 0.40, 0.0)),
}
COLUMNS = ("laplacian_var", "gray_std", "smoke_ratio", "waste_ratio", "entropy", "green_ratio", "bare_ratio")


def scene(name):
    back, boxes = SCENES[name]
    frame = np.empty((480, 640, 3), dtype=np.uint8)
    frame[:] = back
    for y0, y1, x0, x1, colour in boxes:
        frame[y0:y1, x0:x1] = colour
    return frame


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pictures")
    for name in SCENES:
        (path / f"{name}.png").write_bytes(png(480, 640, scene(name).tobytes()))
    (path / "broken.png").write_bytes(b"not an image")
    return str(path)


def _name(origin):
    return origin.rsplit("/", 1)[-1].removesuffix(".png")


def test_statistics_and_scores(spark, folder):
    images = scan_images(spark, folder)
    stats = {_name(r.image_id): r for r in pixels.image_features(images).collect()}
    assert set(stats) == set(SCENES)
    for name, want in EXPECTED.items():
        got = stats[name]
        assert [got[c] for c in COLUMNS] == [pytest.approx(w, abs=6e-3 if w > 2 else 6e-4) for w in want[:-1]]
        assert got.edge_density < 0.15 and (got.height, got.width) == (480, 640)
    scores = {}
    for r in detect.analyse_images(images).collect():
        scores.setdefault(_name(r.image_id), {})[r.issue] = r.confidence
    issues = [d.issue for d in detect.default_detectors()]
    assert {n: tuple(scores[n][i] for i in issues) for n in SCENES} == {n: EXPECTED[n][-1] for n in SCENES}


def test_bad_files(spark, folder):
    images = scan_images(spark, folder)
    assert [_name(r.image_id) for r in bad_images(images).collect()] == ["broken"]
    unread = detect.analyse_images(images).where("confidence is null").collect()
    assert [(_name(r.image_id), r.issue) for r in unread] == [("broken", detect.UNREADABLE)]
    with pytest.raises(Exception, match="could not read image"):
        scan_images(spark, folder, strict=True).select("image.height").collect()
    with pytest.raises(Exception):
        scan_images(spark, folder + "/missing").collect()


def test_regions_of_a_scene(spark, folder):
    rows = pixels.image_regions(scan_images(spark, folder, "demo.png")).collect()
    found = {(r.issue, r.x, r.y, r.w, r.h, r.area) for r in rows}
    assert ("Garbage / Illegal Dumping", 100, 300, 200, 100, 20000) in found
    assert ("Garbage / Illegal Dumping", 400, 350, 200, 100, 20000) in found
    assert ("Deforestation / Vegetation Loss", 100, 300, 200, 100, 20000) in found
    assert ("Smoke / Air Pollution", 0, 0, 640, 480, 480 * 640 - 40000) in found and len(found) == 4


def _flood(mask):
    """Reference labelling by depth-first search."""
    labels, count = np.zeros(mask.shape, dtype=int), 0
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        count += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not labels[a, b]:
                labels[a, b] = count
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return labels, count


@pytest.mark.parametrize("share", [0.2, 0.4, 0.5, 0.7])
def test_labels_equal_flood_fill(share):
    mask = np.random.default_rng(int(share * 10)).random((37, 29)) < share
    labels, count = pixels.label_regions(mask)
    want, number = _flood(mask)
    assert count == number and ((labels > 0) == mask).all()
    assert len({(a, b) for a, b in zip(labels[mask], want[mask])}) == number


def test_edges_of_a_step():
    gray = np.zeros((20, 30))
    gray[:, 15:] = 200.0
    found = pixels.edges(gray)
    assert found.any() and set(np.nonzero(found)[1]) <= {14, 15} and found.sum() == 20
    assert not pixels.edges(np.full((9, 9), 80.0)).any() and not pixels.edges(np.zeros((1, 1))).any()


def test_grey_and_alpha_images():
    assert pixels.decode(1, 2, 1, bytes([7, 9])).tolist() == [[[7, 7, 7], [9, 9, 9]]]
    assert pixels.decode(1, 1, 4, bytes([1, 2, 3, 4])).tolist() == [[[1, 2, 3]]]


def test_report(spark, folder):
    images = scan_images(spark, folder, "smoke.png")
    stats = pixels.image_features(images)
    report = detect.detection_report(detect.detect(stats), pixels.image_regions(images))
    row = report.first()
    assert row.highest_severity == "critical" and len(row.detections) == 3
    assert sorted(d.confidence for d in row.detections) == [0.0, 0.5, 1.0]
    assert {d.issue: d.bbox_count for d in row.detections}["Smoke / Air Pollution"] == 1
    assert len(row.alerts) == 2 and any("smoke_pixels=100.0%" in a for a in row.alerts)
    assert [d.issue for d in row.detections] == [d.issue for d in detect.default_detectors()]
    plain = detect.report_features(stats).first()
    assert plain.alerts == row.alerts and {d.bbox_count for d in plain.detections} == {None}
    body = json.loads(detect.report_json(report).first().report)
    assert set(body) == {"timestamp", "detections", "alerts", "highest_severity"}


def test_stream_equals_batch(spark, folder, tmp_path):
    query = write_detections(stream_images(spark, folder), str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = detect.analyse_images(scan_images(spark, folder)).where("confidence > 0.1 or confidence is null")
    key = lambda df: sorted((_name(r.image_id), r.issue, r.confidence, r.severity) for r in df.collect())
    assert key(got) == key(batch) and got.count() == 9  # with the one that can't be read
    again = write_detections(stream_images(spark, folder), str(tmp_path / "out"), str(tmp_path / "progress"))
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_analysis_reads_images_once(spark, folder):
    images = scan_images(spark, folder)
    plan = detect.analyse_images(images)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan image") == 1 and "Union" not in plan


def test_stream_puts_small_images_together(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i in range(20):
        (tmp_path / "in" / f"{i}.png").write_bytes(png(4, 4, bytes([i] * 48)))
    monkeypatch.setattr(streams, "TASKS_PER_CORE", 1)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a file to a partition
    try:
        write_detections(stream_images(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert spark.read.parquet(str(tmp_path / "out")).select("image_id").distinct().count() == 20
    assert len(list((tmp_path / "out").glob("part-*"))) <= spark.sparkContext.defaultParallelism < 20


def test_image_batches_are_bounded(spark):
    def sizes(parts):
        for batch in parts:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    side = 128
    images = spark.range(0, 600, 1, 1).select(F.struct(
        F.col("id").cast("string").alias("origin"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(3).alias("nChannels"),
        F.lit(16).alias("mode"), F.unhex(F.repeat(F.lit("0A14C8"), side * side)).alias("data")).alias("image"))
    spark.conf.set(batches.SETTING, "64m")
    rows = pixels._image_columns(images).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 600 and max(r["size"] for r in rows) <= 2 * batches.BATCH_BYTES
    stats = pixels.image_features(images).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id", "gray_std").alias("k")).first()
    assert (stats.n, stats.k) == (600, 600)


def test_frame_sample(spark):
    frames = spark.range(100).select(F.when(F.col("id") < 70, "a").otherwise("b").alias("video_id"),
                                     F.when(F.col("id") < 70, F.col("id")).otherwise(F.col("id") - 70).alias("frame_no"))
    got = sorted((r.video_id, r.frame_no) for r in frame_sample(frames, 10, 4).collect())
    assert got == [("a", 0), ("a", 10), ("a", 20), ("a", 30), ("b", 0), ("b", 10), ("b", 20)]
