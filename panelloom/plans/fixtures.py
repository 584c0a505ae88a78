"""Inputs of the registered queries, derived by Spark from the given tables.

The SQL texts are templates over table names so that the same rows can be had
from any engine. Money is summed in whole cents, so sums do not depend on order.
"""

from __future__ import annotations

import re
import struct
import zlib

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.operators.ordering import ranked
from panelloom.sources.storage import scratch_path
from panelloom.sources.tabular import without_nan

TABLES = ("lineitem", "orders", "customer", "nation", "events", "embeddings")

PANEL_SQL = """
WITH agg AS (
  SELECT n.n_nationkey AS k, n.n_name AS country,
         CAST(year(o.o_orderdate) * 4 + quarter(o.o_orderdate) - 6000 AS INT) AS year,
         CAST(count(*) AS DOUBLE) AS n,
         CAST(sum(price) AS DOUBLE) / 100.0E0 AS ext,
         CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN price ELSE 0 END) AS DOUBLE) / 100.0E0 AS ext_r,
         CAST(sum(CASE WHEN l.l_returnflag = 'A' THEN price ELSE 0 END) AS DOUBLE) / 100.0E0 AS ext_a,
         CAST(sum(CASE WHEN l.l_linestatus = 'O' THEN price ELSE 0 END) AS DOUBLE) / 100.0E0 AS ext_o,
         CAST(sum(CAST(floor(l.l_quantity * 100 + 0.5E0) AS BIGINT)) AS DOUBLE) / 100.0E0 AS qty,
         CAST(sum(CAST(floor(l.l_discount * 100 + 0.5E0) AS BIGINT)) AS DOUBLE) / 100.0E0 AS disc,
         CAST(sum(CAST(floor(l.l_tax * 100 + 0.5E0) AS BIGINT)) AS DOUBLE) / 100.0E0 AS tax
  FROM (SELECT *, CAST(floor(l_extendedprice * 100 + 0.5E0) AS BIGINT) AS price FROM {lineitem}) l
  JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {customer} c ON o.o_custkey = c.c_custkey
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2, 3)
SELECT country,
       CASE WHEN k % 12 = 11 THEN NULL
            WHEN k % 12 = 10 THEN concat('OWID_', country)
            ELSE concat('N', lpad(CAST(k AS STRING), 2, '0')) END AS iso_code,
       year,
       n * 1000.0E0 AS population,
       CASE WHEN (k + year) % 13 = 0 THEN NULL ELSE qty * 100.0E0 END AS gdp,
       CASE WHEN (k + year) % 11 = 0 THEN NULL ELSE ext / 1000.0E0 END AS co2,
       CASE WHEN (k + year) % 11 = 0 THEN NULL ELSE ext / (n * 1000.0E0) END AS co2_per_capita,
       ext / (qty * 100.0E0) AS co2_per_gdp,
       qty AS primary_energy_consumption,
       qty / n AS energy_per_capita,
       CASE WHEN k % 5 = 0 THEN NULL ELSE disc END AS methane,
       tax AS nitrous_oxide,
       (ext + ext_r) / 1000.0E0 AS total_ghg,
       disc / n AS temperature_change_from_ghg,
       CASE WHEN (k + year) % 7 = 0 THEN NULL ELSE ext_r / 1000.0E0 END AS coal_co2,
       ext_a / 1000.0E0 AS oil_co2,
       CASE WHEN (k * 3 + year) % 9 = 0 THEN NULL ELSE ext_o / 2500.0E0 END AS gas_co2,
       (ext_r - ext_a) / 1000.0E0 AS land_use_change_co2,
       tax / n AS share_global_co2
FROM agg
"""

IMAGE_FEATURES_SQL = """
SELECT event_id AS image_id,
       CAST(value AS DOUBLE) AS laplacian_var,
       CAST(event_id % 90 AS DOUBLE) AS gray_std,
       CAST(event_id % 101 AS DOUBLE) / 100.0E0 AS smoke_ratio,
       CAST(event_id % 47 AS DOUBLE) / 100.0E0 AS waste_ratio,
       CAST(event_id % 31 AS DOUBLE) / 100.0E0 AS edge_density,
       CAST(event_id % 9 AS DOUBLE) AS entropy,
       CAST(event_id % 37 AS DOUBLE) / 100.0E0 AS green_ratio,
       CAST(event_id % 59 AS DOUBLE) / 100.0E0 AS bare_ratio
FROM {events}
"""

ANOMALY_SCORES_SQL = """
SELECT event_id, user_id AS country, CAST(event_id AS INT) AS year, CAST(value AS DOUBLE) AS co2,
       0.0E0 - CAST(event_id % 60 AS DOUBLE) / 100.0E0 AS if_score,
       event_id % 20 = 0 OR event_id % 7 = 0 AS is_anomaly
FROM {events}
"""

# Palette of the derived images, as (blue, green, red).
PALETTE = ((200, 200, 200), (30, 60, 90), (20, 40, 10), (30, 50, 80),
           (40, 80, 30), (20, 55, 15), (90, 140, 180), (250, 10, 10))
SIDE = 8      # blocks per side; an embedding of 64 numbers fills the grid
BLOCK = 16    # pixels per side of a block


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation-by-quarter panel aggregated from all line items."""
    return without_nan(from_sql(spark, sf_dir, PANEL_SQL))


def panel_paths(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{t}.parquet" for t in TABLES if "{" + t + "}" in PANEL_SQL]


def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, IMAGE_FEATURES_SQL)


def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, ANOMALY_SCORES_SQL)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered per user as video frames, in exact distributed order."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "ts", "event_id")
    numbered = ranked(events, [F.col("ts"), F.col("event_id")], "_n", within=["video_id"])
    return numbered.select("video_id", (F.col("_n") - 1).cast("int").alias("frame_no"), "event_id")


def images(spark: SparkSession, sf_dir: str, block: int = BLOCK) -> DataFrame:
    """One image per embedding: a grid of palette blocks, one per number."""
    palette = F.array(*[F.lit("%02X%02X%02X" % c) for c in PALETTE])
    def colour(v):
        index = F.floor((v.cast("double") + 1) * 1000) % len(PALETTE)
        return F.repeat(F.element_at(palette, index.cast("int") + 1), F.lit(block))
    cells = F.transform("embedding", colour)
    lines = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda y: F.repeat(
        F.array_join(F.slice(cells, y * SIDE + 1, F.lit(SIDE)), ""), F.lit(block)))
    size = F.lit(SIDE * block)
    image = F.struct(
        F.col("vec_id").cast("string").alias("origin"), size.alias("height"), size.alias("width"),
        F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.unhex(F.array_join(lines, "")).alias("data"))
    # An image is a few hundred times its row, so spread the rows before drawing them.
    parts = 4 * spark.sparkContext.defaultParallelism
    rows = table(spark, sf_dir, "embeddings").repartition(parts, "vec_id")
    return rows.select(image.alias("image"))


def png(height: int, width: int, bgr: bytes) -> bytes:
    """Minimal PNG of 8-bit BGR pixels."""
    rgb = bytearray(bgr)
    rgb[0::3], rgb[2::3] = bgr[2::3], bgr[0::3]
    step = width * 3
    raw = b"".join(b"\0" + bytes(rgb[y * step:(y + 1) * step]) for y in range(height))
    def part(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 1)) + part(b"IEND", b"")


def image_folder(spark: SparkSession, sf_dir: str, block: int = BLOCK) -> str:
    """The derived images as PNG files, written by the tasks to the shared folder, on any file system.

    A file has the image's name and appears by a rename, so a repeated task leaves the same files.
    """
    folder = scratch_path(spark, "images")

    def write(rows):
        store, root = FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", folder))
        store.create_dir(root, recursive=True)
        for row in rows:
            target = f"{root}/{row.origin}.png"
            with store.open_output_stream(f"{target}.part") as f:
                f.write(png(row.height, row.width, bytes(row.data)))
            store.move(f"{target}.part", target)

    images(spark, sf_dir, block).select("image.*").foreachPartition(write)
    return folder


def image_name(origin):
    """File name without folder and ending."""
    return F.regexp_extract(origin, r"([^/]+)\.png$", 1)
