"""Consistent-hash ring with virtual nodes and bounded loads.

Law `rows`: no shard holds more than the rows divided by the shards, rounded up, and
counts are at most one apart. A document belongs to the first virtual node clockwise
from its ring cell; where that node's shard is full, it goes on clockwise to the next
shard with room. Only DataFrame functions run: loads are counted for each cell of the
ring, the overflow is folded over the virtual nodes in one row (a table whose size is
shards x nodes), and documents look their place up by their rank on the arc.

Defined cases: null text has size 1 and checksum 0; null identifiers hash like any
value; repeated rows are placed like others; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CELLS = 1 << 16
NODES = 64


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int, int, list[int]]]:
    """Arcs (number, first cell, last cell, shards clockwise) in the order in which they are served."""
    points = sorted((zlib.crc32(f"shard {s} node {v}".encode()) % CELLS, s, v) for s in range(shards) for v in range(nodes))
    cells = [p[0] for p in points]
    arcs = []
    for at, (cell, shard, node) in enumerate(points):
        first = 0 if at == 0 else points[at - 1][0] + 1
        clockwise = list(dict.fromkeys(points[(at + k) % len(points)][1] for k in range(len(points))))
        if first <= cell and bisect_left(cells, cell) == at:
            arcs.append(((node, shard), at, first, cell, clockwise))
    if cells[-1] < CELLS - 1:  # beyond the last node the ring begins again
        arcs.append(((nodes, 0), len(points), cells[-1] + 1, CELLS - 1, list(dict.fromkeys(p[1] for p in points))))
    return [a[1:] for a in sorted(arcs)]


def _segments(arcs: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """Fold the arcs' loads over the shards' room: which ranks of an arc go to which shard and slot."""
    loads = arcs.join(totals, "arc", "left").select(F.struct(
        "turn", "arc", "clockwise", F.coalesce("load", F.lit(0)).cast("long").alias("load")).alias("a"))
    one = loads.agg(F.sort_array(F.collect_list("a")).alias("arcs"), F.sum("a.load").alias("total"))
    one = one.withColumn("room", F.expr(
        f"transform(sequence(0, {shards - 1}), s -> cast(total div {shards} + if(s < total % {shards}, 1, 0) as bigint))"))
    piece = "struct<arc:int,first:bigint,last:bigint,shard:int,slot:bigint>"
    folded = F.expr(f"""
      aggregate(arcs, named_struct('room', room, 'out', cast(array() as array<{piece}>)), (st, a) ->
        aggregate(a.clockwise, named_struct('room', st.room, 'out', st.out, 'at', cast(0 as bigint)), (x, s) ->
          if(least(get(x.room, s), a.load - x.at) <= 0, x, named_struct(
            'room', transform(x.room, (r, i) -> if(i = s, r - least(r, a.load - x.at), r)),
            'out', concat(x.out, array(cast(named_struct(
               'arc', a.arc, 'first', x.at, 'last', x.at + least(get(x.room, s), a.load - x.at) - 1,
               'shard', s, 'slot', get(room, s) - get(x.room, s)) as {piece}))),
            'at', x.at + least(get(x.room, s), a.load - x.at))),
          x -> named_struct('room', x.room, 'out', x.out)),
        st -> st.out)""")
    return one.select(F.inline(folded))


def assign(spark: SparkSession, docs: DataFrame, shards: int = 8, nodes: int = NODES) -> DataFrame:
    """Shard and slot of every document; slots of a shard have no gaps."""
    body = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    keyed = keyed.withColumn("place", F.xxhash64("doc_id", "size", "text_crc32"))
    keyed = keyed.withColumn("cell", F.pmod("place", F.lit(CELLS)).cast("int"))

    rows = [(turn, *a) for turn, a in enumerate(ring(shards, nodes))]
    arcs = spark.createDataFrame(rows, "turn int, arc int, low int, high int, clockwise array<int>")
    cells = arcs.select("arc", F.explode(F.sequence("low", "high")).alias("cell"))
    loads = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("load")).join(F.broadcast(cells), "cell")
    before = F.sum("load").over(Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = loads.select("cell", "arc", F.coalesce(before, F.lit(0)).alias("start"))  # one row a cell of the ring
    totals = loads.groupBy("arc").agg(F.sum("load").alias("load"))
    segments = _segments(arcs, totals, shards)

    ranked = keyed.withColumn("rank", F.row_number().over(
        Window.partitionBy("cell").orderBy("place", "doc_id", "text_crc32", "size")) - 1)
    placed = ranked.join(F.broadcast(starts), "cell").withColumn("rank", F.col("start") + F.col("rank"))
    at = (F.col("rank") >= F.col("first")) & (F.col("rank") <= F.col("last"))
    return placed.join(F.broadcast(segments.withColumnRenamed("arc", "segment_arc")),
                       (F.col("arc") == F.col("segment_arc")) & at).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
