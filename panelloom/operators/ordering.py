"""Global order without a single-task window: exact positions, top-k, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.functions.exprs import severity_rank
from panelloom.sources.storage import stage
from panelloom.spec import PanelSpec

_ID_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def ranked(df: DataFrame, order: list[Column], name: str = "rank",
           within: list[str] | None = None) -> DataFrame:
    """Exact 1-based position in a total order, in equal-sized range partitions.

    The rows are range-partitioned and sorted by ``within`` + ``order``, numbered
    inside their partition, and written once; a table with one row per partition
    (and group) then supplies the offsets. No task sees more than its range.
    ``order`` must be total.
    """
    groups = within or []
    keys = [F.col(c) for c in groups] + list(order)
    sort = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = stage(sort.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    numbered = numbered.withColumn("_part", F.shiftright("_id", _ID_BITS))
    sizes = numbered.groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # One row per range partition: bounded by the number of shuffle partitions.
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_part")
    offsets = sizes.select(
        "_part", *groups, "_first",
        (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"))
    return (numbered.join(offsets, ["_part", *groups])
            .withColumn(name, (F.col("_offset") + F.col("_id") - F.col("_first") + 1).cast("bigint"))
            .drop("_part", "_id", "_first", "_offset"))


def sort_key_time(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.orderBy(spec.key, spec.time)


def top_k(df: DataFrame, column: str, n: int, tiebreak: list[str], largest: bool = True) -> DataFrame:
    """n largest or smallest non-null values; planned as TakeOrderedAndProject."""
    c = F.col(column)
    order = c.desc() if largest else c.asc()
    return df.where(c.isNotNull()).orderBy(order, *tiebreak).limit(n)


def severity_sort(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Flagged rows, most severe first; ties by key and time."""
    return (df.where("is_anomaly")
            .orderBy(severity_rank(F.col("severity")), spec.key, spec.time))


def severity_head(df: DataFrame, spec: PanelSpec, n: int = 15) -> DataFrame:
    return severity_sort(df, spec).limit(n)


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[tuple[str, bool]], n: int) -> DataFrame:
    """Last n rows of an order given as (column, ascending) pairs."""
    back = [F.col(c).desc() if asc else F.col(c).asc() for c, asc in order]
    return df.orderBy(*back).limit(n)


def stack_tagged(parts: dict[str, DataFrame], name: str = "type") -> DataFrame:
    """Bag union by column name, each part tagged with a constant."""
    out = None
    for tag, part in parts.items():
        tagged = part.withColumn(name, F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged)
    return out
