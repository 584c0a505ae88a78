"""Per-key windows that survive a key holding a third of the table.

A key's series is cut into chunks of ``spec.span`` periods. Windows run on
(key, chunk), so their groups are bounded. The rows a window needs from before the
chunk are its *history*: the last ``depth`` rows that precede it. They are few, travel
in a table with one row per key and chunk, and join the chunk's rows where those
already are. What reaches across any distance (fills, positions, totals) is carried on
such a table too. Keys and periods are not null and (key, period) is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.spec import PanelSpec

CHUNK = "_chunk"
HISTORY = "_history"
_REV = "_rev"


def with_chunk(df: DataFrame, spec: PanelSpec) -> DataFrame:
    if CHUNK in df.columns:
        return df
    t = F.col(spec.time).cast("bigint")
    start = t - F.pmod(t, F.lit(spec.span).cast("bigint"))
    return df.withColumn(CHUNK, F.floor(start / F.lit(spec.span)))


def chunk_window(spec: PanelSpec, *order: Column):
    return Window.partitionBy(spec.key, CHUNK).orderBy(*(order or (F.col(spec.time),)))


def across_chunks(spec: PanelSpec):
    """Window over the count table: one row per chunk of the key."""
    return Window.partitionBy(spec.key).orderBy(CHUNK)


def cells(df: DataFrame, spec: PanelSpec, *aggs: Column) -> DataFrame:
    """One row per (key, chunk) with its row count; combined before the shuffle."""
    return (with_chunk(df, spec).groupBy(spec.key, CHUNK)
            .agg(F.count(F.lit(1)).alias("_n"), *aggs))


def histories(base: DataFrame, spec: PanelSpec, depth: int) -> DataFrame:
    """(key, chunk, _history): the ``depth`` rows before each chunk, oldest first.

    Every chunk in the table has a row, so they lie within the ``depth`` chunks before
    it. The row-number filter is limited on the map side.
    """
    columns = [c for c in base.columns if c not in (spec.key, CHUNK)]
    last = base.withColumn(_REV, F.row_number().over(chunk_window(spec, F.col(spec.time).desc()))).where(F.col(_REV) <= depth)
    tails = last.groupBy(spec.key, CHUNK).agg(
        F.sort_array(F.collect_list(F.struct(F.col(spec.time).alias("_at"), F.struct(*columns).alias("_row")))).alias("_tail"))
    before = F.flatten(F.collect_list("_tail").over(across_chunks(spec).rowsBetween(-depth, -1)))
    newest = F.slice("_before", F.greatest(F.size("_before") - depth + 1, F.lit(1)), depth)
    return tails.withColumn("_before", before).select(
        spec.key, CHUNK, F.transform(newest, lambda r: r["_row"]).alias(HISTORY))


def with_history(df: DataFrame, spec: PanelSpec, depth: int) -> DataFrame:
    """Rows plus the ``depth`` rows before each chunk, marked in ``_history``.

    A chunk's first row unfolds into its history and itself, in its own task: the only
    exchange of whole rows is the one on (key, chunk).
    """
    base = with_chunk(df, spec)
    columns = [c for c in base.columns if c not in (spec.key, CHUNK)]
    rows = (base.join(histories(base, spec, depth), [spec.key, CHUNK])
            .withColumn(_REV, F.row_number().over(chunk_window(spec))))
    own = F.array(F.struct(*columns, F.lit(False).alias(HISTORY)))
    older = F.transform(HISTORY, lambda r: F.struct(*[r[c].alias(c) for c in columns], F.lit(True).alias(HISTORY)))
    unfolded = rows.select(spec.key, CHUNK, F.inline(F.when(F.col(_REV) == 1, F.concat(older, own)).otherwise(own)))
    return unfolded.select(*base.columns, HISTORY)


def drop_history(df: DataFrame, keep_chunk: bool = False) -> DataFrame:
    out = df.where(~F.col(HISTORY)).drop(HISTORY)
    return out if keep_chunk else out.drop(CHUNK)


def over_history(df: DataFrame, spec: PanelSpec, depth: int, columns: dict) -> DataFrame:
    """Add window columns that look at most ``depth`` rows back.

    ``columns`` maps a name to a function of the (key, chunk) window.
    """
    keep = CHUNK in df.columns
    w = chunk_window(spec)
    rows = with_history(df, spec, depth).withColumns({name: build(w) for name, build in columns.items()})
    return drop_history(rows, keep)


def key_totals(df: DataFrame, spec: PanelSpec, name: str = "_rows") -> DataFrame:
    """Attach each key's row count, joined per chunk so a hot key stays split."""
    keep = CHUNK in df.columns
    base = with_chunk(df, spec)
    per_key = Window.partitionBy(spec.key)
    totals = cells(base, spec).select(spec.key, CHUNK, F.sum("_n").over(per_key).alias(name))
    out = base.join(totals, [spec.key, CHUNK])
    return out if keep else out.drop(CHUNK)


def positions(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Attach ``_pos`` (0-based row number in the key) and ``_rows`` (its total)."""
    keep = CHUNK in df.columns
    base = with_chunk(df, spec)
    w = across_chunks(spec)
    starts = cells(base, spec).select(
        spec.key, CHUNK,
        (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"),
        F.sum("_n").over(Window.partitionBy(spec.key)).alias("_rows"))
    out = (base.withColumn("_pos", F.row_number().over(chunk_window(spec)))
           .join(starts, [spec.key, CHUNK])
           .withColumn("_pos", F.col("_start") + F.col("_pos") - 1)
           .drop("_start"))
    return out if keep else out.drop(CHUNK)


def last_rows(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    """The last ``n`` rows of every key, with ``_rev`` = 1 for the newest.

    A row-number filter is limited on the map side (window group limit), so a
    hot key sends at most ``n`` rows per map task.
    """
    w = Window.partitionBy(spec.key).orderBy(F.col(spec.time).desc())
    return df.withColumn(_REV, F.row_number().over(w)).where(F.col(_REV) <= n)
