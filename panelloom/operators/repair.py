"""Null repair: fills along each key's series, zeros, infinities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelloom.functions.exprs import finite
from panelloom.operators import filters
from panelloom.operators.chunks import CHUNK, across_chunks, cells, chunk_window, with_chunk
from panelloom.spec import PanelSpec


def _known(columns, spec, pick):
    """Value at the first or last period where each column is known."""
    return [pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(spec.time))) for c in columns]


def fill(df: DataFrame, spec: PanelSpec, columns: list[str], back: bool = True,
         zero: bool = False) -> DataFrame:
    """Forward fill per key, then optionally back fill and zero.

    Within a chunk the fill is a running window. What the chunk inherits (the
    last known value of any earlier chunk) and the first known value of the key
    come from the per-chunk table. After a forward fill only the leading rows of
    a key can be null, so the back fill is that first known value.
    """
    keep = CHUNK in df.columns
    base = with_chunk(df, spec)
    lasts = [a.alias(f"_last_{c}") for a, c in zip(_known(columns, spec, F.max_by), columns)]
    firsts = [a.alias(f"_first_{c}") for a, c in zip(_known(columns, spec, F.min_by), columns)]
    table = cells(base, spec, *lasts, *(firsts if back else []))
    w = across_chunks(spec)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = table.select(
        spec.key, CHUNK,
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns],
        *([F.first(f"_first_{c}", ignorenulls=True).over(whole).alias(f"_key_{c}") for c in columns]
          if back else []))
    running = chunk_window(spec).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumns({c: F.last(c, ignorenulls=True).over(running) for c in columns})
    joined = rows.join(carried, [spec.key, CHUNK])
    steps = lambda c: [F.col(c), F.col(f"_in_{c}")] + ([F.col(f"_key_{c}")] if back else []) \
        + ([F.lit(0.0)] if zero else [])
    out = joined.select(*[F.coalesce(*steps(c)).alias(c) if c in columns else c for c in base.columns])
    return out if keep else out.drop(CHUNK)


def ffill(df: DataFrame, spec: PanelSpec, columns: list[str] | None = None) -> DataFrame:
    return fill(df, spec, columns or spec.present(df.columns), back=False)


def bfill(df: DataFrame, spec: PanelSpec, columns: list[str] | None = None) -> DataFrame:
    """Forward fill, then leading nulls from the next known value."""
    return fill(df, spec, columns or spec.present(df.columns))


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0.0, subset=columns)


def inf_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def select_rows(df: DataFrame, spec: PanelSpec, start: int) -> DataFrame:
    """The row and column filters of the cleaning step; all reach the scan."""
    rows = filters.year_filter(filters.sovereign_filter(df, spec), spec, start)
    return filters.drop_all_null(filters.prune_columns(rows, spec), spec)


def clean(df: DataFrame, spec: PanelSpec, start: int = 1990, back: bool = True) -> DataFrame:
    """Filter, prune and fill every feature; whole rows are exchanged once."""
    rows = select_rows(df, spec, start)
    return fill(rows, spec, spec.present(rows.columns), back=back, zero=True)
