"""Deterministic sorting and paging of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.operators.stats import TOP_K_ROWS, slice_rows
from occurra.session import counted_stage

SORT_COLUMNS = ("name", "mass", "formula", "taxon_name", "pub_year", "ref_title")


def sort_order(column: str, direction: str, position: str) -> list[Column]:
    """absent first going up; going down is the exact reverse, ties too."""
    if column not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {column!r}")
    key, pos = F.col(column), F.col(position)
    if direction == "asc":
        return [key.asc_nulls_first(), pos.asc_nulls_first()]
    return [key.desc_nulls_last(), pos.desc_nulls_last()]


def sort_rows(df: DataFrame, column: str, direction: str = "asc", position: str = "statement") -> DataFrame:
    """Range-partitioned global sort; ``position`` carries the input order."""
    return df.orderBy(*sort_order(column, direction, position))


def page_bounds(total: int, first: int, size: int, overscan: int) -> tuple[int, int]:
    start = max(min(first, total) - overscan, 0)
    return start, min(start + size + 2 * overscan, total)


def page(
    df: DataFrame, order: list[Column], first: int, size: int, overscan: int = 0, total: int | None = None
) -> DataFrame:
    """a window of rows with some rows around it.

    A page near the start is a top-k. Further in, rows are laid out by range and
    only the ranges around the page are sorted, so no task gathers what precedes it.
    """
    if total is None:
        df, total = counted_stage(df, "rows")
    start, end = page_bounds(total, first, size, overscan)
    if end <= TOP_K_ROWS:
        return df.orderBy(*order).limit(end).offset(start)
    return slice_rows(df, order, start, end).orderBy(*order)


def page_after(df: DataFrame, column: str, last_key: str | None, size: int) -> DataFrame:
    """F5, keyset form on a unique column: the ``size`` rows after ``last_key``."""
    if last_key is not None:
        df = df.filter(F.col(column) > F.lit(last_key))
    return df.orderBy(F.col(column)).limit(size)
