"""Window expressions with the guards that panel series need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def last_rows(n: int, by: WindowSpec | None = None) -> WindowSpec:
    return (by or by_ticker()).rowsBetween(-(n - 1), 0)


def next_rows(h: int, by: WindowSpec | None = None) -> WindowSpec:
    return (by or by_ticker()).rowsBetween(1, h)


def rolling(f: Callable[[Column], Column], x: Column, n: int, least: int | None = None, by: WindowSpec | None = None) -> Column:
    """f over the last n rows where at least ``least`` (n unless given) have a value, else NULL."""
    w = last_rows(n, by)
    return F.when(F.count(x).over(w) >= (least or n), f(x).over(w))


def forward(f: Callable[[Column], Column], x: Column, h: int, by: WindowSpec | None = None) -> Column:
    """f over the next h rows, where all of them exist."""
    w = next_rows(h, by)
    return F.when(F.count(x).over(w) == h, f(x).over(w))


def lagged_return(x: Column, n: int, by: WindowSpec | None = None) -> Column:
    return F.try_divide(x, F.lag(x, n).over(by or by_ticker())) - 1


def log_return(x: Column, by: WindowSpec | None = None) -> Column:
    """ln of a price over the one before, prices held above 1e-9."""
    return F.ln(F.greatest(x, F.lit(1e-9))) - F.ln(F.greatest(F.lag(x).over(by or by_ticker()), F.lit(1e-9)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


# --- percentiles: four definitions, none of which stands for another


def percent_rank_of(x: Column, *by: str) -> Column:
    """SQL's PERCENT_RANK with NULLs last, so a NULL has 1."""
    return F.percent_rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last()))


def average_rank(x: Column, *by: str) -> Column:
    """Rank where ties share their mean place; NULL for NULL."""
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))  # in the same order, so rows are sorted once
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def average_rank_share(x: Column, *by: str) -> Column:
    return average_rank(x, *by) / F.count(x).over(Window.partitionBy(*by))


def position_percentile(x: Column, tie: Column, *by: str) -> Column:
    """100 i / (n - 1) by sorted place; 50 where there is one."""
    n = F.count(x).over(Window.partitionBy(*by))
    i = F.row_number().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last(), tie)) - 1
    return F.when(x.isNotNull(), F.when(n == 1, F.lit(50.0)).otherwise(100.0 * i / F.nullif(n - 1, F.lit(0))))


def share_at_most(x: Column, *by: str) -> Column:
    """round(100 * share of values at most this one)."""
    return F.round(100 * F.cume_dist().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last())))
