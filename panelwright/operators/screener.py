"""The valuation screener: scope first, percentile among fresh filings, then an order that depends on the metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.windows import share_at_most

RISING = ("pe", "ps", "evs", "ev_ebitda", "peg")
FALLING = ("growth", "margin", "rule40")


def in_scope(kind: str, value: str | list[str] | None = None) -> Column:
    """all, sector, theme (in a comma-separated list) or pinned tickers."""
    if kind == "all":
        return F.lit(True)
    if kind == "sector":
        return F.col("sector") == value
    if kind == "theme":
        return F.array_contains(F.split("themes", ","), F.lit(value))
    if kind == "pinned":
        return F.col("ticker").isin(list(value or []))
    raise ValueError(kind)


def screener(rows: DataFrame, metric: str, scope: Column) -> DataFrame:
    """Rows in scope with their percentile among the fresh ones (NULL for others), multiples from low to high, rates from high to low."""
    if metric not in RISING + FALLING:
        raise ValueError(f"metric must be of {RISING + FALLING}")
    x = F.when(F.col("freshness") == "fresh", F.col(metric))
    kept = rows.where(scope).withColumn("__fresh", x.isNotNull())
    ranked = kept.withColumn("percentile", F.when(F.col("__fresh"), share_at_most(x, "__fresh"))).drop("__fresh")
    order = F.asc_nulls_last(metric) if metric in RISING else F.desc_nulls_last(metric)
    return ranked.orderBy(order, "ticker")
