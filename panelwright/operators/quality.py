"""Checks of tables and of results against each other: rows of (check, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(rows: DataFrame, **bad: Column) -> DataFrame:
    """One aggregate over the table; one row per check, with how many rows break it."""
    counted = rows.agg(*(F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in bad.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(n, F.lit(0)).alias("detail")) for n in bad))
    return counted.select(F.explode(pairs).alias("x")).select("x.check", (F.col("x.detail") == 0).alias("ok"), "x.detail")


def agree(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows on which two results differ: missing on a side, NULL on one, or further apart than the tolerance."""
    both = a.select(*key, F.col(value).alias("x"), F.lit(True).alias("in_a")).join(b.select(*key, F.col(value).alias("y"), F.lit(True).alias("in_b")), key, "full")
    apart = F.col("in_a").isNull() | F.col("in_b").isNull() | (F.col("x").isNull() != F.col("y").isNull()) | (F.abs(F.col("x") - F.col("y")) > tolerance)
    return both.where(F.coalesce(apart, F.lit(False))).select(*key, "x", "y")
