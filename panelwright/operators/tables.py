"""Keyed maintenance of tables: pure functions of the old rows and the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_keep_first(old: DataFrame, new: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """New attributes win and ``last`` moves on; a key seen before keeps its ``first``."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there = F.col(f"n.{key}").isNotNull()
    columns = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in old.columns:
        if c == first:
            columns.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c != key:
            columns.append(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*columns)


def replace_entities(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the incoming keys go; the incoming rows come. Columns only one side has are NULL on the other."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def rebuild_scope(old: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """Rows in the scope go, the new ones come; columns that only one side has are NULL on the other."""
    return old.where(~F.coalesce(scope, F.lit(False))).unionByName(new, allowMissingColumns=True)


def insert_or_replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row per primary key, the incoming one if there is one."""
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "__seq")]
    w = Window.partitionBy(*key).orderBy(F.desc("__seq"), *rest)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__seq")


def largest_of(rows: DataFrame, key: str, amount: str, *order: str) -> DataFrame:
    """Per key the row with the largest amount (NULL is 0), the first by ``order`` among equals."""
    w = Window.partitionBy(key).orderBy(F.coalesce(F.col(amount), F.lit(0.0)).desc(), *order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def evolved(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both in the columns named, in that order: what a side lacks is NULL there, what isn't named goes. Names decide, not places."""
    return old.select(*(c for c in columns if c in old.columns)).unionByName(new.select(*(c for c in columns if c in new.columns)), allowMissingColumns=True).select(*columns)
