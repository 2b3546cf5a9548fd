"""Per-date cross-sections: percentile family, rank correlation, concentration, bins, overlaps and quantile picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import average_rank, average_rank_share, percent_rank_of, position_percentile, share_at_most


def percentile_family(rows: DataFrame, value: str, by: str, tie: str) -> DataFrame:
    x = F.col(value)
    return rows.select(by, tie, percent_rank_of(x, by).alias("sql_rank"), average_rank_share(x, by).alias("rank_share"), position_percentile(x, F.col(tie), by).alias("position_pct"), share_at_most(x, by).alias("at_most_pct"))


def spearman(rows: DataFrame, x: str, y: str, by: str, least: int) -> DataFrame:
    """Rank correlation per group with at least so many pairs."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", average_rank(F.col(x), by)).withColumn("ry", average_rank(F.col(y), by))
    return both.groupBy(by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("ic")).where(F.col("n") >= least)


def concentration(rows: DataFrame, group: str, amount: str, k: int = 3) -> DataFrame:
    """One row: Gini of the groups' shares and the share of the k largest. Groups are few once they are summed."""
    total = rows.groupBy(group).agg(F.sum(F.col(amount).cast("decimal(28,2)")).cast("double").alias("v"))
    whole = total.groupBy().agg(F.sum("v").alias("t"), F.count("*").alias("n"))
    one = F.lit(0)
    ranked = total.withColumn("i", F.row_number().over(Window.partitionBy(one).orderBy("v", group))).withColumn("j", F.row_number().over(Window.partitionBy(one).orderBy(F.desc("v"), group)))
    share = F.col("v") / F.col("t")
    return ranked.crossJoin(F.broadcast(whole)).groupBy().agg(F.sum((2 * F.col("i") - F.col("n") - 1) * share / F.col("n")).alias("gini"), F.sum(F.when(F.col("j") <= k, share)).alias("top_share"))


def binned(rows: DataFrame, value: str, edges: list[float], measure: str, least: int) -> DataFrame:
    """Half-open bins [lo, hi): count and mean of a measure, where there are enough rows."""
    which: Column = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        which = F.when((F.col(value) >= edges[i]) & (F.col(value) < edges[i + 1]), i).otherwise(which)
    return rows.withColumn("bin", which).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(measure).alias("mean")).where(F.col("n") >= least)


def overlap(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Per group: Jaccard of two flags, and the overlap that chance would give sets of their sizes."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(x).alias("k1"), F.sum(y).alias("k2"), F.sum(x * y).alias("both"))
    return g.select(by, F.try_divide("both", F.col("k1") + F.col("k2") - F.col("both")).alias("jaccard"), (F.col("k1") * F.col("k2") / F.col("n")).alias("by_chance"))


def tails(rows: DataFrame, value: str, by: str, share: float = 0.10, least: int = 5) -> DataFrame:
    """Adds ``tail``: top or bottom, for the max(least, share of n) largest and smallest of each group that has a value."""
    have = rows.where(F.col(value).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    k = F.greatest(F.lit(least), F.floor(n * share))
    up = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), "ticker"))
    down = F.row_number().over(Window.partitionBy(by).orderBy(F.asc(value), "ticker"))
    return have.withColumn("tail", F.when(up <= k, "top").when(down <= k, "bottom"))
