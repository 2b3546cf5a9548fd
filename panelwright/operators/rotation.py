"""Weekly relative strength of buckets, their state and league table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import lagged_return, rolling
from panelwright.operators.series import ema_array, ordered_values, week_ending


def weekly(rows: DataFrame, *by: str) -> DataFrame:
    """Last close of each week, by the Friday that ends it."""
    return rows.where("close is not null").groupBy(*by, week_ending(F.col("date")).alias("week")).agg(F.max_by("close", "date").alias("close"))


def relative_strength(buckets: DataFrame, spx: DataFrame, n: int = 10, k: float = 10.0) -> DataFrame:
    """(bucket, week, rs, rs_ratio): ratio to the benchmark on common weeks, smoothed and scaled by its own mean and deviation."""
    common = weekly(buckets, "bucket").join(weekly(spx).withColumnRenamed("close", "base"), "week").withColumn("rs", 100 * F.try_divide("close", "base"))
    s = ordered_values(common, "bucket", "week", "rs").where(F.size("s") >= 2 * n)
    smooth = s.withColumn("m", ema_array(F.transform("s", lambda p: p.x), n))
    rows = smooth.select("bucket", F.explode(F.arrays_zip("s", "m")).alias("p")).select("bucket", F.col("p.s.t").alias("week"), F.col("p.s.x").alias("rs"), F.col("p.m").alias("m"))
    by = Window.partitionBy("bucket").orderBy("week")
    mean, sd = rolling(F.avg, F.col("m"), n, by=by), rolling(F.stddev_samp, F.col("m"), n, by=by)
    return rows.select("bucket", "week", "rs", (100 + k * F.try_divide(F.col("m") - mean, F.nullif(sd, F.lit(0.0)))).alias("rs_ratio")).where("rs_ratio is not null")


def states(rs: DataFrame) -> DataFrame:
    """(bucket, week, level, slope_4w, state) at each bucket's last week."""
    by = Window.partitionBy("bucket").orderBy("week")
    rows = rs.withColumn("slope_4w", F.coalesce(F.col("rs_ratio") - F.lag("rs_ratio", 4).over(by), F.lit(0.0)))
    last = rows.groupBy("bucket").agg(F.max_by(F.struct("week", "rs_ratio", "slope_4w"), "week").alias("x")).select("bucket", "x.week", F.col("x.rs_ratio").alias("level"), "x.slope_4w")
    high, rising = F.col("level") >= 100, F.col("slope_4w") >= 0
    return last.withColumn("state", F.when(high & rising, "LEADING").when(high, "WEAKENING").when(rising, "IMPROVING").otherwise("LAGGING"))


def breadth(rows: DataFrame, members: DataFrame, min_bars: int = 60) -> DataFrame:
    """(bucket, member_count, breadth_ma50, breadth_ma200, at_high, candidates) on the last day that ``rows`` has.

    Members with at least ``min_bars`` bars (column n_bars) count; a missing close or average counts against.
    """
    day = rows.agg(F.max("date").alias("date"))
    last = rows.where(F.col("n_bars") >= min_bars).join(F.broadcast(day), "date", "left_semi")
    rows = members.where("bucket is not null").select("bucket", "ticker").distinct().join(last, "ticker")
    return rows.groupBy("bucket").agg(
        F.count("*").alias("member_count"),
        *((100 * F.avg(F.when(F.col("close") > F.col(m), 1.0).otherwise(0.0))).alias(f"breadth_{m}") for m in ("ma50", "ma200")),
        F.sum(F.when(F.col("high_prox") >= 0.99, 1).otherwise(0)).alias("at_high"), F.sum(F.when(F.col("candidate") == 1, 1).otherwise(0)).alias("candidates"),
    )


def relative_returns(buckets: DataFrame, spx: DataFrame, **horizons: int) -> DataFrame:
    """(bucket, one column per horizon): a bucket's return over its last n rows less the benchmark's over the same days.

    The benchmark is carried forward onto the bucket's days; NULL where there are no more than n rows.
    """
    by = Window.partitionBy("bucket").orderBy("date")
    rows = buckets.select("bucket", "date", "close").join(spx.select("date", F.col("close").alias("base")), "date", "left").withColumn("base", F.last("base", ignorenulls=True).over(by))
    rel = [(lagged_return(F.col("close"), n, by) - lagged_return(F.col("base"), n, by)).alias(name) for name, n in horizons.items()]
    last = rows.select("bucket", "date", *rel)
    return last.groupBy("bucket").agg(F.max_by(F.struct(*horizons), "date").alias("x")).select("bucket", "x.*")
