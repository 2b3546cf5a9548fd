"""Multiples from filings in force, aligned for splits; percentiles among filings of one vintage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import position_percentile
from panelwright.operators.asof import as_of

METRICS = ("pe", "ps", "evs", "ev_ebitda", "peg", "growth", "margin", "rule40")


def with_growth(filings: DataFrame) -> DataFrame:
    """Growth over the filing four periods earlier, if that lies 330 to 400 days back; margin where there is revenue."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    span = F.datediff("period_end", F.lag("period_end", 4).over(w))
    growth = F.when(span.between(330, 400), F.try_divide("revenue_ttm", F.lag("revenue_ttm", 4).over(w)) - 1)
    return filings.withColumn("growth", growth).withColumn("margin", F.when(F.col("revenue_ttm") > 0, F.col("ebitda_ttm") / F.col("revenue_ttm")))


def valuation(bars: DataFrame, filings: DataFrame, *carried: str, unfiled: bool = False) -> DataFrame:
    """One row per bar from the first filing in force on: multiples are NULL where their sign makes no sense.

    ``filings`` carry ``split_factor`` (asof.split_factor) and growth (with_growth); shares and earnings are brought
    to the price's basis with it. Columns of ``bars`` are carried along; with ``unfiled``, bars of no filing stay too.
    """
    filed = filings.withColumn("in_force", F.coalesce("effective_eod_date", "filed_date"))
    # dealt as the bars are, so the few filings move and the bars stay
    filed = filed.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker")
    rows = as_of(bars.select("ticker", "date", "close", "adj_close", *carried), filed, "ticker", "date", "in_force")
    rows = rows if unfiled else rows.where("revenue_ttm is not null and shares is not null")
    cap = F.col("adj_close") * F.col("shares") * F.col("split_factor")
    ev = cap + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    earns, sells, shares = F.col("eps_ttm") > 0, F.col("revenue_ttm") > 0, F.col("shares") > 0
    pe = F.when(earns, F.col("adj_close") * F.col("split_factor") / F.col("eps_ttm"))
    return rows.select(
        *("ticker", "date", "close"), pe.alias("pe"), F.when(sells & shares, cap / F.col("revenue_ttm")).alias("ps"),
        F.when(sells & shares, ev / F.col("revenue_ttm")).alias("evs"), F.when((F.col("ebitda_ttm") > 0) & shares, ev / F.col("ebitda_ttm")).alias("ev_ebitda"),
        F.when((F.col("growth") > 0) & earns, pe / (100 * F.col("growth"))).alias("peg"), "growth", "margin", (100 * (F.col("growth") + F.col("margin"))).alias("rule40"),
        F.col("period_end").alias("as_of_period_end"), F.col("filed_date").alias("as_of_filed"), F.col("effective_eod_date").alias("as_of_effective_eod"), *carried,
    )


def freshness(age: Column) -> Column:
    """fresh up to 95 days, stale up to 160, overdue beyond; NULL for NULL."""
    return F.when(age.isNull(), None).when(age <= 95, "fresh").when(age <= 160, "stale").otherwise("overdue")


def latest(rows: DataFrame, key: str, at: str, until: str | None = None) -> DataFrame:
    """The last row of each key up to a day."""
    kept = rows if until is None else rows.where(F.col(at) <= F.lit(until).cast("date"))
    columns = [c for c in rows.columns if c != key]
    return kept.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(at)).alias("x")).select(key, "x.*")


def vintage_percentile(rows: DataFrame, metric: str, day: str) -> DataFrame:
    """Percentile of a metric among fresh filings on a day, which share an age of at most 95 days."""
    if metric not in METRICS:
        raise ValueError(f"metric must be of {METRICS}")
    on = rows.where((F.col("date") == F.lit(day).cast("date")) & F.col(metric).isNotNull()).withColumn("age", F.datediff("date", "as_of_period_end")).where("age <= 95")
    return on.select("ticker", metric, "age", position_percentile(F.col(metric), F.col("ticker")).alias("percentile"))
