"""Theme indices: capped weights in closed form and chained returns with weights of the day before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_ticker
from panelwright.operators.asof import membership_intervals


def capped_weights(members: DataFrame, by: list[str], cap: float = 0.30) -> DataFrame:
    """``members`` (with positive ``exposure``) and a ``weight`` that adds up to 1 and exceeds the cap nowhere, if that can be.

    With exposures in falling order, the k largest are capped for the smallest k that leaves the next one at or below
    the cap when the rest shares what remains; with cap * n <= 1 all weigh the same.
    """
    rows = members.where("exposure > 0")
    # from the smallest up, so that what a row leaves to the rest is a running sum, and not a sum over all later rows anew
    order = Window.partitionBy(*by).orderBy("exposure", F.desc("ticker"))
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("__up", F.row_number().over(order)).withColumn("__tail", F.sum("exposure").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__i", F.col("__n") - F.col("__up") + 1).drop("__up")
    rows = rows.withColumn("__fits", (1 - (F.col("__i") - 1) * cap) * F.try_divide("exposure", "__tail") <= cap + 1e-12)
    first = F.min(F.when(F.col("__fits"), F.col("__i"))).over(whole)
    rows = rows.withColumn("__k", first - 1)
    rest = F.max(F.when(F.col("__i") == first, F.col("__tail"))).over(whole)
    rows = rows.withColumn("__rest", rest)
    weight = F.when(cap * F.col("__n") <= 1, 1 / F.col("__n")).when(F.col("__i") <= F.col("__k"), F.lit(cap)).otherwise((1 - F.col("__k") * cap) * F.try_divide("exposure", "__rest"))
    return rows.withColumn("weight", weight).drop("__i", "__n", "__tail", "__fits", "__k", "__rest")


def _statements(members: DataFrame) -> DataFrame:
    """(theme, __dates): a theme's few restatements, one row a theme."""
    return members.groupBy("theme").agg(F.collect_set("as_of_date").alias("__dates"))


def segment_weights(members: DataFrame, cap: float = 0.30) -> DataFrame:
    """(theme, segment, ticker, weight): weights of the members in force on each date on which a theme is restated."""
    dates = _statements(members)
    held = membership_intervals(members).where("exposure > 0").join(dates, "theme")
    held = held.withColumn("segment", F.explode(F.filter("__dates", lambda d: (d >= F.col("as_of_date")) & (d < F.col("until")))))
    return capped_weights(held.select("theme", "segment", "ticker", "exposure"), ["theme", "segment"], cap).select("theme", "segment", "ticker", "weight")


def chained_index(bars: DataFrame, members: DataFrame, cap: float = 0.30) -> DataFrame:
    """(theme, date, ret, level, log_level): 100 at a theme's first statement, then times one plus the weighted return of members priced on both days.

    A day's weights are those in force on the axis date before it; the axis is all dates of those that were ever members.
    """
    ever = members.where("exposure > 0").select("theme", "ticker").distinct()
    start = _statements(members).select("theme", F.array_min("__dates").alias("start"))
    dates = bars.select("ticker", "date").join(ever, "ticker").select("theme", "date").distinct().join(start, "theme").where("date >= start").select("theme", "date")
    axis = dates.unionByName(start.select("theme", F.col("start").alias("date"))).distinct()
    w = Window.partitionBy("theme").orderBy("date")
    weights = segment_weights(members, cap)
    segments = weights.select("theme", "segment").distinct().withColumn("until", F.coalesce(F.lead("segment").over(Window.partitionBy("theme").orderBy("segment")), F.lit("9999-12-31").cast("date")))
    days = axis.withColumn("before", F.lag("date").over(w))
    days = days.join(segments.withColumnRenamed("theme", "__t"), (F.col("theme") == F.col("__t")) & (F.col("segment") <= F.col("before")) & (F.col("before") < F.col("until"))).select("theme", "date", "before", "segment")
    # a member is priced on both days where its last bar lies on the axis date before; a ticker's bars are put in order once, not once a theme
    steps = bars.select("ticker", "date", F.col("adj_close").alias("p1"), F.lag("date").over(by_ticker()).alias("before"), F.lag("adj_close").over(by_ticker()).alias("p0"))
    priced = steps.where("p0 is not null and p1 is not null").join(F.broadcast(days), ["date", "before"])  # one row a theme and date
    held = priced.join(weights, ["theme", "segment", "ticker"])
    moves = held.groupBy("theme", "date").agg(F.try_divide(F.sum(F.col("weight") * (F.col("p1") / F.col("p0") - 1)), F.sum("weight")).alias("ret"))
    path = axis.join(moves, ["theme", "date"], "left")
    growth = F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(w)
    return path.select("theme", "date", "ret", (100 * F.exp(growth)).alias("level"), (F.ln(F.lit(100.0)) + growth).alias("log_level"))
