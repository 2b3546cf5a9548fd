"""Trailing-four-quarter fundamentals from raw filing facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def earliest_filed(facts: DataFrame, *key: str) -> DataFrame:
    """Of facts that restate a period, the one filed first."""
    return facts.groupBy(*key).agg(F.min_by("val", F.struct("filed", "val")).alias("val"), F.min("filed").alias("filed"))


def span_kind(facts: DataFrame) -> DataFrame:
    """Adds ``span``: quarter (80 to 100 days), annual (340 to 380) or other."""
    days = F.datediff("end", "start")
    return facts.withColumn("span", F.when(days.between(80, 100), "quarter").when(days.between(340, 380), "annual").otherwise("other"))


def single_quarters(facts: DataFrame, differencing: bool = True) -> DataFrame:
    """(entity, metric, end, val, filed): direct quarters, else differences of year-to-date facts, else annual less three quarters.

    Year-to-date facts share a start; neighbours 80 to 100 days apart differ by one quarter. A fourth quarter is
    derived where an annual period holds exactly three single ones and none ends with it.
    """
    first = span_kind(earliest_filed(facts, "entity", "metric", "start", "end"))
    key = ["entity", "metric", "end"]
    direct = earliest_filed(first.where("span = 'quarter'"), *key)
    singles = direct
    if differencing:
        w = Window.partitionBy("entity", "metric", "start").orderBy("end")
        step = first.withColumn("p", F.lag("val").over(w)).withColumn("pe", F.lag("end").over(w)).where(F.datediff("end", "pe").between(80, 100))
        derived = step.groupBy(*key).agg(F.min_by(F.col("val") - F.col("p"), F.struct("filed", "start")).alias("val"), F.min("filed").alias("filed"))
        singles = direct.unionByName(derived.join(direct.select(*key), key, "left_anti"))
    annual = first.where("span = 'annual'").groupBy(*key).agg(F.min_by(F.struct("start", "val"), F.struct("filed", "val")).alias("a"), F.min("filed").alias("afiled"))
    inner = singles.select(F.col("entity").alias("e"), F.col("metric").alias("m"), F.col("end").alias("qe"), F.col("val").alias("q"))
    inside = (F.col("entity") == F.col("e")) & (F.col("metric") == F.col("m")) & (F.col("qe") >= F.col("a.start")) & (F.col("qe") < F.col("end"))
    fourth = annual.join(inner, inside).groupBy(*key, "a", "afiled").agg(F.count("*").alias("n"), F.sum("q").alias("s")).where("n = 3")
    fourth = fourth.select(*key, (F.col("a.val") - F.col("s")).alias("val"), F.col("afiled").alias("filed")).join(singles.select(*key), key, "left_anti")
    return singles.unionByName(fourth)


def trailing_four(singles: DataFrame) -> DataFrame:
    """Sum of four quarters whose ends span 250 to 295 days, filed when the last of them was."""
    w = Window.partitionBy("entity", "metric").orderBy("end").rowsBetween(-3, 0)
    rows = singles.withColumn("ttm", F.sum("val").over(w)).withColumn("n", F.count("val").over(w)).withColumn("f", F.min("end").over(w)).withColumn("filed", F.max("filed").over(w))
    return rows.where((F.col("n") == 4) & F.datediff("end", "f").between(250, 295)).select("entity", "metric", "end", "ttm", "filed")


def with_annual(ttm: DataFrame, facts: DataFrame) -> DataFrame:
    """``trailing_four`` and, at ends that have none, the annual value."""
    key = ["entity", "metric", "end"]
    annual = span_kind(earliest_filed(facts, "entity", "metric", "start", "end")).where("span = 'annual'").groupBy(*key).agg(F.min_by("val", F.struct("filed", "val")).alias("ttm"), F.min("filed").alias("filed"))
    return ttm.unionByName(annual.join(ttm.select(*key), key, "left_anti").select(*ttm.columns))


def ebitda(parts: DataFrame) -> DataFrame:
    """(entity, end, ebitda) from trailing parts, one column each: operating income if the filer has any, else pretax
    plus interest; depreciation and amortisation together if the filer has that, else the two added."""
    by = Window.partitionBy("entity")
    has = lambda c: F.max(F.col(c).isNotNull()).over(by)
    ebit = F.when(has("operating_income"), F.col("operating_income")).otherwise(F.col("pretax") + F.coalesce("interest", F.lit(0.0)))
    da = F.when(has("dep_amort"), F.col("dep_amort")).otherwise(F.col("depreciation") + F.coalesce("amortisation", F.lit(0.0)))
    return parts.select("entity", "end", (ebit + da).alias("ebitda"))
