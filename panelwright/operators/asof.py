"""Joins in time: as-of, forward fill, point-in-time membership, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, effective: str) -> DataFrame:
    """Each left row with the latest right row whose ``effective`` date is at most ``at`` (or NULLs): one shuffle by key.

    Both sides are laid into one sequence per key; a right row that takes effect on a date comes before that date's
    left rows. The right row travels as one struct, so its NULLs stay NULLs.
    """
    columns = [c for c in right.columns if c != by]
    l = left.select(F.col(by), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*[c for c in left.columns if c != by]).alias("__l"), F.lit(None).cast(right.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("__r"))
    r = right.select(F.col(by), F.col(effective).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(*columns).alias("__r"))
    w = Window.partitionBy(by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return both.select(by, "__l.*", *(F.col(f"__r.{c}").alias(c) for c in columns))


def meet(left: DataFrame, right: DataFrame, by: str, at: str) -> DataFrame:
    """One row for each (by, at) that a side has, with the columns of both, NULL where one has no such row. Neither side has one twice.

    The full join of both, but only ``right`` is dealt out: a ``left`` that lies together by ``by`` already stays where it is.
    """
    right = right.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy(by, at).agg(*(F.max(c).alias(c) for c in both.columns if c not in (by, at)))


def fill_forward(rows: DataFrame, by: str, order: str, *columns: str, limit: int | None = None) -> DataFrame:
    """Last value that is no NULL, at most ``limit`` rows back."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding if limit is None else -limit, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def membership_at(members: DataFrame, day: str) -> DataFrame:
    """Members of each theme on a day: the latest statement up to it, and only then those with an exposure."""
    w = Window.partitionBy("ticker", "theme").orderBy(F.desc("as_of_date"))
    latest = members.where(F.col("as_of_date") <= F.lit(day).cast("date")).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return latest.where("exposure > 0").select("theme", "ticker", "exposure", "as_of_date")


def membership_intervals(members: DataFrame) -> DataFrame:
    """Each statement with the day on which the next one replaces it (far ahead if none does)."""
    w = Window.partitionBy("ticker", "theme").orderBy("as_of_date")
    return members.withColumn("until", F.coalesce(F.lead("as_of_date").over(w), F.lit("9999-12-31").cast("date")))


def split_factor(filings: DataFrame, splits: DataFrame, bars: DataFrame) -> DataFrame:
    """``filings`` with the product of ratios of splits after they took effect, up to the ticker's last bar (1 if none).

    A ticker's few splits meet its filings as one array, so a filing is never multiplied and equal filings stay apart.
    """
    basis = bars.groupBy("ticker").agg(F.max("date").alias("basis"))
    own = splits.join(basis, "ticker").where("ex_date <= basis").groupBy("ticker").agg(F.collect_list(F.struct("ex_date", "ratio")).alias("splits"))
    after = F.filter("splits", lambda s: s.ex_date > F.coalesce("effective_eod_date", "filed_date"))
    total = F.aggregate(after, F.lit(0.0), lambda a, s: a + F.ln(s.ratio))
    return filings.join(own, "ticker", "left").select(*filings.columns, F.coalesce(F.exp(total), F.lit(1.0)).alias("split_factor"))


def reindex(series: DataFrame, key: str, axis: DataFrame, at: str) -> DataFrame:
    """Every key on every date of a short axis, NULL where the series has none."""
    grid = series.select(key).distinct().join(axis.select(at).distinct().withColumn("__one", F.lit(1)).groupBy().agg(F.collect_set(at).alias("__axis")))
    return grid.select(key, F.explode("__axis").alias(at)).join(series, [key, at], "left")
