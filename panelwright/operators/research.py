"""Event studies: matched controls, walk-forward folds and their metrics, paths around events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import average_rank, by_ticker, rolling  # noqa: F401  average_rank is used by the plans


def matched_lift(rows: DataFrame, cells: list[str], treated: str, outcome: str, least: int) -> DataFrame:
    """Outcome rates of treated rows and their controls within cells that have enough of both, and the treated-weighted ratio."""
    t = F.col(treated)
    cell = rows.groupBy(*cells).agg(F.sum(F.when(t, 1).otherwise(0)).alias("n1"), F.sum(F.when(~t, 1).otherwise(0)).alias("n0"), F.avg(F.when(t, F.col(outcome))).alias("r1"), F.avg(F.when(~t, F.col(outcome))).alias("r0"))
    kept = cell.where((F.col("n1") >= least) & (F.col("n0") >= least))
    return kept.agg(F.count("*").alias("cells"), F.try_divide(F.sum(F.col("n1") * F.col("r1")), F.sum("n1")).alias("treated"), F.try_divide(F.sum(F.col("n1") * F.col("r0")), F.sum("n1")).alias("control"))


def walk_forward(rows: DataFrame, at: str, folds: int, gap: int, first: float = 0.3) -> DataFrame:
    """``rows`` once per fold they belong to, as train or test: expanding train, a gap, then equal test blocks after the first share of dates."""
    places = rows.select(at).distinct().withColumn("__o", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at)) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    places = places.withColumn("__n", n)
    begin = F.floor(F.col("__n") * first)
    size = F.floor((F.col("__n") - begin) / folds)
    f = rows.sparkSession.range(folds).withColumnRenamed("id", "fold")
    marked = places.join(F.broadcast(f)).withColumn("__s", begin + F.col("fold") * size)
    part = F.when((F.col("__o") >= F.col("__s")) & (F.col("__o") < F.col("__s") + size), "test").when(F.col("__o") < F.col("__s") - gap, "train")
    return rows.join(marked.withColumn("part", part).where("part is not null").select(at, "fold", "part"), at)


def fold_metrics(rows: DataFrame, by: str, label: str, score: str) -> DataFrame:
    """Per fold: area under the ROC curve (rank sum, ties shared), average precision and Brier score."""
    y, p, n, k, h = F.col(label).cast("int"), F.col(score), F.col("__n"), F.col("__known"), F.col("__h")
    # equal scores are one row with their counts, so a fold is as long as it has different scores
    counts = rows.groupBy(by, score).agg(F.count(F.lit(1)).alias("__n"), F.count(y).alias("__known"), F.coalesce(F.sum(y), F.lit(0)).alias("__h"))
    up, down = Window.partitionBy(by).orderBy(p.asc_nulls_last()), Window.partitionBy(by).orderBy(F.desc(score))
    marked = counts.withColumn("__r", F.when(p.isNotNull(), F.sum(n).over(up) - (n - 1) / 2)).withColumn("__seen", F.sum(n).over(down)).withColumn("__hits", F.sum(h).over(down))
    n1, n0 = F.sum(h), F.sum(k - h)
    square = F.when(p.isNotNull(), (p - 1) * (p - 1) * h + p * p * (k - h))
    return marked.groupBy(by).agg(
        F.sum(n).alias("n"), F.try_divide(F.sum(h * F.col("__r")) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"),
        F.try_divide(F.sum(h * F.col("__hits") / F.col("__seen")), n1).alias("average_precision"), F.try_divide(F.sum(square), F.sum(F.when(p.isNotNull(), k))).alias("brier"),
    )


def normalised_paths(bars: DataFrame, events: DataFrame, before: int = 60, after: int = 126) -> DataFrame:
    """(ticker, launch, step, path): prices around each event's row, as multiples of the price on it. ``events``: ticker and place, from 0."""
    numbered = bars.select("ticker", (F.row_number().over(by_ticker()) - 1).cast("long").alias("place"), "close")
    steps = events.select("ticker", F.col("place").cast("long").alias("launch"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("step"))
    seen = steps.withColumn("place", F.col("launch") + F.col("step")).join(numbered, ["ticker", "place"])
    base = F.max(F.when(F.col("step") == 0, F.col("close"))).over(Window.partitionBy("ticker", "launch"))
    return seen.select("ticker", "launch", "step", F.try_divide("close", base).alias("path"))


def washed_out_now(bars: DataFrame, washout: float, vol: float, reclaim: bool = False, least: int = 300, stale: int = 10) -> DataFrame:
    """(ticker, date, dd252, min_dd_126, rvol126, dist_ma200) of tickers whose last row is volatile after a deep fall.

    Only tickers with ``least`` rows whose last is at most ``stale`` days older than the newest of all count; with
    ``reclaim`` the last row must also have crossed above its average of 50.
    """
    px, by = F.col("close"), by_ticker()
    rows = bars.where("close is not null").select("ticker", "date", "close", F.count("*").over(Window.partitionBy("ticker")).alias("n"), F.coalesce(F.ln(px) - F.ln(F.lag(px).over(by)), F.lit(0.0)).alias("step"),
        (F.try_divide(px, rolling(F.max, px, 252, 120)) - 1).alias("dd252"), (F.try_divide(px, rolling(F.avg, px, 200, 120)) - 1).alias("dist_ma200"), (px > rolling(F.avg, px, 50)).alias("above")).where(F.col("n") >= least)
    rows = rows.withColumn("min_dd_126", rolling(F.min, F.col("dd252"), 126, 40)).withColumn("rvol126", rolling(F.stddev_samp, F.col("step"), 126, 60) * F.sqrt(F.lit(252.0)))
    rows = rows.withColumn("crossed", F.col("above") & ~F.coalesce(F.lag("above").over(by), F.lit(False)))
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("date", "dd252", "min_dd_126", "rvol126", "dist_ma200", "crossed"), "date").alias("x")).select("ticker", "x.*")
    newest = bars.where("close is not null").agg(F.date_sub(F.max("date"), stale).alias("since"))  # one row
    fired = last.join(F.broadcast(newest), F.col("date") >= F.col("since")).where((F.col("min_dd_126") <= -washout) & (F.col("rvol126") >= vol))
    return (fired.where("crossed") if reclaim else fired).drop("since", "crossed")
