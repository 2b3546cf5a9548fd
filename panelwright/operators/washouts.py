"""Deep falls and the turn out of them: events, what follows them, and the funnel of names that stand there now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_ticker, lagged_return, rolling
from panelwright.operators.series import spaced_events


def washout_events(rows: DataFrame, fall: float, h: int, embargo: int, turn: bool = True) -> DataFrame:
    """(ticker, date, i, fwd, fwd_trough, base, dd): days on which a series that fell by ``fall`` within 63 rows crosses above its average of 50.

    ``fwd`` is the return of the next h rows, ``fwd_trough`` the lowest close until then against the day's, ``base`` the
    mean of the series' own returns over h rows whenever they begin. Events lie h + ``embargo`` rows apart, have 252
    rows before and h behind them, and come from series of 252 + h + 5 rows. Without ``turn`` the fall is enough.
    """
    px, by = F.col("close"), by_ticker()
    full = rows.where("close is not null").select("ticker", "date", "close", (F.row_number().over(by) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("n"),
        (F.try_divide(px, rolling(F.max, px, 252, 200)) - 1).alias("dd"), rolling(F.avg, px, 50).alias("ma50"), (F.try_divide(F.lead(px, h).over(by), px) - 1).alias("fwd"),
        F.when(F.lead(px, h).over(by).isNotNull(), F.try_divide(F.min(px).over(by.rowsBetween(0, h)), px) - 1).alias("fwd_trough"))
    crossed = F.coalesce((px > F.col("ma50")) & (F.lag(px).over(by) <= F.lag("ma50").over(by)), F.lit(False))
    full = full.withColumn("washed", F.coalesce(rolling(F.min, F.col("dd"), 63, 20) <= -fall, F.lit(False))).withColumn("crossed", crossed).withColumn("base", F.avg("fwd").over(Window.partitionBy("ticker")))
    signal = full.where((F.col("n") >= 252 + h + 5) & F.col("washed") & (F.col("crossed") | F.lit(not turn)) & (F.col("i") >= 252) & F.col("fwd").isNotNull())
    kept = spaced_events(signal.select("ticker", "i"), "ticker", "i", h + embargo)
    return signal.join(kept, ["ticker", "i"]).select("ticker", "date", "i", "fwd", "fwd_trough", "base", "dd")


def event_summary(events: DataFrame) -> DataFrame:
    """One row for each decade and one for all (decade NULL): returns after the events, against their series' own mean, and how far they fell first."""
    over = F.col("fwd") - F.col("base")
    share = lambda c: F.avg(c.cast("int"))
    rows = events.withColumn("decade", (F.floor(F.year("date") / 10) * 10).cast("long"))
    return rows.rollup("decade").agg(
        F.count("*").alias("n"), F.avg("fwd").alias("fwd_mean"), F.median("fwd").alias("fwd_median"), F.avg(over).alias("lift_mean"), share(over > 0).alias("lift_positive"),
        share(F.col("fwd") > 0.30).alias("over_30"), share(F.col("fwd") < 0).alias("negative"), F.median("fwd_trough").alias("trough_median"), share(F.col("fwd_trough") < -0.15).alias("trough_below_15"),
    ).where("n > 0")


def standing(bars: DataFrame) -> DataFrame:
    """Each ticker's last row: how far below its high, how volatile, where it stands against its averages, and its median money traded."""
    px, by = F.col("close"), by_ticker()
    rows = bars.where("close is not null").select(
        *("ticker", "date", "close"), (px * F.col("volume")).alias("money"), F.coalesce(F.ln(px) - F.ln(F.lag(px).over(by)), F.lit(0.0)).alias("step"), F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("n"),
        (F.try_divide(px, rolling(F.max, px, 252, 120)) - 1).alias("dd252"), (F.try_divide(px, rolling(F.avg, px, 50)) - 1).alias("dist_ma50"), (F.try_divide(px, rolling(F.avg, px, 200, 120)) - 1).alias("dist_ma200"),
        *(lagged_return(px, k).alias(f"ret_{k}d") for k in (63, 126, 252)), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("back"),
    )
    rows = rows.withColumn("above50", F.coalesce(F.col("dist_ma50") > 0, F.lit(False))).withColumn("above200", F.coalesce(F.col("dist_ma200") > 0, F.lit(False)))
    rows = rows.withColumn("crossed", F.col("above50") & ~F.coalesce(F.lag("above50").over(by), F.lit(False)))
    rows = rows.withColumn("min_dd_126", rolling(F.min, F.col("dd252"), 126, 40)).withColumn("rvol126", rolling(F.stddev_samp, F.col("step"), 126, 60) * F.sqrt(F.lit(252.0))).withColumn("reclaim_20d", F.max("crossed").over(by.rowsBetween(-19, 0)))
    money = rows.where("back <= 63").groupBy("ticker").agg(F.median("money").alias("money"))
    return rows.where("back = 1").drop("step", "back", "crossed", "money").join(money, "ticker")


def funnel(rows: DataFrame, newest: DataFrame, money: float, fall: float, vol: float, least: int = 220, stale: int = 7) -> DataFrame:
    """``rows`` of ``standing`` with ``stage``: how many of the funnel's conditions they meet one after the other.

    1 enough history, not stale; 2 liquid; 3 still deep below the high; 4 volatile; 5 above its average of 50 or
    crossed it in the last 20 rows. ``newest``: one row with the last date of all.
    """
    conditions: list[Column] = [
        (F.col("n") >= least) & (F.col("date") >= F.date_sub("newest", stale)), F.coalesce(F.col("money"), F.lit(0.0)) >= money, F.col("dd252") <= -fall, F.col("rvol126") >= vol, F.col("above50") | F.col("reclaim_20d"),
    ]
    stage = F.lit(0)
    met = F.lit(True)
    for c in conditions:
        met = met & F.coalesce(c, F.lit(False))
        stage = stage + met.cast("int")
    return rows.crossJoin(F.broadcast(newest)).withColumn("stage", stage).drop("newest")  # one row


def stage_counts(rows: DataFrame) -> DataFrame:
    """(stage, names): how many names reach each stage, from one pass over them."""
    names = ("history", "liquid", "washed out", "volatile", "turning")
    reached = rows.agg(*(F.sum((F.col("stage") >= i + 1).cast("int")).cast("long").alias(f"n{i}") for i in range(len(names))))
    each = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("stage"), F.lit(n).alias("name"), F.coalesce(f"n{i}", F.lit(0)).alias("names")) for i, n in enumerate(names))))
    return reached.select(each.alias("x")).select("x.*")


def sector_context(bars: DataFrame) -> DataFrame:
    """(sector, n_names, median_dd252, median_rvol126, share_above50) over the last rows of each sector's tickers (with a column ``sector``)."""
    return bars.groupBy("sector").agg(F.count("*").alias("n_names"), F.median("dd252").alias("sector_dd252"), F.median("rvol126").alias("sector_rvol126"), F.avg(F.col("above50").cast("int")).alias("sector_above50"))
