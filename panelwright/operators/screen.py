"""The daily screen: per-ticker signals, cross-sectional percentiles, composite, gate, candidates and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_ticker, clamp, lagged_return, last_rows, log_return, percent_rank_of, rolling
from panelwright.operators.asof import meet


def riser_metrics(bars: DataFrame, *carried: str) -> DataFrame:
    """(ticker, date, close, net5, net10, net20, up10, ddw10, ker10): short-horizon path measures, with columns carried along.

    ddw10 is the worst fall from a running high within the last 11 closes.
    """
    d = log_return(F.col("adj_close"))
    rows = bars.select("ticker", "date", "adj_close", "close", *carried, d.alias("d"), F.row_number().over(by_ticker()).alias("i"), *(F.lag("adj_close", k).over(by_ticker()).alias(f"__p{k}") for k in range(11)))
    back = [F.col(f"__p{k}") for k in range(10, -1, -1)]  # the closes of ten rows before, nine, ... and the row's own
    fall = F.least(F.lit(0.0), *(F.try_divide(x, F.greatest(*back[: k + 1])) - 1 for k, x in enumerate(back) if k))
    full = F.col("i") > 10
    total = F.sum("d").over(last_rows(10))
    return rows.select(
        *("ticker", "date", "close", *carried), *(lagged_return(F.col("adj_close"), n).alias(f"net{n}") for n in (5, 10, 20)),
        F.when(full, F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).over(last_rows(10)) / 10).alias("up10"),
        F.when(full, fall).alias("ddw10"),
        F.when(full, clamp(F.try_divide(F.abs(total), F.sum(F.abs("d")).over(last_rows(10))))).alias("ker10"),
    )


def with_relative_strength(bars: DataFrame, spx: DataFrame) -> DataFrame:
    """``bars`` with rs_raw: returns over 63 and 126 rows less the benchmark's, which is carried forward onto the ticker's own dates."""
    px = F.col("adj_close")
    rows = bars.join(F.broadcast(spx.select("date", F.col("close").alias("spx"))), "date", "left").withColumn("spx", F.last("spx", ignorenulls=True).over(by_ticker()))
    excess = sum((lagged_return(px, n) - lagged_return(F.col("spx"), n) for n in (63, 126)), F.lit(0.0))
    return rows.withColumn("rs_raw", excess).drop("spx")


def population(bars: DataFrame, spx: DataFrame, *carried: str) -> DataFrame:
    """Riser metrics of the rows that the screen ranks: those with a relative strength. Earlier rows only feed the windows. Columns are carried along."""
    return riser_metrics(with_relative_strength(bars, spx), "rs_raw", *carried).where("rs_raw is not null").drop("rs_raw")


def candidates(rows: DataFrame, top_n: int = 50, up: float = 0.6) -> DataFrame:
    """Adds net10_pct, candidate (gated and among the top_n of its date) and streak_days (consecutive candidate rows)."""
    gate = (F.col("up10") >= up) & (F.col("net10") > 0)
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.when(gate, F.col("net10")).desc_nulls_last(), "ticker"))
    out = rows.withColumn("net10_pct", F.round(100 * percent_rank_of(F.col("net10"), "date"), 1)).withColumn("candidate", F.when(gate & (place <= top_n), 1).otherwise(0))
    out = out.withColumn("__island", F.row_number().over(by_ticker()) - F.row_number().over(Window.partitionBy("ticker", "candidate").orderBy("date")))
    days = F.row_number().over(Window.partitionBy("ticker", "candidate", "__island").orderBy("date"))
    return out.withColumn("streak_days", F.when(F.col("candidate") == 1, days).otherwise(0)).drop("__island")


def signals(bars: DataFrame, spx: DataFrame, min_bars: int = 60) -> DataFrame:
    """One pass of ticker windows: returns against the benchmark, moving averages, trend quality and volume measures.

    The benchmark is carried forward onto the ticker's own dates, then lagged on them.
    """
    px = F.col("adj_close")
    enough = F.count(F.lit(1)).over(Window.partitionBy("ticker")) >= min_bars
    rows = bars.withColumn("__ok", enough).where("__ok").drop("__ok").join(F.broadcast(spx.select("date", F.col("close").alias("spx"))), "date", "left")  # one row a date
    rows = rows.withColumn("spx", F.last("spx", ignorenulls=True).over(by_ticker())).withColumn("step", px - F.lag(px).over(by_ticker()))
    up = F.when(F.col("step") > 0, F.col("volume")).otherwise(F.lit(0))
    down = F.when(F.coalesce(F.col("step") <= 0, F.lit(True)), F.col("volume")).otherwise(F.lit(0))
    r63, r126 = lagged_return(px, 63), lagged_return(px, 126)
    volume = F.col("volume").cast("double")
    return rows.select(
        *("ticker", "date", "close"), r63.alias("ret_63"), r126.alias("ret_126"),
        ((r63 - lagged_return(F.col("spx"), 63)) + (r126 - lagged_return(F.col("spx"), 126))).alias("rs_raw"),
        *(rolling(F.avg, px, n).alias(f"ma{n}") for n in (50, 150, 200)),
        F.try_divide(px, rolling(F.max, px, 252, 20)).alias("high_prox"),
        clamp(F.try_divide(F.abs(px - F.lag(px, 63).over(by_ticker())), rolling(F.sum, F.abs("step"), 63))).alias("trend_quality"),
        F.try_divide(rolling(F.avg, volume, 50), rolling(F.avg, volume, 200)).alias("vol_ratio"),
        F.try_divide(rolling(F.sum, up, 50), rolling(F.sum, down, 50).cast("double")).alias("ud_vol_ratio"),
    )


def weights(k: float) -> dict[str, float]:
    """Weights of the composite's parts along a dial from 0 to 1; they always add up to 1."""
    k = min(1.0, max(0.0, k))
    return {"rs": 0.20 + 0.03 * k, "high": 0.34 - 0.24 * k, "trend": 0.22 - 0.10 * k, "vol": 0.14 - 0.04 * k, "accel": 0.10 + 0.35 * k}


def composite(rows: DataFrame, k: float = 0.5) -> DataFrame:
    """Percentile of rs_raw among rows that have one, its 21-row change, component scores, composite and rank by date."""
    out = _scored(rows.where("rs_raw is not null").withColumn("rs_pct", 100 * percent_rank_of(F.col("rs_raw"), "date")), k)
    return out.withColumn("rank_in_universe", F.rank().over(Window.partitionBy("date").orderBy(F.round("composite", 9).desc_nulls_last())))


def composite_alone(rows: DataFrame, k: float = 0.5) -> DataFrame:
    """(ticker, date, composite) as ``composite`` has it: only the relative strength goes to its date to be ranked and back, the other measures stay with their ticker."""
    known = rows.where("rs_raw is not null")
    ranked = known.select("ticker", "date", "rs_raw").select("ticker", "date", (100 * percent_rank_of(F.col("rs_raw"), "date")).alias("rs_pct"))
    return _scored(meet(known.select("ticker", "date", "high_prox", "trend_quality", "vol_ratio"), ranked, "ticker", "date"), k).select("ticker", "date", "composite")


def _scored(ranked: DataFrame, k: float) -> DataFrame:
    """Adds the change of rs_pct over 21 rows, component scores and composite."""
    out = ranked.withColumn("rs_accel", F.col("rs_pct") - F.lag("rs_pct", 21).over(by_ticker()))
    parts: dict[str, Column] = {
        "rs": clamp(F.col("rs_pct") / 100), "high": clamp(F.col("high_prox")), "trend": clamp(F.col("trend_quality")),
        "vol": clamp((F.col("vol_ratio") - 1) / 0.6 + 0.5), "accel": clamp(F.coalesce("rs_accel", F.lit(0.0)) / 100 + 0.5),
    }
    # a missing input scores 0: greatest() passes over NULL
    parts["vol"] = F.when(F.col("vol_ratio").isNull(), F.lit(0.0)).otherwise(parts["vol"])
    out = out.withColumns({f"c_{n}": F.coalesce(c, F.lit(0.0)) for n, c in parts.items()})
    w = weights(k)
    score = sum((F.col(f"c_{n}") * w[n] for n in w), F.lit(0.0)) * 100
    return out.withColumn("composite", score)
