"""Path-dependent series: recursive averages, paths, events and forward windows."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_ticker
from panelwright.operators.changepoint import TOGETHER, by_blocks


def ordered_values(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row per key: ``order`` and ``value`` as arrays by order. A key's series must fit in one row (thousands of points)."""
    both = F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).alias("x"))))
    return rows.groupBy(key).agg(both.alias("s"))


def ema_array(x: Column, span: int) -> Column:
    """y0 = x0, y = (1 - a) y + a x with a = 2 / (span + 1), over an array without NULLs."""
    a = 2.0 / (span + 1)
    step = F.aggregate(
        x,
        F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<double>").alias("out")),
        lambda acc, v: F.struct(F.coalesce((1 - a) * acc.y + a * v, v).alias("y"), F.concat(acc.out, F.array(F.coalesce((1 - a) * acc.y + a * v, v))).alias("out")),
        lambda acc: acc.out,
    )
    return step


def ew_std_array(x: Column, span: int) -> Column:
    """Exponentially weighted standard deviation, bias-corrected; NULL while fewer than two values are known."""
    a = 2.0 / (span + 1)

    def step(s: Column, v: Column) -> Column:
        first = s.mean.isNull()
        mean = F.when(first, v).otherwise((1 - a) * s.mean + a * v)
        cov = F.when(first, F.lit(0.0)).otherwise((1 - a) * (s.cov + (s.mean - mean) * (s.mean - mean)) + a * (v - mean) * (v - mean))
        w2 = F.when(first, F.lit(1.0)).otherwise((1 - a) * (1 - a) * s.w2 + a * a)
        out = F.when(w2 < 1.0, F.sqrt(cov / (1.0 - w2)))
        return F.struct(mean.alias("mean"), cov.alias("cov"), w2.alias("w2"), F.concat(s.out, F.array(F.when(~first, out))).alias("out"))

    null = F.lit(None).cast("double")
    return F.aggregate(x, F.struct(null.alias("mean"), F.lit(0.0).alias("cov"), F.lit(1.0).alias("w2"), F.array().cast("array<double>").alias("out")), step, lambda s: s.out)


#: fixed values: spans of the two pairs of averages
EWMAC_PAIRS = {"ewmac_fast": (16, 64), "ewmac_slow": (32, 128)}


def ewmac(bars: DataFrame, pairs: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(ticker, date, one column per pair): difference of two EMAs over the EW deviation of daily steps; NULL where that is 0 or unknown.

    Averages begin at the first price and weigh each new one by 2 / (span + 1); the deviation is corrected for bias and
    known from the second step on. Recursions run over one ticker's series at a time, in linear time.
    """
    pairs = EWMAC_PAIRS if pairs is None else pairs

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        out, px = rows[["ticker", "date"]].copy(), rows["adj_close"]
        for name, (fast, slow) in pairs.items():
            spread = px.ewm(span=fast, adjust=False).mean() - px.ewm(span=slow, adjust=False).mean()
            deviation = px.diff().ewm(span=slow, adjust=False).std()
            out[name] = spread / deviation.where(deviation > 0)
        return out

    fields = ", ".join(f"{name} double" for name in pairs)
    return bars.select("ticker", "date", "adj_close").groupBy("ticker").applyInPandas(run, f"ticker string, date date, {fields}")


def spaced(events: Column, place: str, spacing: int) -> Column:
    """Of an array of structs in order of ``place``, greedily those that lie at least ``spacing`` places after the last one that stayed."""
    far = lambda a, p: F.coalesce(p[place] - F.try_element_at(a, F.lit(-1))[place] >= spacing, F.lit(True))
    return F.aggregate(events, F.filter(events, lambda _: F.lit(False)), lambda a, p: F.when(far(a, p), F.concat(a, F.array(p))).otherwise(a))


def spaced_events(events: DataFrame, key: str, place: str, spacing: int) -> DataFrame:
    """Greedy spacing: an event stays if it lies at least ``spacing`` places after the last one that stayed."""
    kept = spaced(F.array_sort(F.collect_list(F.struct(F.col(place).cast("long").alias(place)))), place, spacing)
    return events.where(F.col(place).isNotNull()).groupBy(key).agg(kept.alias("__kept")).select(key, F.explode(f"__kept.{place}").alias(place))


def entries(flag: Column) -> Column:
    """True where a flag is set and was not on the row before."""
    return flag & ~F.coalesce(F.lag(flag).over(by_ticker()), F.lit(False))


def week_ending(d: Column) -> Column:
    """The Friday that ends a date's week; Saturdays and Sundays belong to the next one."""
    return F.date_add(d, ((4 - F.weekday(d) + 7) % 7).cast("int"))


def expanding_share_at_most(rows: DataFrame, key: str, order: str, value: str, least: int) -> DataFrame:
    """Share of a series' own history up to each point that is at most the point, once there are ``least`` values. One key's series at a time, kept sorted as it grows."""
    known = rows.where(F.col(value).isNotNull()).select(key, order, F.col(value).cast("double").alias("share"))

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(order)
        seen: list[float] = []
        shares = []
        for n, x in enumerate(series["share"].tolist(), 1):
            insort(seen, x)
            shares.append(bisect_right(seen, x) / n if n >= least else None)
        return series.assign(share=pd.array(shares, "Float64"))

    return known.groupBy(key).applyInPandas(run, known.schema)


def iid_equity(rows: DataFrame, key: str, order: str, ret: str) -> DataFrame:
    """Per key: Sharpe (mean over population deviation, times sqrt 252) and the largest fall of cumulative log returns."""
    w = Window.partitionBy(key).orderBy(order)
    path = rows.withColumn("c", F.sum(F.log1p(ret)).over(w)).withColumn("top", F.max("c").over(w))
    return path.groupBy(key).agg((F.try_divide(F.avg(ret), F.stddev_pop(ret)) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.min(F.col("c") - F.col("top")).alias("max_drawdown"))


def rolling_regression(rows: DataFrame, size: int) -> DataFrame:
    """(ticker, date, slope, r2) of the least-squares line through ``y`` of the last ``size`` rows, where there are as many; a flat line fits wholly."""
    by = Window.partitionBy("ticker").orderBy("date")
    placed = rows.select("ticker", "date", "y", (F.row_number().over(by) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("n"))

    def lines(r: dict) -> dict:
        n = len(r["i"])
        out = {"slope": np.full(n, np.nan), "r2": np.full(n, np.nan)}
        for a in range(size - 1, n, TOGETHER):
            at = np.arange(a, min(a + TOGETHER, n))
            y = r["y"][at[:, None] - np.arange(size)[None, ::-1]]
            known = ~np.isnan(y)
            flat = np.where(known, y, -np.inf).max(axis=1) == np.where(known, y, np.inf).min(axis=1)
            count = np.maximum(known.sum(axis=1), 1)[:, None]
            x = np.where(known, np.arange(size)[None, :].astype(float), 0.0)
            x = np.where(known, x - x.sum(axis=1, keepdims=True) / count, 0.0)
            filled = np.where(known, y, 0.0)
            y = np.where(known, y - filled.sum(axis=1, keepdims=True) / count, 0.0)
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            fit = xx > 0
            out["slope"][at] = np.where(fit, xy / np.where(fit, xx, 1.0), np.nan)
            out["r2"][at] = np.where(fit, np.where(flat, 1.0, xy * xy / np.where(fit & ~flat, xx * yy, 1.0)), np.nan)
        return out

    return by_blocks(placed, size - 1, lines, ["i", "y"], "slope double, r2 double", ["ticker", "date", "i"]).drop("i")
