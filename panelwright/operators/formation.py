"""Signals judged by what follows: formation dates, picks within a pool, gaps between pickers and their intervals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import average_rank, average_rank_share, by_ticker, forward

#: fixed values: the top share of a pool, the least number of picks, names that a date needs
TOP_SHARE, TOP_LEAST = 0.10, 5
#: Events of a replicate that are drawn together.
STRETCH = 1 << 14
#: fixed values: first years of the regimes
REGIMES = (("pre-2020", 2020), ("2020-COVID", 2021), ("2021-22", 2023))


def ahead(bars: DataFrame, h: int, *carried: str) -> DataFrame:
    """(ticker, date, ret, vol, trough) over each row's next h rows: return, yearly deviation of log steps, worst close against its own; with columns carried along."""
    px, by = F.col("close"), by_ticker()
    rows = bars.select("ticker", "date", *dict.fromkeys(("close", *carried)), (F.ln(px) - F.ln(F.lag(px).over(by))).alias("step"))
    return rows.select(
        *("ticker", "date", *carried), (F.try_divide(F.lead(px, h).over(by), px) - 1).alias("ret"),
        (forward(F.stddev_samp, F.col("step"), h) * F.sqrt(F.lit(252.0))).alias("vol"), (F.try_divide(forward(F.min, px, h), px) - 1).alias("trough"),
    )


#: What ``trends`` adds.
TREND_SCHEMA = "slope_r2 double, ker_63 double, sharpe_63 double"


def trend_reads() -> dict[str, Column]:
    """Close, its logarithm and the step of it, for ``trends``."""
    ln = F.ln("close")
    return {"px": F.col("close"), "ly": ln, "lr": ln - F.lag(ln).over(by_ticker())}


def trends(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """slope_r2, ker_63 and sharpe_63 of the signal panel, for the rows that are wanted alone; windows of these rows lie side by side.

    Sums go through a window in the order and by the steps of Spark's own windows, so that equal series share their ranks.
    """
    out = {c: np.full(len(r["i"]), np.nan) for c in ("slope_r2", "ker_63", "sharpe_63")}
    i, px, first = r["i"], r["px"], r["i"][0]
    size = np.abs(np.diff(px, prepend=np.nan))
    with np.errstate(all="ignore"):
        at = np.flatnonzero((r["wanted"] == 1) & (i >= 89) & (i - 89 >= first))
        if len(at):
            n, ax, ay, ck, kc, mx, my, m2 = (np.zeros(len(at)) for _ in range(8))
            for j in range(-89, 1):
                x, y = i[at + j] + 1.0, r["ly"][at + j]
                ok = ~np.isnan(y)
                n = n + ok
                dx, dy = x - ax, y - ay
                xs, ys = dx / n, dy / n
                bx, by = ax + xs, ay + ys
                steps = ((ax, bx), (ay, by), (ck, ck + dx * (y - by)), (kc, kc + dy * (x - bx)), (mx, mx + dx * (x - bx)), (my, my + dy * (y - by)), (m2, m2 + dx * (dx - xs)))
                ax, ay, ck, kc, mx, my, m2 = (np.where(ok, new, old) for old, new in steps)
            corr = kc / np.sqrt(my) / np.sqrt(mx)
            out["slope_r2"][at] = np.where((m2 == 0) | (mx == 0), np.nan, ck / m2 * 252 * np.where(my == 0, 1.0, corr * corr))
        at = np.flatnonzero((r["wanted"] == 1) & (i >= 63) & (i - 63 >= first))
        if len(at):
            total, n, avg, m2 = (np.zeros(len(at)) for _ in range(4))
            for j in range(-62, 1):
                total, v, n = total + size[at + j], r["lr"][at + j], n + 1
                delta = v - avg
                part = delta / n
                avg, m2 = avg + part, m2 + delta * (delta - part)
            was = px[at - 63]
            spread = np.sqrt(m2 / 62.0) * math.sqrt(252.0)
            out["ker_63"][at] = np.where(total != 0, np.abs(px[at] - was) / total, np.nan)
            out["sharpe_63"][at] = np.where((spread != 0) & (was != 0), (px[at] / was - 1) / spread, np.nan)
    return out


def formation_dates(rows: DataFrame, first: int, h: int, step: int) -> DataFrame:
    """Every ``step``-th date from the date number ``first`` on that leaves h dates and one more. One row a date is numbered, not the panel."""
    whole = Window.partitionBy(F.lit(0))
    dates = rows.select("date").distinct().select("date", (F.row_number().over(whole.orderBy("date")) - 1).alias("o"), F.count(F.lit(1)).over(whole).alias("n"))
    return dates.where((F.col("o") >= first) & (F.col("o") < F.col("n") - h - 1) & ((F.col("o") - first) % step == 0)).select("date")


def mean_rank_share(rows: DataFrame, parts: list[str], name: str) -> DataFrame:
    """Adds the mean of a row's rank shares within its date, over those of ``parts`` that it has."""
    ranked = rows.withColumns({f"__{c}": average_rank_share(F.col(c), "date") for c in parts})
    known = F.array_compact(F.array(*(F.col(f"__{c}") for c in parts)))
    return ranked.withColumn(name, F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))).drop(*(f"__{c}" for c in parts))


def _picked(score: Column, n: Column, share: float, least: int, *by: str) -> Column:
    place = F.row_number().over(Window.partitionBy("date", *by).orderBy(score.desc_nulls_last(), "ticker"))
    return (place <= F.greatest(F.lit(least), F.floor(n * share))) & score.isNotNull()


def _z(x: Column, *by: str) -> Column:
    w = Window.partitionBy("date", *by)
    return F.coalesce(F.try_divide(x - F.avg(x).over(w), F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))), F.lit(0.0))


def signal_study(rows: DataFrame, signals: list[str], least: int, share: float = TOP_SHARE, least_top: int = TOP_LEAST) -> DataFrame:
    """(signal, date, n, ic, top_ret, top_vol, top_trough, bottom_ret): each signal on each date where enough names have it.

    ``rows`` has the signals and ret, vol, trough of the rows ahead. ``ic`` is the rank correlation with ret.
    """
    long = rows.select("ticker", "date", "ret", "vol", "trough", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("x")) for s in signals))).alias("s"))
    long = long.select("ticker", "date", "ret", "vol", "trough", "s.signal", "s.x").where("x is not null and ret is not null")
    by = Window.partitionBy("signal", "date")
    n = F.count(F.lit(1)).over(by)
    k = F.greatest(F.lit(least_top), F.floor(F.col("n") * share))
    ranked = long.withColumn("n", n).where(F.col("n") >= least).withColumn("rx", average_rank(F.col("x"), "signal", "date")).withColumn("ry", average_rank(F.col("ret"), "signal", "date"))
    ranked = ranked.withColumn("top", F.row_number().over(by.orderBy(F.desc("x"), "ticker")) <= k).withColumn("bottom", F.row_number().over(by.orderBy("x", F.desc("ticker"))) <= k)
    means = [F.avg(F.when(F.col("top"), F.col(c))).alias(f"top_{c}") for c in ("ret", "vol", "trough")]
    return ranked.groupBy("signal", "date").agg(F.first("n").alias("n"), F.corr("rx", "ry").alias("ic"), *means, F.avg(F.when(F.col("bottom"), F.col("ret"))).alias("bottom_ret"))


def study_summary(study: DataFrame) -> DataFrame:
    """One row a signal: mean, deviation and t of its rank correlations, and what its top and bottom picks did."""
    ic, spread = F.avg("ic"), F.stddev_pop("ic")
    return study.groupBy("signal").agg(
        F.count("*").alias("n"), ic.alias("ic_mean"), spread.alias("ic_std"), F.when(F.count("ic") > 2, F.try_divide(ic, F.nullif(spread, F.lit(0.0)) / F.sqrt(F.count("ic").cast("double")))).alias("ic_t"),
        *(F.avg(f"top_{c}").alias(f"top_{c}") for c in ("ret", "vol", "trough")), (F.avg("top_ret") - F.avg("bottom_ret")).alias("spread"), F.try_divide(F.avg("top_ret"), F.avg("top_vol")).alias("ret_over_vol"),
    )


def pool_comparison(rows: DataFrame, pool: Column, a: str, b: str, least: int, share: float = TOP_SHARE, least_top: int = TOP_LEAST) -> DataFrame:
    """Per date: picks by ``a``, by ``b`` and by both within one pool, all of one size, and what they did.

    ``rows``: ticker, date, a, b, and ret, vol, trough of the rows ahead. Only rows of the pool are ranked, and only
    dates whose pool has ``least`` of them count. Both together is the sum of the two ranks' z-scores in the pool.
    ic_a and ic_b are rank correlations with ret within the pool. jaccard is the overlap of the picks by a and by b
    out of all rows of the date, whose pick by b is the top share of its ranks, and by_chance what sizes alone give.
    ``rows`` is read once: what holds in the pool is windowed beside the rest of its date.
    """
    known = rows.select("ticker", "date", "ret", "vol", "trough", F.col(a).alias("a"), F.col(b).alias("b"), F.coalesce(pool, F.lit(False)).alias("pool")).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("date")))
    known = known.withColumn("wide_a", _picked(F.col("a"), F.col("all"), share, least_top)).withColumn("wide_b", F.coalesce(average_rank_share(F.col("b"), "date") >= 1 - share, F.lit(False)))
    known = known.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date", "pool"))).withColumns({f"r{x}": average_rank(F.col(c), "date", "pool") for x, c in (("a", "a"), ("b", "b"), ("r", "ret"))})
    known = known.withColumn("c", F.round(_z(F.col("ra"), "pool") + _z(F.col("rb"), "pool"), 9))
    known = known.withColumns({f"pick_{x}": _picked(F.col(x), F.col("n"), share, least_top, "pool") for x in "abc"})
    held = F.col("pool") & (F.col("n") >= least)
    own = lambda c: F.when(held, F.col(c))
    picks = [F.avg(F.when(held & F.col(f"pick_{x}"), F.col(m))).alias(f"{m}_{x}") for x in "abc" for m in ("ret", "vol", "trough")]
    found = known.groupBy("date").agg(
        F.max(own("n")).alias("n"), *picks, *(F.avg(own(m)).alias(f"{m}_pool") for m in ("ret", "vol", "trough")), F.corr(own("ra"), own("rr")).alias("ic_a"), F.corr(own("rb"), own("rr")).alias("ic_b"),
        F.first("all").alias("n_all"), *(F.sum(F.col(c).cast("int")).alias(n) for c, n in (("wide_a", "ka"), ("wide_b", "kb"))), F.sum((F.col("wide_a") & F.col("wide_b")).cast("int")).alias("both"),
    ).where("n is not null")
    over = F.try_divide("ret_a", F.nullif("vol_a", F.lit(0.0))) - F.try_divide("ret_b", F.nullif("vol_b", F.lit(0.0)))
    chance = F.col("ka") * F.col("kb") / F.col("n_all")
    met = (F.col("ka") > 0) & (F.col("kb") > 0)
    of_all = ("n_all", "ka", "kb", "both")
    return found.select(
        *(c for c in found.columns if c not in of_all), (F.col("ret_a") - F.col("ret_b")).alias("gap_ret"), (F.col("trough_a") - F.col("trough_b")).alias("gap_trough"), over.alias("gap_ret_over_vol"),
        "n_all", F.when(met, F.col("both") / (F.col("ka") + F.col("kb") - F.col("both"))).alias("jaccard"), F.when(met, chance / (F.col("ka") + F.col("kb") - chance)).alias("by_chance"),
    )


def regime(year: Column, regimes: tuple = REGIMES, last: str = "2023-25") -> Column:
    out = F.lit(last)
    for name, before in reversed(regimes):
        out = F.when(year < before, name).otherwise(out)
    return out


def series_intervals(rows: DataFrame, key: str, order: list[str], value: str, block: int, draws: int = 2000, seed: int = 1, least: int = 5) -> DataFrame:
    """(key, n, mean, low, high): 5th and 95th percentile of the means of resampled blocks, for each key's series.

    A replicate lays blocks of consecutive points end to end until it is as long as the series and cuts the last one;
    ``block`` 1 draws points one by one. A block's sum is the difference of two running sums, so draws meet the series
    twice a block and not once a point. Series of fewer than ``least`` points have no interval, and those no longer
    than a block have their mean as both ends.
    """
    w = Window.partitionBy(key).orderBy(*order)
    points = rows.where(F.col(value).isNotNull()).select(key, (F.row_number().over(w) - 1).cast("long").alias("i"), F.col(value).alias("v"))
    points = points.withColumn("until", F.sum("v").over(Window.partitionBy(key).orderBy("i")))
    size = points.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    edges = points.select(key, (F.col("i") + 1).alias("i"), "until").unionByName(size.select(key, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("until")))
    slots = size.where(F.col("n") > block).select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("r"))
    slots = slots.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)))
    x = (F.col("r") * 7919 + F.col("s") * 104729 + F.lit(seed * 1299709)) % 2147483647
    slots = slots.withColumn("from", (x * 48271 % 2147483647) % (F.col("n") - block + 1)).withColumn("to", F.col("from") + F.least(F.lit(block).cast("long"), F.col("n") - F.col("s") * block))
    first, last = edges.select(key, F.col("i").alias("from"), F.col("until").alias("u0")), edges.select(key, F.col("i").alias("to"), F.col("until").alias("u1"))
    means = slots.join(first, [key, "from"]).join(last, [key, "to"]).groupBy(key, "r").agg((F.sum(F.col("u1") - F.col("u0")) / F.first("n")).alias("m"))
    ends = means.groupBy(key).agg(F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.95)).alias("high"))
    enough = F.col("n") >= least
    return size.join(ends, key, "left").select(key, "n", "mean", *(F.when(enough, F.when(F.col("n") <= block, F.col("mean")).otherwise(F.col(c))).alias(c) for c in ("low", "high")))


def rate_interval(counts: DataFrame, draws: int = 2000, seed: int = 1, of: Column | None = None) -> DataFrame:
    """``counts`` (key, n, k: k of n events came true) with rate, low and high: percentiles of the rate over n events drawn one by one.

    Which event comes true doesn't matter for a rate, so a draw below k is a true one and the events themselves aren't needed.
    Draws are dealt over all tasks in stretches of STRETCH events and counted there. ``of``: the rows that get an interval,
    by default all of them. ``counts`` is read once.
    """
    known = F.col("n") > 0
    own = known if of is None else known & of
    no = F.array().cast("array<long>")
    replicates = F.when(own, F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).otherwise(no)
    slots = counts.select("key", "n", "k", F.explode_outer(replicates).alias("r"))
    slots = slots.withColumn("at", F.explode_outer(F.when(own, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))).otherwise(no)))
    slots = slots.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "r", "at")
    until = F.least(F.col("at") + STRETCH, F.col("n")) - 1
    slots = slots.withColumn("s", F.explode_outer(F.when(own, F.sequence("at", until)).otherwise(no)))
    x = (F.col("r") * 7919 + F.col("s") * 104729 + F.lit(seed * 1299709)) % 2147483647
    rates = slots.groupBy("key", "n", "k", "r").agg(F.avg(((x * 48271 % 2147483647) % F.col("n") < F.col("k")).cast("int")).alias("m"))
    ends = rates.groupBy("key", "n", "k").agg(F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.95)).alias("high"))
    return ends.select("key", "n", "k", F.try_divide("k", "n").alias("rate"), "low", "high")
