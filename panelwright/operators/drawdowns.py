"""Falls from a high, split into the market's part and a ticker's own, and what follows deep ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import average_rank_share, by_ticker, rolling
from panelwright.operators.changepoint import TOGETHER, by_blocks

# fixed values: windows of beta, volatility and highs, rows ahead, a deep fall, the market's stress
BETA_ROWS, VOL_ROWS, HIGH_ROWS, AHEAD, DEEP, STRESS = 252, 126, 252, 252, 0.30, 0.10


def decomposed(bars: DataFrame, market: DataFrame, stride: int = 5) -> DataFrame:
    """(ticker, date, i, close, dd_total, dd_beta, dd_idio, rvol, beta, mkt_dd) for every row of ``bars``.

    Beta is that of daily log returns to the market's over BETA_ROWS rows. The window's returns are beta times the
    market's and a rest; each part's running sum gives a path, and its fall is how far it lies below its own highest
    point at the end. Paths are looked at every ``stride`` rows from the row BETA_ROWS on; the rows between carry the
    last values on. With running sums S and M of both returns a path's fall is that of S - beta M within the window:
    for the market's part M's largest or smallest value will do, for the rest all its rows are met once.
    """
    by = by_ticker()
    rows = bars.select("ticker", "date", F.col("adj_close").alias("close")).join(market.select("date", F.col("close").alias("m")), "date", "left")
    rows = rows.withColumn("i", (F.row_number().over(by) - 1).cast("long"))
    first = F.col("i") == 0
    rows = rows.withColumn("r", F.when(first, 0.0).otherwise(F.ln("close") - F.ln(F.lag("close").over(by)))).withColumn("q", F.when(first, 0.0).otherwise(F.ln(F.try_divide("m", F.lag("m").over(by)))))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    both = F.when(F.col("q").isNotNull(), F.col("r"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).withColumn("s", F.sum(F.coalesce(both, F.lit(0.0))).over(so_far)).withColumn("k", F.sum(F.coalesce("q", F.lit(0.0))).over(so_far))
    rows = rows.withColumn("at", ((F.col("i") >= BETA_ROWS) & ((F.col("i") - BETA_ROWS) % stride == 0)).cast("long"))
    added = "b double, fall_b double, fall_i double, dd_total double, rvol double, mkt_dd double"
    held = by_blocks(rows, max(BETA_ROWS, VOL_ROWS, HIGH_ROWS) - 1, _falls, ["i", "at", "close", "m", "r", "q", "s", "k"], added, ["ticker", "date", "i", "close", "at"])
    seen = (F.col("at") == 1) & F.col("b").isNotNull()
    carried = lambda x: F.last(F.when(seen, x), ignorenulls=True).over(so_far)
    return held.select(
        *("ticker", "date", "i", "close", "dd_total"), F.expm1(carried(F.col("fall_b"))).alias("dd_beta"), F.expm1(carried(F.col("fall_i"))).alias("dd_idio"),
        "rvol", carried(F.col("b")).alias("beta"), "mkt_dd",
    )


def _falls(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Beta, deviation and falls of each row from the rows before it, windows laid side by side."""
    n, first = len(r["i"]), r["i"][0]
    out = {c: np.full(n, np.nan) for c in ("b", "fall_b", "fall_i", "dd_total", "rvol", "mkt_dd")}
    longest = max(BETA_ROWS, VOL_ROWS, HIGH_ROWS) - 1
    led = {c: np.concatenate([np.full(longest, np.nan), r[c].astype(float)]) for c in ("close", "m", "r", "q", "s", "k")}
    for a in range(0, n, TOGETHER):
        at = np.arange(a, min(a + TOGETHER, n))
        seen = {(c, k): led[c][at[:, None] + (longest - k + 1) + np.arange(k)[None, :]] for c, k in (("close", HIGH_ROWS), ("m", HIGH_ROWS), ("r", BETA_ROWS), ("q", BETA_ROWS), ("r", VOL_ROWS))}
        for c, name in (("close", "dd_total"), ("m", "mkt_dd")):
            x = seen[c, HIGH_ROWS]
            top = np.where(np.isnan(x), -np.inf, x).max(axis=1)
            enough = ((~np.isnan(x)).sum(axis=1) >= HIGH_ROWS // 2) & (top != 0)
            out[name][at] = np.where(enough, r[c][at] / np.where(enough, top, 1.0), np.nan) - 1
        x = seen["r", VOL_ROWS]
        count, _, square = _spread(x, ~np.isnan(x))
        out["rvol"][at] = np.where(count >= max(VOL_ROWS // 2, 2), np.sqrt(square / np.maximum(count - 1, 1)), np.nan) * np.sqrt(252.0)
        x, y = seen["r", BETA_ROWS], seen["q", BETA_ROWS]
        pairs = ~np.isnan(x) & ~np.isnan(y)
        count, away, square = _spread(y, pairs)
        _, own, _ = _spread(x, pairs)
        fine = (count >= BETA_ROWS // 2) & (square > 0)
        b = np.where(fine, (away * own).sum(axis=1) / np.where(fine, square, 1.0), np.nan)
        out["b"][at] = b
        looked = (r["at"][at] == 1) & ~np.isnan(b) & (r["i"][at] - first >= BETA_ROWS - 1)
        if looked.any():
            at, b = at[looked], b[looked]
            places = at[:, None] - np.arange(BETA_ROWS)[None, ::-1]
            s, k = r["s"][places], r["k"][places]
            far = np.where(b >= 0, k.max(axis=1), k.min(axis=1))
            out["fall_b"][at] = b * (r["k"][at] - far)
            out["fall_i"][at] = r["s"][at] - b * r["k"][at] - (s - b[:, None] * k).max(axis=1)
    return out


def _spread(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many values each row has, how far each lies from their mean (0 where unknown), and the sum of squares of that."""
    count = known.sum(axis=1)
    mean = np.where(known, x, 0.0).sum(axis=1) / np.maximum(count, 1)
    away = np.where(known, x - mean[:, None], 0.0)
    return count, away, (away * away).sum(axis=1)


def sampled_days(parts: DataFrame, sectors: DataFrame, step: int, least: int = 300, ahead: int = AHEAD) -> DataFrame:
    """Every ``step``-th row from the row ``least`` on, of tickers with ``least`` + ``ahead`` rows: what was known, and the best that follows.

    ``drawup`` is the highest close of the next ``ahead`` rows over the row's own, ``exceeded`` whether it beats the high
    of the last HIGH_ROWS; ``vol_rank`` is a row's share of the volatilities of its date.
    """
    by = by_ticker()
    best = F.when(F.count("close").over(by.rowsBetween(0, ahead)) == ahead + 1, F.max("close").over(by.rowsBetween(1, ahead)))
    high = rolling(F.max, F.col("close"), HIGH_ROWS, HIGH_ROWS // 2)
    rows = parts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).withColumn("best", best).withColumn("high", high)
    rows = rows.where((F.col("n") >= least + ahead) & (F.col("i") >= least) & ((F.col("i") - least) % step == 0) & F.col("best").isNotNull() & F.col("rvol").isNotNull() & F.col("dd_total").isNotNull())
    rows = rows.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    rows = rows.select("ticker", "date", F.year("date").alias("year"), "sector", "dd_total", "dd_beta", "dd_idio", "rvol", "beta", "mkt_dd", (F.try_divide("best", "close") - 1).alias("drawup"), (F.col("best") > F.col("high")).alias("exceeded"))
    return rows.withColumn("vol_rank", average_rank_share(F.col("rvol"), "date"))


def cells(days: DataFrame, fall: str, rise: float, bins: int, deep: float = DEEP, by_date: bool = True, least: int = 20) -> DataFrame:
    """(year, sector, bin, n1, k1, n0, k0): rows with a deep fall and the others of each cell, and how many of them rose so far.

    A cell is a year, a sector and a bin of a date's own volatilities; without ``by_date`` a sector and a bin of all
    volatilities (year NULL). Cells with fewer than ``least`` rows on a side are left out.
    """
    if by_date:
        binned = days.withColumn("bin", F.least(F.floor(F.col("vol_rank") * bins), F.lit(bins - 1))).withColumn("cell_year", F.col("year"))
    else:
        binned = _global_bins(days, bins).withColumn("cell_year", F.lit(None).cast("int"))
    treated, hit = F.coalesce(F.col(fall) <= -deep, F.lit(False)), F.col("drawup") >= rise
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = binned.groupBy(F.col("cell_year").alias("year"), "sector", F.col("bin").cast("long").alias("bin")).agg(count(treated).alias("n1"), count(treated & hit).alias("k1"), count(~treated).alias("n0"), count(~treated & hit).alias("k0"))
    return out.where((F.col("n1") >= least) & (F.col("n0") >= least))


def _global_bins(days: DataFrame, bins: int) -> DataFrame:
    """Bins of equal size over all volatilities; ranges are counted first, so no task orders all rows."""
    edges = days.agg(F.percentile_approx("rvol", [i / bins for i in range(1, bins)], 100_000).alias("edges"))  # one row
    return days.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("rvol")))).drop("edges")


def lift(found: DataFrame, *by: str) -> DataFrame:
    """Mean of the cells' ratios of rates, each weighted by its rows with a deep fall; cells whose others never rose have no ratio."""
    ratio = F.try_divide(F.col("k1") / F.col("n1"), F.nullif(F.col("k0") / F.col("n0"), F.lit(0.0)))
    used = F.when(ratio.isNotNull(), F.col("weight") * F.col("n1"))
    rows = found if "weight" in found.columns else found.withColumn("weight", F.lit(1))
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(F.try_divide(F.sum(used * ratio), F.sum(used)).alias("lift"), *(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(c) for x, c in ((F.col("weight") * F.col("n1"), "n_deep"), (F.col("weight"), "n_cells"))))


def drawn(replicate: Column, slot: Column, n: Column, seed: int) -> Column:
    """A place in 0..n-1, by arithmetic that any SQL engine repeats."""
    x = (replicate * 7919 + slot * 104729 + F.lit(seed * 1299709)) % 2147483647
    return (x * 48271 % 2147483647) % n


def year_interval(found: DataFrame, draws: int = 2000, seed: int = 1) -> DataFrame:
    """(lift, low, high): the lift and the 5th and 95th percentile of it over resampled years.

    A replicate draws as many years as there are, with repetition. How often it drew a year is the weight of that
    year's cells. Draws are spread over tasks; the years (a few dozen rows) meet them in a join.
    """
    years = found.select("year").distinct()
    order = years.withColumn("slot", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("year")) - 1).cast("long"))  # one row a year
    size = years.agg(F.count("*").alias("n"))
    slots = found.sparkSession.range(draws).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(size)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    picked = slots.select("replicate", drawn(F.col("replicate"), F.col("k"), F.col("n"), seed).alias("slot")).groupBy("replicate", "slot").agg(F.count("*").alias("weight"))
    weighted = picked.join(order, "slot").join(found, "year")
    boots = lift(weighted, "replicate").where("lift is not null").agg(F.percentile("lift", F.lit(0.05)).alias("low"), F.percentile("lift", F.lit(0.95)).alias("high"))
    return lift(found).crossJoin(F.broadcast(boots))  # one row each


def followers(days: DataFrame, rise: float) -> DataFrame:
    """Medians of what was known before days that rose so far and before the others, and the share of the former that stayed below their old high."""
    columns = ("dd_total", "dd_beta", "dd_idio", "rvol", "beta")
    rose = F.col("drawup") >= rise
    return days.groupBy(rose.alias("rose")).agg(F.count("*").alias("n"), *(F.median(c).alias(c) for c in columns), F.avg(F.when(rose, (~F.col("exceeded")).cast("int"))).alias("round_trip"))
