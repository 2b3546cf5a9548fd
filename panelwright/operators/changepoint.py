"""A flat base and the rise out of it: one change of slope, estimated for every day from what lies before it."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_ticker
from panelwright.session import ship

# fixed values: look-back, least length of the base, youngest and oldest rise, weights and guards of the strength
LOOK_BACK, BASE_LEAST, RISE_LEAST, RISE_MOST = 504, 40, 15, 252
FLAT_WEIGHT, CLEARANCE_MOST, SLOPE_MOST, PRICE_LEAST, FLAT_MOST, AFTER = 1.5, 2.5, 0.6, 3.0, 0.08, 20

#: Rows of one ticker that meet in one group of the join below, and of ``by_blocks``; rows whose windows lie in memory together.
BLOCK, SERIES_BLOCK, TOGETHER = 256, 4096, 128
#: Ends of windows whose points ``_turns`` lays side by side.
NEAR = 64


def span_join(ends: DataFrame, points: DataFrame, low: str, high: str, block: int = BLOCK) -> DataFrame:
    """``ends`` with every row of ``points`` (ticker, point, ...) of its ticker from ``low`` to ``high``, both included.

    Points are dealt into blocks by place, and each end goes to the blocks that its span touches, so the work is in
    proportion to the spans and not to the square of a series, and a ticker with a long history is many groups.
    """
    blocks = F.sequence(F.floor(F.col(low) / block), F.floor(F.col(high) / block))
    left = ends.withColumn("block", F.explode(blocks))
    right = points.withColumn("block", F.floor(F.col("point") / block))
    return left.join(right, ["ticker", "block"]).where((F.col("point") >= F.col(low)) & (F.col("point") <= F.col(high))).drop("block")


def by_blocks(rows: DataFrame, reach: int, find: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], reads: list[str], schema: str, keep: list[str] | None = None, block: int = SERIES_BLOCK) -> DataFrame:
    """``rows`` (ticker, i from 0 without gaps, n: the ticker's rows, ...; of them the columns ``keep``, all unless given) and what ``find`` says of each from itself and the ``reach`` rows before it.

    A ticker's rows are dealt into blocks by place, and each block also gets the ``reach`` rows before it, so a group is
    bounded however long a series is. ``find`` gets the columns ``reads`` of a block's rows in order, NULL as NaN, and
    answers for all of them; answers of the rows before the block are dropped. ``schema`` names what is added.
    """
    ship(rows.sparkSession)
    names, added = keep or rows.columns, [c.split()[0] for c in schema.split(",")]
    types = rows.select(*names).schema
    last = F.floor((F.col("n") - 1) / block)
    dealt = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / block), F.least(last, F.floor((F.col("i") + reach) / block))))).select(*dict.fromkeys(["ticker", "i", *names, *reads, "block"]))

    def group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("i").combine_chunks()
        i = table["i"].to_numpy()
        found = find({c: table[c].to_numpy() for c in reads})
        own = np.flatnonzero(i >= key[1].as_py() * block)
        whole = table.select(names).slice(own[0] if len(own) else len(i))
        for c in added:
            x = found[c][own]
            whole = whole.append_column(c, pa.array(x, mask=np.isnan(x)) if x.dtype.kind == "f" else pa.array(x, mask=x < 0))
        return whole

    out = types.simpleString()[len("struct<") : -1].replace(":", " ") + ", " + schema  # columns of plain types
    return dealt.groupBy("ticker", "block").applyInArrow(group, out)


def breakouts(bars: DataFrame) -> DataFrame:
    """(ticker, date, tau_date, base_slope, rise_slope, drift, fit_gain, clearance, range_ratio, volume_ratio, strength) for every day.

    For each day the log price of at most LOOK_BACK rows up to it is fitted by two lines that meet nowhere in
    particular; ``tau_date`` is the first row of the second one, chosen by the least squared error of both. Errors of
    all segments come from running sums. Slopes are in deviations of the window's daily steps. The two ratios compare
    AFTER rows from tau on with the base. Days with too short a history, and tickers of under 60 rows, have NULLs.
    """
    by = by_ticker()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    since = lambda x: F.coalesce(F.lag(x, LOOK_BACK - 1).over(by), F.lit(0.0))  # noqa: E731  of the window's first row; a ticker's first row has 0
    after = by.rowsBetween(0, AFTER - 1)
    y = F.ln(F.greatest("adj_close", F.lit(1e-9)))
    rows = bars.select("ticker", "date", "adj_close", F.coalesce(F.col("volume"), F.lit(0)).cast("double").alias("v"), y.alias("y"))
    rows = rows.withColumn("i", (F.row_number().over(by) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).withColumn("d", F.coalesce(F.col("y") - F.lag("y").over(by), F.lit(0.0)))
    terms = {"y": F.col("y"), "yy": F.col("y") * F.col("y"), "xy": F.col("y") * F.col("i"), "d": F.col("d"), "dd": F.col("d") * F.col("d"), "a": F.abs("d"), "v": F.col("v")}
    # sums of all rows before a row; those of all rows up to it are the next row's
    rows = rows.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"s_{k}") for k, c in terms.items()))
    rows = rows.select("*", *(F.coalesce(F.lead(f"s_{k}").over(by), F.col(f"s_{k}") + c).alias(f"e_{k}") for k, c in terms.items()), *(since(f"s_{k}").alias(f"w_{k}") for k in terms),
        since("d").alias("w_d0"), F.avg(F.abs("d")).over(after).alias("after_a"), F.avg("v").over(after).alias("after_v"))
    rows = rows.withColumn("ws", F.greatest(F.lit(0).cast("long"), F.col("i") - (LOOK_BACK - 1))).withColumn("low", F.greatest(F.col("ws") + BASE_LEAST, F.col("i") - (RISE_MOST - 1))).withColumn("high", F.col("i") - RISE_LEAST)

    enough = (F.col("i") >= BASE_LEAST + RISE_LEAST) & (F.col("n") >= BASE_LEAST + RISE_LEAST + 5) & (F.col("low") <= F.col("high"))
    rows = rows.withColumn("ends", F.when(enough, 1).otherwise(0).cast("long"))
    reads = ["i", "ws", "low", "high", "ends", "adj_close", *(f"{p}_{k}" for p in "sew" for k in ("y", "yy", "xy")), "s_a", "s_v", "after_a", "after_v"]
    added = "point long, sse double, s1 double, s2 double, whole double, p_a double, p_v double, tau_a double, tau_v double, top double, mid double"
    keep = ["ticker", "date", "i", "adj_close", "ws", "e_d", "e_dd", *(f"w_{k}" for k in ("d", "dd", "a", "v")), "w_d0"]
    fitted = by_blocks(rows, LOOK_BACK - 1, _best_splits, reads, added, keep)
    # the day itself is looked up by place, as arrays of a block hold numbers only
    tau = rows.select("ticker", F.col("i").alias("point"), F.col("date").alias("tau_date"))
    return _described(fitted.withColumnsRenamed({"tau_a": "after_a", "tau_v": "after_v"}).join(tau, ["ticker", "point"], "left"))


def turns(bars: DataFrame, *carried: str, dates: DataFrame | None = None, also: tuple[Callable, dict[str, Column], str] | None = None) -> DataFrame:
    """(ticker, date, drift, fit_gain) as ``breakouts`` has them, with columns of ``bars`` carried along; where ``dates`` is given, on these dates alone.

    ``also``, with ``dates``: a function as ``by_blocks`` takes one, what it reads besides i and wanted (1 on the dates), and what it adds.

    What only the other columns need is left out: highs and sorted prices of the base, the day of the change.
    """
    by = by_ticker()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = bars.select("ticker", "date", *carried, F.ln(F.greatest("adj_close", F.lit(1e-9))).alias("y"), *(c.alias(n) for n, c in (also[1] if also else {}).items()))
    rows = rows.withColumn("i", (F.row_number().over(by) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).withColumn("d", F.coalesce(F.col("y") - F.lag("y").over(by), F.lit(0.0)))
    terms = {"y": F.col("y"), "yy": F.col("y") * F.col("y"), "xy": F.col("y") * F.col("i"), "d": F.col("d"), "dd": F.col("d") * F.col("d")}
    find, reads, schema = _turns, ["i", "y", "d", "ends", *(f"s_{k}" for k in terms)], "drift double, fit_gain double"
    if also is not None:
        find, reads, schema = (lambda r, more=also[0]: _turns(r) | more(r)), [*reads, "wanted", *also[1]], f"{schema}, {also[2]}"
    rows = rows.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"s_{k}") for k, c in terms.items()))
    asked = F.lit(1)
    if dates is not None:
        rows, asked = rows.join(F.broadcast(dates.select("date", F.lit(1).alias("asked"))), "date", "left"), F.coalesce("asked", F.lit(0))
        rows = rows.withColumn("wanted", asked)
    rows = rows.withColumn("ends", F.when((F.col("i") >= BASE_LEAST + RISE_LEAST) & (F.col("n") >= BASE_LEAST + RISE_LEAST + 5), asked).otherwise(0).cast("long"))
    found = by_blocks(rows, LOOK_BACK - 1, find, reads, schema, ["ticker", "date", *carried, *(["asked"] if dates is not None else [])])
    return found if dates is None else found.where("asked = 1").drop("asked")


@functools.lru_cache(maxsize=32)
def _places(i: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Points of the windows that end at the places ``i``, which of them lie outside an end's own, and number, sum and spread of the places from a point to an end."""
    end = np.array(i, dtype=np.int64)[:, None]
    low, high = np.maximum(np.maximum(0, end - (LOOK_BACK - 1)) + BASE_LEAST, end - (RISE_MOST - 1)), end - RISE_LEAST
    points = np.arange(low.min(), high.max() + 1)
    a, b = points.astype(float), end + 1.0
    n, x = b - a, b * (b - 1) / 2 - a * (a - 1) / 2
    xx = (b - 1) * b * (2 * b - 1) / 6 - (a - 1) * a * (2 * a - 1) / 6
    with np.errstate(all="ignore"):
        return points, (points < low) | (points > high), n, x, xx - x * x / n


def _turns(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Change of slope and gain of two lines over one for the rows that end a window.

    Ends that follow each other share their points: what a point or an end has alone is one line of an array, and while
    their windows begin at the same row, so is the first line's error. What comes from places alone is kept between tickers.
    """
    i, first, d = r["i"], r["i"][0], r["d"]
    n = len(i)
    out = {c: np.full(n, np.nan) for c in ("drift", "fit_gain")}
    terms = {"y": r["y"], "yy": r["y"] * r["y"], "xy": r["y"] * i, "d": d, "dd": d * d}
    ws_all = np.maximum(0, i - (LOOK_BACK - 1))
    ends = np.flatnonzero((r["ends"] == 1) & (ws_all >= first))  # others lie before the block
    fits = ("y", "yy", "xy")
    k = 0
    while k < len(ends):
        at = ends[k : k + NEAR]
        at = at[at < at[0] + 2 * NEAR]
        k += len(at)
        ws, end = ws_all[at], i[at] + 1
        points, outside, size, x, spread = _places(tuple(i[at].tolist()))
        here = slice(points[0] - first, points[-1] + 1 - first)
        w, e, sums = {c: r[f"s_{c}"][ws - first] for c in terms}, {c: r[f"s_{c}"][at] + x[at] for c, x in terms.items()}, {c: r[f"s_{c}"][here] for c in fits}
        column = lambda x: {c: x[c][:, None] for c in fits}
        with np.errstate(all="ignore"):  # points outside an end's own are left out below
            left = _segment(ws[:1], points, {c: w[c][:1] for c in fits}, sums)[0] if ws[0] == ws[-1] else _segment(ws[:, None], points, column(w), sums)[0]
            y, error, cross = (e[c][:, None] - sums[c] for c in fits)  # the second line's, as _segment has it
            part = np.multiply(x, y)
            cross -= np.divide(part, size, out=part)
            np.multiply(y, y, out=part)
            error -= np.divide(part, size, out=part)
            cross *= np.divide(cross, spread, out=part)
            error -= cross
            error += left
            error[outside] = np.inf
            best = error.argmin(axis=1)  # the first NaN, where there is one
            if np.isnan(error[np.arange(len(at)), best]).any():
                best = np.nanargmin(error, axis=1)
            tau = points[best]
            split = {c: r[f"s_{c}"][tau - first] for c in fits}
            (e1, s1), (e2, s2), (whole, _) = _segment(ws, tau, w, split), _segment(tau, end, split, e), _segment(ws, end, w, e)
            m = i[at] - ws
            mean = (e["d"] - w["d"] - d[ws - first]) / m  # the window's own first step doesn't count
            sigma = np.sqrt(np.maximum((e["dd"] - w["dd"] - d[ws - first] * d[ws - first]) / m - mean * mean, 0.0)) + 1e-9
            out["drift"][at], out["fit_gain"][at] = (s2 - s1) / sigma, np.where(whole > 0, 1 - (e1 + e2) / whole, 0.0)
    return out


def _best_splits(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For the rows that end a window: the place with the least error of two lines, its sums, and highest and middle price of the base before it."""
    i, first = r["i"], r["i"][0]
    n = len(i)
    out = {c: np.full(n, np.nan) for c in ("sse", "s1", "s2", "whole", "p_a", "p_v", "tau_a", "tau_v", "top", "mid")} | {"point": np.full(n, -1, dtype=np.int64)}
    ends = np.flatnonzero((r["ends"] == 1) & (r["ws"] >= first))  # others lie before the block
    for at in (ends[k : k + TOGETHER] for k in range(0, len(ends), TOGETHER)):
        ws, low, high = (r[c][at][:, None] for c in ("ws", "low", "high"))
        point = low + np.arange((high - low).max() + 1)[None, :]
        met = point <= high
        place = np.where(met, point, low) - first
        sums = {k: r[f"s_{k}"][place] for k in ("y", "yy", "xy")}
        w, e = ({k: r[f"{p}_{k}"][at][:, None] for k in ("y", "yy", "xy")} for p in "we")
        end = i[at][:, None] + 1
        error = _segment(ws, point, w, sums)[0] + _segment(point, end, sums, e)[0]
        best = np.nanargmin(np.where(met, error, np.inf), axis=1)
        tau = point[np.arange(len(at)), best]
        there = tau - first
        out["point"][at], out["sse"][at] = tau, error[np.arange(len(at)), best]
        split = {k: r[f"s_{k}"][there][:, None] for k in sums}
        out["s1"][at], out["s2"][at], out["whole"][at] = _segment(ws, tau[:, None], w, split)[1][:, 0], _segment(tau[:, None], end, split, e)[1][:, 0], _segment(ws, end, w, e)[0][:, 0]
        for c, source in (("p_a", "s_a"), ("p_v", "s_v"), ("tau_a", "after_a"), ("tau_v", "after_v")):
            out[c][at] = r[source][there]
        size = (tau - ws[:, 0])[:, None]
        span = np.arange(size.max())[None, :]
        base = r["adj_close"][np.where(span < size, ws - first + span, ws - first)]
        base = np.sort(np.where((span < size) & ~np.isnan(base), base, np.inf), axis=1)
        known = np.isfinite(base).sum(axis=1)
        row, half = np.arange(len(at)), known // 2
        with np.errstate(invalid="ignore"):
            middle = np.where(known % 2 == 1, base[row, np.minimum(half, base.shape[1] - 1)], (base[row, np.maximum(half - 1, 0)] + base[row, np.minimum(half, base.shape[1] - 1)]) / 2)
        out["top"][at] = np.where(known > 0, base[row, np.maximum(known - 1, 0)], np.nan)
        out["mid"][at] = np.where(known > 0, middle, np.nan)
    return out


def _segment(a: np.ndarray, b: np.ndarray, low: dict, high: dict) -> tuple[np.ndarray, np.ndarray]:
    """Squared error and slope of the least-squares line over the places from a to b - 1, by running sums at a and b; NaN for points of one place."""
    a, b = a.astype(float), b.astype(float)
    n, x = b - a, b * (b - 1) / 2 - a * (a - 1) / 2
    xx = (b - 1) * b * (2 * b - 1) / 6 - (a - 1) * a * (2 * a - 1) / 6
    y, yy, xy = (high[k] - low[k] for k in ("y", "yy", "xy"))
    sx, s = xx - x * x / n, xy - x * y / n
    slope = s / np.where(np.abs(sx) >= 1e-12, sx, np.nan)
    return yy - y * y / n - s * slope, slope


def _described(fitted: DataFrame) -> DataFrame:
    c, known = F.col, F.col("point").isNotNull()
    s1, s2, whole = c("s1"), c("s2"), c("whole")
    m = c("i") - c("ws")  # the window's own first step doesn't count
    mean = (c("e_d") - c("w_d") - c("w_d0")) / m
    spread = (c("e_dd") - c("w_dd") - c("w_d0") * c("w_d0")) / m - mean * mean
    sigma = F.sqrt(F.greatest(spread, F.lit(0.0))) + 1e-9
    size = c("point") - c("ws")
    base_a = F.when(size > 1, (c("p_a") - c("w_a") - F.abs("w_d0")) / (size - 1))
    base_v = (c("p_v") - c("w_v")) / size
    fitted, sigma = fitted.withColumn("sigma", F.when(known, sigma)), c("sigma")
    out = fitted.select(
        *("ticker", "date", "tau_date"),
        F.when(known, s1 / sigma).alias("base_slope"), F.when(known, s2 / sigma).alias("rise_slope"), F.when(known, (s2 - s1) / sigma).alias("drift"),
        F.when(known, F.when(whole > 0, 1 - c("sse") / whole).otherwise(0.0)).alias("fit_gain"), F.when(c("top") > 0, c("adj_close") / c("top") - 1).alias("clearance"),
        F.when(base_a > 0, c("after_a") / base_a).alias("range_ratio"), F.when(base_v > 0, c("after_v") / base_v).alias("volume_ratio"), F.when(known, c("mid")).alias("base_price"),
    )
    fine = (c("clearance") > 0) & (c("clearance") < CLEARANCE_MOST) & (c("drift") > 0) & (c("rise_slope") < SLOPE_MOST) & (c("base_price") > PRICE_LEAST) & (F.abs("base_slope") < FLAT_MOST)
    strength = F.when(F.coalesce(fine, F.lit(False)), c("fit_gain") * F.greatest(c("drift"), F.lit(0.0)) * F.exp(-FLAT_WEIGHT * F.abs("base_slope"))).otherwise(0.0)
    return out.withColumn("strength", F.when(c("base_slope").isNotNull(), strength)).drop("base_price")
