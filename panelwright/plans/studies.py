"""Registered queries of the research operators: changes of slope, falls and what follows them, matched comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import changepoint, drawdowns, formation, launches, screen
from panelwright.plans import extended
from panelwright.plans import queries as base
from panelwright.plans.queries import query, rounded
from panelwright.sources import adapters as src

# --- E11


def _fit(n: str, x: str, xx: str, y: str, yy: str, xy: str) -> str:
    return f"(({yy}) - ({y}) * ({y}) / ({n}) - pow(({xy}) - ({x}) * ({y}) / ({n}), 2) / (({xx}) - ({x}) * ({x}) / ({n})))"


def _segment(a: str, b: str, low: str, high: str) -> str:
    """Squared error over the places from a to b - 1, by running sums of the rows at a and b."""
    x, xx = (f"({b}::DOUBLE * ({b} - 1) / 2 - {a}::DOUBLE * ({a} - 1) / 2)", f"(({b} - 1)::DOUBLE * {b} * (2 * {b} - 1) / 6 - ({a} - 1)::DOUBLE * {a} * (2 * {a} - 1) / 6)")
    return _fit(f"({b} - {a})", x, xx, *(f"{high}{k} - {low}{k}" for k in ("sy", "syy", "sxy")))


BREAKOUTS = (
    ", r AS (SELECT ticker, date, adj_close AS px, coalesce(volume, 0)::DOUBLE AS v, ln(greatest(adj_close, 1e-9)) AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    "s AS (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY ticker ORDER BY i), 0) AS d, coalesce(sum(y) OVER w, 0) AS sy, coalesce(sum(y * y) OVER w, 0) AS syy, coalesce(sum(y * i) OVER w, 0) AS sxy FROM r WINDOW w AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "e AS MATERIALIZED (SELECT s.ticker, s.date, s.i, s.px, s.i - least(s.i, 503) AS ws, s.sy + s.y AS e_sy, s.syy + s.y * s.y AS e_syy, s.sxy + s.y * s.i AS e_sxy, a.sy AS w_sy, a.syy AS w_syy, a.sxy AS w_sxy FROM s JOIN s a ON a.ticker = s.ticker AND a.i = s.i - least(s.i, 503) WHERE s.i >= 55 AND s.n >= 60), "
    "c AS (SELECT e.ticker, e.i, e.ws, t.i AS tau, "
    + _segment("e.ws", "t.i", "e.w_", "t.")
    + " + "
    + _segment("t.i", "(e.i + 1)", "t.", "e.e_")
    + " AS sse FROM e JOIN s t ON t.ticker = e.ticker AND t.i BETWEEN greatest(e.ws + 40, e.i - 251) AND e.i - 15), "
    "b AS MATERIALIZED (SELECT ticker, i, ws, arg_min(tau, sse) AS tau, min(sse) AS sse FROM c GROUP BY ticker, i, ws), "
    "base AS (SELECT b.ticker, b.i, regr_slope(y, s.i) AS s1, max(px) AS top, median(px) AS mid, avg(abs(d)) FILTER (s.i > ws) AS a, avg(v) AS v FROM b JOIN s ON s.ticker = b.ticker AND s.i >= ws AND s.i < tau GROUP BY ALL), "
    "rise AS (SELECT b.ticker, b.i, regr_slope(y, s.i) AS s2 FROM b JOIN s ON s.ticker = b.ticker AND s.i BETWEEN tau AND b.i GROUP BY ALL), "
    "late AS (SELECT b.ticker, b.i, avg(abs(d)) AS a, avg(v) AS v FROM b JOIN s ON s.ticker = b.ticker AND s.i BETWEEN tau AND tau + 19 GROUP BY ALL), "
    "whole AS (SELECT b.ticker, b.i, stddev_pop(d) FILTER (s.i > ws) + 1e-9 AS sg, regr_syy(y, s.i) - pow(regr_sxy(y, s.i), 2) / regr_sxx(y, s.i) AS line FROM b JOIN s ON s.ticker = b.ticker AND s.i BETWEEN ws AND b.i GROUP BY ALL), "
    "f AS (SELECT ticker, i, t.date AS tau_date, s1 / sg AS base_slope, s2 / sg AS rise_slope, (s2 - s1) / sg AS drift, CASE WHEN line > 0 THEN 1 - sse / line ELSE 0 END AS fit_gain, CASE WHEN top > 0 THEN e.px / top - 1 END AS clearance, "
    "CASE WHEN base.a > 0 THEN late.a / base.a END AS range_ratio, CASE WHEN base.v > 0 THEN late.v / base.v END AS volume_ratio, mid FROM b JOIN base USING (ticker, i) JOIN rise USING (ticker, i) JOIN late USING (ticker, i) JOIN whole USING (ticker, i) JOIN e USING (ticker, i) JOIN (SELECT ticker, i AS tau, date FROM s) t USING (ticker, tau)) "
    "SELECT s.ticker, s.date, tau_date, {columns} FROM s LEFT JOIN f USING (ticker, i)"
)
_STRENGTH = "CASE WHEN base_slope IS NULL THEN NULL WHEN clearance > 0 AND clearance < 2.5 AND drift > 0 AND rise_slope < 0.6 AND mid > 3 AND abs(base_slope) < 0.08 THEN fit_gain * drift * exp(-1.5 * abs(base_slope)) ELSE 0 END"
_BREAKOUT_COLUMNS = ("base_slope", "rise_slope", "drift", "fit_gain", "clearance", "range_ratio", "volume_ratio")


@query(BREAKOUTS.replace("{columns}", ", ".join(f"CASE WHEN abs({x}) >= 0.00005 THEN round({x}, 4) WHEN {x} IS NOT NULL THEN 0.0 END AS {c}" for c, x in [*zip(_BREAKOUT_COLUMNS, _BREAKOUT_COLUMNS), ("strength", f"({_STRENGTH})")])))
def e11_breakouts(spark, sf):
    """For every ticker and day the best split of its last 504 rows into a base and a rise, and the strength of the rise."""
    return rounded(changepoint.breakouts(src.daily_bars(spark, sf)), 4)


# --- E9 and the studies of falls

PARTS = (
    ", r0 AS (SELECT b.ticker, b.date, b.adj_close AS close, x.close AS m, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) - 1 AS i FROM bars b LEFT JOIN spx x ON b.date = x.date), "
    "r1 AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE ln(close) - ln(lag(close) OVER w) END AS r, CASE WHEN i = 0 THEN 0 ELSE ln(m / lag(m) OVER w) END AS q FROM r0 WINDOW w AS (PARTITION BY ticker ORDER BY i)), "
    "r2 AS (SELECT ticker, date, i, close, CASE WHEN count(q) OVER w >= 126 AND var_samp(q) OVER w > 0 THEN covar_samp(r, q) OVER w / var_samp(q) OVER w END AS b, sum(CASE WHEN q IS NULL THEN 0 ELSE r END) OVER u AS s, sum(coalesce(q, 0)) OVER u AS k, "
    "close / CASE WHEN count(close) OVER w >= 126 THEN max(close) OVER w END - 1 AS dd_total, CASE WHEN count(r) OVER v >= 63 THEN stddev_samp(r) OVER v * sqrt(252) END AS rvol, m / CASE WHEN count(m) OVER w >= 126 THEN max(m) OVER w END - 1 AS mkt_dd FROM r1 "
    "WINDOW w AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), v AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 125 PRECEDING AND CURRENT ROW), u AS (PARTITION BY ticker ORDER BY i ROWS UNBOUNDED PRECEDING)), "
    "r3 AS (SELECT t.ticker, t.i, any_value(t.b) AS beta, any_value(t.b * t.k) - max(t.b * p.k) AS fb, any_value(t.s - t.b * t.k) - max(p.s - t.b * p.k) AS fi FROM r2 t JOIN r2 p ON p.ticker = t.ticker AND p.i BETWEEN t.i - 251 AND t.i WHERE t.i >= 252 AND (t.i - 252) % 5 = 0 AND t.b IS NOT NULL GROUP BY t.ticker, t.i), "
    "parts AS (SELECT ticker, date, i, close, dd_total, exp(last_value(fb IGNORE NULLS) OVER u) - 1 AS dd_beta, exp(last_value(fi IGNORE NULLS) OVER u) - 1 AS dd_idio, rvol, last_value(beta IGNORE NULLS) OVER u AS beta, mkt_dd FROM r2 LEFT JOIN r3 USING (ticker, i) WINDOW u AS (PARTITION BY ticker ORDER BY i ROWS UNBOUNDED PRECEDING))"
)
DAYS = (
    PARTS + ", t0 AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n, CASE WHEN count(close) OVER (w ROWS BETWEEN CURRENT ROW AND 126 FOLLOWING) = 127 THEN max(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 126 FOLLOWING) END AS best, "
    "CASE WHEN count(close) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) >= 126 THEN max(close) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) END AS high FROM parts WINDOW w AS (PARTITION BY ticker ORDER BY i)), "
    "t1 AS (SELECT t0.*, coalesce(sector, 'Unknown') AS sector, year(date) AS year, best / close - 1 AS drawup, best > high AS exceeded FROM t0 LEFT JOIN universe USING (ticker) WHERE n >= 386 AND i >= 260 AND (i - 260) % 5 = 0 AND best IS NOT NULL AND rvol IS NOT NULL AND dd_total IS NOT NULL), "
    "days AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY rvol) + (count(*) OVER (PARTITION BY date, rvol) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS vol_rank FROM t1)"
)


def _cells(fall: str, rise: float, bins: int, where: str = "true") -> str:
    return (
        f"SELECT year, sector, CAST(least(floor(vol_rank * {bins}), {bins - 1}) AS BIGINT) AS bin, count(*) FILTER (coalesce({fall} <= -0.3, false)) AS n1, count(*) FILTER (coalesce({fall} <= -0.3, false) AND drawup >= {rise}) AS k1, "
        f"count(*) FILTER (NOT coalesce({fall} <= -0.3, false)) AS n0, count(*) FILTER (NOT coalesce({fall} <= -0.3, false) AND drawup >= {rise}) AS k0 FROM days WHERE {where} GROUP BY ALL HAVING n1 >= 20 AND n0 >= 20"
    )


LIFT = "sum(weight * n1 * (k1 / n1) / (k0 / n0)) FILTER (k0 > 0) / sum(weight * n1) FILTER (k0 > 0)"


def _parts(spark, sf):
    return drawdowns.decomposed(src.daily_bars(spark, sf), src.benchmark(spark, sf))


def _days(spark, sf):
    """The test tables have some 533 rows a ticker, so half a year follows and not a whole one, and the step is 5."""
    return drawdowns.sampled_days(_parts(spark, sf), src.universe(spark, sf), step=5, least=260, ahead=126)


@query(PARTS + " SELECT ticker, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("dd_total", "dd_beta", "dd_idio", "rvol", "beta", "mkt_dd")) + " FROM parts")
def e9_drawdown_parts(spark, sf):
    """How far each ticker is below its high, and how far the market's part and its own part of the path are."""
    return rounded(_parts(spark, sf).drop("i", "close"))


@query(DAYS + " SELECT ticker, date, CAST(year AS BIGINT) AS year, sector, round(dd_total, 6) AS dd_total, round(dd_beta, 6) AS dd_beta, round(dd_idio, 6) AS dd_idio, round(rvol, 6) AS rvol, round(beta, 6) AS beta, round(mkt_dd, 6) AS mkt_dd, round(drawup, 6) AS drawup, exceeded, round(vol_rank, 6) AS vol_rank FROM days")
def q18_sampled_days(spark, sf):
    """Q18: sampled days with what was known, the best of the rows ahead, whether it beats the old high, and the volatility's rank on its date."""
    return rounded(_days(spark, sf))


_FALLS = ("dd_total", "dd_beta", "dd_idio")


@query(
    DAYS + ", " + ", ".join(f"c_{f} AS ({_cells(f, 0.5, 2)})" for f in _FALLS) + " "
    + " UNION ALL ".join(f"SELECT '{f}' AS fall, year, round({LIFT.replace('weight * ', '')}, 6) AS lift, CAST(coalesce(sum(n1), 0) AS BIGINT) AS n_deep, count(*) AS n_cells FROM c_{f} GROUP BY GROUPING SETS ((), (year))" for f in _FALLS)
)
def q17_matched_cells(spark, sf):
    """Q17: lift of a rise by half after a deep fall, within cells of year, sector and volatility of the same date: overall (year NULL) and by year."""
    days = _days(spark, sf)
    out = None
    for fall in _FALLS:
        found = drawdowns.cells(days, fall, 0.5, 2)
        both = drawdowns.lift(found).withColumn("year", F.lit(None).cast("int")).unionByName(drawdowns.lift(found, "year"))
        rows = both.select(F.lit(fall).alias("fall"), F.col("year").cast("long").alias("year"), "lift", "n_deep", "n_cells")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)


@query(DAYS + f", c AS ({_cells('dd_beta', 0.5, 2, 'mkt_dd <= -0.1')}) SELECT count(*) AS n_cells, round({LIFT.replace('weight * ', '')}, 6) AS lift, CAST(coalesce(sum(n1), 0) AS BIGINT) AS n_deep FROM c")
def q17_stress_lift(spark, sf):
    """Q17: the same for the market's part of the fall, on days of the market's own stress only."""
    days = _days(spark, sf).where(F.col("mkt_dd") <= -drawdowns.STRESS)
    out = drawdowns.lift(drawdowns.cells(days, "dd_beta", 0.5, 2))
    return rounded(out)


@query(
    DAYS + f", c AS ({_cells('dd_total', 0.5, 2)}), y AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM c)), "
    "d AS (SELECT replicate, ((replicate * 7919 + k * 104729 + 1299709) % 2147483647 * 48271 % 2147483647) % n AS slot FROM (SELECT unnest(range(2000)) AS replicate), (SELECT any_value(n) AS n FROM y), LATERAL (SELECT unnest(range(n)) AS k)), "
    "w AS (SELECT replicate, slot, count(*) AS weight FROM d GROUP BY ALL), "
    f"b AS (SELECT replicate, {LIFT} AS lift FROM w JOIN y USING (slot) JOIN c USING (year) GROUP BY replicate) "
    f"SELECT (SELECT round({LIFT.replace('weight * ', '')}, 6) FROM c) AS lift, (SELECT CAST(coalesce(sum(n1), 0) AS BIGINT) FROM c) AS n_deep, (SELECT count(*) FROM c) AS n_cells, round(quantile_cont(lift, 0.05), 6) AS low, round(quantile_cont(lift, 0.95), 6) AS high FROM b WHERE lift IS NOT NULL"
)
def q9_year_interval(spark, sf):
    """Q9: the lift's interval over 2000 draws of whole years."""
    return rounded(drawdowns.year_interval(drawdowns.cells(_days(spark, sf), "dd_total", 0.5, 2)))


@query(DAYS + " SELECT drawup >= 0.5 AS rose, count(*) AS n, " + ", ".join(f"round(median({c}), 6) AS {c}" for c in ("dd_total", "dd_beta", "dd_idio", "rvol", "beta")) + ", CASE WHEN drawup >= 0.5 THEN round(avg(CASE WHEN exceeded THEN 0 ELSE 1 END), 6) END AS round_trip FROM days GROUP BY drawup >= 0.5".replace("CASE WHEN drawup >= 0.5 THEN round", "CASE WHEN bool_and(drawup >= 0.5) THEN round"))
def q19_round_trips(spark, sf):
    """Q19: medians before days that rose by half and before the others, and how many of the former stayed below their old high."""
    return rounded(drawdowns.followers(_days(spark, sf), 0.5))


# --- signals at formation dates, pools and intervals


def _roll(f: str, x: str, n: int, least: int | None = None) -> str:
    frame = f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN {f}({x}) {frame} END"


def _rank(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def _share(x: str, by: str = "date") -> str:
    return f"({_rank(x, by)}) / nullif(count({x}) OVER (PARTITION BY {by}), 0)"


AHEAD = (
    ", fw AS (SELECT ticker, date, lead(close, 21) OVER w / close - 1 AS ret, CASE WHEN count(lr) OVER (w ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) = 21 THEN stddev_samp(lr) OVER (w ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) * sqrt(252) END AS vol, "
    "CASE WHEN count(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) = 21 THEN min(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) END / close - 1 AS trough "
    "FROM (SELECT ticker, date, close, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM bars) WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    "form AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)) WHERE o >= 300 AND o < n - 22 AND (o - 300) % 21 = 0)"
)
_RETURNS = ("ret_5", "ret_21", "ret_63", "ret_126", "mom_12_1", "slope_r2", "ker_63", "sharpe_63")
_PARTS = ("slope_r2", "ker_63", "sharpe_63")
FORMED = (
    extended.SIGNALS + AHEAD + ", c0 AS (SELECT s.*, ret, vol, trough FROM s JOIN fw USING (ticker, date) JOIN form USING (date) WHERE ret IS NOT NULL AND vol IS NOT NULL), "
    f"c1 AS (SELECT *, {', '.join(f'{_share(c)} AS q_{c}' for c in _PARTS)} FROM c0), formed AS (SELECT * EXCLUDE ({', '.join(f'q_{c}' for c in _PARTS)}), round(list_avg([{', '.join(f'q_{c}' for c in _PARTS)}]), 9) AS stable_mom FROM c1)"
)


def _formation_dates(spark, sf, h: int = 21):
    return formation.formation_dates(src.bar_dates(spark, sf), 300, h, 21)


def _formed(spark, sf, h: int = 21):
    """Signals and what follows on formation dates: every 21st date from the 300th on."""
    bars = formation.ahead(src.daily_bars(spark, sf), h, "close")
    signals = extended.signals_of(bars, "ret", "vol", "trough").join(F.broadcast(_formation_dates(spark, sf, h)), "date").where("ret is not null and vol is not null")
    return formation.mean_rank_share(signals, list(_PARTS), "stable_mom").withColumn("stable_mom", F.round("stable_mom", 9))


_SIGNALS = (*_RETURNS, "stable_mom")


@query(
    FORMED + ", l AS (" + " UNION ALL ".join(f"SELECT ticker, date, ret, vol, trough, '{s}' AS signal, {s} AS x FROM formed WHERE {s} IS NOT NULL" for s in _SIGNALS) + "), "
    f"m AS (SELECT *, count(*) OVER (PARTITION BY signal, date) AS n, {_rank('x', 'signal, date')} AS rx, {_rank('ret', 'signal, date')} AS ry, row_number() OVER (PARTITION BY signal, date ORDER BY x DESC, ticker) AS t, row_number() OVER (PARTITION BY signal, date ORDER BY x, ticker DESC) AS b FROM l), "
    "d AS (SELECT signal, date, corr(rx, ry) AS ic, avg(ret) FILTER (t <= greatest(5, floor(n * 0.1))) AS r, avg(vol) FILTER (t <= greatest(5, floor(n * 0.1))) AS v, avg(trough) FILTER (t <= greatest(5, floor(n * 0.1))) AS tr, avg(ret) FILTER (b <= greatest(5, floor(n * 0.1))) AS br FROM m WHERE n >= 10 GROUP BY signal, date) "
    "SELECT signal, count(*) AS n, round(avg(ic), 6) AS ic_mean, round(stddev_pop(ic), 6) AS ic_std, CASE WHEN count(ic) > 2 THEN round(avg(ic) / (nullif(stddev_pop(ic), 0) / sqrt(count(ic))), 6) END AS ic_t, round(avg(r), 6) AS top_ret, round(avg(v), 6) AS top_vol, round(avg(tr), 6) AS top_trough, round(avg(r) - avg(br), 6) AS spread, round(avg(r) / avg(v), 6) AS ret_over_vol FROM d GROUP BY signal"
)
def q6_signal_study(spark, sf):
    """Q6: nine signals on every formation date of at least ten names."""
    return rounded(formation.study_summary(formation.signal_study(_formed(spark, sf), list(_SIGNALS), least=10)))


_PICK = "greatest(2, floor({n} * 0.1))"
POOLED = (
    FORMED + ", brk AS (WITH " + BREAKOUTS[2:].replace("{columns}", "base_slope, drift * fit_gain AS brk") + "), "
    f"u0 AS (SELECT ticker, date, ret, vol, trough, stable_mom AS a, round(brk, 9) AS b FROM formed LEFT JOIN brk USING (ticker, date)), u1 AS (SELECT *, count(*) OVER (PARTITION BY date) AS n_all, a IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY a DESC NULLS LAST, ticker) <= {_PICK.format(n='count(*) OVER (PARTITION BY date)')} AS ka, coalesce({_share('b')} >= 0.9, false) AS kb FROM u0), "
    "wide AS (SELECT date, any_value(n_all) AS n_all, sum(ka::INT)::DOUBLE AS k1, sum(kb::INT)::DOUBLE AS k2, sum((ka AND kb)::INT)::DOUBLE AS k12 FROM u1 GROUP BY date), "
    f"i0 AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, {_rank('a', 'date')} AS ra, {_rank('b', 'date')} AS rb, {_rank('ret', 'date')} AS rr FROM u0 WHERE b > 0), "
    + "i1 AS (SELECT *, " + " + ".join(f"coalesce((r{x} - avg(r{x}) OVER (PARTITION BY date)) / nullif(stddev_samp(r{x}) OVER (PARTITION BY date), 0), 0)" for x in "ab") + " AS c FROM i0 WHERE n >= 6), "
    + "i2 AS (SELECT *, " + ", ".join(f"{x} IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY {'round(c, 9)' if x == 'c' else x} DESC NULLS LAST, ticker) <= {_PICK.format(n='n')} AS p{x}" for x in "abc") + " FROM i1), "
    + "i3 AS (SELECT date, any_value(n) AS n, " + ", ".join(f"avg({m}) FILTER (p{x}) AS {m}_{x}" for x in "abc" for m in ("ret", "vol", "trough")) + ", " + ", ".join(f"avg({m}) AS {m}_pool" for m in ("ret", "vol", "trough")) + ", corr(ra, rr) AS ic_a, corr(rb, rr) AS ic_b FROM i2 GROUP BY date), "
    "pooled AS (SELECT *, ret_a - ret_b AS gap_ret, trough_a - trough_b AS gap_trough, ret_a / nullif(vol_a, 0) - ret_b / nullif(vol_b, 0) AS gap_ret_over_vol, CASE WHEN k1 > 0 AND k2 > 0 THEN k12 / (k1 + k2 - k12) END AS jaccard, CASE WHEN k1 > 0 AND k2 > 0 THEN (k1 * k2 / n_all) / (k1 + k2 - k1 * k2 / n_all) END AS by_chance FROM i3 JOIN wide USING (date))"
)
_POOL_COLUMNS = [*(f"{m}_{x}" for x in "abc" for m in ("ret", "vol", "trough")), *(f"{m}_pool" for m in ("ret", "vol", "trough")), "ic_a", "ic_b", "gap_ret", "gap_trough", "gap_ret_over_vol", "jaccard", "by_chance"]


def _pooled(spark, sf):
    """The pool are names whose slope has risen; the guards of the strength would leave too few of the test tables' names on a date."""
    bars = formation.ahead(src.daily_bars(spark, sf), 21, "close", "adj_close")
    found = changepoint.turns(bars, "ret", "vol", "trough", dates=_formation_dates(spark, sf), also=(formation.trends, formation.trend_reads(), formation.TREND_SCHEMA)).where("ret is not null and vol is not null")
    rows = formation.mean_rank_share(found, list(_PARTS), "stable_mom").select("ticker", "date", "ret", "vol", "trough", F.round("stable_mom", 9).alias("stable_mom"), F.round(F.col("drift") * F.col("fit_gain"), 9).alias("brk"))
    return formation.pool_comparison(rows, F.col("brk") > 0, "stable_mom", "brk", least=6, least_top=2)


@query(POOLED + " SELECT date, n, n_all, " + ", ".join(f"round({c}, 6) AS {c}" for c in _POOL_COLUMNS) + " FROM pooled")
def q7_pool_comparison(spark, sf):
    """Q7: on each formation date, picks of one size out of the pool of names that turned up: by stable momentum, by the turn, by both."""
    return rounded(_pooled(spark, sf))


_MEASURES = ("gap_ret", "gap_trough", "gap_ret_over_vol", "ic_a", "ic_b")


def _intervals(points: str, block: int) -> str:
    """Of ``points`` (key, i from 0, v): as series_intervals, point by point."""
    return (
        f", pts AS ({points}), size AS (SELECT key, count(*) AS n, avg(v) AS mean FROM pts GROUP BY key), "
        f"slots AS (SELECT key, n, r, s FROM size, (SELECT unnest(range(2000)) AS r), LATERAL (SELECT unnest(range(CAST(ceil(n / {block}) AS BIGINT))) AS s) WHERE n > {block}), "
        f"draws AS (SELECT key, n, r, s, ((r * 7919 + s * 104729 + 1299709) % 2147483647 * 48271 % 2147483647) % (n - {block} + 1) AS start FROM slots), "
        f"means AS (SELECT key, r, avg(v) AS m FROM (SELECT key, r, start + j AS i FROM draws, (SELECT unnest(range({block})) AS j) WHERE s * {block} + j < n) JOIN pts USING (key, i) GROUP BY key, r), "
        f"ends AS (SELECT key, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM means GROUP BY key), "
        f"intervals AS (SELECT key, n, mean, CASE WHEN n >= 5 THEN CASE WHEN n <= {block} THEN mean ELSE low END END AS low, CASE WHEN n >= 5 THEN CASE WHEN n <= {block} THEN mean ELSE high END END AS high FROM size LEFT JOIN ends USING (key))"
    )


@query(
    POOLED + _intervals(" UNION ALL ".join(f"SELECT '{m}' AS key, row_number() OVER (ORDER BY date) - 1 AS i, {m} AS v FROM pooled WHERE {m} IS NOT NULL" for m in _MEASURES), 3)
    + " SELECT key AS measure, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM intervals"
)
def q7_pool_intervals(spark, sf):
    """Q7, Q8: gaps between the two pickers and their rank correlations, each with an interval by blocks of three dates."""
    found = _pooled(spark, sf)
    long = found.select("date", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in _MEASURES))).alias("x")).select("date", "x.measure", "x.v")
    return rounded(formation.series_intervals(long, "measure", ["date"], "v", block=3))


@query(
    POOLED + " SELECT CASE WHEN year(date) < 1997 THEN 'early' WHEN year(date) < 1999 THEN 'middle' ELSE 'late' END AS regime, count(*) AS dates, round(avg(trough_a), 6) AS trough_a, round(avg(trough_b), 6) AS trough_b, round(avg(ret_a), 6) AS ret_a, round(avg(ret_b), 6) AS ret_b, round(avg(jaccard), 6) AS jaccard, round(avg(by_chance), 6) AS by_chance FROM pooled GROUP BY 1"
)
def q7_pool_regimes(spark, sf):
    """Q7: the same by regime, with years that the test tables have."""
    by = formation.regime(F.year("date"), (("early", 1997), ("middle", 1999)), "late")
    return rounded(_pooled(spark, sf).groupBy(by.alias("regime")).agg(F.count("*").alias("dates"), *(F.avg(c).alias(c) for c in ("trough_a", "trough_b", "ret_a", "ret_b", "jaccard", "by_chance"))))


@query(", " + _intervals("SELECT bucket AS key, row_number() OVER (PARTITION BY bucket ORDER BY date) - 1 AS i, ln(close) AS v FROM sector_bars", 20)[2:] + " SELECT key AS bucket, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM intervals")
def q8_block_bootstrap(spark, sf):
    """Q8: the mean log price of every sector with an interval over 2000 draws of blocks of 20 dates."""
    return rounded(formation.series_intervals(src.sector_bars(spark, sf).withColumn("v", F.ln("close")), "bucket", ["date"], "v", block=20))


# --- launches

IGNITE = (
    ", g0 AS (SELECT b.ticker, b.date, b.adj_close AS px, coalesce(b.volume, 0)::DOUBLE AS v, last_value(x.close IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date) AS m FROM bars b LEFT JOIN spx x ON x.date = b.date), "
    "g1 AS (SELECT *, px / m AS line, abs(px - lag(px) OVER w) AS move FROM g0 WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    f"g2 AS (SELECT ticker, date, (px / lag(px, 10) OVER w - 1) / 10 - (px / lag(px, 50) OVER w - 1) / 50 AS accel, {_roll('avg', 'move', 10)} / nullif({_roll('avg', 'move', 60)}, 0) AS expand, {_roll('avg', 'v', 5)} / nullif({_roll('avg', 'v', 60)}, 0) AS vsurge, "
    f"px / ({_roll('max', 'px', 60)}) * coalesce((px > {_roll('avg', 'px', 50)})::INT, 0) AS breakout, (line / lag(line, 10) OVER w - 1) - (line / lag(line, 30) OVER w - 1) / 3 AS rsturn FROM g1 WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    f"g3 AS (SELECT *, {', '.join(f'{_share(c)} AS q_{c}' for c in launches.IGNITION)} FROM g2), g4 AS (SELECT * EXCLUDE ({', '.join(f'q_{c}' for c in launches.IGNITION)}), round(100 * list_avg([{', '.join(f'q_{c}' for c in launches.IGNITION)}]), 9) AS ignition FROM g3), "
    f"ignite AS (SELECT *, 100 * {_share('ignition')} AS ignition_pct FROM g4)"
)


def _ignition(spark, sf):
    return launches.ignition(src.daily_bars(spark, sf), src.benchmark(spark, sf))


@query(IGNITE + " SELECT ticker, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in (*launches.IGNITION, "ignition", "ignition_pct")) + " FROM ignite")
def q1_ignition(spark, sf):
    """Q1: five short-window measures of every ticker and day, and the rank of their mean rank."""
    return rounded(_ignition(spark, sf))


@query(
    IGNITE + f", comp AS (SELECT ticker, date, 100 * {_share('cr')} AS composite FROM (SELECT ticker, date, round(composite, 9) AS cr FROM scored)), "
    "h AS (SELECT ticker, date, adj_close AS px, max(adj_close) OVER (PARTITION BY ticker) AS top, CASE WHEN count(adj_close) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) >= 20 THEN max(adj_close) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS before, max(adj_close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS nxt FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    "l AS (SELECT ticker, coalesce(min(date) FILTER (px > before AND px < 0.6 * top AND nxt > px * 1.15), min(date) FILTER (px > 0.2 * top)) AS t0 FROM h GROUP BY ticker), l0 AS (SELECT l.ticker, t0, px AS p0 FROM l JOIN h ON h.ticker = l.ticker AND h.date = t0), "
    + ", ".join(f"{n}_d AS (SELECT l0.ticker, min(x.date) AS d FROM l0 JOIN {table} x ON x.ticker = l0.ticker AND x.date >= t0 AND x.{col} >= 90 GROUP BY 1)" for n, table, col in (("ig", "ignite", "ignition_pct"), ("co", "comp", "composite")))
    + " SELECT l0.ticker, t0, round(p0, 6) AS p0, ig_d.d AS ignition_lit, date_diff('day', t0, ig_d.d) // 7 AS ignition_weeks, round(i.px / p0 - 1, 6) AS ignition_runup, co_d.d AS composite_lit, date_diff('day', t0, co_d.d) // 7 AS composite_weeks, round(c.px / p0 - 1, 6) AS composite_runup "
    "FROM l0 LEFT JOIN ig_d USING (ticker) LEFT JOIN co_d USING (ticker) LEFT JOIN h i ON i.ticker = l0.ticker AND i.date = ig_d.d LEFT JOIN h c ON c.ticker = l0.ticker AND c.date = co_d.d"
)
def q2_first_lit(spark, sf):
    """Q2: when each ticker's rise began, and how late the ignition and the composite first put it among a date's top tenth."""
    bars = src.daily_bars(spark, sf)
    comp = screen.composite_alone(base._signals(spark, sf)).select("ticker", "date", (100 * launches.average_rank_share(F.round("composite", 9), "date")).alias("composite"))
    scores = _ignition(spark, sf).select("ticker", "date", F.col("ignition_pct").alias("ignition")).unionByName(comp, allowMissingColumns=True)
    return rounded(launches.first_lit(launches.launch_dates(bars, high_share=0.6), scores, bars, ["ignition", "composite"]))


SIGNED = (
    ", k0 AS (SELECT ticker, date, close, row_number() OVER w - 1 AS i, coalesce(ln(close) - ln(lag(close) OVER w), 0) AS step, count(*) OVER (PARTITION BY ticker) AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    f"k1 AS (SELECT *, close / ({_roll('max', 'close', 252, 120)}) - 1 AS dd252, close / ({_roll('avg', 'close', 200, 120)}) - 1 AS dist_ma200, coalesce(close > {_roll('avg', 'close', 50)}, false) AS above FROM k0 WINDOW w AS (PARTITION BY ticker ORDER BY i)), "
    f"signed AS (SELECT *, {_roll('min', 'dd252', 126, 40)} AS min_dd_126, {_roll('stddev_samp', 'step', 126, 60)} * sqrt(252) AS rvol126, above AND NOT coalesce(lag(above) OVER w, false) AS reclaim FROM k1 WINDOW w AS (PARTITION BY ticker ORDER BY i))"
)


@query(
    SIGNED + ", lo AS (SELECT ticker, arg_min(i, (close, i)) AS low_i FROM signed WHERE n >= 300 AND i >= n - 504 GROUP BY ticker), trn AS (SELECT ticker, low_i, coalesce(min(s.i) FILTER (s.reclaim AND s.i >= low_i), low_i) AS i FROM lo JOIN signed s USING (ticker) GROUP BY ticker, low_i) "
    "SELECT x.ticker, y.date AS low, x.date AS launch, " + ", ".join(f"round(x.{c}, 6) AS {c}" for c in ("dd252", "min_dd_126", "rvol126", "dist_ma200")) + " FROM trn JOIN signed x USING (ticker, i) JOIN signed y ON y.ticker = trn.ticker AND y.i = low_i"
)
def q15_launch_signature(spark, sf):
    """Q15: how washed out and volatile every ticker was when it first crossed its average after its two-year low."""
    return rounded(launches.launch_signature(launches.signature_features(src.daily_bars(spark, sf))))


@query(
    SIGNED + ", y0 AS (SELECT ticker, i, CASE WHEN lead(close, 63) OVER w IS NOT NULL THEN max(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) END / close - 1 >= 30 AS y, coalesce(rvol126 >= 0.4, false) AS vol, coalesce(rvol126 >= 0.4 AND min_dd_126 <= -0.4, false) AS washed, coalesce(rvol126 >= 0.4 AND min_dd_126 <= -0.4 AND reclaim, false) AS sig, n FROM signed WINDOW w AS (PARTITION BY ticker ORDER BY i)), "
    "y1 AS (SELECT * FROM y0 WHERE n >= 363 AND y IS NOT NULL), sg AS (SELECT ticker, i, y, row_number() OVER (PARTITION BY ticker ORDER BY i) AS k FROM y1 WHERE sig), "
    "chain AS (SELECT ticker, i, y FROM sg WHERE k = 1 UNION ALL SELECT sg.ticker, sg.i, sg.y FROM chain JOIN sg ON sg.ticker = chain.ticker AND sg.i = (SELECT min(z.i) FROM sg z WHERE z.ticker = chain.ticker AND z.i >= chain.i + 126)), "
    "pops AS (SELECT 'all' AS key, count(*) AS n, sum(y::INT) AS k FROM y1 UNION ALL SELECT 'volatile', count(*), sum(y::INT) FROM y1 WHERE vol UNION ALL SELECT 'volatile and washed out', count(*), sum(y::INT) FROM y1 WHERE washed UNION ALL SELECT 'signal', count(*), sum(y::INT) FROM chain), "
    "ev AS (SELECT n, k FROM pops WHERE key = 'signal'), rates AS (SELECT r, avg((((r * 7919 + s * 104729 + 1299709) % 2147483647 * 48271 % 2147483647) % n < k)::INT) AS m FROM ev, (SELECT unnest(range(2000)) AS r), LATERAL (SELECT unnest(range(n)) AS s) GROUP BY r) "
    "SELECT key AS population, n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS rate, CASE WHEN key = 'signal' THEN round((SELECT quantile_cont(m, 0.05) FROM rates), 6) END AS low, CASE WHEN key = 'signal' THEN round((SELECT quantile_cont(m, 0.95) FROM rates), 6) END AS high, round((SELECT k / n FROM ev) / nullif(k / n, 0), 6) AS lift FROM pops WHERE n > 0"
)
def q15_nested_baselines(spark, sf):
    """Q15, Q10: how often a rise to 31 times (prices of the test tables leap) follows the signal, against all rows, volatile ones and washed-out ones; the signal's rate with an interval over 2000 draws of its events."""
    pops = launches.baselines(launches.signature_features(src.daily_bars(spark, sf)), h=63, rise=30.0, washout=0.4, vol=0.4)
    signal = F.col("key") == "signal"
    rates = formation.rate_interval(pops.withColumnRenamed("population", "key"), of=signal)
    signal_rate = F.max(F.when(signal, F.col("rate"))).over(Window.partitionBy(F.lit(0)))  # four rows
    return rounded(rates.select(F.col("key").alias("population"), "n", "k", "rate", "low", "high", F.try_divide(signal_rate, F.nullif("rate", F.lit(0.0))).alias("lift")))


RANKED = (
    ", v0 AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, ticker, date, {score} AS score FROM riser" for n, score in (
        ("net", "net10"), ("strict", "CASE WHEN ker10 >= 0.6 AND ddw10 >= -0.05 AND net10 > 0 THEN net10 END"), ("net_times_ker", "CASE WHEN net10 > 0 THEN net10 * ker10 END"),
        ("up_days", "CASE WHEN up10 >= 0.6 AND net10 > 0 THEN net10 END"), ("loose", "CASE WHEN ker10 >= 0.5 AND ddw10 >= -0.08 AND net10 > 0 THEN net10 END"))) + "), "
    f"listed AS (SELECT * FROM (SELECT variant, ticker, date, {_rank('-score', 'variant, date')} AS place FROM v0 WHERE score IS NOT NULL) WHERE place <= 3)"
)


def _variant_lists(spark, sf):
    metrics = screen.riser_metrics(src.daily_bars(spark, sf))
    return metrics, launches.variant_ranks(metrics)


@query(
    RANKED.replace("listed AS", "picks AS") + f", q0 AS (SELECT ticker, date, adj_close AS px, ln(adj_close) - ln(lag(adj_close) OVER (PARTITION BY ticker ORDER BY date)) AS step FROM bars), q1 AS (SELECT ticker, date, {_roll('max', 'step', 10)} / greatest(abs({_roll('sum', 'step', 10)}), 1e-9) AS spike, lead(px, 21) OVER w / px - 1 AS ret FROM q0 WINDOW w AS (PARTITION BY ticker ORDER BY date)) "
    "SELECT variant, count(*) AS n, " + ", ".join(f"round(median({c}), 6) AS {c}" for c in ("net10", "ker10", "up10", "ddw10", "spike", "ret")) + " FROM picks JOIN riser USING (ticker, date) JOIN q1 USING (ticker, date) GROUP BY variant"
)
def q24_pick_quality(spark, sf):
    """Q24: what the picks of five gates look like, and what follows them, in medians over all dates."""
    metrics, ranks = _variant_lists(spark, sf)
    return rounded(launches.pick_quality(metrics, ranks, src.daily_bars(spark, sf), top_n=3))


@query(
    RANKED.replace("listed AS", "picks AS") + ", dn AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM bars)), pd AS (SELECT variant, ticker, o FROM picks JOIN dn USING (date)), "
    "bo AS (SELECT variant, ticker, o, true AS now FROM pd UNION ALL SELECT variant, ticker, o + 1, false FROM pd), un AS (SELECT variant, o, ticker, count(*) AS k FROM bo WHERE o > 1 AND o <= (SELECT max(o) FROM dn) GROUP BY ALL), jd AS (SELECT variant, o, count(*) FILTER (k = 2) / count(*) AS j FROM un GROUP BY ALL) SELECT variant, count(*) AS days, round(median(j), 6) AS jaccard FROM jd GROUP BY variant"
)
def q24_list_overlap(spark, sf):
    """Q24: how much of each gate's list is left on the next date."""
    _, ranks = _variant_lists(spark, sf)
    return rounded(launches.list_overlap(ranks, src.daily_bars(spark, sf), top_n=3))


@query(
    RANKED.replace("listed AS", "picks AS") + ", n0 AS (SELECT ticker, date, adj_close AS px, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM bars), pk AS (SELECT ticker, arg_max(i, (px, -i)) AS peak_i FROM n0 GROUP BY ticker), "
    "tr AS (SELECT ticker, peak_i, arg_min(i, (px, i)) AS trough_i FROM n0 JOIN pk USING (ticker) WHERE i <= peak_i AND i > peak_i - 189 GROUP BY ticker, peak_i), "
    "rn AS (SELECT tr.ticker, a.date AS trough, b.date AS peak, trough_i, a.px AS low, b.px / a.px - 1 AS run FROM tr JOIN n0 a ON a.ticker = tr.ticker AND a.i = trough_i JOIN n0 b ON b.ticker = tr.ticker AND b.i = peak_i), "
    "vs AS (SELECT unnest(['net', 'strict', 'net_times_ker', 'up_days', 'loose']) AS variant), ft AS (SELECT rn.ticker, variant, min(date) AS listed FROM rn JOIN picks USING (ticker) WHERE date BETWEEN trough AND peak GROUP BY ALL) "
    "SELECT rn.ticker, vs.variant, trough, peak, round(run, 6) AS run, listed, n0.i - trough_i AS day, round(n0.px / low - 1, 6) AS gained FROM rn CROSS JOIN vs LEFT JOIN ft ON ft.ticker = rn.ticker AND ft.variant = vs.variant LEFT JOIN n0 ON n0.ticker = rn.ticker AND n0.date = listed"
)
def q24_first_listed(spark, sf):
    """How soon after the trough of its biggest run each gate lists a ticker, and what it has gained by then."""
    _, ranks = _variant_lists(spark, sf)
    bars = src.daily_bars(spark, sf)
    return rounded(launches.first_listed(launches.biggest_runs(bars), ranks, bars, top_n=3))
