"""More registered queries: reports, grids, summaries, signal panels, labels, splits and checks across surfaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.windows import average_rank_share, by_ticker, forward, lagged_return, last_rows, rolling
from panelwright.operators import asof, fundamentals, research, screen, screener, series, themes, valuation, views
from panelwright.plans import queries as base
from panelwright.plans.queries import ORACLE_SQL, query, rounded
from panelwright.sources import adapters as src

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("SELECT ticker, CASE WHEN sector IN ('AFRICA', 'MIDDLE EAST') THEN 'MEA' WHEN sector = 'AMERICA' THEN 'AMERICAS' ELSE sector END AS sector FROM universe")
def s3_sector_names(spark, sf):
    """S3: names of another taxonomy, others pass through."""
    u = src.universe(spark, sf)
    return u.select("ticker", views.renamed(F.col("sector"), {"AFRICA": "MEA", "MIDDLE EAST": "MEA", "AMERICA": "AMERICAS"}).alias("sector"))


def _points(spark, sf):
    """Both coordinates of a ticker's point on a date: the screen's percentile and a multiple that can be shown."""
    x = base._risers(spark, sf).select("ticker", "date", "net10_pct", "candidate")
    y = base._valued(spark, sf).select("ticker", "date", F.round("ps", 2).alias("ps")).where("ps > 0")
    return x.join(y, ["ticker", "date"])


GRID = (
    ", pts AS (SELECT l.ticker, l.date, net10_pct, CAST(candidate AS BIGINT) AS candidate, round(ps, 2) AS ps FROM listed l JOIN valued v ON v.ticker = l.ticker AND v.date = l.date WHERE round(ps, 2) > 0), ax AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place FROM (SELECT DISTINCT date FROM pts ORDER BY date DESC LIMIT 20)), "
    "grid AS (SELECT t.ticker, place, ax.date, net10_pct, candidate, ps FROM (SELECT ticker FROM pts WHERE date = (SELECT max(date) FROM pts)) t CROSS JOIN ax LEFT JOIN pts ON pts.ticker = t.ticker AND pts.date = ax.date)"
)


@query(GRID + " SELECT * FROM grid")
def d5_phase_map(spark, sf):
    """Tickers that can be shown on the last date, over the last 20 dates, both coordinates or neither."""
    return rounded(views.panel_grid(_points(spark, sf), 20), 2)


@query(GRID + " SELECT ticker, 20 AS dates, CAST(count(ps) AS BIGINT) AS shown, bool_and((ps IS NULL) = (net10_pct IS NULL) AND (ps IS NULL) = (candidate IS NULL)) AS aligned FROM grid GROUP BY ticker")
def k7_array_alignment(spark, sf):
    """K7: arrays of one length, NULL at the same places."""
    g = views.panel_grid(_points(spark, sf), 20).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("place", "ps", "net10_pct", "candidate"))).alias("x"))
    same = F.forall("x", lambda p: (p.ps.isNull() == p.net10_pct.isNull()) & (p.ps.isNull() == p.candidate.isNull()))
    return g.select("ticker", F.size("x").cast("long").alias("dates"), F.size(F.filter("x", lambda p: p.ps.isNotNull())).cast("long").alias("shown"), same.alias("aligned"))


@query("SELECT * FROM (SELECT date, " + ", ".join(f"max(close) FILTER (bucket = '{r}') AS {r.replace(' ', '_').lower()}" for r in REGIONS) + " FROM sector_bars GROUP BY date) WHERE " + " AND ".join(f"{r.replace(' ', '_').lower()} IS NOT NULL" for r in REGIONS))
def j18_aligned_series(spark, sf):
    a = views.aligned(src.sector_bars(spark, sf), "bucket", "date", "close", REGIONS)
    return a.toDF("date", *(r.replace(" ", "_").lower() for r in REGIONS))


@query(
    "SELECT CAST(candidate AS BIGINT) AS candidate, count(*) AS n, round(quantile_cont(fwd, 0.05), 6) AS q05, round(quantile_cont(fwd, 0.25), 6) AS q25, round(median(fwd), 6) AS q50, round(quantile_cont(fwd, 0.75), 6) AS q75, round(quantile_cont(fwd, 0.95), 6) AS q95, round(quantile_cont(fwd, 0.75) - quantile_cont(fwd, 0.25), 6) AS iqr "
    "FROM (SELECT candidate, lead(close, 20) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM streaks) WHERE fwd IS NOT NULL GROUP BY candidate"
)
def a5_outcome_quantiles(spark, sf):
    """A5, Q3, Q19: outcomes of listed rows and of all others."""
    r = base._risers(spark, sf).withColumn("fwd", F.try_divide(F.lead("close", 20).over(by_ticker()), "close") - 1).where("fwd is not null")
    q = r.groupBy("candidate").agg(F.count("*").alias("n"), F.percentile("fwd", F.array(*(F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("q"))
    return rounded(q.select("candidate", "n", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate(("05", "25", "50", "75", "95"))), (F.col("q")[3] - F.col("q")[1]).alias("iqr")))


@query("SELECT CAST(year(date) AS BIGINT) AS yr, CASE WHEN date_diff('day', as_of_period_end, date) <= 95 THEN 'fresh' WHEN date_diff('day', as_of_period_end, date) <= 160 THEN 'stale' ELSE 'overdue' END AS state, count(*) AS n FROM valued GROUP BY 1, 2")
def a15_state_counts(spark, sf):
    v = base._valued(spark, sf)
    return v.groupBy(F.year("date").cast("long").alias("yr"), valuation.freshness(F.datediff("date", "as_of_period_end")).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT bucket, date, round(100 * exp(sum(ln(1 + r / 100)) OVER (PARTITION BY bucket ORDER BY date)), 4) AS price FROM (SELECT bucket, date, 100 * (close / lag(close) OVER (PARTITION BY bucket ORDER BY date) - 1) AS r FROM sector_bars) WHERE r IS NOT NULL")
def e10_price_from_returns(spark, sf):
    by = Window.partitionBy("bucket").orderBy("date")
    r = src.sector_bars(spark, sf).select("bucket", "date", (100 * lagged_return(F.col("close"), 1, by)).alias("r")).where("r is not null")
    return rounded(r.select("bucket", "date", (100 * F.exp(F.sum(F.log1p(F.col("r") / 100)).over(by))).alias("price")), 4)


@query("SELECT ticker, date, round(ps, 4) AS ps FROM (SELECT ticker, date, ps, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM valued WHERE ps IS NOT NULL) WHERE n <= 504")
def v18_ps_tail(spark, sf):
    """The last 504 multiples of each ticker."""
    v = base._valued(spark, sf).select("ticker", "date", "ps").where("ps is not null")
    v = v.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("n <= 504")
    return rounded(v.select("ticker", "date", "ps"), 4)


@query(", b AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS day_index FROM bars) SELECT f.ticker, f.period_end, b.date, b.day_index FROM filings f ASOF LEFT JOIN b ON b.ticker = f.ticker AND f.period_end >= b.date")
def d7_fiscal_day_index(spark, sf):
    f = src.fundamentals(spark, sf).select("ticker", "period_end")
    return views.trading_day_index(f, src.daily_bars(spark, sf), "period_end").select("ticker", "period_end", "date", F.col("day_index").cast("long").alias("day_index"))


@query("SELECT b.ticker, b.date, f.period_end AS quarter, round(f.revenue_ttm, 4) AS revenue_ttm FROM bars b ASOF LEFT JOIN (SELECT ticker, period_end, revenue_ttm, coalesce(effective_eod_date, period_end) AS eff FROM filings) f ON b.ticker = f.ticker AND b.date >= f.eff")
def d8_effective_quarter(spark, sf):
    f = src.fundamentals(spark, sf).select("ticker", F.col("period_end").alias("quarter"), "revenue_ttm", F.coalesce("effective_eod_date", "period_end").alias("eff"))
    return rounded(asof.as_of(src.daily_bars(spark, sf).select("ticker", "date"), f, "ticker", "date", "eff").drop("eff"), 4)


@query(
    "SELECT f.ticker, f.period_end, round(c.val, 4) AS cash FROM filings f ASOF LEFT JOIN (SELECT ticker, period_end AS \"end\", revenue * 0.1 AS val FROM revenue WHERE k % 3 = 0 OR month(period_end) = 12) c ON c.ticker = f.ticker AND f.period_end >= c.\"end\""
)
def v7_instant_facts(spark, sf):
    """V7: a balance as first filed, at the latest end up to a period's. Two of three filers state it at year ends only; all restate it later."""
    q = src.quarterly_revenue(spark, sf).where("k % 3 = 0 or month(period_end) = 12")
    fact = q.select("ticker", F.col("period_end").alias("end"), (F.col("revenue") * 0.1).alias("val"), F.date_add("period_end", 35).alias("filed"))
    facts = fact.unionByName(fact.withColumn("val", F.col("val") * 2).withColumn("filed", F.date_add("filed", 100)))
    return rounded(views.instant_value(src.fundamentals(spark, sf).select("ticker", "period_end"), facts, "cash").select("ticker", "period_end", "cash"), 4)


@query(
    "SELECT ticker AS entity, period_end AS \"end\", round(ttm, 4) AS ttm FROM ttm WHERE n4 = 4 AND date_diff('day', first_end, period_end) BETWEEN 250 AND 295 AND k % 5 <> 0 UNION ALL SELECT ticker, max(period_end), round(sum(revenue), 4) FROM revenue WHERE k % 5 = 0 GROUP BY ticker, year(period_end) HAVING count(*) = 4"
)
def v6_annual_fallback(spark, sf):
    """V6: every fifth filer files whole years only."""
    q = src.quarterly_revenue(spark, sf)
    start = F.add_months(F.date_add("period_end", 1), -3)
    quarters = q.where("k % 5 <> 0").select(F.col("ticker").alias("entity"), start.alias("start"), F.col("period_end").alias("end"), F.col("revenue").alias("val"))
    whole = q.where("k % 5 = 0").groupBy(F.col("ticker").alias("entity"), F.trunc("period_end", "year").alias("start")).agg(F.max("period_end").alias("end"), src.exact_sum(F.col("revenue"), 4).alias("val"), F.count("*").alias("n")).where("n = 4").drop("n")
    facts = quarters.unionByName(whole).select("entity", F.lit("revenue").alias("metric"), "start", "end", "val", F.date_add("end", 35).alias("filed"))
    out = fundamentals.with_annual(fundamentals.trailing_four(fundamentals.single_quarters(facts)), facts)
    return rounded(out.select("entity", "end", "ttm"), 4)


@query()
def x4_theme_summary(spark, sf):
    """Days, first and last of each theme's index, and its members in force on the last; themes with one point are left out."""
    m = base._members(spark, sf)
    index = themes.chained_index(src.daily_bars(spark, sf), m, 0.03).groupBy("theme").agg(F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last")).where("days >= 2")
    held = asof.membership_intervals(m).where("exposure > 0").join(index.select("theme", "last"), "theme").where("as_of_date <= last and last < until")
    return index.join(held.groupBy("theme").agg(F.count("*").alias("members")), "theme", "left")


ORACLE_SQL["x4_theme_summary"] = base._recursive(
    base.PRICES + base.INDEX.format(s="") + ", ix AS (SELECT theme, count(*) AS days, min(date) AS first, max(date) AS last FROM path GROUP BY theme HAVING count(*) >= 2) "
    "SELECT ix.*, (SELECT count(*) FROM (SELECT *, coalesce(lead(as_of_date) OVER (PARTITION BY ticker, theme ORDER BY as_of_date), DATE '9999-12-31') AS until FROM membership) m WHERE m.theme = ix.theme AND exposure > 0 AND as_of_date <= ix.last AND ix.last < until) AS members FROM ix",
    0.03,
)


@query("SELECT theme, coalesce(min(b.first), DATE '2020-01-01') AS as_of FROM (SELECT DISTINCT theme, ticker FROM membership) LEFT JOIN (SELECT ticker, min(date) AS first FROM bars GROUP BY ticker) b USING (ticker) GROUP BY theme")
def x5_baseline_date(spark, sf):
    """A seed counts from the first bar of its members, else from a constant."""
    first = src.daily_bars(spark, sf).groupBy("ticker").agg(F.min("date").alias("first"))
    return base._members(spark, sf).select("theme", "ticker").distinct().join(first, "ticker", "left").groupBy("theme").agg(F.coalesce(F.min("first"), F.lit("2020-01-01").cast("date")).alias("as_of"))


SIGNALS = (
    ", s AS (SELECT ticker, date, close / lag(close, 5) OVER w - 1 AS ret_5, close / lag(close, 21) OVER w - 1 AS ret_21, close / lag(close, 63) OVER w - 1 AS ret_63, close / lag(close, 126) OVER w - 1 AS ret_126, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom_12_1, "
    "CASE WHEN i >= 90 THEN regr_slope(y, i) OVER (w ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) * 252 * regr_r2(y, i) OVER (w ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) END AS slope_r2, CASE WHEN count(d) OVER w63 = 63 THEN abs(close - lag(close, 63) OVER w) / nullif(sum(abs(d)) OVER w63, 0) END AS ker_63, "
    "CASE WHEN count(lr) OVER w63 = 63 THEN (close / lag(close, 63) OVER w - 1) / nullif(stddev_samp(lr) OVER w63 * sqrt(252), 0) END AS sharpe_63 FROM (SELECT *, ln(close) AS y, close - lag(close) OVER v AS d, ln(close) - ln(lag(close) OVER v) AS lr, row_number() OVER v AS i FROM bars WINDOW v AS (PARTITION BY ticker ORDER BY date)) WINDOW w AS (PARTITION BY ticker ORDER BY date), w63 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)), "
    "k AS (SELECT *, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} ASC NULLS LAST) + (count({c}) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY date) END AS r_{c}" for c in ("slope_r2", "ker_63", "sharpe_63")) + " FROM s)"
)


def signal_panel(spark, sf):
    """Returns over several spans, momentum and trend quality of every ticker and day."""
    return signals_of(src.daily_bars(spark, sf))


def signals_of(bars, *carried):
    """``signal_panel`` of given bars, with columns of theirs carried along."""
    px, w90, one = F.col("close"), last_rows(90), by_ticker()
    b = bars.select("ticker", "date", "close", *carried).withColumn("d", px - F.lag(px).over(one)).withColumn("lr", F.ln(px) - F.ln(F.lag(px).over(one))).withColumn("i", F.row_number().over(one).cast("double")).withColumn("y", F.ln(px))
    r63 = lagged_return(px, 63)
    return b.select(
        "ticker", "date", *(lagged_return(px, n).alias(f"ret_{n}") for n in (5, 21, 63, 126)), (F.try_divide(F.lag(px, 21).over(one), F.lag(px, 252).over(one)) - 1).alias("mom_12_1"),
        F.when(F.col("i") >= 90, F.regr_slope("y", "i").over(w90) * 252 * F.regr_r2("y", "i").over(w90)).alias("slope_r2"),
        F.try_divide(F.abs(px - F.lag(px, 63).over(one)), rolling(F.sum, F.abs("d"), 63)).alias("ker_63"),
        F.try_divide(r63, F.nullif(rolling(F.stddev_samp, F.col("lr"), 63) * F.sqrt(F.lit(252.0)), F.lit(0.0))).alias("sharpe_63"), *carried,
    )


@query(SIGNALS + " SELECT ticker, date, round(ret_5, 6) AS ret_5, round(ret_21, 6) AS ret_21, round(ret_63, 6) AS ret_63, round(ret_126, 6) AS ret_126, round(mom_12_1, 6) AS mom_12_1, round(slope_r2, 6) AS slope_r2, round(ker_63, 6) AS ker_63, round(sharpe_63, 6) AS sharpe_63, round(list_avg([r_slope_r2, r_ker_63, r_sharpe_63]), 6) AS stable_mom FROM k")
def q5_signal_panel(spark, sf):
    """Returns, momentum, trend quality, and the mean of three ranks within a date, of those that a ticker has."""
    s = signal_panel(spark, sf)
    parts = ["slope_r2", "ker_63", "sharpe_63"]
    s = s.withColumns({f"r_{c}": average_rank_share(F.col(c), "date") for c in parts})
    known = F.filter(F.array(*(F.col(f"r_{c}") for c in parts)), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    return rounded(s.withColumn("stable_mom", mean).drop(*(f"r_{c}" for c in parts)))


@query(
    ", l AS (SELECT bucket, date, close, ln(close) - ln(lag(close) OVER (PARTITION BY bucket ORDER BY date)) AS lr FROM sector_bars), v AS (SELECT *, CASE WHEN count(lr) OVER f = 21 THEN stddev_samp(lr) OVER f * sqrt(252) END AS fwd_vol, CASE WHEN count(close) OVER f = 21 THEN min(close) OVER f / close - 1 END AS fwd_trough, CASE WHEN count(lr) OVER p = 21 THEN stddev_samp(lr) OVER p * sqrt(252) END AS trail FROM l "
    "WINDOW f AS (PARTITION BY bucket ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING), p AS (PARTITION BY bucket ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)), t AS (SELECT *, CASE WHEN count(trail) OVER e >= 252 THEN quantile_cont(trail, 0.8) OVER e END AS thr FROM v WINDOW e AS (PARTITION BY bucket ORDER BY date)) "
    "SELECT bucket, date, round(fwd_vol, 6) AS fwd_vol, round(fwd_trough, 6) AS fwd_trough, CASE WHEN fwd_vol IS NOT NULL THEN CAST(coalesce(fwd_vol > thr, false) AS BIGINT) END AS rough, CASE WHEN fwd_vol IS NOT NULL THEN CAST(fwd_trough < -0.05 AS BIGINT) END AS fall FROM t"
)
def q26_forward_labels(spark, sf):
    """What lies ahead against thresholds known on the day; NULL where the window does not end."""
    by = Window.partitionBy("bucket").orderBy("date")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    year = F.sqrt(F.lit(252.0))
    b = src.sector_bars(spark, sf).select("bucket", "date", "close").withColumn("lr", F.ln("close") - F.ln(F.lag("close").over(by)))
    b = b.withColumn("fwd_vol", forward(F.stddev_samp, F.col("lr"), 21, by) * year).withColumn("fwd_trough", forward(F.min, F.col("close"), 21, by) / F.col("close") - 1).withColumn("trail", rolling(F.stddev_samp, F.col("lr"), 21, by=by) * year)
    b = b.withColumn("thr", F.when(F.count("trail").over(so_far) >= 252, F.percentile("trail", F.lit(0.8)).over(so_far)))
    label = lambda x: F.when(F.col("fwd_vol").isNotNull(), F.coalesce(x, F.lit(False)).cast("long"))
    return rounded(b.select("bucket", "date", "fwd_vol", "fwd_trough", label(F.col("fwd_vol") > F.col("thr")).alias("rough"), label(F.col("fwd_trough") < -0.05).alias("fall")))


EPISODES = [("first", "1997-07-01", "1998-01-31"), ("second", "1998-07-15", "1998-10-31"), ("third", "2000-03-15", "2001-04-15")]


@query("SELECT episode, part, count(*) AS n, min(date) AS first, max(date) AS last FROM (SELECT episode, date, CASE WHEN date BETWEEN a AND b THEN 'test' WHEN date < a - 63 OR date > b + 63 THEN 'train' END AS part FROM spx, (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in EPISODES) + ") e(episode, a, b)) WHERE part IS NOT NULL GROUP BY episode, part")
def q28_leave_one_out(spark, sf):
    """Q28: a horizon of 21 days and as many of embargo are 63 calendar days."""
    parts = views.leave_one_out(src.benchmark(spark, sf), "date", EPISODES, int((21 + 21) * 1.5))
    return parts.groupBy("episode", "part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query()
def k2_membership_checks(spark, sf):
    """K2: shape of the memberships, and whether each index is long enough to be judged (else SKIP)."""
    m = base._members(spark, sf)
    shape = m.agg(F.count_distinct("theme").alias("themes"), F.sum(F.when((F.col("exposure") < 0) | (F.col("exposure") > 1), 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("as_of_date").isNull(), 1).otherwise(0)).alias("undated"))
    state = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    rows = shape.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), state(ok).alias("state"), d.cast("long").alias("detail")) for n, ok, d in (("four themes", F.col("themes") >= 4, F.col("themes")), ("exposure in range", F.col("bad") == 0, F.col("bad")), ("dated", F.col("undated") == 0, F.col("undated")))))))
    days = themes.chained_index(src.daily_bars(spark, sf), m, 0.03).groupBy("theme").agg(F.count("*").alias("n"), F.count("log_level").alias("known"))
    landed = days.select(F.concat(F.lit("index of "), "theme").alias("check"), F.when(F.col("n") < 120, "SKIP").otherwise(state(F.col("n") == F.col("known"))).alias("state"), F.col("n").alias("detail"))
    return rows.unionByName(landed)


ORACLE_SQL["k2_membership_checks"] = base._recursive(
    base.PRICES + base.INDEX.format(s="") + " SELECT 'four themes' AS \"check\", CASE WHEN count(DISTINCT theme) >= 4 THEN 'PASS' ELSE 'FAIL' END AS state, count(DISTINCT theme) AS detail FROM membership UNION ALL SELECT 'exposure in range', CASE WHEN count(*) FILTER (exposure < 0 OR exposure > 1) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (exposure < 0 OR exposure > 1) FROM membership "
    "UNION ALL SELECT 'dated', CASE WHEN count(*) FILTER (as_of_date IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (as_of_date IS NULL) FROM membership UNION ALL SELECT 'index of ' || theme, CASE WHEN count(*) < 120 THEN 'SKIP' WHEN count(*) = count(log_level) THEN 'PASS' ELSE 'FAIL' END, count(*) FROM path GROUP BY theme",
    0.03,
)


@query(
    ", r AS (SELECT s.ticker, s.date, row_number() OVER (PARTITION BY s.date ORDER BY candidate DESC, net10 DESC NULLS LAST, s.ticker) AS by_rise, row_number() OVER (PARTITION BY s.date ORDER BY round(composite, 9) DESC NULLS LAST, s.ticker) AS by_score, net5 IS NOT NULL AND net10 IS NOT NULL AND net20 IS NOT NULL AND up10 IS NOT NULL AND ddw10 IS NOT NULL AND ker10 IS NOT NULL AS whole FROM streaks s JOIN scored c ON c.ticker = s.ticker AND c.date = s.date) "
    "SELECT date, count(*) AS n, count(*) FILTER (by_rise <> by_score) AS moved, bool_and(whole) AS whole FROM r GROUP BY date"
)
def k6_order_differs(spark, sf):
    """K6: by date, how many rows stand elsewhere in the list than in the composite's order, and whether all measures are there."""
    rows = base._risers(spark, sf).join(screen.composite(base._signals(spark, sf)).select("ticker", "date", "composite"), ["ticker", "date"])
    place = lambda *order: F.row_number().over(Window.partitionBy("date").orderBy(*order, "ticker"))
    rows = rows.withColumn("by_rise", place(F.desc("candidate"), F.desc_nulls_last("net10"))).withColumn("by_score", place(F.round("composite", 9).desc_nulls_last()))
    whole = F.lit(True)
    for c in ("net5", "net10", "net20", "up10", "ddw10", "ker10"):
        whole &= F.col(c).isNotNull()
    return rows.groupBy("date").agg(F.count("*").alias("n"), F.sum((F.col("by_rise") != F.col("by_score")).cast("long")).alias("moved"), F.every(whole).alias("whole"))


@query(
    ", approved AS (SELECT DISTINCT ticker, theme, 0.777::DOUBLE AS exposure, DATE '2000-09-01' AS as_of_date FROM membership), joint AS (SELECT ticker, theme, exposure, as_of_date FROM membership UNION ALL SELECT * FROM approved), "
    "shown AS (SELECT d, theme, exposure FROM (SELECT d, theme, exposure, row_number() OVER (PARTITION BY d, ticker, theme ORDER BY as_of_date DESC) AS n FROM joint, (VALUES (DATE '2000-09-01'), (DATE '2000-08-31')) v(d) WHERE as_of_date <= d) WHERE n = 1 AND exposure > 0) "
    "SELECT theme, count(*) FILTER (d = DATE '2000-09-01') AS forward, count(*) FILTER (d = DATE '2000-09-01' AND exposure = 0.777) AS approved_wins, count(*) FILTER (d = DATE '2000-08-31') AS backward, count(*) FILTER (d = DATE '2000-08-31' AND exposure = 0.777) AS leaked FROM shown GROUP BY theme"
)
def k8_forward_backward(spark, sf):
    """K8: approved exposures hold from their day on and leave the day before as it was."""
    m = base._members(spark, sf).select("ticker", "theme", "exposure", "as_of_date")
    approved = m.select("ticker", "theme").distinct().withColumn("exposure", F.lit(0.777)).withColumn("as_of_date", F.lit("2000-09-01").cast("date"))
    both = m.unionByName(approved)
    day = lambda d: asof.membership_at(both, d).select("theme", "exposure", F.lit(d).alias("d"))
    rows = day("2000-09-01").unionByName(day("2000-08-31"))
    new, own = F.col("d") == "2000-09-01", F.col("exposure") == 0.777
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("theme").agg(count(new).alias("forward"), count(new & own).alias("approved_wins"), count(~new).alias("backward"), count(~new & own).alias("leaked"))


@query(
    f"SELECT ticker, sector, round(ps, 4) AS ps, freshness, CASE WHEN freshness = 'fresh' THEN round(100 * cume_dist() OVER (PARTITION BY freshness = 'fresh' ORDER BY ps ASC NULLS LAST)) END AS percentile FROM (SELECT v.ticker, sector, ps, CASE WHEN date_diff('day', as_of_period_end, DATE '{base.CROSS}') <= 95 THEN 'fresh' WHEN date_diff('day', as_of_period_end, DATE '{base.CROSS}') <= 160 THEN 'stale' ELSE 'overdue' END AS freshness "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM valued WHERE date <= DATE '{base.CROSS}') v JOIN universe u ON u.ticker = v.ticker WHERE n = 1 AND sector IN ('ASIA', 'EUROPE')) WHERE ps IS NOT NULL"
)
def o3_screener(spark, sf):
    """A scope, percentiles among its fresh filings, and the metric's order."""
    v = valuation.latest(base._valued(spark, sf), "ticker", "date", base.CROSS).join(src.universe(spark, sf).select("ticker", "sector"), "ticker")
    v = v.withColumn("freshness", valuation.freshness(F.datediff(F.lit(base.CROSS).cast("date"), "as_of_period_end"))).where("ps is not null")
    return rounded(screener.screener(v.select("ticker", "sector", "ps", "freshness"), "ps", F.col("sector").isin("ASIA", "EUROPE")), 4)


@query(
    ", v AS (SELECT bucket, date, CASE WHEN count(lr) OVER p = 21 THEN stddev_samp(lr) OVER p * sqrt(252) END AS rv21, CASE WHEN count(lr) OVER q = 63 THEN stddev_samp(lr) OVER q * sqrt(252) END AS rv63 FROM (SELECT bucket, date, ln(close) - ln(lag(close) OVER (PARTITION BY bucket ORDER BY date)) AS lr FROM sector_bars) WINDOW p AS (PARTITION BY bucket ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), q AS (PARTITION BY bucket ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)), "
    "m AS (SELECT date, CASE WHEN count(lr) OVER p = 21 THEN stddev_samp(lr) OVER p * sqrt(252) END AS mv FROM (SELECT date, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS lr FROM spx) WINDOW p AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) "
    "SELECT v.bucket, v.date, round(rv21, 6) AS rv21, round(rv63, 6) AS rv63, round(rv21 / nullif(mv, 0), 5) AS to_market, round(min(rv21) OVER y, 6) AS year_low, round(max(rv21) OVER y, 6) AS year_high FROM v LEFT JOIN m USING (date) WHERE rv21 IS NOT NULL WINDOW y AS (PARTITION BY v.bucket ORDER BY v.date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
)
def q20_realised_vol(spark, sf):
    """Deviation of daily log returns by the year, against the market's and the year's range."""
    year, by = F.sqrt(F.lit(252.0)), Window.partitionBy("bucket").orderBy("date")
    both = src.sector_bars(spark, sf).select("bucket", "date", "close").unionByName(src.benchmark(spark, sf).select(F.lit("*").alias("bucket"), "date", "close"))
    v = both.withColumn("lr", F.ln("close") - F.ln(F.lag("close").over(by)))
    v = v.select("bucket", "date", (rolling(F.stddev_samp, F.col("lr"), 21, by=by) * year).alias("rv21"), (rolling(F.stddev_samp, F.col("lr"), 63, by=by) * year).alias("rv63")).where("rv21 is not null")
    m = v.where("bucket = '*'").select("date", F.col("rv21").alias("mv"))
    own, w = v.where("bucket <> '*'").join(m, "date", "left"), last_rows(252, by)
    return rounded(own.select("bucket", "date", "rv21", "rv63", F.try_divide("rv21", F.nullif("mv", F.lit(0.0))).alias("to_market"), F.min("rv21").over(w).alias("year_low"), F.max("rv21").over(w).alias("year_high")), to_market=5)


@query(
    ", p AS (SELECT ticker, date, close, row_number() OVER w - 1 AS i, lead(close, 20) OVER w / close - 1 AS fwd, close / lag(close, 10) OVER w - 1 AS trail, list(close) OVER (w ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS path FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    "c AS (SELECT ticker, i, fwd, (SELECT min(y) FROM (SELECT unnest([path[j] / list_max(path[1:j]) - 1 FOR j IN range(1, 22)]) AS y)) AS dd, abs(path[21] - path[1]) / nullif(list_sum([abs(path[j + 1] - path[j]) FOR j IN range(1, 21)]), 0) AS ker FROM p WHERE i >= 10 AND fwd >= 0.1 AND trail <= 0.15 AND len(path) = 21), g AS (SELECT ticker, list(i ORDER BY i) AS l FROM c WHERE dd >= -0.8 AND ker >= 0.01 GROUP BY ticker) "
    "SELECT ticker, CAST(place AS BIGINT) AS place FROM (SELECT ticker, unnest(list_slice(list_reduce(list_prepend([-1000000000]::BIGINT[], list_transform(l, lambda i: [i::BIGINT])), lambda a, q: CASE WHEN q[1] - a[-1] >= 20 THEN list_concat(a, q) ELSE a END), 2, 100000)) AS place FROM g)"
)
def q11_smooth_winners(spark, sf):
    """Starts of rises that were efficient and fell little on the way, from no high base, spaced apart."""
    n, px = 20, F.col("close")
    ahead = by_ticker().rowsBetween(0, n)
    b = src.daily_bars(spark, sf).select("ticker", "date", "close", (F.row_number().over(by_ticker()) - 1).alias("place"), (F.try_divide(F.lead(px, n).over(by_ticker()), px) - 1).alias("fwd"), lagged_return(px, 10).alias("trail"), F.array_agg("close").over(ahead).alias("path"))
    b = b.where(f"place >= 10 and fwd >= 0.1 and trail <= 0.15 and size(path) = {n + 1}")
    fall = F.aggregate("path", F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("worst")), lambda a, x: F.struct(F.greatest(a.top, x).alias("top"), F.least(a.worst, F.try_divide(x, F.greatest(a.top, x)) - 1).alias("worst")), lambda a: a.worst)
    steps = F.aggregate(F.zip_with(F.slice("path", 2, n), F.slice("path", 1, n), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)
    ker = F.try_divide(F.abs(F.element_at("path", n + 1) - F.element_at("path", 1)), F.nullif(steps, F.lit(0.0)))
    return series.spaced_events(b.where((fall >= -0.8) & (ker >= 0.01)), "ticker", "place", n)


@query(
    GRID + ", nx AS (SELECT ticker, place, ps, net10_pct, candidate, lead(ps) OVER w AS ps2, lead(net10_pct) OVER w AS y2, lead(candidate) OVER w AS c2, lead(place) OVER w AS p2 FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY place)) "
    "SELECT ticker, place, phase, round(CASE WHEN ps IS NULL THEN ps2 WHEN ps2 IS NULL THEN ps ELSE pow(10, log10(ps) + (log10(ps2) - log10(ps)) * phase) END, 4) AS ps, round(CASE WHEN ps IS NULL THEN y2 WHEN ps2 IS NULL THEN net10_pct ELSE net10_pct + (y2 - net10_pct) * phase END, 4) AS net10_pct, "
    "CASE WHEN ps IS NULL OR (ps2 IS NOT NULL AND phase >= 0.5) THEN c2 ELSE candidate END AS candidate, CASE WHEN ps IS NULL THEN phase WHEN ps2 IS NULL THEN 1 - phase ELSE 1.0 END AS fade FROM nx CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75]::DOUBLE[]) AS phase) v WHERE p2 IS NOT NULL AND (ps IS NOT NULL OR ps2 IS NOT NULL)"
)
def e15_between_snapshots(spark, sf):
    """Four steps between any two neighbouring dates of the phase map."""
    return rounded(views.between_snapshots(views.panel_grid(_points(spark, sf), 20), "ps", "net10_pct", "candidate", [0, 0.25, 0.5, 0.75]), 4)


@query(
    "SELECT e.ticker, e.place AS launch, b.place - e.place AS step, round(b.close / a.close, 6) AS path FROM (" + ORACLE_SQL["q11_smooth_winners"] + ") e "
    "JOIN (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS place FROM bars) a ON a.ticker = e.ticker AND a.place = e.place "
    "JOIN (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS place FROM bars) b ON b.ticker = e.ticker AND b.place BETWEEN e.place - 60 AND e.place + 126"
)
def q13_normalised_paths(spark, sf):
    """Q13: the price on its way 60 rows before and 126 after the start of each smooth rise."""
    return rounded(research.normalised_paths(src.daily_bars(spark, sf), q11_smooth_winners(spark, sf)))


@query(
    ", f AS (SELECT *, close / CASE WHEN count(close) OVER w252 >= 120 THEN max(close) OVER w252 END - 1 AS dd252, close / CASE WHEN count(close) OVER w200 >= 120 THEN avg(close) OVER w200 END - 1 AS dist_ma200, coalesce(ln(close) - ln(lag(close) OVER w), 0) AS step, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars "
    "WINDOW w AS (PARTITION BY ticker ORDER BY date), w252 AS (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), w200 AS (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)), "
    "g AS (SELECT *, CASE WHEN count(dd252) OVER w >= 40 THEN min(dd252) OVER w END AS min_dd_126, CASE WHEN count(step) OVER w >= 60 THEN stddev_samp(step) OVER w * sqrt(252) END AS rvol126 FROM f WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)) "
    "SELECT ticker, date, n, round(dd252, 6) AS dd252, round(min_dd_126, 6) AS min_dd_126, round(rvol126, 6) AS rvol126, round(dist_ma200, 6) AS dist_ma200 FROM g WHERE back = 1 AND n >= 300 AND date >= (SELECT max(date) FROM bars) - 10 AND min_dd_126 <= -0.4 AND rvol126 >= 0.4"
)
def q16_washed_out_now(spark, sf):
    """Q16: tickers that are volatile after a deep fall, as of their last row, with the number of their rows."""
    b = src.daily_bars(spark, sf)
    n = b.groupBy("ticker").agg(F.count("*").alias("n"))
    return rounded(research.washed_out_now(b, 0.4, 0.4).join(n, "ticker"))
