"""Registered queries of the panel operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_ticker, clamp
from panelwright.operators import asof, filters, fundamentals, research, rotation, screen, series, tables, text, themes, valuation
from panelwright.operators import crosssection as cs
from panelwright.operators import quality as checks
from panelwright.plans.sqltext import sql
from panelwright.sources import adapters as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **other: int | None) -> DataFrame:
    """Doubles rounded (None: as they are, for quotients of exact sums, which may lie on a tie); integers as long."""
    return df.select(*(F.round(c, other.get(c, digits)).alias(c) if t == "double" and other.get(c, digits) is not None else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def _risers(spark: SparkSession, sf: str) -> DataFrame:
    return screen.candidates(screen.population(src.daily_bars(spark, sf), src.benchmark(spark, sf)), top_n=3)


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return screen.signals(src.daily_bars(spark, sf), src.benchmark(spark, sf))


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.with_growth(asof.split_factor(src.fundamentals(spark, sf), src.splits(spark, sf), src.daily_bars(spark, sf)))


def _valued(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.valuation(src.daily_bars(spark, sf), _filings(spark, sf))


@query("SELECT ticker, date, open, high, low, close, volume FROM bars")
def s5_daily_bars(spark, sf):
    return src.daily_bars(spark, sf).drop("adj_close")


@query("SELECT date, close FROM spx")
def s14_benchmark(spark, sf):
    return src.benchmark(spark, sf)


@query("SELECT bucket_type, bucket, date, close FROM sector_bars")
def s15_bucket_bars(spark, sf):
    return src.sector_bars(spark, sf)


@query("SELECT ticker, name, sector, industry, round(mktcap, 2) AS mktcap FROM universe")
def s1_universe(spark, sf):
    return rounded(src.universe(spark, sf), 2)


@query("SELECT ticker, period_end, filed_date, round(revenue_ttm, 5) AS revenue_ttm, shares, eps_ttm FROM filings")
def v5_trailing_revenue(spark, sf):
    """Trailing sums over four quarters that follow each other (V5), with filing dates (V9)."""
    f = src.fundamentals(spark, sf)
    return f.select("ticker", "period_end", "filed_date", F.round("revenue_ttm", 5).alias("revenue_ttm"), "shares", "eps_ttm")


@query("SELECT ticker, date, round(net5, 6) AS net5, round(net10, 6) AS net10, round(net20, 6) AS net20, round(up10, 6) AS up10, round(ddw10, 6) AS ddw10, round(ker10, 6) AS ker10 FROM riser")
def c3_riser_metrics(spark, sf):
    """W1, E5, E6, E7, W18."""
    return rounded(screen.riser_metrics(src.daily_bars(spark, sf)).drop("close"))


@query("SELECT ticker, date, net10_pct, CAST(candidate AS BIGINT) AS candidate, CAST(streak_days AS BIGINT) AS streak_days FROM streaks")
def w13_candidate_streaks(spark, sf):
    """W8, W12, W13, C8."""
    return rounded(_risers(spark, sf).select("ticker", "date", "net10_pct", "candidate", "streak_days"))


FLAGSHIP = "SELECT ticker, date, round(net10, 6) AS net10, net10_pct, round(up10, 6) AS up10, streak_days FROM streaks WHERE candidate = 1 AND date = (SELECT max(date) FROM streaks WHERE candidate = 1)"


@query(FLAGSHIP)
def o2_latest_candidates(spark, sf):
    """The screen's list: candidates on the latest date that has any (F2, O2)."""
    rows = _risers(spark, sf).where("candidate = 1").groupBy("date").agg(F.collect_list(F.struct("ticker", "net10", "net10_pct", "up10", "streak_days")).alias("listed"))
    last = rows.orderBy(F.desc("date")).limit(1)  # a date lists no more than top_n
    return rounded(last.select("date", F.inline("listed")).select("ticker", "date", "net10", "net10_pct", "up10", "streak_days")).orderBy(F.desc_nulls_last("net10"), "ticker")


@query(
    "SELECT ticker, date, round(ret_63, 6) AS ret_63, round(ret_126, 6) AS ret_126, round(rs_raw, 6) AS rs_raw, round(ma50, 4) AS ma50, round(ma150, 4) AS ma150, round(ma200, 4) AS ma200, "
    "round(high_prox, 6) AS high_prox, round(trend_quality, 6) AS trend_quality, round(vol_ratio, 6) AS vol_ratio, ud_vol_ratio FROM signal"
)
def c1_signals(spark, sf):
    """C1, C2, C9, W1, W3, E4, E8, J2."""
    return rounded(_signals(spark, sf).drop("close"), ma50=4, ma150=4, ma200=4, ud_vol_ratio=None)


@query("SELECT ticker, date, round(rs_pct, 6) AS rs_pct, round(rs_accel, 6) AS rs_accel, round(c_high, 6) AS c_high, round(c_vol, 6) AS c_vol, round(c_accel, 6) AS c_accel, round(composite, 6) AS composite, rank() OVER (PARTITION BY date ORDER BY round(composite, 9) DESC NULLS LAST) AS rank_in_universe FROM scored")
def c6_composite(spark, sf):
    """C4, C5, C6, C7, W8, W10, W11."""
    return rounded(screen.composite(_signals(spark, sf)).select("ticker", "date", "rs_pct", "rs_accel", "c_high", "c_vol", "c_accel", "composite", "rank_in_universe"))


@query("SELECT ticker, date, round(pe, 4) AS pe, round(ps, 4) AS ps, round(evs, 4) AS evs, round(ev_ebitda, 4) AS ev_ebitda, round(peg, 4) AS peg, round(growth, 6) AS growth, round(rule40, 4) AS rule40, as_of_period_end, as_of_effective_eod FROM valued")
def j1_asof_valuation(spark, sf):
    """J1, J6, V10, V11, V12, V13, W21."""
    v = _valued(spark, sf).select("ticker", "date", "pe", "ps", "evs", "ev_ebitda", "peg", "growth", "rule40", "as_of_period_end", "as_of_effective_eod")
    return rounded(v, 4, growth=6)


@query("SELECT ticker, period_end, round(split_factor, 6) AS split_factor, round(growth, 6) AS growth, round(margin, 6) AS margin FROM filings_growth")
def j6_split_factor(spark, sf):
    return rounded(_filings(spark, sf).select("ticker", "period_end", "split_factor", "growth", "margin"))


# --- membership, themes, rotation

DAY = "2000-06-30"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return src.theme_membership(spark, sf)


@query("SELECT ticker, theme, exposure, as_of_date FROM membership")
def s10_membership(spark, sf):
    return _members(spark, sf).select("ticker", "theme", "exposure", "as_of_date")


@query(f"SELECT theme, ticker, exposure, as_of_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker, theme ORDER BY as_of_date DESC) AS n FROM membership WHERE as_of_date <= DATE '{DAY}') WHERE n = 1 AND exposure > 0")
def j4_membership_at(spark, sf):
    return asof.membership_at(_members(spark, sf), DAY)


@query(f"SELECT ticker, string_agg(theme, ',' ORDER BY theme) AS themes FROM (SELECT *, row_number() OVER (PARTITION BY ticker, theme ORDER BY as_of_date DESC) AS n FROM membership WHERE as_of_date <= DATE '{DAY}') WHERE n = 1 AND exposure > 0 GROUP BY ticker")
def j11_theme_lists(spark, sf):
    m = asof.membership_at(_members(spark, sf), DAY)
    return m.groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_list("theme")), ",").alias("themes"))


WEIGHTS = """, held{s} AS (SELECT d.theme, d.segment, m.ticker, m.exposure FROM (SELECT *, coalesce(lead(as_of_date) OVER (PARTITION BY ticker, theme ORDER BY as_of_date), DATE '9999-12-31') AS until FROM membership{s}) m
    JOIN (SELECT DISTINCT theme, as_of_date AS segment FROM membership{s}) d ON m.theme = d.theme AND m.as_of_date <= d.segment AND d.segment < m.until WHERE exposure > 0),
  r0{s} AS (SELECT theme, segment, ticker, exposure AS e, CASE WHEN count(*) OVER g * {cap} <= 1 THEN 1.0::DOUBLE / count(*) OVER g ELSE exposure / sum(exposure) OVER g END AS w0, count(*) OVER g AS n FROM held{s} WINDOW g AS (PARTITION BY theme, segment)),
  rounds{s} AS (SELECT *, false AS capped, 0 AS i FROM (SELECT theme, segment, ticker, e, n, w0 AS w FROM r0{s})
    UNION ALL SELECT theme, segment, ticker, e, n, CASE WHEN n * {cap} <= 1 THEN w WHEN capped OR w > {cap} + 1e-12 THEN {cap}
      ELSE e / sum(CASE WHEN capped OR w > {cap} + 1e-12 THEN 0 ELSE e END) OVER g * (1 - {cap} * sum(CASE WHEN capped OR w > {cap} + 1e-12 THEN 1 ELSE 0 END) OVER g) END, capped OR w > {cap} + 1e-12, i + 1 FROM rounds{s} WHERE i < 12 WINDOW g AS (PARTITION BY theme, segment, i))"""


def _recursive(tail: str, cap: float) -> str:
    """The iterative rule in SQL (clamp what exceeds the cap, let the rest share what remains), against the closed form here."""
    base = sql("SELECT 1 FROM membership").rsplit("\n", 1)[0].replace("WITH ", "WITH RECURSIVE ", 1)
    return base + WEIGHTS.format(cap=f"{cap}::DOUBLE", s="") + "\n" + tail


@query()
def x1_capped_weights(spark, sf):
    """X1, X2."""
    return rounded(themes.segment_weights(_members(spark, sf), cap=0.03), 9)


ORACLE_SQL["x1_capped_weights"] = _recursive("SELECT theme, segment, ticker, round(w, 9) AS weight FROM rounds WHERE i = 12", 0.03)


@query()
def x3_chained_index(spark, sf):
    """X3, J5, U4."""
    return rounded(themes.chained_index(src.daily_bars(spark, sf), _members(spark, sf), cap=0.03).select("theme", "date", "log_level"), 5)


PRICES = ", bars AS (SELECT 'T' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS px FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL)"
INDEX = """, w{s} AS (SELECT theme, segment, ticker, w AS weight FROM rounds{s} WHERE i = 12), st{s} AS (SELECT theme, min(as_of_date) AS start FROM membership{s} GROUP BY 1),
  axis{s} AS (SELECT DISTINCT theme, date FROM (SELECT e.theme, b.date FROM bars b JOIN (SELECT DISTINCT theme, ticker FROM membership{s} WHERE exposure > 0) e USING (ticker) JOIN st{s} USING (theme) WHERE b.date >= start UNION ALL SELECT theme, start FROM st{s})),
  days{s} AS (SELECT *, lag(date) OVER (PARTITION BY theme ORDER BY date) AS before FROM axis{s}),
  seg{s} AS (SELECT theme, segment, coalesce(lead(segment) OVER (PARTITION BY theme ORDER BY segment), DATE '9999-12-31') AS until FROM (SELECT DISTINCT theme, segment FROM w{s})),
  mv{s} AS (SELECT d.theme, d.date, sum(weight * (n.px / p.px - 1)) / sum(weight) AS ret FROM days{s} d JOIN seg{s} s ON d.theme = s.theme AND s.segment <= d.before AND d.before < s.until JOIN w{s} w ON w.theme = s.theme AND w.segment = s.segment
    JOIN bars n ON n.ticker = w.ticker AND n.date = d.date JOIN bars p ON p.ticker = w.ticker AND p.date = d.before GROUP BY 1, 2),
  path{s} AS (SELECT theme, date, ln(100) + sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY theme ORDER BY date) AS log_level FROM axis{s} LEFT JOIN mv{s} USING (theme, date))"""
ORACLE_SQL["x3_chained_index"] = _recursive(PRICES + INDEX.format(s="") + " SELECT theme, date, round(log_level, 5) AS log_level FROM path", 0.03)


@query("SELECT ticker, week, close FROM (SELECT ticker, date + CAST((4 - (isodow(date) - 1) + 7) % 7 AS INTEGER) AS week, max_by(close, date) AS close FROM bars GROUP BY 1, 2)")
def r1_weekly_closes(spark, sf):
    return rotation.weekly(src.daily_bars(spark, sf), "ticker").select("ticker", "week", "close")


@query(
    """, wk AS (SELECT bucket, date + CAST((4 - (isodow(date) - 1) + 7) % 7 AS INTEGER) AS week, max_by(close, date) AS close FROM sector_bars GROUP BY 1, 2),
  bw AS (SELECT date + CAST((4 - (isodow(date) - 1) + 7) % 7 AS INTEGER) AS week, max_by(close, date) AS base FROM spx GROUP BY 1),
  rs AS (SELECT bucket, week, 100 * close / base AS rs, row_number() OVER (PARTITION BY bucket ORDER BY week) AS i FROM wk JOIN bw USING (week)),
  ema AS (SELECT bucket, week, rs, i, rs AS m FROM rs WHERE i = 1 UNION ALL SELECT r.bucket, r.week, r.rs, r.i, (1 - 2.0::DOUBLE / 11) * e.m + 2.0::DOUBLE / 11 * r.rs FROM ema e JOIN rs r ON r.bucket = e.bucket AND r.i = e.i + 1)
  SELECT bucket, week, round(rs, 5) AS rs, round(rs_ratio, 5) AS rs_ratio FROM (SELECT bucket, week, rs, 100 + 10 * (m - avg(m) OVER g) / nullif(CASE WHEN count(m) OVER g = 10 THEN stddev_samp(m) OVER g END, 0) AS rs_ratio FROM ema
  WINDOW g AS (PARTITION BY bucket ORDER BY week ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE rs_ratio IS NOT NULL"""
)
def r2_relative_strength(spark, sf):
    """R1, R2, E1, J12, T12."""
    return rounded(rotation.relative_strength(src.sector_bars(spark, sf), src.benchmark(spark, sf)), 5)


def _snapshot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the league counts its members from: signals with a relative strength, bars so far, and the screen's flag."""
    rows = _signals(spark, sf).withColumn("n_bars", F.count("*").over(by_ticker())).where("rs_raw is not null")
    return rows.join(_risers(spark, sf).select("ticker", "date", "candidate"), ["ticker", "date"])


BREADTH = (
    "breadth AS (SELECT sector AS bucket, count(*) AS member_count, round(100 * avg(CASE WHEN s.close > ma50 THEN 1.0 ELSE 0.0 END), 6) AS breadth_ma50, round(100 * avg(CASE WHEN s.close > ma200 THEN 1.0 ELSE 0.0 END), 6) AS breadth_ma200, "
    "CAST(sum(CASE WHEN high_prox >= 0.99 THEN 1 ELSE 0 END) AS BIGINT) AS at_high, CAST(sum(candidate) AS BIGINT) AS candidates FROM signal s JOIN listed l ON l.ticker = s.ticker AND l.date = s.date JOIN universe u ON u.ticker = s.ticker "
    "JOIN (SELECT ticker, count(*) AS n_bars FROM bars GROUP BY 1) b ON b.ticker = s.ticker WHERE sector IS NOT NULL AND n_bars >= 60 AND s.date = (SELECT max(date) FROM signal WHERE rs_raw IS NOT NULL) GROUP BY sector)"
)


@query(
    ", " + BREADTH + """, wk AS (SELECT bucket, date + CAST((4 - (isodow(date) - 1) + 7) % 7 AS INTEGER) AS week, max_by(close, date) AS close FROM sector_bars GROUP BY 1, 2),
  bw AS (SELECT date + CAST((4 - (isodow(date) - 1) + 7) % 7 AS INTEGER) AS week, max_by(close, date) AS base FROM spx GROUP BY 1),
  rs AS (SELECT bucket, week, 100 * close / base AS rs, row_number() OVER (PARTITION BY bucket ORDER BY week) AS i FROM wk JOIN bw USING (week)),
  ema AS (SELECT bucket, week, rs, i, rs AS m FROM rs WHERE i = 1 UNION ALL SELECT r.bucket, r.week, r.rs, r.i, (1 - 2.0::DOUBLE / 11) * e.m + 2.0::DOUBLE / 11 * r.rs FROM ema e JOIN rs r ON r.bucket = e.bucket AND r.i = e.i + 1),
  ratio AS (SELECT * FROM (SELECT bucket, week, 100 + 10 * (m - avg(m) OVER g) / nullif(CASE WHEN count(m) OVER g = 10 THEN stddev_samp(m) OVER g END, 0) AS level FROM ema WINDOW g AS (PARTITION BY bucket ORDER BY week ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE level IS NOT NULL),
  slopes AS (SELECT bucket, week, level, coalesce(level - lag(level, 4) OVER (PARTITION BY bucket ORDER BY week), 0) AS slope FROM ratio),
  evs AS (SELECT sector AS bucket, median(evs) AS agg_evs FROM valued JOIN universe USING (ticker) WHERE evs IS NOT NULL AND date = (SELECT max(date) FROM valued) GROUP BY 1),
  rel AS (SELECT bucket, date, close / lag(close, 21) OVER w - base / lag(base, 21) OVER w AS rel_ret_1m, close / lag(close, 63) OVER w - base / lag(base, 63) OVER w AS rel_ret_3m, close / lag(close, 126) OVER w - base / lag(base, 126) OVER w AS rel_ret_6m FROM (
    SELECT bucket, b.date, b.close, last_value(x.close IGNORE NULLS) OVER (PARTITION BY bucket ORDER BY b.date) AS base FROM sector_bars b LEFT JOIN spx x ON x.date = b.date) WINDOW w AS (PARTITION BY bucket ORDER BY date))
  SELECT s.bucket, s.week, round(level, 5) AS level, round(slope, 5) AS slope_4w, CASE WHEN level >= 100 AND slope >= 0 THEN 'LEADING' WHEN level >= 100 THEN 'WEAKENING' WHEN slope >= 0 THEN 'IMPROVING' ELSE 'LAGGING' END AS state,
  member_count, round(breadth_ma50, 5) AS breadth_ma50, round(breadth_ma200, 5) AS breadth_ma200, at_high, candidates, round(agg_evs, 5) AS agg_evs, round(rel_ret_1m, 5) AS rel_ret_1m, round(rel_ret_3m, 5) AS rel_ret_3m, round(rel_ret_6m, 5) AS rel_ret_6m
  FROM slopes s LEFT JOIN breadth USING (bucket) LEFT JOIN evs USING (bucket) LEFT JOIN rel ON rel.bucket = s.bucket AND rel.date = (SELECT max(r.date) FROM rel r WHERE r.bucket = s.bucket) WHERE s.week = (SELECT max(t.week) FROM slopes t WHERE t.bucket = s.bucket)"""
)
def r8_league_table(spark, sf):
    """R3, R4, R5, R6, R7, R8, A3, O4."""
    buckets, spx = src.sector_bars(spark, sf), src.benchmark(spark, sf)
    members = src.universe(spark, sf).select(F.col("sector").alias("bucket"), "ticker")
    valued = _valued(spark, sf).select("ticker", "date", "evs")
    evs = valued.join(F.broadcast(valued.agg(F.max("date").alias("date"))), "date", "left_semi").where("evs is not null").join(members, "ticker").groupBy("bucket").agg(F.median("evs").alias("agg_evs"))
    league = rotation.states(rotation.relative_strength(buckets, spx)).join(rotation.breadth(_snapshot_rows(spark, sf), members), "bucket", "left").join(evs, "bucket", "left")
    league = league.join(rotation.relative_returns(buckets, spx, rel_ret_1m=21, rel_ret_3m=63, rel_ret_6m=126), "bucket", "left")
    return rounded(league.orderBy(F.desc("level"), "bucket"), 5)


@query(", " + BREADTH + " SELECT * FROM breadth")
def a3_breadth(spark, sf):
    """A3, J8, J9, R5."""
    members = src.universe(spark, sf).select(F.col("sector").alias("bucket"), "ticker")
    return rounded(rotation.breadth(_snapshot_rows(spark, sf), members))


@query("SELECT sector, round(median(evs), 4) AS agg_evs, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM valued) JOIN universe USING (ticker) WHERE n = 1 AND evs IS NOT NULL GROUP BY sector")
def a4_median_multiple(spark, sf):
    """A4, R6, J10."""
    v = valuation.latest(_valued(spark, sf).select("ticker", "date", "evs"), "ticker", "date").where("evs is not null").join(src.universe(spark, sf).select("ticker", "sector"), "ticker")
    return rounded(v.groupBy("sector").agg(F.median("evs").alias("agg_evs"), F.count("*").alias("n")), 4)


# --- cross-sections


@query(
    "SELECT date, ticker, round(percent_rank() OVER (PARTITION BY date ORDER BY net20 ASC NULLS LAST), 9) AS sql_rank, round(CASE WHEN net20 IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY net20 ASC NULLS LAST) + (count(net20) OVER (PARTITION BY date, net20) - 1) / 2.0) / count(net20) OVER (PARTITION BY date) END, 9) AS rank_share, "
    "round(CASE WHEN net20 IS NOT NULL THEN CASE WHEN count(net20) OVER (PARTITION BY date) = 1 THEN 50.0 ELSE 100.0 * (row_number() OVER (PARTITION BY date ORDER BY net20 ASC NULLS LAST, ticker) - 1) / nullif(count(net20) OVER (PARTITION BY date) - 1, 0) END END, 9) AS position_pct, "
    "round(100 * cume_dist() OVER (PARTITION BY date ORDER BY net20 ASC NULLS LAST)) AS at_most_pct FROM riser"
)
def w9_percentile_family(spark, sf):
    """T7, W8, W9, V14, V15."""
    return rounded(cs.percentile_family(screen.riser_metrics(src.daily_bars(spark, sf)), "net20", "date", "ticker"), 9)


@query(
    ", f AS (SELECT ticker, date, net20, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM riser), r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY net20) + (count(*) OVER (PARTITION BY date, net20) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS ry FROM f WHERE net20 IS NOT NULL AND fwd IS NOT NULL) "
    "SELECT date, count(*) AS n, round(corr(rx, ry), 6) AS ic FROM r GROUP BY date HAVING count(*) >= 10"
)
def a10_spearman_ic(spark, sf):
    """A9, A10, W16, Q6."""
    r = screen.riser_metrics(src.daily_bars(spark, sf)).withColumn("fwd", F.try_divide(F.lead("close", 5).over(by_ticker()), "close") - 1)
    return rounded(cs.spearman(r, "net20", "fwd", "date", 10))


@query(
    ", t AS (SELECT r_name AS g, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1), q AS (SELECT *, row_number() OVER (ORDER BY v, g) AS i, row_number() OVER (ORDER BY v DESC, g) AS j, sum(v) OVER () AS t, count(*) OVER () AS n FROM t) "
    "SELECT round(sum((2 * i - n - 1) * (v / t) / n), 6) AS gini, round(sum(CASE WHEN j <= 3 THEN v / t END), 6) AS top_share FROM q"
)
def a7_concentration(spark, sf):
    """A6, A7, A8."""
    rows = src.table(spark, sf, "lineitem").withColumn("ticker", src.ticker(F.col("l_suppkey"))).join(src.universe(spark, sf), "ticker")
    return rounded(cs.concentration(rows, "sector", "l_extendedprice"))


@query("SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(net10), 6) AS mean FROM (SELECT net10, CASE WHEN up10 >= 0 AND up10 < 0.35 THEN 0 WHEN up10 >= 0.35 AND up10 < 0.55 THEN 1 WHEN up10 >= 0.55 AND up10 < 0.75 THEN 2 WHEN up10 >= 0.75 AND up10 < 1.01 THEN 3 END AS bin FROM riser) WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= 30")
def a11_binned_means(spark, sf):
    """A11, A12."""
    return rounded(cs.binned(screen.riser_metrics(src.daily_bars(spark, sf)), "up10", [0, 0.35, 0.55, 0.75, 1.01], "net10", 30))


@query(
    ", f AS (SELECT date, CASE WHEN net10 > 0 THEN 1 ELSE 0 END AS x, CASE WHEN up10 >= 0.6 THEN 1 ELSE 0 END AS y FROM riser WHERE net10 IS NOT NULL AND up10 IS NOT NULL), g AS (SELECT date, count(*) AS n, sum(x) AS k1, sum(y) AS k2, sum(x * y) AS b FROM f GROUP BY date) SELECT date, round(b / nullif(k1 + k2 - b, 0), 6) AS jaccard, round(k1 * k2 / n, 6) AS by_chance FROM g"
)
def a14_pick_overlap(spark, sf):
    """A14, U3."""
    r = screen.riser_metrics(src.daily_bars(spark, sf)).where("net10 is not null and up10 is not null").withColumn("x", F.col("net10") > 0).withColumn("y", F.col("up10") >= 0.6)
    return rounded(cs.overlap(r, "x", "y", "date"))


@query("SELECT date, ticker, tail FROM (SELECT date, ticker, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY net10 DESC, ticker) <= greatest(5, floor(count(*) OVER (PARTITION BY date) * 0.1)) THEN 'top' WHEN row_number() OVER (PARTITION BY date ORDER BY net10 ASC, ticker) <= greatest(5, floor(count(*) OVER (PARTITION BY date) * 0.1)) THEN 'bottom' END AS tail FROM riser WHERE net10 IS NOT NULL) WHERE tail IS NOT NULL")
def o5_decile_tails(spark, sf):
    return cs.tails(screen.riser_metrics(src.daily_bars(spark, sf)), "net10", "date").where("tail is not null").select("date", "ticker", "tail")


# --- table maintenance


@query(
    ", o AS (SELECT c_custkey AS k, c_mktsegment AS seg, DATE '2000-01-01' AS first_seen, DATE '2000-06-01' AS last_seen FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, DATE '2001-01-01' AS first_seen, DATE '2001-01-01' AS last_seen FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.seg ELSE o.seg END AS seg, coalesce(o.first_seen, n.first_seen) AS first_seen, CASE WHEN n.k IS NOT NULL THEN n.last_seen ELSE o.last_seen END AS last_seen FROM o FULL JOIN n ON o.k = n.k"
)
def m1_upsert_keep_first(spark, sf):
    c = src.table(spark, sf, "customer")
    day = lambda d: F.lit(d).cast("date")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), day("2000-01-01").alias("first_seen"), day("2000-06-01").alias("last_seen"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lower("c_mktsegment").alias("seg"), day("2001-01-01").alias("first_seen"), day("2001-01-01").alias("last_seen"))
    return tables.upsert_keep_first(old, new, "k", "first_seen", "last_seen")


@query("SELECT ticker, date, close FROM bars WHERE ticker NOT IN (SELECT 'T' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0) UNION ALL SELECT ticker, date, close * 2 AS close FROM bars WHERE ticker IN (SELECT 'T' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)")
def m2_replace_entities(spark, sf):
    bars = src.daily_bars(spark, sf).select("ticker", "date", "close")
    some = src.table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(src.ticker(F.col("s_suppkey")).alias("ticker"))
    return tables.replace_entities(bars, bars.join(some, "ticker", "left_semi").withColumn("close", F.col("close") * 2), "ticker")


@query("SELECT ticker, date, CASE WHEN volume > 50 THEN -close ELSE close END AS close FROM bars")
def m3_insert_or_replace(spark, sf):
    bars = src.daily_bars(spark, sf).select("ticker", "date", "close", "volume")
    return tables.insert_or_replace(bars, bars.where("volume > 50").withColumn("close", -F.col("close")), ["ticker", "date"]).drop("volume")


@query("SELECT c_nationkey AS nation, c_custkey AS k, c_acctbal AS cap FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(c_acctbal, 0) DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def s4_largest_of(spark, sf):
    rows = src.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("cap"))
    return tables.largest_of(rows, "nation", "cap", "k")


# --- paths and events


@query(
    "SELECT ticker, CAST(place AS BIGINT) AS place FROM (SELECT ticker, unnest(list_slice(list_reduce(list_prepend([-1000000000]::BIGINT[], list(CAST([i] AS BIGINT[]) ORDER BY i)), lambda a, p: CASE WHEN p[1] - a[-1] >= 20 THEN list_concat(a, p) ELSE a END), 2, 100000)) AS place FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, up10 >= 0.6 AND net10 > 0 AS g FROM riser) WHERE g GROUP BY ticker)"
)
def w23_spaced_events(spark, sf):
    rows = screen.riser_metrics(src.daily_bars(spark, sf)).withColumn("place", F.row_number().over(by_ticker())).where("up10 >= 0.6 and net10 > 0")
    return series.spaced_events(rows, "ticker", "place", 20)


@query("SELECT ticker, date FROM (SELECT ticker, date, g AND NOT coalesce(lag(g) OVER (PARTITION BY ticker ORDER BY date), false) AS e FROM (SELECT ticker, date, coalesce(net20 > 0.5, false) AS g FROM riser)) WHERE e")
def w14_threshold_entries(spark, sf):
    r = screen.riser_metrics(src.daily_bars(spark, sf)).withColumn("g", F.coalesce(F.col("net20") > 0.5, F.lit(False)))
    return r.withColumn("e", series.entries(F.col("g"))).where("e").select("ticker", "date")


@query(
    "SELECT ticker, date, round(CASE WHEN count(close) OVER f = 20 THEN min(close) OVER f / close - 1 END, 6) AS trough20, round(CASE WHEN count(close) OVER f = 20 THEN max(close) OVER f / close - 1 END, 6) AS drawup20, round(lead(close, 20) OVER w / close - 1, 6) AS fwd20, round(least(close, min(close) OVER f) / close - 1, 6) AS trough_from_entry FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)"
)
def w16_forward_windows(spark, sf):
    """W16, W17, F13."""
    from panelwright.functions.windows import forward, next_rows

    b, c = src.daily_bars(spark, sf), F.col("close")
    return rounded(b.select("ticker", "date", (forward(F.min, c, 20) / c - 1).alias("trough20"), (forward(F.max, c, 20) / c - 1).alias("drawup20"), (F.lead(c, 20).over(by_ticker()) / c - 1).alias("fwd20"), (F.least(c, F.min(c).over(next_rows(20))) / c - 1).alias("trough_from_entry")))


@query(
    "SELECT ticker, date, round(CASE WHEN count(*) OVER w = 90 THEN regr_slope(ln(close), i) OVER w END, 9) AS slope, round(CASE WHEN count(*) OVER w = 90 THEN regr_r2(ln(close), i) OVER w END, 6) AS r2 FROM (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"
)
def w7_rolling_regression(spark, sf):
    b = src.daily_bars(spark, sf).select("ticker", "date", F.ln("close").alias("y"))
    return rounded(series.rolling_regression(b, 90), slope=9)


@query("SELECT ticker, date, round(x, 6) AS share FROM (SELECT a.ticker, a.date, CASE WHEN max(a.i) >= 252 THEN sum(CASE WHEN b.close <= a.close THEN 1 ELSE 0 END) / max(a.i) END AS x FROM (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars) a JOIN bars b ON a.ticker = b.ticker AND b.date <= a.date GROUP BY ALL)")
def w4_expanding_share(spark, sf):
    return rounded(series.expanding_share_at_most(src.daily_bars(spark, sf), "ticker", "date", "close", 252))


def _ewmac_sql() -> str:
    """The recursion row by row: two averages, and mean, squared deviation and sum of squared weights of the steps, for each pair."""
    first, step, means, out = [], [], [], []
    for j, (fast, slow) in enumerate(series.EWMAC_PAIRS.values()):
        a, b = f"(2.0::DOUBLE / {fast + 1})", f"(2.0::DOUBLE / {slow + 1})"
        first.append(f"x AS f{j}, x AS g{j}, NULL::DOUBLE AS m{j}, 0.0::DOUBLE AS c{j}, 1.0::DOUBLE AS w{j}")
        means.append(f"coalesce((1 - {b}) * r.m{j} + {b} * d, d) AS n{j}")
        step.append(f"(1 - {a}) * f{j} + {a} * x, (1 - {b}) * g{j} + {b} * x, n{j}, CASE WHEN m{j} IS NULL THEN 0 ELSE (1 - {b}) * (c{j} + (m{j} - n{j}) * (m{j} - n{j})) + {b} * (d - n{j}) * (d - n{j}) END, CASE WHEN m{j} IS NULL THEN 1 ELSE (1 - {b}) * (1 - {b}) * w{j} + {b} * {b} END")
        out.append(f"round((f{j} - g{j}) / nullif(CASE WHEN w{j} < 1 THEN sqrt(c{j} / (1 - w{j})) END, 0), 6) + 0.0 AS {list(series.EWMAC_PAIRS)[j]}")
    return (
        ", p AS (SELECT ticker, date, close AS x, close - lag(close) OVER w AS d, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
        f"r AS (SELECT ticker, date, i, {', '.join(first)} FROM p WHERE i = 1 UNION ALL SELECT ticker, date, i, {', '.join(step)} FROM (SELECT r.* EXCLUDE (date, i), p.date, p.i, p.x, p.d, {', '.join(means)} FROM r JOIN p ON p.ticker = r.ticker AND p.i = r.i + 1)) SELECT ticker, date, {', '.join(out)} FROM r"
    )


@query(_ewmac_sql())
def e3_ewmac(spark, sf):
    """Both pairs of averages, a ticker's series as one array."""
    out = rounded(series.ewmac(src.daily_bars(spark, sf)))
    return out.withColumns({c: F.col(c) + 0.0 for c in series.EWMAC_PAIRS})  # no negative zero


@query(
    ", p AS (SELECT bucket, date, close / lag(close) OVER (PARTITION BY bucket ORDER BY date) - 1 AS r FROM sector_bars), c AS (SELECT bucket, date, r, sum(ln(1 + r)) OVER (PARTITION BY bucket ORDER BY date) AS c FROM p WHERE r IS NOT NULL), t AS (SELECT *, max(c) OVER (PARTITION BY bucket ORDER BY date) AS top FROM c) SELECT bucket, round(avg(r) / stddev_pop(r) * sqrt(252), 6) AS sharpe, round(min(c - top), 6) AS max_drawdown FROM t GROUP BY bucket"
)
def e13_equity_stats(spark, sf):
    by = Window.partitionBy("bucket").orderBy("date")
    r = src.sector_bars(spark, sf).withColumn("r", F.try_divide("close", F.lag("close").over(by)) - 1).where("r is not null")
    return rounded(series.iid_equity(r, "bucket", "date", "r"))


# --- fundamentals from facts


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Even entities report quarters, odd ones the year to date; every period is restated 200 days later."""
    q = src.quarterly_revenue(spark, sf).withColumn("qs", F.add_months(F.date_add("period_end", 1), -3))
    year = F.trunc("period_end", "year")
    ytd = F.sum("revenue").over(Window.partitionBy("ticker", year).orderBy("period_end"))
    base = q.select(F.col("ticker").alias("entity"), F.lit("revenue").alias("metric"), F.when(F.col("k") % 2 == 0, F.col("qs")).otherwise(year).alias("start"), F.col("period_end").alias("end"), F.when(F.col("k") % 2 == 0, F.col("revenue")).otherwise(ytd).alias("val"))
    return base.withColumn("filed", F.date_add("end", 35)).unionByName(base.withColumn("val", F.col("val") * 1.1).withColumn("filed", F.date_add("end", 200)))


@query("SELECT ticker AS entity, period_end AS \"end\", round(revenue, 5) AS val, period_end + 35 AS filed FROM revenue")
def v3_single_quarters(spark, sf):
    """Whatever way an entity reports, its single quarters come out."""
    return fundamentals.single_quarters(_facts(spark, sf)).select("entity", "end", F.round("val", 5).alias("val"), "filed")


@query("SELECT ticker AS entity, period_end AS \"end\", round(ttm, 4) AS ttm, period_end + 35 AS filed FROM ttm WHERE n4 = 4 AND date_diff('day', first_end, period_end) BETWEEN 250 AND 295")
def v6_trailing_four(spark, sf):
    """V5, V6."""
    f = _facts(spark, sf)
    out = fundamentals.trailing_four(fundamentals.single_quarters(f))
    return out.select("entity", "end", F.round("ttm", 4).alias("ttm"), "filed")


@query("SELECT ticker, period_end, revenue_ttm, filed_date, date_diff('day', period_end, filed_date) AS disclosure_lag, revenue_ttm / nullif(lag(revenue_ttm, 4) OVER (PARTITION BY ticker ORDER BY period_end), 0) - 1 AS yoy FROM filings WHERE coalesce(effective_eod_date, filed_date) <= DATE '2001-01-01'")
def v17_revenue_history(spark, sf):
    """V17, W22."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    f = src.fundamentals(spark, sf).where("coalesce(effective_eod_date, filed_date) <= date'2001-01-01'")
    return f.select("ticker", "period_end", "revenue_ttm", "filed_date", F.datediff("filed_date", "period_end").cast("long").alias("disclosure_lag"), (F.try_divide("revenue_ttm", F.lag("revenue_ttm", 4).over(w)) - 1).alias("yoy"))


CROSS = "2001-06-15"


@query(
    f"SELECT ticker, round(ps, 4) AS ps, age, round(CASE WHEN count(*) OVER () = 1 THEN 50.0 ELSE 100.0 * (row_number() OVER (ORDER BY ps, ticker) - 1) / nullif(count(*) OVER () - 1, 0) END, 6) AS percentile FROM (SELECT ticker, ps, date_diff('day', as_of_period_end, date) AS age FROM valued WHERE date = DATE '{CROSS}' AND ps IS NOT NULL) WHERE age <= 95"
)
def v14_vintage_percentile(spark, sf):
    p = valuation.vintage_percentile(_valued(spark, sf), "ps", CROSS)
    return p.select("ticker", F.round("ps", 4).alias("ps"), F.col("age").cast("long").alias("age"), F.round("percentile", 6).alias("percentile"))


@query(
    f"SELECT v.ticker, name, sector, round(ps, 4) AS ps, date_diff('day', as_of_period_end, DATE '{CROSS}') AS age, date_diff('day', as_of_period_end, as_of_filed) AS disclosure_lag, CASE WHEN date_diff('day', as_of_period_end, DATE '{CROSS}') <= 95 THEN 'fresh' WHEN date_diff('day', as_of_period_end, DATE '{CROSS}') <= 160 THEN 'stale' ELSE 'overdue' END AS freshness "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM valued WHERE date <= DATE '{CROSS}') v LEFT JOIN universe u ON u.ticker = v.ticker WHERE n = 1"
)
def v16_cross_section(spark, sf):
    """V16, J7, J10, F7."""
    v = valuation.latest(_valued(spark, sf), "ticker", "date", CROSS).join(src.universe(spark, sf), "ticker", "left")
    age = F.datediff(F.lit(CROSS).cast("date"), "as_of_period_end")
    return v.select("ticker", "name", "sector", F.round("ps", 4).alias("ps"), age.cast("long").alias("age"), F.datediff("as_of_filed", "as_of_period_end").cast("long").alias("disclosure_lag"), valuation.freshness(age).alias("freshness"))


# --- sources, filters, joins


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS amount FROM orders")
def s2_money_strings(spark, sf):
    o = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("s"))
    return o.select("k", F.round(F.nullif(F.regexp_replace("s", "[$,\\s]", "").try_cast("double"), F.lit(0.0)), 2).alias("amount"))


@query("SELECT ticker, date, field, value FROM (SELECT ticker, date, high, low, close FROM bars) UNPIVOT (value FOR field IN (high, low, close))")
def s6_wide_to_long(spark, sf):
    return src.daily_bars(spark, sf).unpivot(["ticker", "date"], ["high", "low", "close"], "field", "value").where("value is not null")


@query("SELECT 'T' || s_suppkey AS ticker FROM supplier WHERE s_acctbal >= 5000 OR s_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 25) OR s_suppkey < 3")
def s8_target_selection(spark, sf):
    """A floor or the largest, and a seed list."""
    u = src.table(spark, sf, "supplier")
    picked = u.where("s_acctbal >= 5000").unionByName(u.orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey").limit(25)).unionByName(u.where("s_suppkey < 3"))
    return picked.select(src.ticker(F.col("s_suppkey")).alias("ticker")).distinct()


@query("SELECT ticker, lpad(CAST(s_suppkey * 37 AS VARCHAR), 10, '0') AS cik FROM universe JOIN supplier ON ticker = 'T' || s_suppkey WHERE s_suppkey % 6 <> 0")
def s25_identifiers(spark, sf):
    ids = src.table(spark, sf, "supplier").where("s_suppkey % 6 <> 0").select(src.ticker(F.col("s_suppkey")).alias("ticker"), F.lpad((F.col("s_suppkey") * 37).cast("string"), 10, "0").alias("cik"))
    return src.universe(spark, sf).select("ticker").join(ids, "ticker")


@query("SELECT 'bars' AS surface, count(*) AS n, max(date) AS as_of FROM bars UNION ALL SELECT 'filings', count(*), max(effective_eod_date) FROM filings UNION ALL SELECT 'membership', count(*), max(as_of_date) FROM membership")
def s22_manifest(spark, sf):
    surface = lambda n, df, c: df.agg(F.count("*").alias("n"), F.max(c).alias("as_of")).select(F.lit(n).alias("surface"), "n", "as_of")
    return surface("bars", src.daily_bars(spark, sf), "date").unionByName(surface("filings", src.fundamentals(spark, sf), "effective_eod_date")).unionByName(surface("membership", _members(spark, sf), "as_of_date"))


@query("SELECT ticker, date, close FROM bars WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 20)")
def f3_last_dates(spark, sf):
    b = src.daily_bars(spark, sf).select("ticker", "date", "close")
    return b.join(b.select("date").distinct().orderBy(F.desc("date")).limit(20), "date", "left_semi")


@query("SELECT ticker, sector, rank() OVER (ORDER BY mktcap DESC NULLS LAST) AS place FROM universe WHERE sector = 'ASIA' OR ticker IN ('T1', 'T2')")
def f4_scope_then_rank(spark, sf):
    """The scope holds before the rank."""
    u = src.universe(spark, sf).where((F.col("sector") == "ASIA") | F.col("ticker").isin("T1", "T2"))
    return u.select("ticker", "sector", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("mktcap"))).cast("long").alias("place"))


@query("SELECT ticker, n_bars, last_date FROM (SELECT ticker, count(*) AS n_bars, max(date) AS last_date FROM bars GROUP BY ticker), (SELECT max(date) AS panel_end FROM bars) WHERE n_bars >= 500 AND last_date >= panel_end - 10")
def f12_eligible_and_recent(spark, sf):
    """F11, F12."""
    b = src.daily_bars(spark, sf)
    g = b.groupBy("ticker").agg(F.count("*").alias("n_bars"), F.max("date").alias("last_date"))
    end = g.groupBy().agg(F.max("last_date").alias("panel_end"))
    return g.join(end, (F.col("n_bars") >= 500) & (F.col("last_date") >= F.date_sub("panel_end", 10))).select("ticker", "n_bars", "last_date")


@query(
    ", w AS (SELECT bucket, date + CAST((4 - (isodow(date) - 1) + 7) % 7 AS INTEGER) AS week, max_by(close, date) AS close FROM sector_bars GROUP BY 1, 2), ax AS (SELECT DISTINCT week FROM w ORDER BY week DESC LIMIT 12), g AS (SELECT bucket, week FROM (SELECT DISTINCT bucket FROM w) CROSS JOIN ax) "
    "SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY week) - 1 AS place, close FROM g LEFT JOIN w USING (bucket, week)"
)
def j13_shared_axis(spark, sf):
    """Aligned arrays that keep their NULLs."""
    w = rotation.weekly(src.sector_bars(spark, sf), "bucket")
    axis = w.select("week").distinct().orderBy(F.desc("week")).limit(12)
    grid = asof.reindex(w, "bucket", axis, "week")
    return grid.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("week", "close"))), lambda x: x.close).alias("closes")).select("bucket", F.posexplode("closes").alias("place", "close")).select("bucket", F.col("place").cast("long").alias("place"), "close")


@query("SELECT ticker, date, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS v FROM (SELECT ticker, date, CASE WHEN volume % 4 = 0 THEN close END AS v FROM bars)")
def j3_fill_limit(spark, sf):
    b = src.daily_bars(spark, sf).select("ticker", "date", F.when(F.col("volume") % 4 == 0, F.col("close")).alias("v"))
    return asof.fill_forward(b, "ticker", "date", "v", limit=5)


@query("SELECT 'T' || s_suppkey AS ticker FROM supplier WHERE 'T' || s_suppkey NOT IN (SELECT ticker FROM filings)")
def j15_without_filings(spark, sf):
    """J15, U5."""
    return src.universe(spark, sf).select("ticker").join(src.fundamentals(spark, sf), "ticker", "left_anti")


@query("SELECT ticker, date, x, y FROM (SELECT b.ticker, b.date, b.close AS x, CASE WHEN b.volume % 50 = 0 THEN b.close * 1.5 WHEN b.volume % 51 = 0 THEN NULL ELSE b.close END AS y FROM bars b) WHERE y IS NULL OR abs(x - y) > 0.01")
def k5_surfaces_agree(spark, sf):
    """Only the rows that were changed differ."""
    b = src.daily_bars(spark, sf).select("ticker", "date", "close", "volume")
    other = b.withColumn("close", F.when(F.col("volume") % 50 == 0, F.col("close") * 1.5).when(F.col("volume") % 51 == 0, None).otherwise(F.col("close")))
    return checks.agree(b, other, ["ticker", "date"], "close", 0.01)


@query("SELECT 'null_close' AS \"check\", count(*) FILTER (close IS NULL) = 0 AS ok, count(*) FILTER (close IS NULL) AS detail FROM bars UNION ALL SELECT 'high_below_low', count(*) FILTER (high < low) = 0, count(*) FILTER (high < low) FROM bars UNION ALL SELECT 'no_volume', count(*) FILTER (volume <= 0) = 0, count(*) FILTER (volume <= 0) FROM bars UNION ALL SELECT 'large_day', count(*) FILTER (volume > 100) = 0, count(*) FILTER (volume > 100) FROM bars")
def k1_bar_checks(spark, sf):
    b = src.daily_bars(spark, sf)
    return checks.checks(b, null_close=F.col("close").isNull(), high_below_low=F.col("high") < F.col("low"), no_volume=F.col("volume") <= 0, large_day=F.col("volume") > 100)


@query(
    "SELECT 'streak_without_flag' AS \"check\", count(*) FILTER ((streak_days > 0) <> (candidate = 1)) = 0 AS ok, count(*) FILTER ((streak_days > 0) <> (candidate = 1)) AS detail FROM streaks UNION ALL SELECT 'flag_without_gate', count(*) FILTER (candidate = 1 AND NOT (up10 >= 0.6 AND net10 > 0)) = 0, count(*) FILTER (candidate = 1 AND NOT (up10 >= 0.6 AND net10 > 0)) FROM streaks"
)
def k1_screen_checks(spark, sf):
    r, flag = _risers(spark, sf), F.col("candidate") == 1
    return checks.checks(r, streak_without_flag=(F.col("streak_days") > 0) != flag, flag_without_gate=flag & ~((F.col("up10") >= 0.6) & (F.col("net10") > 0)))


@query()
def k3_no_retro_probe(spark, sf):
    """M6, K3: a later restatement leaves every earlier level of its theme as it was, and moves later ones. Levels of each theme, and how many changed."""
    m, bars = _members(spark, sf), src.daily_bars(spark, sf)
    probe = m.groupBy("theme").agg(F.max_by("ticker", F.struct("exposure", "ticker")).alias("ticker")).select("ticker", "theme", F.lit(0.0).alias("exposure"), F.lit("2001-03-05").cast("date").alias("as_of_date"))
    plain = themes.chained_index(bars, m, 0.03).select("theme", "date", F.col("log_level").alias("x"))
    probed = themes.chained_index(bars, m.unionByName(probe), 0.03).select("theme", "date", F.col("log_level").alias("y"))
    both = plain.join(probed, ["theme", "date"], "full").withColumn("same", F.coalesce(F.abs(F.col("x") - F.col("y")) < 1e-7, F.lit(False)))
    early = F.col("date") <= F.lit("2001-03-05").cast("date")
    share = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.groupBy("theme").agg(share(early).alias("earlier"), share(early & ~F.col("same")).alias("earlier_changed"), (share(~early & ~F.col("same")) > 0).alias("later_moved"))


PROBE = ", membership_p AS (SELECT ticker, theme, exposure, as_of_date FROM membership UNION ALL SELECT arg_max(ticker, (exposure, ticker)), theme, 0.0::DOUBLE, DATE '2001-03-05' FROM membership GROUP BY theme)"
ORACLE_SQL["k3_no_retro_probe"] = _recursive(
    PRICES + INDEX.format(s="") + PROBE + WEIGHTS.format(cap="0.03::DOUBLE", s="_p") + INDEX.format(s="_p")
    + " SELECT theme, count(*) FILTER (date <= DATE '2001-03-05') AS earlier, count(*) FILTER (date <= DATE '2001-03-05' AND NOT same) AS earlier_changed, count(*) FILTER (date > DATE '2001-03-05' AND NOT same) > 0 AS later_moved "
    "FROM (SELECT theme, date, coalesce(abs(a.log_level - b.log_level) < 1e-7, false) AS same FROM path a FULL JOIN path_p b USING (theme, date)) GROUP BY theme",
    0.03,
)


# --- windows and paths


@query("SELECT ticker, arg_max(date, i) AS last_high, date_diff('day', arg_max(date, i), max(d)) AS days_since FROM (SELECT ticker, date, i, d FROM (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, max(date) OVER (PARTITION BY ticker) AS d, max(close) OVER (PARTITION BY ticker ORDER BY date) AS top FROM bars) WHERE close >= top) GROUP BY ticker")
def w19_last_high(spark, sf):
    b = src.daily_bars(spark, sf).withColumn("top", F.max("close").over(by_ticker())).withColumn("d", F.max("date").over(Window.partitionBy("ticker")))
    return b.where("close >= top").groupBy("ticker").agg(F.max("date").alias("last_high"), F.datediff(F.max("d"), F.max("date")).cast("long").alias("days_since"))


@query("SELECT sector, ticker, round(net10, 6) AS net10, place FROM (SELECT sector, r.ticker, net10, row_number() OVER (PARTITION BY sector ORDER BY net10 DESC NULLS LAST, r.ticker) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM riser) r JOIN universe u ON u.ticker = r.ticker WHERE n = 1) WHERE place <= 6")
def w20_top_members(spark, sf):
    """A bounded list per sector."""
    r = valuation.latest(screen.riser_metrics(src.daily_bars(spark, sf)).select("ticker", "date", "net10"), "ticker", "date").join(src.universe(spark, sf).select("ticker", "sector"), "ticker")
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc_nulls_last("net10"), "ticker")).cast("long"))
    return rounded(r.where("place <= 6").select("sector", "ticker", "net10", "place"))


@query("SELECT ticker, date, close >= coalesce(lag(close, 3) OVER (PARTITION BY ticker ORDER BY date), first_value(close) OVER (PARTITION BY ticker ORDER BY date)) AS rising FROM bars")
def w24_slope_signs(spark, sf):
    return src.daily_bars(spark, sf).select("ticker", "date", (F.col("close") >= F.coalesce(F.lag("close", 3).over(by_ticker()), F.first("close").over(by_ticker()))).alias("rising"))


@query("SELECT ticker, date, round(covar_samp(r, m) OVER w / nullif(var_samp(m) OVER w, 0), 5) AS beta FROM (SELECT *, count(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS k FROM (SELECT ticker, b.date, close / lag(close) OVER (PARTITION BY ticker ORDER BY b.date) - 1 AS r, s.m FROM bars b JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS m FROM spx) s ON s.date = b.date)) WHERE r IS NOT NULL AND m IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w >= 126")
def w6_rolling_beta(spark, sf):
    from panelwright.functions.windows import last_rows

    one = Window.partitionBy(F.lit(0)).orderBy("date")
    m = src.benchmark(spark, sf).select("date", (F.try_divide("close", F.lag("close").over(one)) - 1).alias("m"))
    b = src.daily_bars(spark, sf).select("ticker", "date", (F.try_divide("close", F.lag("close").over(by_ticker())) - 1).alias("r")).join(m, "date").where("r is not null and m is not null")
    w = last_rows(252)
    out = b.select("ticker", "date", F.try_divide(F.covar_samp("r", "m").over(w), F.nullif(F.var_samp("m").over(w), F.lit(0.0))).alias("beta"), F.count(F.lit(1)).over(w).alias("k"))
    return rounded(out.where("k >= 126").drop("k"), 5)


@query("SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS place, date, close FROM (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars) WHERE n <= 90")
def d2_chart_arrays(spark, sf):
    """The last 90 bars of each ticker as arrays side by side."""
    b = src.daily_bars(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("n <= 90")
    s = b.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("s"))
    return s.select("ticker", F.posexplode("s").alias("place", "x")).select("ticker", F.col("place").cast("long").alias("place"), "x.date", "x.close")


@query(
    "SELECT ticker, sector, CAST(candidate AS BIGINT) AS candidate, CAST(streak_days AS BIGINT) AS streak_days, round(net10, 6) AS net10, round(ps, 4) AS ps, themes FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM streaks) s JOIN universe u USING (ticker) "
    "LEFT JOIN (SELECT ticker, ps FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM valued) WHERE n = 1) v USING (ticker) LEFT JOIN (SELECT ticker, string_agg(theme, ',' ORDER BY exposure DESC, theme) AS themes FROM (SELECT *, row_number() OVER (PARTITION BY ticker, theme ORDER BY as_of_date DESC) AS n FROM membership WHERE as_of_date <= DATE '2001-11-04') WHERE n = 1 AND exposure > 0 GROUP BY ticker) t USING (ticker) WHERE n = 1"
)
def d3_board_rows(spark, sf):
    """Identity, screen, valuation and theme chips of each ticker."""
    r = valuation.latest(_risers(spark, sf).select("ticker", "date", "candidate", "streak_days", "net10"), "ticker", "date")
    v = valuation.latest(_valued(spark, sf).select("ticker", "date", "ps"), "ticker", "date").select("ticker", "ps")
    m = asof.membership_at(_members(spark, sf), "2001-11-04").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct((-F.col("exposure")).alias("e"), "theme"))).alias("s"))
    chips = m.select("ticker", F.array_join(F.transform("s", lambda x: x.theme), ",").alias("themes"))
    out = r.join(src.universe(spark, sf).select("ticker", "sector"), "ticker").join(v, "ticker", "left").join(chips, "ticker", "left")
    return rounded(out.select("ticker", "sector", "candidate", "streak_days", "net10", "ps", "themes"), ps=4)


# --- research

FORWARD = "SELECT r.ticker, r.date, sector, up10, net10, CASE WHEN lead(close, 20) OVER (PARTITION BY r.ticker ORDER BY r.date) / close - 1 > 0 THEN 1 ELSE 0 END AS y, lead(close, 20) OVER (PARTITION BY r.ticker ORDER BY r.date) / close - 1 AS fwd FROM riser r JOIN universe u ON u.ticker = r.ticker"


def _forward(spark: SparkSession, sf: str) -> DataFrame:
    r = screen.riser_metrics(src.daily_bars(spark, sf)).withColumn("fwd", F.try_divide(F.lead("close", 20).over(by_ticker()), "close") - 1).where("fwd is not null and up10 is not null")
    return r.withColumn("y", (F.col("fwd") > 0).cast("int")).join(src.universe(spark, sf).select("ticker", "sector"), "ticker")


@query(f", f AS ({FORWARD}), c AS (SELECT sector, year(date) AS yr, count(*) FILTER (up10 >= 0.6) AS n1, count(*) FILTER (up10 < 0.6) AS n0, avg(y) FILTER (up10 >= 0.6) AS r1, avg(y) FILTER (up10 < 0.6) AS r0 FROM f WHERE fwd IS NOT NULL AND up10 IS NOT NULL GROUP BY 1, 2) SELECT count(*) AS cells, round(sum(n1 * r1) / sum(n1), 6) AS treated, round(sum(n1 * r0) / sum(n1), 6) AS control FROM c WHERE n1 >= 20 AND n0 >= 20")
def q17_matched_lift(spark, sf):
    """Q17, A13."""
    f = _forward(spark, sf).withColumn("t", F.col("up10") >= 0.6).withColumn("yr", F.year("date"))
    return rounded(research.matched_lift(f, ["sector", "yr"], "t", "y", 20))


@query(
    ", d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)), f AS (SELECT unnest(range(5)) AS fold), m AS (SELECT date, fold, o, floor(n * 0.3) + fold * floor((n - floor(n * 0.3)) / 5) AS s, floor((n - floor(n * 0.3)) / 5) AS size FROM d, f), "
    "p AS (SELECT date, fold, CASE WHEN o >= s AND o < s + size THEN 'test' WHEN o < s - 25 THEN 'train' END AS part FROM m) SELECT fold, part, count(*) AS n, min(b.date) AS first, max(b.date) AS last FROM bars b JOIN p ON p.date = b.date WHERE part IS NOT NULL GROUP BY fold, part"
)
def q27_walk_forward(spark, sf):
    """Q4, Q27."""
    f = research.walk_forward(src.daily_bars(spark, sf), "date", folds=5, gap=25)
    return f.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    f", f AS (SELECT * FROM ({FORWARD}) WHERE fwd IS NOT NULL AND up10 IS NOT NULL), r AS (SELECT sector, y, up10, rank() OVER (PARTITION BY sector ORDER BY up10) + (count(*) OVER (PARTITION BY sector, up10) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY sector ORDER BY up10 DESC) AS seen, sum(y) OVER (PARTITION BY sector ORDER BY up10 DESC) AS hits FROM f) "
    "SELECT sector, count(*) AS n, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc, round(avg(CASE WHEN y = 1 THEN hits / seen END), 6) AS average_precision, round(avg((up10 - y) * (up10 - y)), 6) AS brier FROM r GROUP BY sector"
)
def q29_fold_metrics(spark, sf):
    return rounded(research.fold_metrics(_forward(spark, sf), "sector", "y", "up10"))


# --- text


TEXT = "html"
for _pattern, _to in (("(?is)<script[^>]*>.*?</script>", "' '"), ("(?is)<style[^>]*>.*?</style>", "' '"), ("(?i)</(p|div|tr|li|h1|h2|h3|h4|h5|h6|table)>", "chr(10)"), ("<[^>]+>", "' '")):
    TEXT = f"regexp_replace({TEXT}, '{_pattern}', {_to}, 'g')"
TEXT = f"replace(replace(replace({TEXT}, '&nbsp;', ' '), '&amp;', '&'), '&#8217;', '''')"
for _pattern, _to in (("[ \\t]+", "' '"), ("\\n\\s*\\n", "chr(10)"), ("^\\s+|\\s+$", "''")):
    TEXT = f"regexp_replace({TEXT}, '{_pattern}', {_to}, 'g')"


@query(f"SELECT page_id, {TEXT} AS text FROM pages")
def l1_html_text(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query(
    "SELECT doc_id, a AS start, least(b, length(text)) AS \"end\", md5(substring(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))) AS piece_md5 FROM (SELECT doc_id, any_value(text) AS text, min(a) AS a, max(b) AS b, island FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM ("
    "SELECT doc_id, text, pos, greatest(0, pos - 500) AS a, pos + 3000 AS b, CASE WHEN greatest(0, pos - 500) < lag(pos + 3000) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM ("
    "SELECT doc_id, text, i, n, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * 4 AS BIGINT) AS pos FROM (SELECT doc_id, text, unnest(string_split(text, 'that')) AS x, generate_subscripts(string_split(text, 'that'), 1) AS i, len(string_split(text, 'that')) AS n FROM documents WHERE text IS NOT NULL)) WHERE i < n)) q GROUP BY doc_id, island) WHERE island <= 12"
)
def l2_keyword_windows(spark, sf):
    """Windows of 500 characters before and 3,000 behind a word in whole texts, overlapping ones merged, the first twelve."""
    found = text.keyword_windows(src.table(spark, sf, "documents"), "doc_id", "text", "that")
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("piece").alias("piece_md5"))


@query("SELECT theme, ticker, try_cast(e AS DOUBLE) AS exposure, CASE WHEN c IN ('high', 'medium', 'low') THEN c ELSE 'low' END AS confidence FROM (SELECT theme, ticker, CASE WHEN ticker LIKE '%7' THEN 'n/a' WHEN ticker LIKE '%8' THEN '1.5' ELSE CAST(exposure AS VARCHAR) END AS e, CASE WHEN ticker LIKE '%1' THEN 'high' WHEN ticker LIKE '%2' THEN '?' END AS c FROM membership) WHERE theme <> 'MACHINERY' AND try_cast(e AS DOUBLE) BETWEEN 0 AND 1")
def l3_valid_rows(spark, sf):
    """L3, S11."""
    m, t = _members(spark, sf), F.col("ticker")
    raw = m.select("theme", "ticker", F.when(t.endswith("7"), "n/a").when(t.endswith("8"), "1.5").otherwise(F.col("exposure").cast("string")).alias("exposure"), F.when(t.endswith("1"), "high").when(t.endswith("2"), "?").alias("confidence"))
    return text.valid_rows(raw, m.where("theme <> 'MACHINERY'"), "theme").select("theme", "ticker", "exposure", "confidence")


@query("SELECT o_custkey AS k, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS first_id FROM orders GROUP BY o_custkey")
def l4_first_of_form(spark, sf):
    s = src.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("s"))
    return s.select("k", text.first_of_form(F.transform("s", lambda x: x.o_orderstatus), F.transform("s", lambda x: x.o_orderkey), "F").alias("first_id"))


# --- smaller operators


@query("SELECT ticker, CASE WHEN d < 0 OR d IS NULL THEN 'stale' WHEN d <= 3 THEN 'fresh' WHEN d <= 7 THEN 'aging' ELSE 'stale' END AS age FROM (SELECT ticker, date_diff('day', max(date), DATE '2001-11-04') AS d FROM bars GROUP BY ticker)")
def f8_data_age(spark, sf):
    last = src.daily_bars(spark, sf).groupBy("ticker").agg(F.max("date").alias("d"))
    return last.select("ticker", filters.data_age(F.col("d"), F.lit("2001-11-04").cast("date")).alias("age"))


@query("SELECT ticker, date, CASE WHEN round(ps, 2) > 0 THEN round(ps, 2) END AS ps FROM valued")
def f10_renderable_multiple(spark, sf):
    """rounded first, shown only if still positive."""
    return _valued(spark, sf).select("ticker", "date", filters.renderable(filters.safe_number(F.col("ps"))).alias("ps"))


@query("SELECT ticker, date FROM riser WHERE up10 BETWEEN 0.5 AND 0.7 AND net10 BETWEEN -0.2 AND 0.3")
def f5_rectangle(spark, sf):
    return screen.riser_metrics(src.daily_bars(spark, sf)).where(filters.in_rectangle("up10", "net10", (0.7, -0.2), (0.5, 0.3))).select("ticker", "date")


@query("SELECT u.ticker, v.ticker AS nearest FROM (SELECT s_suppkey AS k, 'T' || s_suppkey AS ticker, s_acctbal AS x, s_nationkey AS y FROM supplier WHERE s_suppkey % 10 = 0) u, LATERAL (SELECT 'T' || s_suppkey AS ticker FROM supplier WHERE s_suppkey <> k AND (s_acctbal - x) * (s_acctbal - x) + (s_nationkey - y) * (s_nationkey - y) * 10000 <= 4000000 ORDER BY (s_acctbal - x) * (s_acctbal - x) + (s_nationkey - y) * (s_nationkey - y) * 10000, ticker LIMIT 1) v")
def f6_nearest_point(spark, sf):
    """For a tenth of the points, the nearest other one within a radius."""
    p = src.table(spark, sf, "supplier").select(src.ticker(F.col("s_suppkey")).alias("ticker"), "s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))
    return filters.nearest(p.where("s_suppkey % 10 = 0"), p, "ticker", ("x", "y"), 2000.0)


@query("SELECT c_custkey AS k FROM (SELECT * FROM customer WHERE c_acctbal BETWEEN 1000 AND 8000) ORDER BY (c_custkey * 48271) % 2147483647, c_custkey LIMIT 100")
def f14_habitat_sample(spark, sf):
    """A sampling operator: a band, then the first by a hash of the key."""
    c = src.table(spark, sf, "customer").where("c_acctbal between 1000 and 8000")
    return c.orderBy((F.col("c_custkey") * 48271) % 2147483647, "c_custkey").limit(100).select(F.col("c_custkey").alias("k"))


@query("SELECT ticker, date, round(lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1, 6) AS mom_12_1, CASE WHEN close > m AND NOT coalesce(lag(close > m) OVER w, close > m) THEN 1::BIGINT ELSE 0::BIGINT END AS reclaim FROM (SELECT *, CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS m FROM bars WINDOW w50 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def w2_momentum_and_reclaim(spark, sf):
    """W2, W15."""
    from panelwright.functions.windows import rolling

    b = src.daily_bars(spark, sf).withColumn("m", rolling(F.avg, F.col("close"), 50))
    above = F.col("close") > F.col("m")
    mom = F.try_divide(F.lag("close", 21).over(by_ticker()), F.lag("close", 252).over(by_ticker())) - 1
    cross = above & ~F.coalesce(F.lag(above).over(by_ticker()), above)
    return rounded(b.select("ticker", "date", mom.alias("mom_12_1"), F.when(cross, 1).otherwise(0).cast("long").alias("reclaim")))


@query("SELECT bucket, date, round(CASE WHEN count(v) OVER w >= 252 THEN quantile_cont(v, 0.8) OVER w END, 6) AS q80 FROM (SELECT bucket, date, ln(close) AS v FROM sector_bars) WINDOW w AS (PARTITION BY bucket ORDER BY date)")
def w5_expanding_quantile(spark, sf):
    by = Window.partitionBy("bucket").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = src.sector_bars(spark, sf).withColumn("v", F.ln("close"))
    return rounded(v.select("bucket", "date", F.when(F.count("v").over(by) >= 252, F.percentile("v", F.lit(0.8)).over(by)).alias("q80")))


@query("SELECT 'T' || l_suppkey AS ticker, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1 UNION ALL SELECT 'R', count(*) * 2 FROM lineitem WHERE l_returnflag = 'R'")
def m4_scoped_rebuild(spark, sf):
    """M4, M5: one scope is cleared and rebuilt, the others stay; a column that is new on one side is NULL on the other."""
    l = src.table(spark, sf, "lineitem")
    old = l.groupBy(src.ticker(F.col("l_suppkey")).alias("ticker"), (F.col("l_returnflag") == "R").alias("scope")).agg(F.count("*").alias("n"))
    new = l.where("l_returnflag = 'R'").agg((F.count("*") * 2).alias("n")).select(F.lit("R").alias("ticker"), F.lit(True).alias("scope"), "n", F.lit(1).alias("version"))
    return tables.rebuild_scope(old, new, F.col("scope")).select("ticker", "n")


@query("SELECT date, round(w * r, 9) AS ret FROM (SELECT date, r, lag(CASE WHEN v <> 0 THEN least(1.5, greatest(0, 0.15 / v)) END) OVER (ORDER BY date) AS w FROM (SELECT date, r, CASE WHEN count(r) OVER k = 21 THEN stddev_samp(r) OVER k * sqrt(252) END AS v FROM (SELECT date, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS r FROM spx) WINDOW k AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))) WHERE w IS NOT NULL AND r IS NOT NULL")
def e14_vol_target(spark, sf):
    """Weight by yesterday's trailing deviation. One series, so one task; a few thousand rows."""
    from panelwright.functions.windows import rolling

    one = Window.partitionBy(F.lit(0)).orderBy("date")
    b = src.benchmark(spark, sf).withColumn("r", F.ln("close") - F.ln(F.lag("close").over(one)))
    b = b.withColumn("v", rolling(F.stddev_samp, F.col("r"), 21, by=one) * F.sqrt(F.lit(252.0)))
    b = b.withColumn("w", F.lag(clamp(F.try_divide(F.lit(0.15), F.nullif("v", F.lit(0.0))), 0.0, 1.5)).over(one)).where("w is not null and r is not null")
    return b.select("date", F.round(F.col("w") * F.col("r"), 9).alias("ret"))


@query("SELECT DISTINCT d AS date FROM (SELECT unnest(range(DATE '2001-01-01', DATE '2001-11-05', INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6 AND d IN (SELECT date FROM spx)")
def s24_weekdays(spark, sf):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2001-01-01").cast("date"), F.lit("2001-11-04").cast("date"))).alias("date")).where(F.weekday("date") < 5)
    return src.benchmark(spark, sf).select("date").join(days, "date")


@query()
def k4_weight_bounds(spark, sf):
    w = themes.capped_weights(asof.membership_at(_members(spark, sf), DAY), ["theme"], 0.03)
    bound = F.greatest(F.lit(0.03), 1 / F.count("*")) + 1e-9
    return w.groupBy("theme").agg(F.count("*").alias("members"), (F.max("weight") <= bound).alias("capped"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("whole"))


ORACLE_SQL["k4_weight_bounds"] = _recursive(
    f"SELECT theme, count(*) AS members, max(w) <= greatest(0.03, 1.0 / count(*)) + 1e-9 AS capped, abs(sum(w) - 1) < 1e-9 AS whole FROM rounds r WHERE i = 12 AND segment = (SELECT max(m.as_of_date) FROM membership m WHERE m.theme = r.theme AND m.as_of_date <= DATE '{DAY}') GROUP BY theme", 0.03
)


@query("SELECT ticker, round(close / lag21 - 1, 6) AS ret_1m, round(close / top - 1, 6) AS from_high, round(volume / mean50, 6) AS volume_ratio FROM (SELECT ticker, date, close, volume, lag(close, 21) OVER w AS lag21, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS top, avg(CAST(volume AS DOUBLE)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS mean50, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE n = 1")
def d1_evidence(spark, sf):
    from panelwright.functions.windows import last_rows

    b = src.daily_bars(spark, sf)
    e = b.select("ticker", "date", (F.col("close") / F.lag("close", 21).over(by_ticker()) - 1).alias("ret_1m"), (F.col("close") / F.max("close").over(last_rows(252)) - 1).alias("from_high"), (F.col("volume") / F.avg(F.col("volume").cast("double")).over(last_rows(50))).alias("volume_ratio"))
    return rounded(valuation.latest(e, "ticker", "date").drop("date"))


@query("SELECT max(abs(100 * (0.215 * c_rs + 0.22 * c_high + 0.17 * c_trend + 0.12 * c_vol + 0.275 * c_accel) - composite)) <= 1e-6 AS ok, count(*) AS n FROM scored")
def d4_reconstruct_guard(spark, sf):
    c = screen.composite(_signals(spark, sf))
    again = sum((F.col(f"c_{n}") * w for n, w in screen.weights(0.5).items()), F.lit(0.0)) * 100
    return c.agg((F.max(F.abs(again - F.col("composite"))) <= 1e-6).alias("ok"), F.count("*").alias("n"))


@query("SELECT yr, n, round(mean, 6) AS mean, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM (SELECT year(date) AS yr, count(*) AS n, avg(fwd) AS mean FROM (SELECT ticker, date, up10, net10, lead(close, 20) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM riser) WHERE fwd IS NOT NULL AND i % 21 = 0 GROUP BY 1)")
def q18_sampled_panel(spark, sf):
    """Every 21st row with a complete forward window, by year."""
    r = screen.riser_metrics(src.daily_bars(spark, sf)).withColumn("fwd", F.try_divide(F.lead("close", 20).over(by_ticker()), "close") - 1).withColumn("i", F.row_number().over(by_ticker())).where("fwd is not null and i % 21 = 0")
    g = r.groupBy(F.year("date").cast("long").alias("yr")).agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"))
    return rounded(g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@query("SELECT ticker, start_date, high_date, round(top / low - 1, 6) AS run FROM (SELECT ticker, arg_max(date, close) AS high_date, max(close) AS top, arg_max(low_date, close) AS start_date, arg_max(low, close) AS low FROM (SELECT ticker, date, close, min(close) OVER w AS low, arg_min(date, close) OVER w AS low_date FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 189 PRECEDING AND CURRENT ROW)) GROUP BY ticker)")
def e12_biggest_run(spark, sf):
    from panelwright.functions.windows import last_rows

    w = last_rows(190)
    b = src.daily_bars(spark, sf).select("ticker", "date", "close", F.min("close").over(w).alias("low"), F.min_by("date", "close").over(w).alias("low_date"))
    top = b.groupBy("ticker").agg(F.max_by(F.struct("date", "close", "low", "low_date"), "close").alias("x"))
    return rounded(top.select("ticker", F.col("x.low_date").alias("start_date"), F.col("x.date").alias("high_date"), (F.col("x.close") / F.col("x.low") - 1).alias("run")))
