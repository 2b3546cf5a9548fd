"""Registered queries of whole snapshot rows, and of whether two surfaces that show the same thing agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_ticker, last_rows, rolling
from panelwright.operators import asof, rotation, screen, valuation, views
from panelwright.operators import quality as checks
from panelwright.plans import extended
from panelwright.plans import queries as base
from panelwright.plans.queries import query, rounded
from panelwright.sources import adapters as src

LAST = "row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back"


def _evidence(spark, sf):
    """The raw numbers of each ticker's last day: returns of a month, a quarter and half a year, distance from and weeks
    since the high of its last 260 rows, volume against its mean of 50."""
    by = by_ticker()
    s = base._signals(spark, sf).select("ticker", "date", F.col("ret_63").alias("ret_3m"), F.col("ret_126").alias("ret_6m"), (F.col("high_prox") - 1).alias("from_high"))
    b = src.daily_bars(spark, sf)
    px, v = F.col("adj_close"), F.col("volume").cast("double")
    bars = b.select("ticker", "date", "adj_close", (F.try_divide(px, F.lag(px, 21).over(by)) - 1).alias("ret_1m"), F.when(F.row_number().over(by) >= 50, F.try_divide(v, F.avg(v).over(last_rows(50)))).alias("vol_mult"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("back"))
    recent = bars.where("back <= 260").withColumn("top", F.max("adj_close").over(by))
    weeks = recent.groupBy("ticker").agg(F.floor(F.datediff(F.max("date"), F.max(F.when(F.col("adj_close") >= F.col("top"), F.col("date")))) / 7).cast("long").alias("weeks_since_high"))
    return bars.where("back = 1").select("ticker", "date", "ret_1m", "vol_mult").join(s, ["ticker", "date"], "left").join(weeks, "ticker").drop("date")


EVIDENCE = (
    ", e0 AS (SELECT ticker, date, adj_close, adj_close / lag(adj_close, 21) OVER w - 1 AS ret_1m, CASE WHEN row_number() OVER w >= 50 THEN volume / avg(CAST(volume AS DOUBLE)) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS vol_mult, " + LAST + " FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    "e1 AS (SELECT *, max(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS top FROM e0 WHERE back <= 260), e2 AS (SELECT ticker, date_diff('day', max(date) FILTER (adj_close >= top), max(date)) // 7 AS weeks_since_high FROM e1 GROUP BY ticker), "
    "evidence AS (SELECT e0.ticker, ret_1m, ret_63 AS ret_3m, ret_126 AS ret_6m, high_prox - 1 AS from_high, weeks_since_high, vol_mult FROM e0 LEFT JOIN signal s ON s.ticker = e0.ticker AND s.date = e0.date JOIN e2 ON e2.ticker = e0.ticker WHERE back = 1)"
)
_EVIDENCE = ("ret_1m", "ret_3m", "ret_6m", "from_high", "vol_mult")


@query(EVIDENCE + " SELECT ticker, " + ", ".join(f"round({c}, 6) AS {c}" for c in _EVIDENCE) + ", weeks_since_high FROM evidence")
def d1_evidence_numbers(spark, sf):
    """The six raw numbers of every ticker's last day."""
    return rounded(_evidence(spark, sf))


_AVERAGES = (50, 150, 200)


@query(
    ", c0 AS (SELECT ticker, date, open, high, low, close, adj_close, volume, " + ", ".join(f"CASE WHEN count(adj_close) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(adj_close) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS ma{n}" for n in _AVERAGES)
    + ", max(adj_close) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS high_52w, " + LAST + " FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), hi AS (SELECT ticker, high_52w AS last_high FROM c0 WHERE back = 1) "
    "SELECT ticker, greatest(0, least(90, count(*) OVER (PARTITION BY ticker)) - back) AS place, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("ma50", "ma150", "ma200")) + ", open, high, low, close, adj_close, volume, last_high AS high_52w FROM c0 JOIN hi USING (ticker) WHERE back <= 90"
)
def d2_chart(spark, sf):
    """The last 90 bars of every ticker side by side with its averages by date, and its high of 252 rows."""
    px = F.col("adj_close")
    b = src.daily_bars(spark, sf).select("*", *(rolling(F.avg, px, n).alias(f"ma{n}") for n in _AVERAGES), F.max(px).over(last_rows(252)).alias("top"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("back"))
    columns = ("open", "high", "low", "close", "adj_close", "volume", *(f"ma{n}" for n in _AVERAGES))
    chart = b.where("back <= 90").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", *columns))).alias("chart"), F.max(F.when(F.col("back") == 1, F.col("top"))).alias("high_52w"))
    rows = chart.select("ticker", "high_52w", F.posexplode("chart").alias("place", "x")).select("ticker", F.col("place").cast("long").alias("place"), "x.*", "high_52w")
    return rounded(rows, open=None, high=None, low=None, close=None, adj_close=None, high_52w=None)


AS_OF = "2001-11-04"


def _board(spark, sf, *shown: str, riser=None):
    """Identity, components, composite and the one before, the screen's block, the multiples in force with their age, and theme chips of every ticker's last scored day.

    ``shown``: the columns that are asked for besides ticker and date, all unless given. Parts of which none is asked
    for and which have one row a ticker at most are left out; the universe stays, as it may name a ticker twice.
    ``riser``: the screen's block, where its rows of the days that count are had for less than all of it.
    """
    scored = screen.composite(base._signals(spark, sf))
    parts = [f"c_{n}" for n in screen.weights(0.5)]
    last = Window.partitionBy("ticker").orderBy("date")
    scored = scored.select("ticker", "date", *parts, "composite", F.lag("composite").over(last).alias("composite_prev"), "rank_in_universe")
    riser = base._risers(spark, sf).drop("close") if riser is None else riser
    if shown:
        scored, riser = (x.select("ticker", "date", *(c for c in x.columns if c in shown)) for x in (scored, riser))
    rows = valuation.latest(scored, "ticker", "date")
    age = F.datediff("valued_on", "as_of_period_end")
    v = valuation.latest(base._valued(spark, sf).drop("close").withColumn("valued_on", F.col("date")), "ticker", "date").select("ticker", "pe", "ps", "evs", "growth", "margin", age.cast("long").alias("age"), F.datediff("as_of_filed", "as_of_period_end").cast("long").alias("disclosure_lag"), valuation.freshness(age).alias("freshness"))
    out = rows.join(riser, ["ticker", "date"]).join(src.universe(spark, sf).select("ticker", "name", "sector", "mktcap"), "ticker", "left")
    if shown:
        v = v.select("ticker", *(c for c in v.columns if c in shown))
    out = out.join(v, "ticker", "left") if len(v.columns) > 1 else out
    if shown and "themes" not in shown:
        return out.select("ticker", "date", *shown)
    chips = asof.membership_at(base._members(spark, sf), AS_OF).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct((-F.col("exposure")).alias("e"), "theme"))).alias("s"))
    chips = chips.select("ticker", F.array_join(F.transform("s", lambda x: F.concat(x.theme, F.lit(":"), F.format_number(-x.e, 4))), ",").alias("themes"))
    return out.join(chips, "ticker", "left")


_BOARD = ("composite", "composite_prev", "c_rs", "c_high", "c_trend", "c_vol", "c_accel", "net5", "net10", "net20", "up10", "ddw10", "ker10", "net10_pct", "pe", "ps", "evs", "growth", "margin")
BOARD = (
    ", b0 AS (SELECT ticker, date, composite, lag(composite) OVER (PARTITION BY ticker ORDER BY date) AS composite_prev, c_rs, c_high, c_trend, c_vol, c_accel, rank() OVER (PARTITION BY date ORDER BY round(composite, 9) DESC NULLS LAST) AS rank_in_universe, " + LAST + " FROM scored), "
    "v0 AS (SELECT *, date_diff('day', as_of_period_end, date) AS age, date_diff('day', as_of_period_end, as_of_filed) AS disclosure_lag, " + LAST + " FROM valued), "
    f"th AS (SELECT ticker, string_agg(theme || ':' || format('{{:.4f}}', exposure), ',' ORDER BY exposure DESC, theme) AS themes FROM (SELECT *, row_number() OVER (PARTITION BY ticker, theme ORDER BY as_of_date DESC) AS n FROM membership WHERE as_of_date <= DATE '{AS_OF}') WHERE n = 1 AND exposure > 0 GROUP BY ticker), "
    "board AS (SELECT b0.ticker, name, sector, mktcap, b0.date, " + ", ".join(_BOARD) + ", rank_in_universe, candidate, streak_days, age, disclosure_lag, CASE WHEN age <= 95 THEN 'fresh' WHEN age <= 160 THEN 'stale' WHEN age IS NOT NULL THEN 'overdue' END AS freshness, themes "
    "FROM b0 JOIN streaks USING (ticker, date) LEFT JOIN universe USING (ticker) LEFT JOIN (SELECT * EXCLUDE (date, close, back) FROM v0 WHERE back = 1) v USING (ticker) LEFT JOIN th USING (ticker) WHERE back = 1)"
)


@query(
    BOARD + " SELECT ticker, name, sector, round(mktcap, 2) AS mktcap, date, " + ", ".join(f"round({c}, 4) AS {c}" for c in _BOARD) + ", rank_in_universe, CAST(candidate AS BIGINT) AS candidate, CAST(streak_days AS BIGINT) AS streak_days, age, disclosure_lag, freshness, themes FROM board"
)
def d3_board(spark, sf):
    """Whole board rows."""
    columns = ("ticker", "name", "sector", "mktcap", "date", *_BOARD, "rank_in_universe", "candidate", "streak_days", "age", "disclosure_lag", "freshness", "themes")
    return rounded(_board(spark, sf).select(*columns), 4, mktcap=2)


def _agreement(both, *pairs: tuple):
    """One row for each (pair, value, left, right, tolerance): how many keys both surfaces have with a value, and on how many the two differ. ``both`` is read once."""
    rows = []
    for pair, value, left, right, tolerance in pairs:
        left, right = F.col(left), F.col(right)
        known = left.isNotNull() & right.isNotNull()
        apart = F.coalesce(F.abs(left - right) > tolerance, F.lit(False))
        rows.append(F.struct(F.lit(pair).alias("pair"), F.lit(value).alias("value"), F.count(F.when(known, 1)).alias("compared"), F.count(F.when(known & apart, 1)).alias("differ"), F.count(F.when(~known, 1)).alias("on_one_side")))
    return both.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _compared(pair: str, both: str, value: str, left: str, right: str, tolerance: float) -> str:
    known = f"({left}) IS NOT NULL AND ({right}) IS NOT NULL"
    return f"SELECT '{pair}' AS pair, '{value}' AS value, count(*) FILTER ({known}) AS compared, count(*) FILTER ({known} AND abs(({left}) - ({right})) > {tolerance}) AS differ, count(*) FILTER (NOT ({known})) AS on_one_side FROM {both}"


def _last_points(spark, sf):
    """The phase map's points on the last date that has any, and the screen's block of that date.

    Multiples are found on the screen's own rows, so the two need not be joined, and only the last date's rows are
    dealt out by date to be ranked.
    """
    rows = screen.population(src.daily_bars(spark, sf), src.benchmark(spark, sf), "adj_close")
    valued = valuation.valuation(rows, base._filings(spark, sf), "net10", "up10", unfiled=True).select("ticker", "date", "net10", "up10", F.round("ps", 2).alias("ps"))
    last = F.broadcast(valued.where("ps > 0").agg(F.max("date").alias("date")))  # one row
    ranked = screen.candidates(valued.join(last, "date"), top_n=3).select("ticker", "date", "net10_pct", "candidate", "ps")
    return ranked.where("ps > 0"), ranked.drop("ps")


_BM = "(SELECT b.ticker, b.net10_pct AS l1, g.net10_pct AS r1, b.candidate AS l2, g.candidate AS r2, round(b.ps, 2) AS l3, g.ps AS r3 FROM board b JOIN (SELECT * FROM grid WHERE place = (SELECT max(place) FROM grid) AND ps IS NOT NULL) g USING (ticker, date))"


@query(
    BOARD + extended.GRID + " " + _compared("board, phase map", _BM, "net10_pct", "l1", "r1", 0.05) + " UNION ALL " + _compared("board, phase map", _BM, "candidate", "l2", "r2", 0) + " UNION ALL " + _compared("board, phase map", _BM, "ps", "l3", "r3", 0.005)
)
def k5_board_and_phase_map(spark, sf):
    """K5: the board's numbers and the last points of the phase map, for tickers on both."""
    points, riser = _last_points(spark, sf)
    last = views.panel_grid(points, 1).select("ticker", "date", F.col("net10_pct").alias("r1"), F.col("candidate").alias("r2"), F.col("ps").alias("r3"))
    both = _board(spark, sf, "net10_pct", "candidate", "ps", riser=riser).select("ticker", "date", F.col("net10_pct").alias("l1"), F.col("candidate").alias("l2"), F.round("ps", 2).alias("l3")).join(last, ["ticker", "date"])
    return _agreement(both, *(("board, phase map", *x) for x in (("net10_pct", "l1", "r1", 0.05), ("candidate", "l2", "r2", 0), ("ps", "l3", "r3", 0.005))))


_VAL = "(SELECT b.ticker, b.ps AS l1, t.ps AS r1, b.age AS l2, date_diff('day', c.as_of_period_end, c.date) AS r2 FROM board b FULL JOIN (SELECT ticker, arg_max(ps, date) AS ps FROM valued WHERE ps IS NOT NULL GROUP BY ticker) t USING (ticker) FULL JOIN (SELECT ticker, as_of_period_end, date FROM v0 WHERE back = 1) c USING (ticker))"


@query(BOARD + " " + _compared("board, stock page", _VAL, "ps", "l1", "r1", 0.0001) + " UNION ALL " + _compared("board, cross-section", _VAL, "age", "l2", "r2", 0))
def k5_board_and_valuation(spark, sf):
    """K5: the board's multiple and the last of the stock page's series, and its filing's age and that of the cross-section."""
    valued = base._valued(spark, sf)
    # the stock page's last multiple and the cross-section's filing, found in one reading
    other = valued.groupBy("ticker").agg(F.max_by("ps", F.when(F.col("ps").isNotNull(), F.col("date"))).alias("r1"), F.max_by(F.datediff("date", "as_of_period_end"), "date").alias("r2"))
    riser = valuation.latest(screen.population(src.daily_bars(spark, sf), src.benchmark(spark, sf)).select("ticker", "date"), "ticker", "date")  # a ticker's last scored day is the last that is ranked
    both = _board(spark, sf, "ps", "age", riser=riser).select("ticker", F.col("ps").alias("l1"), F.col("age").alias("l2")).join(other, "ticker", "full")
    return _agreement(both, ("board, stock page", "ps", "l1", "r1", 0.0001), ("board, cross-section", "age", "l2", "r2", 0))


_ROT = "(SELECT bucket, m.n AS l1, member_count AS r1, m.c AS l2, candidates AS r2 FROM (SELECT sector AS bucket, count(*) AS n, sum(candidate) AS c FROM board WHERE date = (SELECT max(date) FROM board) GROUP BY sector) m FULL JOIN breadth USING (bucket))"


@query(BOARD + ", " + base.BREADTH + " " + _compared("board, rotation", _ROT, "members", "l1", "r1", 0) + " UNION ALL " + _compared("board, rotation", _ROT, "candidates", "l2", "r2", 0))
def k5_board_and_rotation(spark, sf):
    """K5: tickers and candidates of a sector that are on the board on its last date, and what the rotation table counts for it."""
    members = src.universe(spark, sf).select(F.col("sector").alias("bucket"), "ticker")
    counted = rotation.breadth(base._snapshot_rows(spark, sf), members).select("bucket", F.col("member_count").alias("r1"), F.col("candidates").alias("r2"))
    board = _board(spark, sf).select("ticker", "date", "sector", "candidate")
    last = F.broadcast(board.agg(F.max("date").alias("date")))  # one row
    own = board.join(last, "date").groupBy(F.col("sector").alias("bucket")).agg(F.count("*").alias("l1"), F.sum("candidate").alias("l2"))
    both = own.join(counted, "bucket", "full")
    return _agreement(both, ("board, rotation", "members", "l1", "r1", 0), ("board, rotation", "candidates", "l2", "r2", 0))


_RULES = {
    "scored": {f"{c}_range": f"NOT ({c} >= -1e-9 AND {c} <= 1 + 1e-9)" for c in ("c_rs", "c_high", "c_trend", "c_vol", "c_accel")},
    "streaks": {
        "net10_pct_range": "NOT (net10_pct >= -1e-9 AND net10_pct <= 100 + 1e-9)", "up10_range": "NOT (up10 >= -1e-9 AND up10 <= 1 + 1e-9)", "ddw10_range": "ddw10 > 1e-9",
        "candidate_without_gate": "candidate = 1 AND NOT (up10 >= 0.6 AND net10 > 0)", "streak_without_candidate": "(streak_days > 0) <> (candidate = 1)",
    },
    "valued": {
        "filed_ahead": "as_of_filed > date", "effective_ahead": "as_of_effective_eod > date", "filed_after_effective": "as_of_filed > as_of_effective_eod", "period_after_filed": "as_of_period_end > as_of_filed", "negative_pe": "pe < 0",
    },
    "bars": {"null_close": "close IS NULL", "no_volume": "volume <= 0 OR volume IS NULL", "high_below_low": "high < low"},
}


@query(" UNION ALL ".join(f"SELECT '{t}.{n}' AS \"check\", count(*) FILTER ({c}) = 0 AS ok, count(*) FILTER ({c}) AS detail FROM {t}" for t, rules in _RULES.items() for n, c in rules.items()))
def k1_rules(spark, sf):
    """K1: ranges of components and metrics, flags against gates, no look-ahead, order of days, signs; one pass over each table."""
    tables = {"scored": screen.composite(base._signals(spark, sf)), "streaks": base._risers(spark, sf), "valued": base._valued(spark, sf), "bars": src.daily_bars(spark, sf)}
    out = None
    for t, rules in _RULES.items():
        found = checks.checks(tables[t], **{n: F.expr(c) for n, c in rules.items()}).withColumn("check", F.concat(F.lit(f"{t}."), F.col("check")))
        out = found if out is None else out.unionByName(found)
    return out


# --- D5, R9: what stands behind the phase map's points, and the rotation's rows

_DETAIL = ("net5", "net10", "net20", "up10", "ddw10", "streak_days", "evs", "pe", "ev_ebitda", "freshness", "as_of_period_end", "as_of_effective_eod")
DETAIL = (
    ", pts AS (SELECT s.ticker, s.date, net10_pct, net5, net10, net20, up10, ddw10, CAST(streak_days AS BIGINT) AS streak_days, evs, pe, ev_ebitda, CASE WHEN date_diff('day', as_of_period_end, s.date) <= 95 THEN 'fresh' WHEN date_diff('day', as_of_period_end, s.date) <= 160 THEN 'stale' WHEN as_of_period_end IS NOT NULL THEN 'overdue' END AS freshness, "
    "as_of_period_end, as_of_effective_eod, round(ps, 2) AS ps FROM streaks s JOIN valued v ON v.ticker = s.ticker AND v.date = s.date WHERE round(ps, 2) > 0), ax AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place FROM (SELECT DISTINCT date FROM pts ORDER BY date DESC LIMIT 60)), "
    "detail AS (SELECT t.ticker, place, ax.date, pts.* EXCLUDE (ticker, date) FROM (SELECT ticker FROM pts WHERE date = (SELECT max(date) FROM pts)) t CROSS JOIN ax LEFT JOIN pts ON pts.ticker = t.ticker AND pts.date = ax.date)"
)


def _detail(spark, sf):
    v = base._valued(spark, sf).select("ticker", "date", "evs", "pe", "ev_ebitda", "as_of_period_end", "as_of_effective_eod", F.round("ps", 2).alias("ps")).where("ps > 0")
    points = base._risers(spark, sf).select("ticker", "date", "net10_pct", "net5", "net10", "net20", "up10", "ddw10", "streak_days").join(v, ["ticker", "date"])
    points = points.withColumn("freshness", valuation.freshness(F.datediff("date", "as_of_period_end")))
    return views.panel_grid(points, 60)


@query(DETAIL + " SELECT ticker, place, date, ps, net10_pct, " + ", ".join(f"round({c}, 4) AS {c}" if c in ("net5", "net10", "net20", "up10", "ddw10", "evs", "pe", "ev_ebitda") else c for c in _DETAIL) + " FROM detail")
def d5_phase_detail(spark, sf):
    """The twelve numbers behind every point of the phase map over 60 dates, unknown exactly where the point is."""
    return rounded(_detail(spark, sf).select("ticker", "place", "date", "ps", "net10_pct", *_DETAIL), 4)


@query(DETAIL + " SELECT coalesce(round(min(ps), 4), 0.1) AS low, coalesce(round(max(ps), 4), 100.0) AS high, count(ps) AS points, count(DISTINCT ticker) AS names FROM detail")
def d5_domain(spark, sf):
    """The span of the multiple over all points, and a fixed one where there are none."""
    d = _detail(spark, sf).agg(F.min("ps").alias("low"), F.max("ps").alias("high"), F.count("ps").alias("points"), F.count_distinct("ticker").alias("names"))
    return rounded(d.select(F.coalesce("low", F.lit(0.1)).alias("low"), F.coalesce("high", F.lit(100.0)).alias("high"), "points", "names"), 4)


@query(
    ", rr AS (SELECT * FROM (" + base.ORACLE_SQL["r2_relative_strength"] + ")), wa AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS place FROM (SELECT DISTINCT week FROM rr ORDER BY week DESC LIMIT 26)) SELECT b.bucket, place, wa.week, rr.rs_ratio FROM (SELECT DISTINCT bucket FROM rr) b CROSS JOIN wa LEFT JOIN rr ON rr.bucket = b.bucket AND rr.week = wa.week"
)
def r9_aligned_weeks(spark, sf):
    """Every sector's relative strength on the last 26 weeks that any has, unknown where it has none."""
    rs = rotation.relative_strength(src.sector_bars(spark, sf), src.benchmark(spark, sf)).select("bucket", "week", "rs_ratio")
    axis = rs.select("week").distinct().orderBy(F.desc("week")).limit(26)
    grid = asof.reindex(rs, "bucket", axis, "week")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("week")) - 1
    return rounded(grid.select("bucket", place.alias("place"), "week", "rs_ratio"), 5)


_LEAGUE = ("level", "slope_4w", "breadth_ma50", "breadth_ma200", "agg_evs", "rel_ret_1m", "rel_ret_3m", "rel_ret_6m")


@query(
    ", le AS (SELECT * FROM (" + base.ORACLE_SQL["r8_league_table"] + ")), md AS (SELECT max(date) AS as_of FROM listed), mb AS (SELECT sector AS bucket, string_agg(ticker, ',' ORDER BY place) AS members FROM (SELECT sector, l.ticker, row_number() OVER (PARTITION BY sector ORDER BY net10 DESC NULLS LAST, l.ticker) AS place FROM listed l JOIN universe u ON u.ticker = l.ticker WHERE l.date = (SELECT as_of FROM md)) WHERE place <= 6 GROUP BY sector) "
    "SELECT le.bucket, as_of, 'SPX' AS benchmark, 10 AS n_ema, 10 AS n_window, 10.0::DOUBLE AS k, state, " + ", ".join(_LEAGUE) + ", member_count, at_high, candidates, members FROM le LEFT JOIN mb USING (bucket), md"
)
def r9_rotation_rows(spark, sf):
    """The league's row of every sector with parameters, the last trading day as its date, and its six strongest members."""
    last = base._risers(spark, sf).select("ticker", "date", "net10")
    day = last.agg(F.max("date").alias("as_of"))  # one row
    now = last.join(F.broadcast(day), F.col("date") == F.col("as_of")).join(src.universe(spark, sf).select("ticker", F.col("sector").alias("bucket")), "ticker")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc_nulls_last("net10"), "ticker"))
    top = now.withColumn("place", place).where("place <= 6").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("place", "ticker"))).alias("s"))
    members = top.select("bucket", F.array_join(F.transform("s", lambda x: x.ticker), ",").alias("members"))
    league = base.r8_league_table(spark, sf).drop("week")
    rows = league.join(members, "bucket", "left").crossJoin(F.broadcast(day)).withColumn("benchmark", F.lit("SPX")).withColumn("n_ema", F.lit(10)).withColumn("n_window", F.lit(10)).withColumn("k", F.lit(10.0))
    return rounded(rows.select("bucket", "as_of", "benchmark", "n_ema", "n_window", "k", "state", *_LEAGUE, "member_count", "at_high", "candidates", "members"), 5)
