"""Registered queries of market regimes: term structure, feature panel, fold models, entry studies with a holdout."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.windows import forward, rolling
from panelwright.operators import changepoint, launches, regimes, research
from panelwright.plans.queries import query, rounded
from panelwright.plans.studies import BREAKOUTS, IGNITE, _roll, _share
from panelwright.sources import adapters as src

YEAR = 252**0.5


def _market_vol(spark, sf, k: int):
    by = regimes.dates()
    m = src.benchmark(spark, sf).withColumn("step", F.ln("close") - F.ln(F.lag("close").over(by)))
    return m.select("date", (rolling(F.stddev_samp, F.col("step"), k, by=by) * YEAR).alias("value"))


TERM = (
    f", m0 AS (SELECT date, close, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS step FROM spx), m1 AS (SELECT date, close, {_roll('stddev_samp', 'step', 21)} * sqrt(252) AS short, {_roll('stddev_samp', 'step', 63)} * sqrt(252) AS long FROM m0 WINDOW w AS (ORDER BY date)), "
    "m2 AS (SELECT *, short / long AS ratio, CASE WHEN short / long > 1 THEN 'backwardation' ELSE 'contango' END AS state FROM m1 WHERE short IS NOT NULL AND long IS NOT NULL), m3 AS (SELECT *, sum(CASE WHEN state IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (ORDER BY date) AS spell FROM (SELECT *, lag(state) OVER (ORDER BY date) AS prev FROM m2)), "
    "m4 AS (SELECT t.date, CASE WHEN count(*) >= 252 THEN count(*) FILTER (p.ratio <= t.ratio) / count(*) END AS pct FROM m2 t JOIN m2 p ON p.date <= t.date GROUP BY t.date), term AS (SELECT m3.*, row_number() OVER (PARTITION BY spell ORDER BY date) AS days, pct FROM m3 JOIN m4 USING (date))"
)


def _term(spark, sf):
    return regimes.term_structure(_market_vol(spark, sf, 21), _market_vol(spark, sf, 63))


@query(TERM + " SELECT date, round(short, 6) AS short, round(long, 6) AS long, round(ratio, 6) AS ratio, state, days, round(pct, 6) AS pct FROM term")
def q22_term_structure(spark, sf):
    """Q22: the market's volatility of 21 rows against that of 63: ratio, state, how long it has lasted, and its place in its own history."""
    return rounded(_term(spark, sf))


@query(
    TERM + ", r0 AS (SELECT ratio, lead(close, 21) OVER (ORDER BY date) / close - 1 AS f21, lead(close, 63) OVER (ORDER BY date) / close - 1 AS f63 FROM term JOIN (SELECT date AS d2 FROM spx) x ON x.d2 = term.date), "
    "r1 AS (SELECT *, CASE WHEN ratio > -1 AND ratio <= 0.9 THEN 'deep contango' WHEN ratio > 0.9 AND ratio <= 0.97 THEN 'contango' WHEN ratio > 0.97 AND ratio <= 1 THEN 'flat' WHEN ratio > 1 AND ratio <= 1.05 THEN 'backwardation' WHEN ratio > 1.05 AND ratio <= 9 THEN 'deep backwardation' END AS regime FROM r0 WHERE f21 IS NOT NULL) "
    "SELECT regime, count(*) AS n, round(pow(1 + avg(f21), 252.0 / 21) - 1, 4) AS fwd21, round(pow(1 + avg(f63), 252.0 / 63) - 1, 4) AS fwd63 FROM r1 WHERE regime IS NOT NULL GROUP BY regime HAVING count(*) >= 30"
)
def q22_returns_by_regime(spark, sf):
    """Q22: what followed the five states of the ratio."""
    rows = _term(spark, sf).join(src.benchmark(spark, sf), "date")
    return rounded(regimes.returns_by_regime(rows, "close", [21, 63], least=30), 4)


@query(TERM + ", l0 AS (SELECT ratio, close / lag(close, 21) OVER (ORDER BY date) - 1 AS before, lead(close, 21) OVER (ORDER BY date) / close - 1 AS after FROM term) SELECT count(*) AS n, round(corr(ratio, before), 6) AS with_past, round(corr(ratio, after), 6) AS with_future FROM l0 WHERE before IS NOT NULL AND after IS NOT NULL")
def q21_lead_lag(spark, sf):
    """Whether the ratio moves with the past or leads what comes."""
    return rounded(regimes.lead_lag(_term(spark, sf).join(src.benchmark(spark, sf), "date"), "ratio", "close", 21))


# --- Q25, Q30

SECTORS = {"africa": "AFRICA", "america": "AMERICA", "asia": "ASIA", "europe": "EUROPE", "middle_east": "MIDDLE EAST"}
PRICES = ["spx", "asia", "europe"]
RATIOS = {"asia_spx": ("asia", "spx"), "europe_asia": ("europe", "asia")}


def _panel(spark, sf):
    """The market and five sectors on the market's dates, and the mean order of odd days, filled from at most five dates back."""
    market, sectors, orders = src.benchmark(spark, sf), src.sector_bars(spark, sf), src.table(spark, sf, "orders")
    name = F.replace(F.lower("bucket"), F.lit(" "), F.lit("_"))
    prices = market.select(F.lit("spx").alias("name"), "date", F.col("close").alias("value")).unionByName(sectors.select(name.alias("name"), "date", F.col("close").alias("value")))
    day = F.to_date("o_orderdate")
    mean = orders.where(F.day("o_orderdate") % 2 == 1).groupBy(day.alias("date")).agg((src.exact_sum(F.col("o_totalprice")) / F.count("*")).alias("value")).withColumn("name", F.lit("orders"))
    return regimes.on_calendar(prices, market, ["spx", *SECTORS], 0).join(regimes.on_calendar(mean, market, ["orders"], 5), "date")


def _features(spark, sf):
    return regimes.features(_panel(spark, sf), PRICES, RATIOS, list(SECTORS), {"orders": [5, 20]})


def _z(x: str) -> str:
    return f"({x} - ({_roll('avg', x, 252, 63)})) / nullif({_roll('stddev_samp', x, 252, 63)}, 0)"


_FEATURES = {
    **{f"{p}_rv{k}": f"{_roll('stddev_samp', 'd_' + p, k)} * sqrt(252)" for p in PRICES for k in (5, 22, 63)}, **{f"{p}_ret{k}": f"{p} / lag({p}, {k}) OVER w - 1" for p in PRICES for k in (5, 20, 63)},
    **{f"{p}_dd": f"{p} / ({_roll('max', p, 252, 63)}) - 1" for p in PRICES}, **{f"{n}_chg{k}": f"q_{n} / lag(q_{n}, {k}) OVER w - 1" for n in RATIOS for k in (20, 63)}, **{f"{n}_z": _z(f"q_{n}") for n in RATIOS},
    "dispersion": "dispersion", "dispersion_z": _z("dispersion"), "orders": "orders", "orders_chg5": "orders - lag(orders, 5) OVER w", "orders_chg20": "orders - lag(orders, 20) OVER w",
}


@query(
    ", mac AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM orders WHERE day(o_orderdate) % 2 = 1 GROUP BY 1), sec AS (SELECT date, " + ", ".join(f"max(close) FILTER (bucket = '{b}') AS {n}" for n, b in SECTORS.items()) + " FROM sector_bars GROUP BY date), "
    "pan AS (SELECT s.date, s.close AS spx, " + ", ".join(SECTORS) + ", last_value(v IGNORE NULLS) OVER (ORDER BY s.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS orders FROM spx s LEFT JOIN sec USING (date) LEFT JOIN mac USING (date)), "
    "st AS (SELECT *, " + ", ".join(f"ln({p}) - ln(lag({p}) OVER (ORDER BY date)) AS d_{p}" for p in ("spx", *SECTORS)) + ", " + ", ".join(f"{a} / {b} AS q_{n}" for n, (a, b) in RATIOS.items()) + " FROM pan), "
    "di AS (SELECT *, list_aggregate(list_filter([" + ", ".join(f"d_{s}" for s in SECTORS) + "], lambda x: x IS NOT NULL), 'stddev_pop') AS dispersion FROM st), "
    "pc AS (SELECT t.date, CASE WHEN count(*) >= 252 THEN count(*) FILTER (p.orders <= t.orders) / count(*) END AS orders_pct FROM pan t JOIN pan p ON p.date <= t.date WHERE t.orders IS NOT NULL AND p.orders IS NOT NULL GROUP BY t.date) "
    "SELECT date, " + ", ".join(f"round({x}, 6) AS {c}" for c, x in _FEATURES.items()) + ", round(orders_pct, 6) AS orders_pct FROM di LEFT JOIN pc USING (date) WINDOW w AS (ORDER BY date)"
)
def q25_feature_panel(spark, sf):
    """Q25: volatilities, returns, falls, ratios, dispersion and a slower series, all on the market's dates and known on them."""
    return rounded(_features(spark, sf))


def _folds(spark, sf, h: int = 21, embargo: int = 5):
    """Features, the label (whether the market's next ``h`` rows are rougher than its last) and the fold of every date."""
    by = regimes.dates()
    m = src.benchmark(spark, sf).withColumn("step", F.ln("close") - F.ln(F.lag("close").over(by)))
    ahead, behind = forward(F.stddev_samp, F.col("step"), h, by), rolling(F.stddev_samp, F.col("step"), h, by=by)
    label = m.select("date", F.when(ahead.isNotNull() & behind.isNotNull(), (ahead > behind).cast("int")).alias("label"), ahead.alias("ahead"), F.abs("step").alias("day"), rolling(F.stddev_samp, F.col("step"), 5, by=by).alias("week"), rolling(F.stddev_samp, F.col("step"), 22, by=by).alias("month"))
    return research.walk_forward(_features(spark, sf).join(label, "date"), "date", folds=3, gap=h + embargo)


@query()
def q30_fold_models(spark, sf):
    """Q30, Q29: a logistic model, boosted trees and volatilities of a day, week and month by least squares, each fitted on a fold's train rows; area, precision and Brier score of its test rows."""
    rows = _folds(spark, sf).coalesce(4).persist()  # some thousands of rows that every fit passes over many times
    columns = [*_FEATURES, "orders_pct"]
    scores = {"logistic": regimes.fold_scores(rows, columns, regimes.logistic), "boosted": regimes.fold_scores(rows, columns, lambda c: regimes.boosted(c, rounds=4, depth=2)), "har": regimes.har_scores(rows, ["day", "week", "month"], "ahead")}
    out = None
    for name, scored in scores.items():
        m = research.fold_metrics(scored, "fold", "label", "score").select(F.lit(name).alias("model"), "fold", "n", "auc", "average_precision", F.when(F.lit(name != "har"), F.col("brier")).alias("brier"))
        out = m if out is None else out.unionByName(m)
    return rounded(out)


# --- Q3, Q4

_HORIZONS = {"fwd20": 20, "fwd60": 60}
_ENTRIES = {"top tenth": 90.0, "top twentieth": 95.0}


def _relative(spark, sf):
    """Bars with the returns ahead on a ticker's own rows, less the market's over the same days."""
    w = research.by_ticker()
    b = src.daily_bars(spark, sf).join(F.broadcast(src.benchmark(spark, sf).select("date", F.col("close").alias("m"))), "date", "left")  # one row a date
    b = b.withColumn("m", F.last("m", ignorenulls=True).over(w))
    ahead = lambda x, k: F.try_divide(F.lead(x, k).over(w), x) - 1
    return b.select("ticker", "date", "adj_close", "volume", *((ahead("adj_close", k) - ahead("m", k)).alias(n) for n, k in _HORIZONS.items()))


def _study(score: str, x: str) -> str:
    """SQL of ``entry_study`` over rows ``sc`` (ticker, date, x)."""
    seg = "sg AS (SELECT date, CASE WHEN row_number() OVER (ORDER BY date) - 1 < floor(count(*) OVER () * 0.6) THEN 'TRAIN' ELSE 'TEST' END AS segment FROM (SELECT DISTINCT date FROM sc))"
    rel = "rl0 AS (SELECT b.ticker, b.date, b.adj_close AS px, last_value(s.close IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date) AS m FROM bars b LEFT JOIN spx s ON s.date = b.date), rl AS (SELECT ticker, date, " + ", ".join(f"(lead(px, {k}) OVER w / px - 1) - (lead(m, {k}) OVER w / m - 1) AS {n}" for n, k in _HORIZONS.items()) + " FROM rl0 WINDOW w AS (PARTITION BY ticker ORDER BY date))"
    marks = f"mk AS (SELECT segment, {', '.join(_HORIZONS)}, x >= 90 AND lag(x) OVER w < 90 AS e1, x >= 95 AND lag(x) OVER w < 95 AS e2, x >= 90 AND lag(x) OVER w < 90 AND lead(x, 5) OVER w >= 90 AS e3 FROM sc JOIN sg USING (date) JOIN rl USING (ticker, date) WINDOW w AS (PARTITION BY ticker ORDER BY date))"
    long = "lo AS (" + " UNION ALL ".join(f"SELECT segment, '{n}' AS horizon, greatest(-0.95, least(10.0, {n})) AS x, e1, e2, e3 FROM mk WHERE {n} IS NOT NULL" for n in _HORIZONS) + ")"
    base = "ba AS (SELECT segment, horizon, median(x) AS base_median, avg((x > 0.10)::INT) AS base_over_10 FROM lo GROUP BY ALL)"
    events = "ev AS (" + " UNION ALL ".join(f"SELECT segment, horizon, x, '{v}' AS variant FROM lo WHERE {e}" for v, e in (("top tenth", "e1"), ("top twentieth", "e2"), ("top tenth, stays", "e3"))) + ")"
    return (
        f", sc AS (SELECT ticker, date, {x} AS x FROM {score}), {seg}, {rel}, {marks}, {long}, {base}, {events} SELECT segment, variant, horizon, count(*) AS n, round(median(x), 6) AS event_median, round(any_value(base_median), 6) AS base_median, round(median(x) - any_value(base_median), 6) AS lift, "
        "round(avg((x > 0.10)::INT), 6) AS event_over_10, round(any_value(base_over_10), 6) AS base_over_10 FROM ev JOIN ba USING (segment, horizon) GROUP BY segment, variant, horizon"
    )


@query(IGNITE + _study("ignite", "ignition_pct"))
def q3_entry_study(spark, sf):
    """Q3, Q4: what follows the day on which a ticker's ignition enters a date's top, against all days, before and after the split of dates."""
    rows = launches.ignition(_relative(spark, sf), src.benchmark(spark, sf), *_HORIZONS).select("ticker", "date", "ignition_pct", *_HORIZONS)
    return rounded(regimes.entry_study(regimes.segment_of(rows, dates=src.bar_dates(spark, sf)), "ignition_pct", _ENTRIES, list(_HORIZONS)))


@query(", brk AS (WITH " + BREAKOUTS[2:].replace("{columns}", "round(drift * fit_gain, 9) AS turn") + f"), bk AS (SELECT ticker, date, 100 * {_share('turn')} AS pct FROM brk)" + _study("bk", "pct"))
def q4_temporal_holdout(spark, sf):
    """Q4: the same for the change of slope, with its rank on each date."""
    turn = changepoint.turns(_relative(spark, sf), *_HORIZONS).select("ticker", "date", *_HORIZONS, F.round(F.col("drift") * F.col("fit_gain"), 9).alias("turn"))
    ranked = turn.select("ticker", "date", *_HORIZONS, (100 * research.average_rank(F.col("turn"), "date") / F.nullif(F.count("turn").over(research.Window.partitionBy("date")), F.lit(0))).alias("pct"))
    return rounded(regimes.entry_study(regimes.segment_of(ranked, dates=src.bar_dates(spark, sf)), "pct", _ENTRIES, list(_HORIZONS)))
