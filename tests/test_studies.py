"""Research operators against plain loops."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import changepoint, drawdowns, formation, launches

DAY = date(2020, 1, 1)


def walk(seed, n, quiet=0, start=50.0):
    r = random.Random(seed)
    out = [start]
    for i in range(n - 1):
        out.append(out[-1] * math.exp(r.gauss(0.02 if quiet and i > quiet else 0.0, 0.02)))
    return out


@pytest.fixture(scope="module")
def prices():
    return {"A": walk(1, 620), "B": walk(2, 420, quiet=330), "C": walk(3, 59), "D": walk(4, 60)}


@pytest.fixture(scope="module")
def bars(spark, prices):
    rows = [(t, DAY + timedelta(i), p, p, float(100 + (7 * i) % 23)) for t, x in prices.items() for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "ticker string, date date, adj_close double, close double, volume double").repartition(3).cache()


def error(y, a, b):
    x = np.arange(a, b)
    slope, level = np.polyfit(x - x.mean(), y[a:b], 1)
    return float(((y[a:b] - level - slope * (x - x.mean())) ** 2).sum()), float(slope)


def test_breakouts_equal_a_plain_scan(bars, prices):
    got = {(r.ticker, (r.date - DAY).days): r for r in changepoint.breakouts(bars).collect()}
    assert len(got) == sum(map(len, prices.values()))
    assert all(got["C", i].strength is None and got["C", i].tau_date is None for i in range(59))
    fired = 0
    for t, e in [("A", 55), ("A", 54), ("A", 300), ("A", 504), ("A", 619), ("B", 100), ("B", 380), ("B", 419), ("D", 59)]:
        p, r = np.array(prices[t]), got[t, e]
        y, n = np.log(p), len(p)
        ws = max(0, e - 503)
        low, high = max(ws + 40, e - 251), e - 15
        if e < 55 or low > high:
            assert r.tau_date is None
            continue
        tau = min(range(low, high + 1), key=lambda k: error(y, ws, k)[0] + error(y, k, e + 1)[0])
        (e1, s1), (e2, s2), (whole, _) = error(y, ws, tau), error(y, tau, e + 1), error(y, ws, e + 1)
        d = np.diff(y, prepend=y[0])
        sigma = d[ws + 1 : e + 1].std() + 1e-9
        volume = np.array([100 + (7 * i) % 23 for i in range(n)], float)
        assert r.tau_date == DAY + timedelta(tau)
        want = [s1 / sigma, s2 / sigma, (s2 - s1) / sigma, 1 - (e1 + e2) / whole, p[e] / p[ws:tau].max() - 1, np.abs(d[tau : tau + 20]).mean() / np.abs(d[ws + 1 : tau]).mean(), volume[tau : tau + 20].mean() / volume[ws:tau].mean()]
        assert np.allclose([r.base_slope, r.rise_slope, r.drift, r.fit_gain, r.clearance, r.range_ratio, r.volume_ratio], want, rtol=1e-6)
        ok = 0 < want[4] < 2.5 and want[2] > 0 and want[1] < 0.6 and np.median(p[ws:tau]) > 3 and abs(want[0]) < 0.08
        assert math.isclose(r.strength, want[3] * want[2] * math.exp(-1.5 * abs(want[0])) if ok else 0.0, rel_tol=1e-6)
        fired += ok
    assert fired


def test_span_join_meets_each_pair_once(spark):
    ends = spark.createDataFrame([("a", 3, 1, 9), ("a", 20, 5, 5), ("b", 0, 0, 3)], "ticker string, i int, low long, high long")
    points = spark.createDataFrame([(t, k) for t in "ab" for k in range(12)], "ticker string, point long")
    got = sorted((r.ticker, r.i, r.point) for r in changepoint.span_join(ends, points, "low", "high", block=4).collect())
    assert got == sorted([("a", 3, k) for k in range(1, 10)] + [("a", 20, 5)] + [("b", 0, k) for k in range(4)])


@pytest.fixture(scope="module")
def parts(spark, bars):
    r = random.Random(9)
    market = spark.createDataFrame([(DAY + timedelta(i), 100 * math.exp(r.gauss(0, 0.01) + 0.001 * i)) for i in range(620) if i != 300], "date date, close double")
    return market, drawdowns.decomposed(bars, market).cache()


def test_falls_equal_a_plain_fold(parts, prices):
    market, found = parts
    m = {r.date: r.close for r in market.collect()}
    got = {(r.ticker, r.i): r for r in found.collect()}
    p = np.array(prices["A"])
    r = np.diff(np.log(p), prepend=np.log(p[0]))
    x = np.array([m.get(DAY + timedelta(i), np.nan) for i in range(len(p))])
    q = np.append(0.0, np.log(x[1:] / x[:-1]))
    last = None
    for t in range(252, 620, 5):
        a, b = r[t - 251 : t + 1], q[t - 251 : t + 1]
        known = ~np.isnan(b)
        beta = np.cov(a[known], b[known])[0, 1] / np.var(b[known], ddof=1)
        market_path, own = np.cumsum(np.where(known, beta * b, 0)), np.cumsum(np.where(known, a - beta * b, 0))
        last = [beta, np.expm1(market_path[-1] - market_path.max()), np.expm1(own[-1] - own.max())]
        for i in range(t, min(t + 5, 620)):
            row = got["A", i]
            assert np.allclose([row.beta, row.dd_beta, row.dd_idio], last, rtol=1e-8, atol=1e-12)
    assert got["A", 251].beta is None and math.isclose(got["A", 400].dd_total, p[400] / p[149:401].max() - 1)
    assert np.isclose(got["A", 400].rvol, r[275:401].std(ddof=1) * math.sqrt(252))


def test_cells_and_lift(spark):
    r = random.Random(3)
    rows = [(2000 + r.randrange(4), r.choice(["x", "y"]), r.random(), -r.random() if r.random() > 0.05 else None, r.random()) for _ in range(3000)]
    days = spark.createDataFrame(rows, "year int, sector string, vol_rank double, dd_total double, drawup double").withColumn("rvol", F.col("vol_rank"))
    cells = {}
    for y, s, v, d, up in rows:
        c = cells.setdefault((y, s, min(int(v * 3), 2)), [0, 0, 0, 0])
        deep = d is not None and d <= -0.3
        c[0 if deep else 2] += 1
        c[1 if deep else 3] += up >= 0.7
    want = {k: c for k, c in cells.items() if c[0] >= 40 and c[2] >= 40}
    found = drawdowns.cells(days, "dd_total", 0.7, 3, least=40)
    assert {(c.year, c.sector, c.bin): [c.n1, c.k1, c.n0, c.k0] for c in found.collect()} == want and 0 < len(want) < len(cells)

    def lift(some):
        used = [c for c in some if c[3]]
        return sum(c[0] * (c[1] / c[0]) / (c[3] / c[2]) for c in used) / sum(c[0] for c in used)

    years = sorted({k[0] for k in want})
    boots = []
    for rep in range(200):
        picks = [years[(((rep * 7919 + k * 104729 + 1299709) % 2147483647) * 48271 % 2147483647) % len(years)] for k in range(len(years))]
        boots.append(lift([c for y in picks for k, c in want.items() if k[0] == y]))
    row = drawdowns.year_interval(found, draws=200).first()
    assert np.allclose([row.lift, row.low, row.high], [lift(want.values()), *np.percentile(boots, [5, 95])]) and row.n_cells == len(want)
    whole = drawdowns.lift(drawdowns.cells(days, "dd_total", 0.7, 3, by_date=False)).first()
    assert whole.n_cells == 6 and whole.n_deep == sum(1 for x in rows if x[3] is not None and x[3] <= -0.3)
    assert drawdowns.lift(found.where("false")).first().n_cells == 0


def test_series_intervals_equal_plain_draws(spark):
    r = random.Random(5)
    series = {"long": [r.random() for _ in range(23)], "short": [1.0, 2.0, 4.0], "block": [float(i) for i in range(6)]}
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)]
    got = {x.key: x for x in formation.series_intervals(spark.createDataFrame(rows, "key string, t int, v double"), "key", ["t"], "v", block=6, draws=150).collect()}
    means = []
    for rep in range(150):
        take = []
        for s in range(4):
            start = (((rep * 7919 + s * 104729 + 1299709) % 2147483647) * 48271 % 2147483647) % 18
            take += series["long"][start : start + 6]
        means.append(np.mean(take[:23]))
    assert np.allclose([got["long"].mean, got["long"].low, got["long"].high], [np.mean(series["long"]), *np.percentile(means, [5, 95])])
    assert got["short"].low is None and got["block"].low == got["block"].high == 2.5


def test_pool_picks(spark):
    r = random.Random(6)
    rows = [(f"t{i:02}", DAY + timedelta(d), r.gauss(0, 1), 0.2 + r.random(), -r.random(), float(r.randrange(6)), r.gauss(0, 1)) for d in range(3) for i in range(30 if d else 4)]
    df = spark.createDataFrame(rows, "ticker string, date date, ret double, vol double, trough double, a double, b double")
    got = {x.date: x for x in formation.pool_comparison(df, F.col("b") > 0, "a", "b", least=5, least_top=2).collect()}
    assert DAY not in got and len(got) == 2
    for d, x in got.items():
        pool = [w for w in rows if w[1] == d and w[6] > 0]
        k = max(2, int(len(pool) * 0.1))
        by_a, by_b = (sorted(pool, key=lambda w, c=c: (-w[c], w[0]))[:k] for c in (5, 6))
        assert x.n == len(pool) and x.n_all == 30 and math.isclose(x.ret_a, np.mean([w[2] for w in by_a])) and math.isclose(x.trough_b, np.mean([w[4] for w in by_b]))
        assert math.isclose(x.gap_ret, np.mean([w[2] for w in by_a]) - np.mean([w[2] for w in by_b]))


def test_launch_and_first_lit(spark):
    px = [10.0] * 30 + [9.0, 11.0, 11.5] + [13.0] * 10 + [40.0] * 5
    bars = spark.createDataFrame([("a", DAY + timedelta(i), p) for i, p in enumerate(px)] + [("b", DAY, 1.0), ("b", DAY + timedelta(1), 10.0)], "ticker string, date date, adj_close double")
    t0 = launches.launch_dates(bars)
    assert {r.ticker: (r.t0, r.p0) for r in t0.collect()} == {"a": (DAY + timedelta(31), 11.0), "b": (DAY + timedelta(1), 10.0)}
    scores = spark.createDataFrame([("a", DAY + timedelta(i), 95.0 if i in (3, 40) else 10.0) for i in range(45)], "ticker string, date date, s double")
    got = {r.ticker: tuple(r)[3:] for r in launches.first_lit(t0, scores, bars, ["s"]).collect()}
    assert got["b"] == (None, None, None) and got["a"][:2] == (DAY + timedelta(40), 1) and math.isclose(got["a"][2], 13 / 11 - 1)


def test_biggest_run_and_first_listed(spark):
    px = [5.0, 1.0, 2.0, 3.0, 2.0, 9.0, 9.0, 0.5]
    bars = spark.createDataFrame([("a", DAY + timedelta(i), p) for i, p in enumerate(px)], "ticker string, date date, adj_close double")
    runs = launches.biggest_runs(bars)
    assert tuple(runs.first()) == ("a", DAY + timedelta(1), DAY + timedelta(5), 1, 5, 8.0)
    assert launches.biggest_runs(bars, rows_before=3).first().trough == DAY + timedelta(4)
    ranks = spark.createDataFrame([("net", "a", DAY + timedelta(3), 2.0), ("net", "a", DAY + timedelta(0), 1.0), ("loose", "a", DAY + timedelta(2), 9.0)], "variant string, ticker string, date date, place double")
    got = {r.variant: (r.listed, r.day, r.gained) for r in launches.first_listed(runs, ranks, bars, top_n=3).collect()}
    assert got["net"] == (DAY + timedelta(3), 2, 2.0) and got["loose"] == (None, None, None) and len(got) == 5


def test_nested_baselines_and_rates(spark):
    rows = [("a", i, 1.0 if i % 40 else 0.5, -0.5 if i > 100 else 0.0, 0.6 if i > 50 else 0.1, i % 40 == 39) for i in range(400)]
    f = spark.createDataFrame(rows, "ticker string, i long, close double, min_dd_126 double, rvol126 double, reclaim boolean").withColumn("date", F.expr("date_add(date'2020-01-01', cast(i as int))"))
    got = {r.population: (r.n, r.k) for r in launches.baselines(f, h=20, rise=0.9, washout=0.4, vol=0.4).collect()}
    up = [i for i in range(380) if rows[i][2] == 0.5]
    assert got["all"] == (380, len(up)) and got["volatile"] == (329, sum(i > 50 for i in up)) and got["volatile and washed out"] == (279, sum(i > 100 for i in up))
    assert got["signal"] == (2, 0)  # at 119 and, 126 rows on or later, 279
    rate = formation.rate_interval(spark.createDataFrame([("x", 10, 5), ("y", 0, 0)], "key string, n long, k long"), draws=100)
    x = {r.key: r for r in rate.collect()}
    draws = [np.mean([((rep * 7919 + s * 104729 + 1299709) % 2147483647 * 48271 % 2147483647) % 10 < 5 for s in range(10)]) for rep in range(100)]
    assert x["y"].rate is None and x["x"].rate == 0.5 and np.allclose([x["x"].low, x["x"].high], np.percentile(draws, [5, 95]))
