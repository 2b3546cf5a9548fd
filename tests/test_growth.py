"""Steps whose cost once grew faster than their input."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import themes


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().lower()


def test_capped_weights_of_a_large_group_by_running_sums(spark):
    r = random.Random(5)
    xs = [r.random() ** 6 + 1e-4 for _ in range(3000)]
    members = spark.createDataFrame([("g", f"T{i:05}", x) for i, x in enumerate(xs)], "theme string, ticker string, exposure double")
    out = themes.capped_weights(members, ["theme"], 0.001)
    assert "unboundedfollowing" not in plan(out).replace("unboundedpreceding$(), unboundedfollowing$()", "")
    left, cap = dict(enumerate(xs)), 0.001
    while True:
        rest = 1 - cap * (len(xs) - len(left))
        over = [i for i, x in left.items() if x / sum(left.values()) * rest > cap + 1e-12]
        if not over:
            break
        left = {i: x for i, x in left.items() if i not in over}
    total = sum(left.values())
    want = {f"T{i:05}": left[i] / total * rest if i in left else cap for i in range(len(xs))}
    assert {x.ticker: x.weight for x in out.collect()} == pytest.approx(want, abs=1e-10)


def test_best_splits_do_not_lay_windows_into_rows(spark):
    from panelwright.operators import changepoint

    r = random.Random(7)
    rows = [(t, i, 20.0 + 3 * r.random() + (0.2 * max(0, i - 400) if t == "a" else 0.0), r.randint(1, 50)) for t in "ab" for i in range(700)]
    bars = spark.createDataFrame(rows, "ticker string, i int, adj_close double, volume long").selectExpr("ticker", "date_add(date'2020-01-01', i) as date", "adj_close", "volume")
    whole = changepoint.breakouts(bars)
    assert "collect_list" not in plan(whole) and "min_by" not in plan(whole)  # once every window was an array, and every pair a row
    want = {(x.ticker, x.date): x for x in whole.collect()}
    by_blocks, changepoint.by_blocks = changepoint.by_blocks, lambda *a: changepoint_blocks(*a, block=90)
    changepoint_blocks = by_blocks
    try:
        got = {(x.ticker, x.date): x for x in changepoint.breakouts(bars).collect()}
    finally:
        changepoint.by_blocks = by_blocks
    assert got == want and sum(x.tau_date is not None for x in want.values()) > 1200


def test_falls_do_not_lay_windows_into_rows(spark):
    from panelwright.operators import drawdowns

    r = random.Random(9)
    bars = spark.createDataFrame([(t, i, 20.0 + 9 * r.random()) for t in "ab" for i in range(420)], "ticker string, i int, adj_close double").selectExpr("ticker", "date_add(date'2020-01-01', i) as date", "adj_close")
    market = bars.where("ticker = 'a' and day(date) <> 7").selectExpr("date", "adj_close * 2 + dayofmonth(date) as close")
    whole = drawdowns.decomposed(bars, market)
    assert "covar_samp" not in plan(whole) and "span" not in plan(whole) and plan(whole).count("explode") <= 1
    want = {(x.ticker, x.i): x for x in whole.collect()}
    by_blocks = drawdowns.by_blocks
    drawdowns.by_blocks = lambda *a: by_blocks(*a, block=100)
    try:
        got = {(x.ticker, x.i): x for x in drawdowns.decomposed(bars, market).collect()}
    finally:
        drawdowns.by_blocks = by_blocks
    assert got == want and sum(x.dd_idio is not None for x in want.values()) == 2 * (420 - 252)


def test_rolling_regression_of_windows_side_by_side(spark):
    import numpy as np

    from panelwright.operators import series

    r = random.Random(11)
    ys = [r.random() + (0.0 if i < 60 else 1.0) for i in range(150)] + [2.0] * 20
    rows = spark.createDataFrame([("a", i, y) for i, y in enumerate(ys)], "ticker string, i int, y double").selectExpr("ticker", "date_add(date'2020-01-01', i) as date", "y")
    out = series.rolling_regression(rows, 12)
    got = [(x.slope, x.r2) for x in out.orderBy("date").collect()]
    assert "regr" not in plan(out) and got[:11] == [(None, None)] * 11 and got[-1] == (0.0, 1.0)
    for i in range(11, 150):
        y = np.array(ys[i - 11 : i + 1])
        assert got[i] == pytest.approx((np.polyfit(np.arange(12), y, 1)[0], np.corrcoef(np.arange(12), y)[0, 1] ** 2), abs=1e-9)


def test_shared_ranks_sort_once(spark):
    from pyspark.sql import functions as F

    from panelwright.functions.windows import average_rank

    rows = spark.createDataFrame([("g", x) for x in (3.0, 1.0, 3.0, None, 2.0, 3.0)] + [("h", 5.0)], "g string, x double")
    out = rows.withColumn("r", average_rank(F.col("x"), "g"))
    assert plan(out).count("sort [") == 1
    assert sorted((x.g, x.x or 0.0, x.r) for x in out.collect() if x.x) == [("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", 3.0, 4.0), ("g", 3.0, 4.0), ("g", 3.0, 4.0), ("h", 5.0, 1.0)]
    assert [x.r for x in out.collect() if x.x is None] == [None]


def test_fold_metrics_window_over_different_scores_only(spark):
    from panelwright.operators import research

    rows = spark.sql("select 'g' as g, cast(id % 4 as double) / 4 as p, cast(id % 3 = 0 as int) as y from range(2000)")
    out = research.fold_metrics(rows, "g", "y", "p")
    assert plan(out).rindex("hashaggregate") > plan(out).rindex("window [")  # counted before it is put in order
    all_ = [(r.p, r.y) for r in rows.collect()]
    pos, neg = [p for p, y in all_ if y], [p for p, y in all_ if not y]
    r = out.first()
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    ap = sum(sum(q >= p for q in pos) / sum(q >= p for q, _ in all_) for p in pos) / len(pos)
    assert (r.n, r.auc, r.average_precision, r.brier) == pytest.approx((2000, auc, ap, sum((p - y) ** 2 for p, y in all_) / 2000))


def test_nearest_point_of_crowded_cells(spark, monkeypatch):
    from panelwright.operators import filters

    monkeypatch.setattr(filters, "LEAF", 3)
    r = random.Random(13)
    rows = [(f"K{i:03}", *r.choice([(r.random() * 3, r.random() * 3), (r.choice([0.5, 0.25, -2.0]), 1.0), (r.random() * 1e-3, 7.0), (r.uniform(-60, 60), r.uniform(-60, 60))])) for i in range(400)]
    rows += [("K000", 0.5, 1.0), ("n", None, 1.0), ("m", float("nan"), 1.0), (None, 0.3, 1.0)]
    points = spark.createDataFrame(rows, "k string, x double, y double")
    out = filters.nearest(points.where("k is null or k < 'K350' or k >= 'L'"), points, "k", ("x", "y"), 5.0)
    want = {}
    for k, x, y in rows:
        if k and k < "K350" and x is not None and x == x:
            near = [((a - x) * (a - x) + (b - y) * (b - y), j) for j, a, b in rows if j and j != k and a is not None and a == a]
            near = [p for p in near if p[0] <= 25.0]
            want[k] = min([*want.get(k, []), *near], default=None) and [min([*want.get(k, []), *near])]
    want = {k: v[0][1] for k, v in want.items() if v}
    assert {x.k: x.nearest for x in out.collect()} == want and len(want) > 250
    # once all points of a cell met all queries near it: 900 million pairs here
    crowd = spark.sql("select cast(id as int) as k, cast(id % 3 as double) as x, 0d as y from range(30000)")
    out = filters.nearest(crowd, crowd, "k", ("x", "y"), 5.0)
    assert plan(out).count("min(__k") > 1 and {(x.k % 3, x.nearest) for x in out.where("k > 2").collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {x.k: x.nearest for x in out.where("k < 3").collect()} == {0: 3, 1: 4, 2: 5}


def test_rates_draw_in_stretches_of_one_reading(spark, monkeypatch):
    import numpy as np

    from panelwright.operators import formation

    monkeypatch.setattr(formation, "STRETCH", 64)
    counts = spark.createDataFrame([("x", 150, 40), ("y", 0, 0), ("z", 9, 3)], "key string, n long, k long")
    out = formation.rate_interval(counts, draws=100, of=counts["key"] != "z")
    assert plan(out).count("existingrdd") == 1 and "join" not in plan(out)  # once read for the rates and again for their ends
    assert any("hashpartitioning(key" in x and "at#" in x for x in plan(out).splitlines())  # once all draws of a key were made in one task
    got = {r.key: (r.n, r.k, r.rate, r.low, r.high) for r in out.collect()}
    draws = [np.mean([((rep * 7919 + s * 104729 + 1299709) % 2147483647 * 48271 % 2147483647) % 150 < 40 for s in range(150)]) for rep in range(100)]
    assert got["x"] == pytest.approx((150, 40, 40 / 150, *np.percentile(draws, [5, 95])))
    assert got["y"] == (0, 0, None, None, None) and got["z"] == (9, 3, 3 / 9, None, None)


def test_baselines_in_one_pass(spark):
    from panelwright.operators import launches

    rows = [(t, i, 1.0 if i % 40 else 0.5, -0.5 if i > 100 else 0.0, 0.6 if i > 50 else 0.1, i % 40 == 39) for t in "ab" for i in range(400)]
    f = spark.createDataFrame(rows, "ticker string, i long, close double, min_dd_126 double, rvol126 double, reclaim boolean").withColumn("date", F.expr("date_add(date'2020-01-01', cast(i as int))"))
    out = launches.baselines(f, h=20, rise=0.9, washout=0.4, vol=0.4)
    assert plan(out).count("existingrdd") == 1 and "join" not in plan(out)
    assert {r.population: r.n for r in out.collect()} == {"all": 760, "volatile": 658, "volatile and washed out": 558, "signal": 4}


def test_turns_equal_breakouts_without_their_sorts(spark, monkeypatch):
    from panelwright.operators import changepoint

    r = random.Random(17)
    rows = [(t, i, 20.0 + 3 * r.random() + (0.2 * max(0, i - 400) if t == "a" else 0.0), float(i)) for t, size in (("a", 700), ("b", 620), ("c", 59)) for i in range(size)]
    bars = spark.createDataFrame(rows, "ticker string, i int, adj_close double, x double").selectExpr("ticker", "date_add(date'2020-01-01', i) as date", "adj_close", "x", "1L as volume")
    out = changepoint.turns(bars, "x")
    assert "join" not in plan(out) and plan(out).count("exchange") == 1  # breakouts deals its rows again to look up a day
    want = {(y.ticker, y.date): (y.drift, y.fit_gain) for y in changepoint.breakouts(bars).collect()}
    got = {(y.ticker, y.date): (y.drift, y.fit_gain) for y in out.collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 1200 and {y.x for y in out.collect()} == set(map(float, range(700)))
    monkeypatch.setattr(changepoint, "by_blocks", lambda *a, f=changepoint.by_blocks: f(*a, block=90))
    assert {(y.ticker, y.date): (y.drift, y.fit_gain) for y in changepoint.turns(bars).collect()} == want
    some = bars.where("dayofmonth(date) in (3, 17)").select("date").distinct()
    days = {y.date for y in some.collect()}
    assert {(y.ticker, y.date): (y.drift, y.fit_gain) for y in changepoint.turns(bars, dates=some).collect()} == {k: v for k, v in want.items() if k[1] in days}


def test_entry_study_counts_before_it_sorts(spark):
    from statistics import median

    from panelwright.operators import regimes

    r = random.Random(19)
    rows = [(f"t{k}", i, None if r.random() < 0.02 else 100 * r.random(), r.choice([r.gauss(0, 0.3), 50.0, 0.1, None, -2.0])) for k in range(20) for i in range(90)]
    df = spark.createDataFrame(rows, "ticker string, i int, s double, f double").selectExpr("ticker", "date_add(date'2020-01-01', i) as date", "s", "f")
    study = regimes.entry_study(regimes.segment_of(df, dates=df.select("date")), "s", {"top": 90.0, "higher": 95.0}, ["f"])
    assert "percentile" not in plan(study)  # once all values of a group met in one task
    got = {(x.segment, x.variant): (x.n, x.event_median, x.base_median, x.lift, x.event_over_10, x.base_over_10) for x in study.collect()}
    assert study._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1
    want = {}
    for seg, days in (("TRAIN", range(54)), ("TEST", range(54, 90))):
        of = {(t, i): (s, f) for t, i, s, f in rows}
        clip = lambda f: max(-0.95, min(10.0, f))
        base = [clip(f) for t, i, s, f in rows if i in days and f is not None]
        was, later = (lambda t, i: (of.get((t, i - 1)) or (None,))[0]), (lambda t, i: (of.get((t, i + 5)) or (None,))[0])
        for name, low, stays in (("top", 90, False), ("higher", 95, False), ("top, stays", 90, True)):
            xs = [clip(f) for t, i, s, f in rows if i in days and f is not None and s is not None and s >= low and was(t, i) is not None and was(t, i) < low and (not stays or (later(t, i) or 0) >= low)]
            if xs:
                want[seg, name] = (len(xs), median(xs), median(base), median(xs) - median(base), sum(x > 0.1 for x in xs) / len(xs), sum(x > 0.1 for x in base) / len(base))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) == 6


def test_bars_are_dealt_once(spark, tmp_path):
    from panelwright.functions.windows import lagged_return
    from panelwright.sources import adapters

    lines = spark.sql("select id % 7 as l_suppkey, date_add(date'1995-01-01', cast(id % 11 as int)) as l_shipdate, cast(id % 5 + 1 as double) as l_quantity, cast(id as double) + 0.25 as l_extendedprice from range(300)")
    lines.unionByName(spark.sql("select null as l_suppkey, date'1996-01-01' as l_shipdate, 1d as l_quantity, 2d as l_extendedprice")).write.parquet(str(tmp_path / "lineitem.parquet"))
    bars = adapters.daily_bars(spark, str(tmp_path))
    out = bars.select("ticker", "date", "close", lagged_return(F.col("close"), 1).alias("r"))
    assert plan(out).count("exchange") == 1  # once by ticker and date and again by ticker
    assert out.count() == 77 and {x.date for x in bars.select("date").collect()} == {x.date for x in adapters.bar_dates(spark, str(tmp_path)).collect()}


def test_pools_are_picked_in_one_reading(spark):
    from panelwright.operators import formation

    r = random.Random(23)
    rows = [(f"t{i:02}", d, r.gauss(0, 1), 0.5, -r.random(), r.gauss(0, 1) if i % 5 else None, r.gauss(0, 1)) for d in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "ticker string, d int, ret double, vol double, trough double, a double, b double").selectExpr("*", "date_add(date'2020-01-01', d) as date")
    out = formation.pool_comparison(df, F.col("b") > 0, "a", "b", least=5, least_top=2)
    assert "join" not in plan(out) and plan(out).count("existingrdd") == 1  # once read for the pool and again for all rows
    got = {x.date.day - 1: x for x in out.collect()}
    for d in range(3):
        of = [x for x in rows if x[1] == d]
        pool = [x for x in of if x[6] > 0]
        k = max(2, int(len(pool) * 0.1))
        best = sorted((x for x in pool if x[5] is not None), key=lambda x: -x[5])[:k]
        wide_a = {x[0] for x in sorted((x for x in of if x[5] is not None), key=lambda x: -x[5])[:3]}
        wide_b = {x[0] for x in sorted(of, key=lambda x: -x[6])[:4]}
        assert (got[d].n, got[d].n_all) == (len(pool), 30) and got[d].ret_a == pytest.approx(sum(x[2] for x in best) / k) and got[d].ret_pool == pytest.approx(sum(x[2] for x in pool) / len(pool))
        assert got[d].jaccard == pytest.approx(len(wide_a & wide_b) / len(wide_a | wide_b)) and got[d].by_chance == pytest.approx((12 / 30) / (7 - 12 / 30))


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Six suppliers with a line on most of 220 dates, one of which stops early and one of which is named twice."""
    at = tmp_path_factory.mktemp("star")
    r = random.Random(29)
    lines = [(k, i, float(r.randint(1, 9)), round(100 + 40 * r.random() + k * i / 20, 2), 0.01 * r.randint(0, 9)) for k in range(1, 7) for i in range(220) if r.random() < 0.95 and (k < 6 or i < 180)]
    rows = spark.createDataFrame(lines, "l_suppkey long, i int, l_quantity double, l_extendedprice double, l_discount double")
    tables = {
        "lineitem": rows.selectExpr("l_suppkey", "l_quantity", "l_extendedprice * l_quantity as l_extendedprice", "l_discount", "timestamp(date_add(date'1999-01-01', 3 * i)) as l_shipdate", "cast(i as long) as l_orderkey"),
        "orders": spark.sql("select id as o_orderkey, id % 3 as o_custkey from range(220)"), "customer": spark.sql("select id as c_custkey, concat('S', id) as c_mktsegment from range(3)"),
        "supplier": spark.sql("select explode(array(1, 2, 3, 4, 5, 5, 6)) as k").selectExpr("cast(k as long) as s_suppkey", "concat('s', k) as s_name", "0L as s_nationkey", "cast(k as double) as s_acctbal"),
        "nation": spark.sql("select 0L as n_nationkey, 'n' as n_name, 0L as n_regionkey"), "region": spark.sql("select 0L as r_regionkey, 'r' as r_name"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


def test_surfaces_read_what_they_compare(spark, star):
    from panelwright.plans import extended, surfaces
    from panelwright.plans import queries as base

    board = surfaces._board(spark, star).collect()
    assert sorted(x.ticker for x in board) == ["T1", "T2", "T3", "T4", "T5", "T5", "T6"]
    grid = {x.ticker: x for x in extended.d5_phase_map(spark, star).where("place = 19 and ps is not null").collect()}
    out = surfaces.k5_board_and_phase_map(spark, star)
    assert "o_orderkey" not in plan(out) and "c_mktsegment" not in plan(out)  # the themes have no part in it
    met = [x for x in board if x.ticker in grid and grid[x.ticker].date == x.date]
    n = len([x for x in met if x.ps is not None])
    assert [tuple(x) for x in out.collect()] == [("board, phase map", c, n, 0, 0) for c in ("net10_pct", "candidate", "ps")] and n >= 4

    out = surfaces.k5_board_and_valuation(spark, star)
    assert "o_orderkey" not in plan(out)
    tail = {x.ticker for x in base._valued(spark, star).where("ps is not null").collect()}
    known = [x for x in board if x.ps is not None and x.ticker in tail]
    got = {x.value: x for x in out.collect()}
    assert got["ps"].compared == len(known) == 6 and got["ps"].differ == got["age"].differ == 0 and got["age"].compared == 6 and got["ps"].on_one_side == 1  # T4 never files


def test_composite_alone_and_first_lit_deal_little(spark, star):
    from panelwright.operators import launches, screen
    from panelwright.plans import queries as base
    from panelwright.sources import adapters

    rows = base._signals(spark, star)
    want = {(x.ticker, x.date): x.composite for x in screen.composite(rows).collect()}
    alone = screen.composite_alone(rows)
    assert {(x.ticker, x.date): x.composite for x in alone.collect()} == want and len(want) > 300

    bars = adapters.daily_bars(spark, star)
    comp = alone.select("ticker", "date", F.col("composite").alias("c"))
    ranks = bars.select("ticker", "date", F.col("volume").cast("double").alias("v"))
    both = comp.unionByName(ranks, allowMissingColumns=True)
    found = launches.first_lit(launches.launch_dates(bars, fallback=0.5), both, bars, ["c", "v"], threshold=55.0)
    px = {(x.ticker, x.date): x.adj_close for x in bars.collect()}
    vol = {(x.ticker, x.date): x.v for x in ranks.collect()}
    for x in found.collect():
        for name, of in (("c", want), ("v", vol)):
            days = sorted(d for (t, d), s in of.items() if t == x.ticker and d >= x.t0 and s >= 55.0)
            assert x[f"{name}_lit"] == (days[0] if days else None) and x[f"{name}_runup"] == (pytest.approx(px[x.ticker, days[0]] / x.p0 - 1) if days else None)
    reads = alone._jdf.queryExecution().executedPlan().toString()
    shared = [line for line in reads.splitlines() if "ReusedExchange" in line and "l_extendedprice" in line]
    assert shared  # both readers of the bars take one exchange


def test_meet_is_a_full_join_that_moves_one_side(spark):
    from panelwright.operators import asof

    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, None), ("y", 1, 3.0)], "t string, d int, a double").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "t")
    b = spark.createDataFrame([("x", 2, True), ("z", 1, False)], "t string, d int, b boolean")
    out = asof.meet(a, b, "t", "d")
    assert plan(out).count("exchange") == 2  # one of each side
    assert sorted(map(tuple, out.collect())) == [("x", 1, 1.0, None), ("x", 2, None, True), ("y", 1, 3.0, None), ("z", 1, None, False)]


def test_trends_of_wanted_rows_equal_the_panel(spark):
    from panelwright.operators import changepoint, formation
    from panelwright.plans import extended

    r = random.Random(31)
    rows = [(t, i, {"c": 7.0, "n": None if i % 97 == 5 else 9.0 + r.random(), "z": 0.0 if i == 40 else 1.0 + r.random()}.get(t, 20.0 + r.random() + i / 50)) for t in ("a", "c", "n", "z") for i in range(260)]
    bars = spark.createDataFrame(rows, "ticker string, i int, close double").selectExpr("ticker", "date_add(date'2020-01-01', i) as date", "close", "close as adj_close")
    some = bars.where("datediff(date, date'2020-01-01') % 7 = 3").select("date").distinct()
    columns = ("slope_r2", "ker_63", "sharpe_63")
    out = changepoint.turns(bars, dates=some, also=(formation.trends, formation.trend_reads(), formation.TREND_SCHEMA))
    assert "regr" not in plan(out) and plan(out).count("exchange hashpartitioning") == 2  # a ticker's rows once, and the dates; windows were summed anew for every row
    want = {(x.ticker, x.date): [x[c] for c in columns] for x in extended.signals_of(bars).join(some, "date").collect()}
    got = {(x.ticker, x.date): [x[c] for c in columns] for x in out.collect()}
    assert got.keys() == want.keys() and sum(v[0] is not None for v in want.values()) > 90
    for k, v in want.items():
        assert [x is None for x in got[k]] == [x is None for x in v] and [x for x in got[k] if x is not None] == pytest.approx([x for x in v if x is not None], rel=1e-12, abs=1e-15)
