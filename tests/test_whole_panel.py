"""Queries that once left out part of the panel."""

from panelwright.operators import screen
from panelwright.plans import queries
from panelwright.sources import adapters as src

SF = "/root/testdata/sf0.001"


def test_percentiles_of_every_date(spark):
    bars = screen.riser_metrics(src.daily_bars(spark, SF)).select("date", "ticker", "net20").collect()
    by_date = {}
    for b in bars:
        by_date.setdefault(b.date, []).append(b.net20)
    out = {(r.date, r.ticker): r for r in queries.QUERIES["w9_percentile_family"](spark, SF).collect()}
    assert len(out) == len(bars) and min(d for d, _ in out).year == 1995
    for b in bars:
        values, r = by_date[b.date], out[b.date, b.ticker]
        known = [v for v in values if v is not None]
        if b.net20 is None:
            assert r.rank_share is None and r.position_pct is None
            continue
        below, ties = sum(v < b.net20 for v in known), sum(v == b.net20 for v in known)
        assert abs(r.sql_rank - (below / (len(values) - 1) if len(values) > 1 else 0)) < 1e-8
        assert abs(r.rank_share - (below + 1 + (ties - 1) / 2) / len(known)) < 1e-8


def test_points_between_snapshots(spark):
    from panelwright.operators import views

    grid = spark.createDataFrame([("a", 0, 1.0, 10.0, 1), ("a", 1, 100.0, 20.0, 0), ("a", 2, None, None, None), ("a", 3, None, None, None)], "ticker string, place int, ps double, pct double, state int")
    got = {(r.place, r.phase): (round(r.ps, 6), r.pct, r.state, r.fade) for r in views.between_snapshots(grid, "ps", "pct", "state", [0.25, 0.5]).collect()}
    assert got == {(0, 0.25): (round(10**0.5, 6), 12.5, 1, 1.0), (0, 0.5): (10.0, 15.0, 0, 1.0), (1, 0.25): (100.0, 20.0, 0, 0.75), (1, 0.5): (100.0, 20.0, 0, 0.5)}


def test_paths_around_events(spark):
    from panelwright.operators import research

    bars = spark.sql("select 'a' as ticker, date_add(date'2020-01-01', cast(id as int)) as date, cast(id + 1 as double) as close from range(6)")
    events = spark.createDataFrame([("a", 1), ("a", 5)], "ticker string, place int")
    got = {(r.launch, r.step): r.path for r in research.normalised_paths(bars, events, 2, 2).collect()}
    assert got == {(1, -1): 0.5, (1, 0): 1.0, (1, 1): 1.5, (1, 2): 2.0, (5, -2): 4 / 6, (5, -1): 5 / 6, (5, 0): 1.0}
