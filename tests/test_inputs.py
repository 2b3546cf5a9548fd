"""Listings, identifiers, theme definitions, the synthetic panel, evidence text, changed schemas."""

import json
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators import tables, text
from panelwright.sources import listing, synthetic


def test_listing(spark):
    rows = [
        {"symbol": " aa ", "name": "One", "sector": " ", "country": "X", "marketCap": "$1,000.50"}, {"symbol": "AA", "name": "Larger", "sector": "S", "country": "", "marketCap": "2000"},
        {"symbol": "B^C", "name": "class"}, {"symbol": "B/C", "name": "class"}, {"symbol": "", "name": "nothing"}, {"name": "no symbol"}, {"symbol": "D", "name": None, "marketCap": "0.00"}, {"symbol": "e", "marketCap": "n/a"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("no json",), (None,)], "json string")
    got = {r.ticker: tuple(r)[1:] for r in listing.listed(df, "json").collect()}
    assert got == {"AA": ("Larger", "S", None, 2000.0), "D": (None, None, None, None), "E": (None, None, None, None)}


def test_identifiers_and_definitions(spark):
    ids = spark.createDataFrame([("aa", 320193), (" bb ", 7), ("bb", 7)], "ticker string, id long")
    got = {r.ticker: r.identifier for r in listing.with_identifiers(spark.createDataFrame([("AA",), ("BB",), ("CC",)], "ticker string"), ids).collect()}
    assert got == {"AA": "0000320193", "BB": "0000000007", "CC": None}
    d = {r.theme: (r.cap, r.header, r.keywords) for r in listing.theme_definitions(spark, {"x": {"cap": 0.1, "keywords": ["k"]}, "y": {"header": "Why"}}).collect()}
    assert d == {"x": (0.1, "x", ["k"]), "y": (0.3, "Why", [])}


def test_weekdays(spark):
    for end in (date(2026, 6, 5), date(2026, 6, 7), date(2026, 6, 8)):
        got = sorted(r.date for r in synthetic.weekdays(spark.createDataFrame([(end,)], "end date"), 11).collect())
        want = [d for d in (end - timedelta(k) for k in range(30)) if d.weekday() < 5][:11]
        assert got == sorted(want)


def test_synthetic_panel_does_not_depend_on_partitions(spark):
    calendar = synthetic.weekdays(spark.createDataFrame([(date(2026, 6, 5),)], "end date"), 320).cache()
    tickers = spark.createDataFrame([(f"T{i}", i) for i in range(30)], "ticker string, place int")
    one, two = (sorted(tuple(r) for r in synthetic.bars(t, calendar).collect()) for t in (tickers.coalesce(1), tickers.repartition(7, F.rand(3))))
    assert one == two and len(one) == 30 * 320 and one != sorted(tuple(r) for r in synthetic.bars(tickers, calendar, seed=1).collect())
    assert all(low <= min(o, c) and high >= max(o, c) and low > 0 and v > 0 for _, _, o, high, low, c, _, v in one)
    b = synthetic.bars(tickers, calendar)
    closes = np.array([r.close for r in b.where("ticker = 'T9'").orderBy("date").collect()])
    steps = np.diff(np.log(closes))
    assert 0.15 < steps.std() * np.sqrt(252) < 0.75 and abs(np.corrcoef(steps[1:], steps[:-1])[0, 1]) < 0.2
    last = b.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    f = {}
    for r in synthetic.filings(tickers, last).collect():
        f.setdefault(r.ticker, []).append(r)
    end = date(2026, 6, 5)
    age = {t: (end - max(r.period_end for r in x)).days for t, x in f.items()}
    assert "T4" not in f and len(f) == 29 and all(len(x) == 8 for x in f.values())
    assert age["T2"] == 130 and age["T3"] == 230 and age["T0"] == age["T20"] == 50
    assert all(r.eps_ttm < 0 for r in f["T0"] + f["T1"]) and all(r.ebitda_ttm < 0 for r in f["T1"]) and all(r.eps_ttm > 0 and r.ebitda_ttm > 0 for r in f["T7"])
    assert all(r.period_end <= r.filed_date <= end for x in f.values() for r in x)


def test_evidence(spark):
    long = "a" * 50 + "Item 1" + "b" * 20_000 + "segment" + "c" * 30_000
    df = spark.createDataFrame([(1, long), (2, "short segment here"), (3, None), (4, "")], "k int, t string")
    got = {r.k: r.evidence for r in text.evidence(df, "k", "t", "Item 1", "segment").collect()}
    at = long.index("segment")
    assert got[1] == long[50:14050] + f"\n\n--- (offset {at - 500}) ---\n" + long[at - 500 : at + 3000]
    assert got[2] == "short segment here\n\n--- (offset 0) ---\nshort segment here" and got[4] == "" and 3 not in got
    assert len(text.evidence(df, "k", "t", "Item 1", "segment", most=14_010).where("k = 1").first().evidence) == 14_010


def test_evolved(spark):
    old = spark.createDataFrame([(1, "x", 2.0)], "b int, gone string, a double")
    new = spark.createDataFrame([(5.0, 4, "n")], "a double, b int, extra string")
    out = tables.evolved(old, new, ["a", "b", "extra"])
    assert out.columns == ["a", "b", "extra"] and sorted(tuple(r) for r in out.collect()) == [(2.0, 1, None), (5.0, 4, "n")]
