"""Nested facts, washouts, regimes and fold models against plain loops."""

import json
import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import regimes, research, series, washouts
from panelwright.sources import facts

DAY = date(2020, 1, 1)


def test_document_facts(spark):
    def fact(start, end, val, filed):
        return {"start": start, "end": end, "val": val, "filed": filed} if start else {"end": end, "val": val, "filed": filed}

    body = {"facts": {"us-gaap": {
        "SalesRevenueNet": {"units": {"USD": [fact("2020-01-01", "2020-03-31", 5.0, "2020-05-01"), fact("2019-10-01", "2019-12-31", 4.0, "2020-02-01")]}},
        "Revenues": {"units": {"USD": [fact("2020-01-01", "2020-03-31", 6.0, "2020-05-01"), fact("2020-01-01", "2020-03-31", 9.0, "2020-04-30"), fact("2020-04-01", "2020-06-30", 7.0, None)], "EUR": [fact("2020-01-01", "2020-03-31", 1.0, "2020-01-01")]}},
        "CommonStockSharesOutstanding": {"units": {"shares": [fact(None, "2020-03-31", 100.0, "2020-05-01")]}},
        "NobodyAsksFor": {"units": {"USD": [fact("2020-01-01", "2020-03-31", 1.0, "2020-01-01")]}},
    }}}
    rows = spark.createDataFrame([("a", json.dumps(body)), ("b", "no json"), ("c", None), ("d", '{"facts": {}}')], "entity string, document string")
    flat = facts.document_facts(rows).collect()
    assert {r.entity for r in flat} == {"a"} and len(flat) == 6
    got = {(r.metric, str(r.start), str(r.end)): (r.val, str(r.filed)) for r in facts.first_reported(facts.document_facts(rows)).collect()}
    assert got == {("revenue", "2020-01-01", "2020-03-31"): (9.0, "2020-04-30"), ("revenue", "2019-10-01", "2019-12-31"): (4.0, "2020-02-01"), ("shares", "None", "2020-03-31"): (100.0, "2020-05-01")}
    same = facts.first_reported(facts.document_facts(rows).where("filed = date'2020-05-01' and metric = 'revenue'")).first()
    assert same.val == 6.0  # of one day's, the preferred name's


def test_split_events_and_valid_filings(spark):
    rows = spark.createDataFrame([(x,) for x in (2.0, 1.0, 0.0, -2.0, None, 0.5)], "ratio double")
    assert sorted(r.ratio for r in facts.split_events(rows).collect()) == [0.5, 2.0]
    f = spark.createDataFrame([(1, DAY, DAY, 5.0, None), (2, DAY, None, 5.0, 1.0), (3, DAY, DAY - timedelta(1), 5.0, 1.0), (4, DAY, DAY + timedelta(9), None, 1.0)], "k int, period_end date, filed_date date, debt_long double, debt_current double")
    assert {r.k: r.total_debt for r in facts.valid_filings(f).collect()} == {1: 5.0, 4: None}


def test_washout_events_equal_a_plain_scan(spark):
    r = random.Random(4)
    px = [100.0]
    for _ in range(899):
        px.append(px[-1] * math.exp(r.gauss(0, 0.05)))
    bars = spark.createDataFrame([("a", DAY + timedelta(i), p) for i, p in enumerate(px)] + [("b", DAY + timedelta(i), p) for i, p in enumerate(px[:270])], "ticker string, date date, close double")
    got = washouts.washout_events(bars, fall=0.3, h=20, embargo=4)
    p = pd.Series(px)
    dd, ma = p / p.rolling(252, min_periods=200).max() - 1, p.rolling(50).mean()
    low, fwd = dd.rolling(63, min_periods=20).min(), p.shift(-20) / p - 1
    want, last = [], -1000
    for i in range(252, 880):
        if low[i] <= -0.3 and p[i] > ma[i] and p[i - 1] <= ma[i - 1] and i - last >= 24:
            want.append(i)
            last = i
    rows = sorted(got.collect(), key=lambda x: x.i)
    assert [x.i for x in rows] == want and {x.ticker for x in rows} == {"a"} and len(want) > 3
    for x in rows:
        assert np.allclose([x.fwd, x.fwd_trough, x.base, x.dd], [fwd[x.i], p[x.i : x.i + 21].min() / p[x.i] - 1, fwd.mean(), dd[x.i]])
    whole = washouts.event_summary(got).where("decade is null").first()
    assert whole.n == len(want) and math.isclose(whole.lift_mean, np.mean([fwd[i] for i in want]) - fwd.mean())
    assert washouts.event_summary(got.where("false")).count() == 0


def test_funnel_stages(spark):
    rows = [("old", 300, DAY - timedelta(30), 9e9, -0.9, 1.0, True, False), ("thin", 300, DAY, 1.0, -0.9, 1.0, True, False), ("high", 300, DAY, 9e9, -0.1, 1.0, True, False), ("calm", 300, DAY, 9e9, -0.9, None, True, False), ("down", 300, DAY, 9e9, -0.9, 1.0, False, False), ("yes", 300, DAY, 9e9, -0.9, 1.0, False, True)]
    df = spark.createDataFrame(rows, "ticker string, n long, date date, money double, dd252 double, rvol126 double, above50 boolean, reclaim_20d boolean")
    out = washouts.funnel(df, df.agg(F.max("date").alias("newest")), money=1e6, fall=0.4, vol=0.4)
    assert {r.ticker: r.stage for r in out.collect()} == {"old": 0, "thin": 1, "high": 2, "calm": 3, "down": 4, "yes": 5}
    assert [(r.stage, r.names) for r in washouts.stage_counts(out).orderBy("stage").collect()] == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]
    assert [r.names for r in washouts.stage_counts(out.where("false")).collect()] == [0] * 5


def test_recursions_equal_pandas(spark):
    r = random.Random(8)
    px = {t: [round(50 + r.gauss(0, 3), 3) for _ in range(n)] for t, n in (("a", 90), ("b", 1), ("c", 2))} | {"flat": [5.0] * 20}
    bars = spark.createDataFrame([(t, DAY + timedelta(i), p) for t, x in px.items() for i, p in enumerate(x)], "ticker string, date date, adj_close double").repartition(3)
    got = {(x.ticker, (x.date - DAY).days): x for x in series.ewmac(bars).collect()}
    s = pd.Series(px["a"])
    want = (s.ewm(span=16, adjust=False).mean() - s.ewm(span=64, adjust=False).mean()) / s.diff().ewm(span=64, adjust=False).std()
    assert np.allclose([got["a", i].ewmac_fast for i in range(2, 90)], want[2:]) and got["a", 0].ewmac_fast is None and got["a", 1].ewmac_fast is None
    assert got["b", 0].ewmac_slow is None and all(got["flat", i].ewmac_fast is None for i in range(20))
    share = {(x.ticker, (x.date - DAY).days): x.share for x in series.expanding_share_at_most(bars, "ticker", "date", "adj_close", 10).collect()}
    assert share["a", 8] is None and all(math.isclose(share["a", i], np.mean([v <= px["a"][i] for v in px["a"][: i + 1]])) for i in range(9, 90)) and share["flat", 15] == 1.0


def test_term_structure(spark):
    short, long = [1.0, 1.2, 1.3, 0.8, 0.8, 1.5], [1.0, 1.0, 1.0, 1.0, None, 1.0]
    make = lambda x: spark.createDataFrame([(DAY + timedelta(i), v) for i, v in enumerate(x)], "date date, value double")
    got = regimes.term_structure(make(short), make(long), least=2).orderBy("date").collect()
    assert [(r.state[0], r.days) for r in got] == [("c", 1), ("b", 1), ("b", 2), ("c", 1), ("b", 1)]
    assert [r.pct for r in got] == [None, 1.0, 1.0, 0.25, 1.0]


def test_calendar_fills_only_what_is_fresh(spark):
    cal = spark.createDataFrame([(DAY + timedelta(i),) for i in range(8)], "date date")
    s = spark.createDataFrame([("x", DAY, 1.0), ("x", DAY + timedelta(5), 2.0), ("y", DAY + timedelta(2), 3.0), ("z", DAY, 9.0)], "name string, date date, value double")
    got = [tuple(r)[1:] for r in regimes.on_calendar(s, cal, ["x", "y"], 2).orderBy("date").collect()]
    assert got == [(1, None), (1, None), (1, 3), (None, 3), (None, 3), (2, None), (2, None), (2, None)]


@pytest.fixture(scope="module")
def folded(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        y = r.randrange(2)
        rows.append((DAY + timedelta(i), y if i % 50 else None, r.gauss(2.0 * y, 1) if i % 7 else None, r.gauss(0, 1) + (1000 if i > 350 else 0), abs(r.gauss(y, 1))))
    df = spark.createDataFrame(rows, "date date, label int, a double, b double, ahead double")
    return research.walk_forward(df, "date", folds=3, gap=10).cache()


def test_fold_models_learn_from_train_rows_alone(spark, folded):
    scores = regimes.fold_scores(folded, ["a", "b"], regimes.logistic)
    got = {(r.fold, r.date): r.score for r in scores.collect()}
    tests = {(r.fold, r.date) for r in folded.where("part = 'test' and label is not null").collect()}
    assert set(got) == tests and {f for f, _ in tests} == {0, 1, 2}
    auc = {r.fold: r.auc for r in research.fold_metrics(scores, "fold", "label", "score").collect()}
    assert all(auc[f] > 0.75 for f in (0, 1))
    # whatever test rows hold, the model is the same: change them, and score the old ones' neighbours alike
    spoilt = folded.withColumn("label", F.when(F.col("part") == "test", 1 - F.col("label")).otherwise(F.col("label")))
    again = {(r.fold, r.date): r.score for r in regimes.fold_scores(spoilt, ["a", "b"], regimes.logistic).collect()}
    assert all(math.isclose(again[k], got[k], rel_tol=1e-9) for k in got)
    # the median that stands in for a missing value is the train rows'
    train = [r.a for r in folded.where("fold = 1 and part = 'train' and label is not null and a is not null").collect()]
    fitted = regimes.logistic(["a", "b"]).fit(folded.where("fold = 1 and part = 'train' and label is not null"))
    assert min(train) <= fitted.stages[0].surrogateDF.first().a <= max(train) and abs(fitted.stages[0].surrogateDF.first().a - np.median(train)) < 0.1
    assert regimes.fold_scores(folded, ["a"], regimes.logistic, least=10**6).count() == 0


def test_least_squares_scores(folded):
    got = {(r.fold, r.date): r.score for r in regimes.har_scores(folded, ["b"], "ahead").collect()}
    train = folded.where("fold = 0 and part = 'train' and label is not null").collect()
    slope, level = np.polyfit([r.b for r in train], [r.ahead for r in train], 1)
    rows = folded.where("fold = 0 and part = 'test' and label is not null").collect()
    assert rows and np.allclose([got[0, r.date] for r in rows], [level + slope * r.b for r in rows])


def test_against_baselines(spark):
    m = spark.createDataFrame([("m", 0, 0.8), ("m", 1, 0.6), ("x", 0, 0.7), ("x", 1, 0.5), ("y", 0, 0.1), ("y", 1, 0.9)], "model string, fold int, auc double")
    r = regimes.against_baselines(m, "m").first()
    assert r.folds == 2 and np.allclose([r.auc_mean, r.auc_min, r.gap_mean, r.win_rate], [0.7, 0.6, -0.1, 0.5])


def test_entries_and_segments(spark):
    rows = [("a", DAY + timedelta(i), s, float(i)) for i, s in enumerate([80.0, 92.0, 96.0, 70.0, 95.0, 95.0, 95.0, 95.0, 95.0, 95.0])]
    df = regimes.segment_of(spark.createDataFrame(rows, "ticker string, date date, s double, f double"))
    assert [r.segment for r in df.orderBy("date").collect()] == ["TRAIN"] * 6 + ["TEST"] * 4
    got = {(r.segment, r.variant): (r.n, r.event_median, r.base_median) for r in regimes.entry_study(df, "s", {"high": 90.0, "top": 95.0}, ["f"]).collect()}
    assert got == {("TRAIN", "high"): (2, 2.5, 2.5), ("TRAIN", "top"): (2, 3.0, 2.5), ("TRAIN", "high, stays"): (2, 2.5, 2.5)}
