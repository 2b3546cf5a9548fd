"""Hand-computed cases and properties of the panel operators."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions.windows import average_rank_share, clamp, percent_rank_of, position_percentile
from panelwright.operators import asof, fundamentals, quality, rotation, screen, series, tables, text, themes, valuation


def day(s):
    return dt.date.fromisoformat(s)


def filings(spark, rows):
    return spark.createDataFrame([(t, day(p), day(f), day(f), float(r), float(s), None, None, e, float(r) * 0.2) for t, p, f, r, s, e in rows], "ticker string, period_end date, filed_date date, effective_eod_date date, revenue_ttm double, shares double, total_debt double, cash double, eps_ttm double, ebitda_ttm double")


def bars(spark, rows):
    return spark.createDataFrame([(t, day(d), float(c), float(c)) for t, d, c in rows], "ticker string, date date, close double, adj_close double")


def test_a_filing_counts_from_its_filing_date(spark):
    f = filings(spark, [("A", "2025-12-31", "2026-02-15", 100, 1000, None), ("A", "2026-03-31", "2026-04-24", 200, 1000, None)])
    f = valuation.with_growth(f.withColumn("split_factor", F.lit(1.0)))
    b = bars(spark, [("A", d, 10) for d in ("2026-02-10", "2026-04-23", "2026-04-24", "2026-04-27")])
    out = {str(r.date): r.ps for r in valuation.valuation(b, f).collect()}
    assert out == {"2026-04-23": 100.0, "2026-04-24": 50.0, "2026-04-27": 50.0}


@pytest.mark.parametrize(
    "split,filed,eps,shares,want",
    [("2026-03-01", "2026-02-15", 20.0, 100, (5.0, 10.0)), (None, "2026-02-15", 20.0, 100, (0.5, 1.0)), ("2026-03-01", "2026-05-01", 2.0, 1000, (5.0, 10.0))],
)
def test_splits_after_the_filing_are_applied(spark, split, filed, eps, shares, want):
    f = filings(spark, [("A", "2025-12-31", filed, 1000, shares, eps)])
    s = spark.createDataFrame([("A", day(split), 10.0)] if split else [], "ticker string, ex_date date, ratio double")
    b = bars(spark, [("A", "2026-05-15", 10)])
    f = valuation.with_growth(asof.split_factor(f, s, b))
    r = valuation.valuation(b, f).first()
    assert (round(r.pe, 9), round(r.ps, 9)) == want


def facts(spark, rows):
    return spark.createDataFrame([("E", m, day(a), day(b), float(v), day(f)) for m, a, b, v, f in rows], "entity string, metric string, start date, end date, val double, filed date")


ENDS = ["03-31", "06-30", "09-30", "12-31"]


def test_year_to_date_facts_are_differenced(spark):
    rows = [("da", "2024-01-01", f"2024-{e}", 5 * (i + 1), "2025-01-15") for i, e in enumerate(ENDS)] + [("da", "2025-01-01", f"2025-{e}", 5 * (i + 1), "2025-11-15") for i, e in enumerate(ENDS[:3])]
    f = facts(spark, rows)
    ttm = {str(r.end): r.ttm for r in fundamentals.trailing_four(fundamentals.single_quarters(f)).collect()}
    assert ttm["2025-09-30"] == 20
    assert fundamentals.trailing_four(fundamentals.single_quarters(f, differencing=False)).count() == 0


def test_the_earliest_filing_wins_and_fourth_quarters_are_derived(spark):
    rows = [("r", "2024-01-01", "2024-03-31", 1, "2024-05-01"), ("r", "2024-01-01", "2024-03-31", 9, "2024-09-01"), ("r", "2024-04-01", "2024-06-30", 2, "2024-08-01"), ("r", "2024-07-01", "2024-09-30", 3, "2024-11-01"), ("r", "2024-01-01", "2024-12-31", 10, "2025-02-01")]
    out = {str(r.end): r.val for r in fundamentals.single_quarters(facts(spark, rows)).collect()}
    assert out == {"2024-03-31": 1, "2024-06-30": 2, "2024-09-30": 3, "2024-12-31": 4}


@pytest.mark.parametrize(
    "parts,want",
    [((None, 80.0, 8.0, 20.0, None, None), 108.0), ((100.0, 80.0, 8.0, 20.0, None, None), 120.0), ((100.0, None, None, None, 20.0, 8.0), 128.0)],
)
def test_ebitda(spark, parts, want):
    df = spark.createDataFrame([("E", day("2025-12-31"), *parts)], "entity string, end date, operating_income double, pretax double, interest double, dep_amort double, depreciation double, amortisation double")
    assert fundamentals.ebitda(df).first().ebitda == want


def iterated(exposures, cap):
    e = [x / sum(exposures) for x in exposures]
    if cap * len(e) <= 1:
        return [1 / len(e)] * len(e)
    capped: set = set()
    for _ in e:
        over = {i for i, x in enumerate(e) if x > cap + 1e-12} - capped
        if not over:
            break
        capped |= over
        rest = sum(exposures[i] for i in range(len(e)) if i not in capped)
        e = [cap if i in capped else exposures[i] / rest * (1 - cap * len(capped)) for i in range(len(e))]
    return e


def test_capped_weights_equal_the_iterated_rule(spark):
    r = random.Random(3)
    groups = {g: [r.random() ** 4 + 1e-3 for _ in range(r.randint(1, 12))] for g in range(60)}
    df = spark.createDataFrame([(g, f"T{i:02}", x) for g, xs in groups.items() for i, x in enumerate(xs)], "g int, ticker string, exposure double")
    out: dict = {}
    for x in themes.capped_weights(df, ["g"]).collect():
        out.setdefault(x.g, {})[x.ticker] = x.weight
    for g, xs in groups.items():
        assert [out[g][f"T{i:02}"] for i in range(len(xs))] == pytest.approx(iterated(xs, 0.30), abs=1e-10)


def test_membership_is_read_as_of_a_day(spark):
    m = spark.createDataFrame([("A", "x", 0.111, day("2025-01-01")), ("A", "x", 0.5, day("2025-06-01")), ("A", "x", 0.0, day("2025-09-01"))], "ticker string, theme string, exposure double, as_of_date date")
    at = lambda d: [r.exposure for r in asof.membership_at(m, d).collect()]
    assert (at("2025-05-31"), at("2025-06-01"), at("2025-09-01"), at("2024-12-31")) == ([0.111], [0.5], [], [])


def test_recursive_averages_equal_pandas(spark):
    x = [1.0, 3.0, 2.0, 6.0, 5.5, 7.25, 1.0]
    row = spark.createDataFrame([(x,)], "x array<double>").select(series.ema_array(F.col("x"), 3).alias("e"), series.ew_std_array(F.col("x"), 3).alias("s")).first()
    assert row.e == pytest.approx(pd.Series(x).ewm(span=3, adjust=False).mean().tolist())
    assert row.s[0] is None and row.s[1:4] == pytest.approx([1.41421356, 0.89442719, 2.54483604], abs=1e-8)
    assert row.s[1:] == pytest.approx(pd.Series(x).ewm(span=3, adjust=False).std().tolist()[1:])


def test_ewmac_equals_pandas(spark):
    r = random.Random(0)
    x = [100.0]
    for _ in range(120):
        x.append(x[-1] * (1 + r.gauss(0, 0.02)))
    rows = [("A", day("2024-01-01") + dt.timedelta(days=i), v) for i, v in enumerate(x)]
    out = series.ewmac(spark.createDataFrame(rows, "ticker string, date date, adj_close double")).orderBy("date").toPandas()["ewmac_fast"]
    s = pd.Series(x)
    want = (s.ewm(span=16, adjust=False).mean() - s.ewm(span=64, adjust=False).mean()) / s.diff().ewm(span=64, adjust=False).std()
    assert out[5:].tolist() == pytest.approx(want[5:].tolist())


def test_weeks_end_on_friday(spark):
    df = spark.createDataFrame([(day(d),) for d in ("2026-06-06", "2026-06-01", "2026-06-05", "2026-06-07")], "d date")
    assert [str(r[0]) for r in df.select(series.week_ending(F.col("d"))).collect()] == ["2026-06-12", "2026-06-05", "2026-06-05", "2026-06-12"]


def test_weights_add_up():
    w = screen.weights(0.5)
    assert [round(x, 3) for x in w.values()] == [0.215, 0.22, 0.17, 0.12, 0.275]
    assert all(abs(sum(screen.weights(k).values()) - 1) < 1e-12 for k in (-1, 0, 0.3, 1, 2))


def test_percentiles_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 2.0), (1, "d", None)], "g int, t string, x double")
    out = {r.t: r for r in df.select("t", percent_rank_of(F.col("x"), "g").alias("p"), average_rank_share(F.col("x"), "g").alias("a"), position_percentile(F.col("x"), F.col("t"), "g").alias("q"), clamp(F.col("x") - 1).alias("c")).collect()}
    assert out["d"].p == 1.0 and out["d"].a is None and out["d"].q is None and out["d"].c is None
    assert out["b"].a == out["c"].a == pytest.approx(2.5 / 3)


def test_streaks_and_gate(spark):
    rows = [("A", day("2024-01-01") + dt.timedelta(days=i), 10.0, n, 0.7, 0.0) for i, n in enumerate([0.1, 0.2, -0.1, 0.3])]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, net10 double, up10 double, ker10 double")
    assert [(r.candidate, r.streak_days) for r in screen.candidates(df).orderBy("date").collect()] == [(1, 1), (1, 2), (0, 0), (1, 1)]


def test_spacing_is_greedy(spark):
    df = spark.createDataFrame([("A", i) for i in (1, 5, 11, 12, 21, 22)], "k string, p long")
    assert sorted(r.p for r in series.spaced_events(df, "k", "p", 10).collect()) == [1, 11, 21]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], "k int, v string, first int, last int")
    new = spark.createDataFrame([(2, None, 5, 5), (3, "c", 5, 5)], "k int, v string, first int, last int")
    assert sorted(map(tuple, tables.upsert_keep_first(old, new, "k", "first", "last").collect())) == [(1, "a", 1, 1), (2, None, 1, 5), (3, "c", 5, 5)]
    assert sorted(r.k for r in tables.replace_entities(old, new.withColumn("extra", F.lit(1)), "k").collect()) == [1, 2, 3]
    assert len(tables.insert_or_replace(old, new, ["k"]).collect()) == 3


def test_states(spark):
    rows = [("B", day("2024-01-05") + dt.timedelta(weeks=i), 1.0, 99.0 + i) for i in range(6)]
    r = rotation.states(spark.createDataFrame(rows, "bucket string, week date, rs double, rs_ratio double")).first()
    assert (r.state, r.slope_4w) == ("LEADING", 4.0)


def test_html_and_windows(spark):
    html = "<html><style>p{}</style><p>One &amp; two</p> <br>  <script>x()</script><div>three&nbsp; four&#8217;s</div></html>"
    assert spark.createDataFrame([(html,)], "h string").select(text.html_text(F.col("h"))).first()[0] == "One & two\n three four's"
    t = "aaa that bbb that " + "c" * 50 + " that end"
    got = [(r.start, r.end) for r in text.keyword_windows(spark.createDataFrame([(1, t), (2, None), (3, "none")], "k int, t string"), "k", "t", "that", 4, 10, 12).orderBy("start").collect()]
    at = [i for i in range(len(t)) if t.startswith("that", i)]
    want: list = []
    for i in at:
        a, b = max(0, i - 4), min(len(t), i + 10)
        if want and a < want[-1][1]:
            want[-1] = (want[-1][0], max(b, want[-1][1]))
        else:
            want.append((a, b))
    assert got == want


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "k int, x double")
    assert [tuple(r) for r in quality.checks(df, null_x=F.col("x").isNull(), never=F.col("k") > 9).collect()] == [("null_x", False, 1), ("never", True, 0)]
    assert quality.agree(df, df, ["k"], "x", 0.1).count() == 0


def test_as_of_keeps_nulls_and_ties(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("B", 5)], "k string, t int")
    right = spark.createDataFrame([("A", 5, None), ("A", 2, 7)], "k string, e int, v int")
    assert sorted((r.k, r.t, r.e or 0, r.v or 0) for r in asof.as_of(left, right, "k", "t", "e").collect()) == [("A", 1, 0, 0), ("A", 5, 5, 0), ("B", 5, 0, 0)]


def test_entry_and_queries_run(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
