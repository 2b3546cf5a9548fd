"""Registered queries of nested filing facts, split events, washouts and the turnaround funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import fundamentals, washouts
from panelwright.plans.queries import query, rounded
from panelwright.plans.studies import _roll
from panelwright.sources import adapters as src
from panelwright.sources import facts

_NAMES = facts.CONCEPTS["revenue"][1]


def _documents(spark, sf):
    """A filer's JSON document out of its quarters: odd ones changed the name they report revenue under in 1998, both names
    have 1997, a tenth higher under the old one, and the later of two filings restates."""
    q = src.quarterly_revenue(spark, sf).withColumn("start", F.add_months(F.date_add("period_end", 1), -3)).withColumn("odd", F.col("k") % 2 == 1)
    fact = lambda val, late: F.struct(F.col("start"), F.col("period_end").alias("end"), val.alias("val"), F.date_add("period_end", late).alias("filed"))
    year, revenue = F.year("period_end"), F.col("revenue")
    named = q.select(
        "ticker", F.explode(F.array_compact(F.array(
            F.when(~F.col("odd"), F.struct(F.lit(_NAMES[1]).alias("name"), fact(revenue, 35).alias("fact"))), F.when(~F.col("odd"), F.struct(F.lit(_NAMES[1]).alias("name"), fact(revenue * 1.5, 200).alias("fact"))),
            F.when(F.col("odd") & (year >= 1997), F.struct(F.lit(_NAMES[0]).alias("name"), fact(revenue, 35).alias("fact"))), F.when(F.col("odd") & (year <= 1997), F.struct(F.lit(_NAMES[2]).alias("name"), fact(revenue * 1.1, 35).alias("fact"))),
        ))).alias("x"),
    ).select("ticker", "x.*")
    concepts = named.groupBy("ticker", "name").agg(F.collect_list("fact").alias("facts")).groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct(F.create_map(F.lit("USD"), F.col("facts")).alias("units"))))).alias("us-gaap"))
    return concepts.select(F.col("ticker").alias("entity"), F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("document"))


@query("SELECT ticker AS entity, 'revenue' AS metric, period_end AS \"end\", round(CASE WHEN k % 2 = 1 AND year(period_end) < 1997 THEN revenue * 1.1 ELSE revenue END, 4) AS val, period_end + 35 AS filed FROM revenue")
def s13_nested_facts(spark, sf):
    """Nested documents are read, all names of a metric merged, and of each period the first report kept, of one day's the preferred name's."""
    return rounded(facts.first_reported(facts.document_facts(_documents(spark, sf))).drop("start"), 4)


@query("SELECT entity, round(sum(val), 2) AS val, count(*) AS n FROM (SELECT ticker AS entity, CASE WHEN k % 2 = 1 AND year(period_end) < 1997 THEN revenue * 1.1 ELSE revenue END AS val FROM revenue) GROUP BY entity")
def s13_singles_of_documents(spark, sf):
    """The documents' facts through the same assembly as flat ones."""
    flat = facts.first_reported(facts.document_facts(_documents(spark, sf)))
    return rounded(fundamentals.single_quarters(flat).groupBy("entity").agg(F.sum("val").alias("val"), F.count("*").alias("n")), 2)


def _raw_splits(spark, sf):
    s = src.table(spark, sf, "supplier").select(src.ticker(F.col("s_suppkey")).alias("ticker"), "s_suppkey")
    ratio = F.element_at(F.array(F.lit(2.0), F.lit(1.0), F.lit(0.0), F.lit(0.5), F.lit(None).cast("double"), F.lit(-3.0)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return s.select("ticker", F.expr("date_add(date'2001-03-01', cast(s_suppkey % 28 as int))").alias("ex_date"), ratio.alias("ratio"))


@query("SELECT 'T' || s_suppkey AS ticker, DATE '2001-03-01' + CAST(s_suppkey % 28 AS INTEGER) AS ex_date, CASE WHEN s_suppkey % 6 = 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS ratio FROM supplier WHERE s_suppkey % 6 IN (0, 3)")
def s7_split_events(spark, sf):
    """Of a provider's rows only true splits."""
    return facts.split_events(_raw_splits(spark, sf))


def _parts(spark, sf):
    """Parts of a result by filer: some report operating income, some only what is left before tax; some one sum of depreciation and amortisation, some two."""
    f = src.fundamentals(spark, sf).withColumn("k", F.substring("ticker", 2, 20).cast("long"))
    x = F.col("revenue_ttm")
    some = lambda c, v: F.when(c, x * v)
    k = F.col("k")
    return f.select(
        F.col("ticker").alias("entity"), F.col("period_end").alias("end"), some((k % 3 == 0) & (F.month("period_end") != 6), 0.2).alias("operating_income"), (x * 0.15).alias("pretax"), some(k % 2 == 0, 0.02).alias("interest"),
        some(k % 4 != 1, 0.05).alias("dep_amort"), (x * 0.03).alias("depreciation"), some(k % 5 == 0, 0.01).alias("amortisation"),
    )


@query(
    "SELECT ticker AS entity, period_end AS \"end\", round(CASE WHEN k % 3 = 0 THEN CASE WHEN month(period_end) <> 6 THEN x * 0.2::DOUBLE END ELSE x * 0.15::DOUBLE + CASE WHEN k % 2 = 0 THEN x * 0.02::DOUBLE ELSE 0 END END + CASE WHEN k % 4 <> 1 THEN x * 0.05::DOUBLE ELSE x * 0.03::DOUBLE + CASE WHEN k % 5 = 0 THEN x * 0.01::DOUBLE ELSE 0 END END, 4) AS ebitda "
    "FROM (SELECT ticker, period_end, revenue_ttm AS x, CAST(substr(ticker, 2) AS BIGINT) AS k FROM filings)"
)
def v8_ebitda(spark, sf):
    """V8: operating income if a filer has any, else what stands in for it, and depreciation and amortisation in one or two parts."""
    return rounded(fundamentals.ebitda(_parts(spark, sf)), 4)


@query(
    "SELECT ticker, period_end, filed, round(l + coalesce(c, 0), 4) AS total_debt FROM (SELECT ticker, period_end, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN period_end - 3 WHEN k % 5 = 1 THEN period_end ELSE filed_date END AS filed, CASE WHEN k % 3 <> 0 THEN total_debt END AS l, CASE WHEN k % 2 = 0 THEN total_debt * 0.5::DOUBLE END AS c FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS k FROM filings)) WHERE filed >= period_end"
)
def v9_valid_filings(spark, sf):
    """V9: rows without a day of filing or filed before their period ended go; debt is unknown where its long-term part is."""
    f = src.fundamentals(spark, sf).withColumn("k", F.substring("ticker", 2, 20).cast("long"))
    k = F.col("k")
    filed = F.when(k % 7 == 0, F.lit(None).cast("date")).when(k % 5 == 0, F.date_sub("period_end", 3)).when(k % 5 == 1, F.col("period_end")).otherwise(F.col("filed_date"))
    rows = f.withColumn("filed_date", filed).withColumn("debt_long", F.when(k % 3 != 0, F.col("total_debt"))).withColumn("debt_current", F.when(k % 2 == 0, F.col("total_debt") * 0.5))
    return rounded(facts.valid_filings(rows).select("ticker", "period_end", F.col("filed_date").alias("filed"), "total_debt"), 4)


EVENTS = (
    ", w0 AS (SELECT ticker, date, close, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, " + f"close / ({_roll('max', 'close', 252, 200)}) - 1 AS dd, {_roll('avg', 'close', 50)} AS ma50, "
    "lead(close, 21) OVER w / close - 1 AS fwd, CASE WHEN lead(close, 21) OVER w IS NOT NULL THEN min(close) OVER (w ROWS BETWEEN CURRENT ROW AND 21 FOLLOWING) / close - 1 END AS fwd_trough FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    f"w1 AS (SELECT *, coalesce({_roll('min', 'dd', 63, 20)} <= -0.5, false) AS washed, coalesce(close > ma50 AND lag(close) OVER w <= lag(ma50) OVER w, false) AS crossed, avg(fwd) OVER (PARTITION BY ticker) AS base FROM w0 WINDOW w AS (PARTITION BY ticker ORDER BY i)), "
    "sg AS (SELECT * FROM w1 WHERE n >= 278 AND washed AND crossed AND i >= 252 AND fwd IS NOT NULL), f1 AS (SELECT ticker, min(i) AS i FROM sg GROUP BY ticker), "
    "chain AS (SELECT ticker, i FROM f1 UNION ALL SELECT chain.ticker, (SELECT min(z.i) FROM sg z WHERE z.ticker = chain.ticker AND z.i >= chain.i + 26) AS i FROM chain WHERE chain.i IS NOT NULL), "
    "events AS (SELECT sg.ticker, sg.date, sg.i, fwd, fwd_trough, base, dd FROM chain JOIN sg ON sg.ticker = chain.ticker AND sg.i = chain.i)"
)


def _events(spark, sf):
    return washouts.washout_events(src.daily_bars(spark, sf), fall=0.5, h=21, embargo=5)


@query(EVENTS + " SELECT ticker, date, i, round(fwd, 6) AS fwd, round(fwd_trough, 6) AS fwd_trough, round(base, 6) AS base, round(dd, 6) AS dd FROM events")
def q14_washout_events(spark, sf):
    """Q14: days on which a washed-out ticker turned, 26 rows apart, with what followed and its own unconditional mean."""
    return rounded(_events(spark, sf))


@query(
    EVENTS + ", ev AS (SELECT *, year(date) // 10 * 10 AS decade FROM events) SELECT decade, count(*) AS n, round(avg(fwd), 6) AS fwd_mean, round(median(fwd), 6) AS fwd_median, round(avg(fwd - base), 6) AS lift_mean, round(avg((fwd - base > 0)::INT), 6) AS lift_positive, round(avg((fwd > 0.3)::INT), 6) AS over_30, "
    "round(avg((fwd < 0)::INT), 6) AS negative, round(median(fwd_trough), 6) AS trough_median, round(avg((fwd_trough < -0.15)::INT), 6) AS trough_below_15 FROM ev GROUP BY GROUPING SETS ((), (decade)) HAVING count(*) > 0"
)
def q14_event_summary(spark, sf):
    """Q14: the events by decade and together."""
    return rounded(washouts.event_summary(_events(spark, sf)))


STANDING = (
    f", a0 AS (SELECT ticker, date, close, close * volume AS money, coalesce(ln(close) - ln(lag(close) OVER w), 0) AS step, count(*) OVER (PARTITION BY ticker) AS n, close / ({_roll('max', 'close', 252, 120)}) - 1 AS dd252, close / ({_roll('avg', 'close', 50)}) - 1 AS dist_ma50, close / ({_roll('avg', 'close', 200, 120)}) - 1 AS dist_ma200, "
    + ", ".join(f"close / lag(close, {k}) OVER w - 1 AS ret_{k}d" for k in (63, 126, 252)) + ", row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    "a1 AS (SELECT *, coalesce(dist_ma50 > 0, false) AS above50, coalesce(dist_ma200 > 0, false) AS above200, coalesce(dist_ma50 > 0, false) AND NOT coalesce(lag(dist_ma50) OVER (PARTITION BY ticker ORDER BY date) > 0, false) AS crossed FROM a0), "
    f"a2 AS (SELECT *, {_roll('min', 'dd252', 126, 40)} AS min_dd_126, {_roll('stddev_samp', 'step', 126, 60)} * sqrt(252) AS rvol126, bool_or(crossed) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS reclaim_20d, median(money) FILTER (back <= 63) OVER (PARTITION BY ticker) AS usual FROM a1 WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    "standing AS (SELECT * EXCLUDE (money, back, step, crossed, usual), usual AS money, CASE WHEN NOT coalesce(n >= 220 AND date >= (SELECT max(date) FROM bars) - 60, false) THEN 0 WHEN NOT coalesce(usual >= 20000, false) THEN 1 WHEN NOT coalesce(dd252 <= -0.4, false) THEN 2 WHEN NOT coalesce(rvol126 >= 0.4, false) THEN 3 WHEN NOT (above50 OR reclaim_20d) THEN 4 ELSE 5 END AS stage FROM a2 WHERE back = 1)"
)


def _funnel(spark, sf):
    bars = src.daily_bars(spark, sf)
    return washouts.funnel(washouts.standing(bars), bars.agg(F.max("date").alias("newest")), money=20_000, fall=0.4, vol=0.4, stale=60)


@query(
    STANDING + ", ctx AS (SELECT sector, count(*) AS n_names, median(dd252) AS sector_dd252, median(rvol126) AS sector_rvol126, avg(above50::INT) AS sector_above50 FROM standing JOIN universe USING (ticker) GROUP BY sector) "
    "SELECT s.ticker, u.sector, s.date, round(dd252, 6) AS dd252, round(min_dd_126, 6) AS min_dd_126, round(rvol126, 6) AS rvol126, round(dist_ma50, 6) AS dist_ma50, round(dist_ma200, 6) AS dist_ma200, above50, above200, reclaim_20d, round(ret_63d, 6) AS ret_63d, round(ret_126d, 6) AS ret_126d, round(ret_252d, 6) AS ret_252d, round(money, 2) AS money, "
    "n_names, round(sector_dd252, 6) AS sector_dd252, round(sector_rvol126, 6) AS sector_rvol126, round(sector_above50, 6) AS sector_above50 FROM standing s JOIN universe u USING (ticker) LEFT JOIN ctx USING (sector) WHERE stage = 5"
)
def q23_turnarounds(spark, sf):
    """Q23: names that pass every stage of the funnel, with their sector's state beside them."""
    rows = _funnel(spark, sf).join(src.universe(spark, sf).select("ticker", "sector"), "ticker")
    out = rows.where("stage = 5").join(washouts.sector_context(rows), "sector", "left").drop("close", "n", "stage")
    return rounded(out, money=2)


@query(STANDING + ", st AS (SELECT unnest([1, 2, 3, 4, 5]) AS stage, unnest(['history', 'liquid', 'washed out', 'volatile', 'turning']) AS name) SELECT CAST(st.stage AS BIGINT) AS stage, name, count(s.ticker) AS names FROM st LEFT JOIN standing s ON s.stage >= st.stage GROUP BY ALL")
def q23_stage_counts(spark, sf):
    """Q23: how many names are left after each stage."""
    return rounded(washouts.stage_counts(_funnel(spark, sf)))
