"""SQL of the canonical tables, and a way to put queries on top of only those they use."""

from __future__ import annotations

import re

CTES = {
    "bars": """SELECT 'T' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, (min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2 AS open,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS adj_close, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
        FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY ALL""",
    "spx": """SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close
        FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1""",
    "universe": """SELECT 'T' || s_suppkey AS ticker, s_name AS name, r_name AS sector, n_name AS industry, s_acctbal * 1e6 AS mktcap
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "sector_bars": """SELECT 'sector' AS bucket_type, sector AS bucket, CAST(l_shipdate AS DATE) AS date,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close
        FROM lineitem JOIN universe ON ticker = 'T' || l_suppkey WHERE l_shipdate IS NOT NULL GROUP BY ALL""",
    "revenue": """SELECT 'T' || l_suppkey AS ticker, l_suppkey AS k, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
        CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL""",
    "ttm": """SELECT *, sum(revenue) OVER four AS ttm, count(revenue) OVER four AS n4, min(period_end) OVER four AS first_end FROM revenue
        WINDOW four AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    "filings": """SELECT ticker, period_end, period_end + CAST(35 + k % 11 AS INTEGER) AS filed_date, period_end + CAST(35 + k % 11 AS INTEGER) AS effective_eod_date, ttm AS revenue_ttm, 1000.0::DOUBLE + k AS shares,
        ttm * 0.3::DOUBLE AS total_debt, ttm * 0.1::DOUBLE AS cash, ttm * 0.2::DOUBLE AS ebitda_ttm, s_acctbal / 1000 AS eps_ttm FROM ttm LEFT JOIN supplier ON s_suppkey = k
        WHERE n4 = 4 AND date_diff('day', first_end, period_end) BETWEEN 250 AND 295 AND k % 10 <> 4 AND (k % 10 <> 2 OR period_end < DATE '2000-01-01')""",
    "splits": """SELECT 'T' || s_suppkey AS ticker, DATE '2001-03-01' AS ex_date, 2.0::DOUBLE AS ratio FROM supplier WHERE s_suppkey % 7 = 0
        UNION ALL SELECT 'T' || s_suppkey, DATE '2001-06-01', 0.2::DOUBLE FROM supplier WHERE s_suppkey % 11 = 0""",
    "membership": """SELECT 'T' || k AS ticker, theme, CASE WHEN share < 0.15 THEN 0.0::DOUBLE ELSE share END AS exposure, make_date(y + 1, 1, 1) AS as_of_date FROM (
        SELECT k, y, theme, round(CAST(part AS DOUBLE) / CAST(sum(part) OVER (PARTITION BY k, y) AS DOUBLE), 6) AS share FROM (
        SELECT l_suppkey AS k, year(l_shipdate) AS y, c_mktsegment AS theme, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS part
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_shipdate IS NOT NULL GROUP BY ALL))""",
    "riser": """SELECT ticker, date, close, adj_close / lag(adj_close, 5) OVER w - 1 AS net5, adj_close / lag(adj_close, 10) OVER w - 1 AS net10, adj_close / lag(adj_close, 20) OVER w - 1 AS net20,
        CASE WHEN i > 10 THEN CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER w10 AS DOUBLE) / 10 END AS up10,
        CASE WHEN i > 10 THEN (SELECT least(0.0, min(y)) FROM (SELECT unnest([p[j] / list_max(p[1:j]) - 1 FOR j IN range(1, 12)]) AS y)) END AS ddw10,
        CASE WHEN i > 10 THEN greatest(0.0, least(1.0, abs(sum(d) OVER w10) / nullif(sum(abs(d)) OVER w10, 0))) END AS ker10
        FROM (SELECT *, ln(greatest(adj_close, 1e-9)) - ln(greatest(lag(adj_close) OVER v, 1e-9)) AS d, row_number() OVER v AS i, list(adj_close) OVER (v ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS p FROM bars WINDOW v AS (PARTITION BY ticker ORDER BY date))
        WINDOW w AS (PARTITION BY ticker ORDER BY date), w10 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "listed": """SELECT *, round(100 * percent_rank() OVER (PARTITION BY date ORDER BY net10 ASC NULLS LAST), 1) AS net10_pct,
        CASE WHEN up10 >= 0.6 AND net10 > 0 AND row_number() OVER (PARTITION BY date ORDER BY CASE WHEN up10 >= 0.6 AND net10 > 0 THEN net10 END DESC NULLS LAST, ticker) <= 3 THEN 1 ELSE 0 END AS candidate FROM (SELECT r.* FROM riser r JOIN signal s ON r.ticker = s.ticker AND r.date = s.date WHERE s.rs_raw IS NOT NULL)""",
    "streaks": """SELECT * EXCLUDE (island), CASE WHEN candidate = 1 THEN row_number() OVER (PARTITION BY ticker, candidate, island ORDER BY date) ELSE 0 END AS streak_days FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - row_number() OVER (PARTITION BY ticker, candidate ORDER BY date) AS island FROM listed)""",
    "filings_split": """SELECT f.*, coalesce(exp(sum(ln(s.ratio))), 1.0) AS split_factor FROM filings f LEFT JOIN (SELECT ticker, max(date) AS basis FROM bars GROUP BY ticker) b ON f.ticker = b.ticker
        LEFT JOIN splits s ON f.ticker = s.ticker AND s.ex_date > coalesce(f.effective_eod_date, f.filed_date) AND s.ex_date <= b.basis GROUP BY ALL""",
    "filings_growth": """SELECT *, CASE WHEN date_diff('day', lag(period_end, 4) OVER w, period_end) BETWEEN 330 AND 400 THEN revenue_ttm / nullif(lag(revenue_ttm, 4) OVER w, 0) - 1 END AS growth,
        CASE WHEN revenue_ttm > 0 THEN ebitda_ttm / revenue_ttm END AS margin FROM filings_split WINDOW w AS (PARTITION BY ticker ORDER BY period_end)""",
    "valued": """SELECT ticker, date, close, pe, ps, evs, ev_ebitda, CASE WHEN growth > 0 AND eps_ttm > 0 THEN pe / (100 * growth) END AS peg, growth, margin, 100 * (growth + margin) AS rule40, period_end AS as_of_period_end, filed_date AS as_of_filed, effective_eod_date AS as_of_effective_eod FROM (
        SELECT *, CASE WHEN eps_ttm > 0 THEN adj_close * split_factor / eps_ttm END AS pe, CASE WHEN revenue_ttm > 0 AND shares > 0 THEN cap / revenue_ttm END AS ps, CASE WHEN revenue_ttm > 0 AND shares > 0 THEN ev / revenue_ttm END AS evs, CASE WHEN ebitda_ttm > 0 AND shares > 0 THEN ev / ebitda_ttm END AS ev_ebitda FROM (
        SELECT *, cap + coalesce(total_debt, 0) - coalesce(cash, 0) AS ev FROM (
        SELECT b.ticker, b.date, b.close, b.adj_close, f.* EXCLUDE (ticker), b.adj_close * f.shares * f.split_factor AS cap
        FROM bars b ASOF JOIN filings_growth f ON b.ticker = f.ticker AND b.date >= coalesce(f.effective_eod_date, f.filed_date)) WHERE revenue_ttm IS NOT NULL AND shares IS NOT NULL))""",
    "signal": """SELECT ticker, date, close, r63 AS ret_63, r126 AS ret_126, (r63 - (spx / lag(spx, 63) OVER w - 1)) + (r126 - (spx / lag(spx, 126) OVER w - 1)) AS rs_raw,
        CASE WHEN count(px) OVER w50 = 50 THEN avg(px) OVER w50 END AS ma50, CASE WHEN count(px) OVER w150 = 150 THEN avg(px) OVER w150 END AS ma150, CASE WHEN count(px) OVER w200 = 200 THEN avg(px) OVER w200 END AS ma200,
        px / CASE WHEN count(px) OVER w252 >= 20 THEN max(px) OVER w252 END AS high_prox,
        CASE WHEN count(step) OVER w63 = 63 THEN greatest(0.0, least(1.0, abs(px - lag(px, 63) OVER w) / nullif(sum(abs(step)) OVER w63, 0))) END AS trend_quality,
        CASE WHEN count(volume) OVER w200 = 200 THEN avg(CAST(volume AS DOUBLE)) OVER w50 / nullif(avg(CAST(volume AS DOUBLE)) OVER w200, 0) END AS vol_ratio,
        CASE WHEN count(volume) OVER w50 = 50 THEN CAST(sum(CASE WHEN step > 0 THEN volume ELSE 0 END) OVER w50 AS DOUBLE) / nullif(CAST(sum(CASE WHEN step IS NULL OR step <= 0 THEN volume ELSE 0 END) OVER w50 AS DOUBLE), 0) END AS ud_vol_ratio
        FROM (SELECT *, px / lag(px, 63) OVER v - 1 AS r63, px / lag(px, 126) OVER v - 1 AS r126, px - lag(px) OVER v AS step, last_value(bench IGNORE NULLS) OVER v AS spx FROM (
          SELECT b.*, b.adj_close AS px, s.close AS bench, count(*) OVER (PARTITION BY ticker) AS n FROM bars b LEFT JOIN spx s ON b.date = s.date) WHERE n >= 60 WINDOW v AS (PARTITION BY ticker ORDER BY date))
        WINDOW w AS (PARTITION BY ticker ORDER BY date), w50 AS (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), w63 AS (w ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), w150 AS (w ROWS BETWEEN 149 PRECEDING AND CURRENT ROW),
        w200 AS (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), w252 AS (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""",
    "scored": """SELECT *, 100 * (0.215 * c_rs + 0.22 * c_high + 0.17 * c_trend + 0.12 * c_vol + 0.275 * c_accel) AS composite FROM (
        SELECT *, greatest(0.0, least(1.0, rs_pct / 100)) AS c_rs, coalesce(greatest(0.0, least(1.0, high_prox)), 0.0) AS c_high, coalesce(trend_quality, 0.0) AS c_trend,
        CASE WHEN vol_ratio IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (vol_ratio - 1) / 0.6 + 0.5)) END AS c_vol, greatest(0.0, least(1.0, coalesce(rs_accel, 0) / 100 + 0.5)) AS c_accel FROM (
        SELECT *, rs_pct - lag(rs_pct, 21) OVER (PARTITION BY ticker ORDER BY date) AS rs_accel FROM (
        SELECT *, 100 * percent_rank() OVER (PARTITION BY date ORDER BY rs_raw ASC NULLS LAST) AS rs_pct FROM signal WHERE rs_raw IS NOT NULL)))""",
}


def sql(query: str) -> str:
    """``query`` with the canonical tables it names, and those they name, put before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                needed.append(name)

    visit(query)
    if query.startswith(","):  # more tables of its own
        return "WITH " + ("RECURSIVE " if "UNION ALL SELECT" in query else "") + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + (query if needed else query[1:])
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" if needed else "") + query
