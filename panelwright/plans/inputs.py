"""Registered queries of sources: listings, calendars, identifiers, theme definitions, a synthetic panel, extrema, evidence text, stratified samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import tables, text
from panelwright.plans import extended
from panelwright.plans.queries import ORACLE_SQL, query, rounded
from panelwright.sources import adapters as src
from panelwright.sources import synthetic
from panelwright.sources.listing import listed, theme_definitions, with_identifiers


def _listing(spark, sf):
    """Screener rows as JSON: untidy symbols, share classes, empty fields, some tickers twice with another size."""
    s = src.table(spark, sf, "supplier").join(src.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    k = F.col("s_suppkey")
    row = lambda symbol, cap: F.to_json(F.struct(symbol.alias("symbol"), F.col("s_name").alias("name"), F.when(k % 4 == 0, F.lit("  ")).otherwise(F.col("n_name")).alias("sector"), F.lit("").alias("country"), cap.alias("marketCap")))
    cap = F.when(k % 9 == 0, F.lit("n/a")).when(k % 9 == 1, F.lit("$0.00")).otherwise(F.concat(F.lit("$"), F.format_number(F.abs("s_acctbal"), 2)))
    name = F.concat(F.lit(" t"), k.cast("string"))
    main = s.select(row(name, cap).alias("json"))
    twice = s.where("s_suppkey % 5 = 0").select(row(F.concat(F.lit("T"), k.cast("string")), F.format_number(F.abs(F.col("s_acctbal")) * 2, 2)).alias("json"))
    classes = s.where("s_suppkey % 3 = 0").select(row(F.concat(name, F.when(k % 2 == 0, F.lit("^A")).otherwise(F.lit("/B"))), cap).alias("json"))
    return main.unionByName(twice).unionByName(classes)


@query(
    "SELECT 'T' || s_suppkey AS ticker, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN n_name END AS sector, CAST(NULL AS VARCHAR) AS country, round(CASE WHEN s_suppkey % 5 = 0 AND s_acctbal <> 0 THEN abs(s_acctbal) * 2 WHEN s_suppkey % 9 > 1 AND s_acctbal <> 0 THEN abs(s_acctbal) END, 2) AS mktcap FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"
)
def s1_listing(spark, sf):
    """A listing's JSON rows: symbols trimmed and upper case, share classes gone, empty fields NULL, of a ticker's rows the largest."""
    return rounded(listed(_listing(spark, sf), "json"), 2)


@query(", e AS (SELECT max(date) AS e FROM bars), d AS (SELECT e, unnest(range(0, 800)) AS k FROM e), w AS (SELECT e - CAST(k AS INTEGER) AS date FROM d WHERE isodow(e - CAST(k AS INTEGER)) < 6) SELECT date FROM w ORDER BY date DESC LIMIT 320")
def s24_last_weekdays(spark, sf):
    """The 320 weekdays that end with the last bar."""
    return synthetic.weekdays(src.daily_bars(spark, sf).agg(F.max("date").alias("end")), 320)


@query(
    ", u AS (SELECT ticker, mktcap, CAST(substr(ticker, 2) AS BIGINT) AS k FROM universe), t AS (SELECT *, k % 6 <> 0 AS has FROM u WHERE mktcap >= 1e9) SELECT count(*) AS targets, count(*) FILTER (has) AS known, count(*) FILTER (NOT has) AS missing, min(lpad(CAST(k * 37 AS VARCHAR), 10, '0')) FILTER (has) AS first_id FROM t"
)
def s25_targets(spark, sf):
    """Targets above a size, with their ten-digit ids, and how many have none."""
    ids = src.table(spark, sf, "supplier").where("s_suppkey % 6 != 0").select(F.lower(src.ticker(F.col("s_suppkey"))).alias("ticker"), (F.col("s_suppkey") * 37).alias("id"))
    found = with_identifiers(src.universe(spark, sf).where("mktcap >= 1e9").select("ticker"), ids)
    return found.agg(F.count("*").alias("targets"), F.count("identifier").alias("known"), F.count(F.when(F.col("identifier").isNull(), 1)).alias("missing"), F.min("identifier").alias("first_id"))


_THEMES = {"BUILDING": {"cap": 0.2, "header": "Builders", "keywords": ["house", "brick"]}, "MACHINERY": {"header": "Machines"}, "FURNITURE": {"cap": 0.5, "keywords": ["chair"]}}


@query(
    ", c AS (SELECT unnest(['BUILDING', 'MACHINERY', 'FURNITURE']) AS theme, unnest([0.2, 0.3, 0.5]::DOUBLE[]) AS cap, unnest(['Builders', 'Machines', 'FURNITURE']) AS header, unnest([2, 0, 1]::BIGINT[]) AS n_keywords) SELECT theme, cap, header, n_keywords, count(DISTINCT ticker) AS members FROM c LEFT JOIN (SELECT * FROM membership WHERE exposure > 0) m USING (theme) GROUP BY ALL"
)
def s12_theme_definitions(spark, sf):
    """Definitions of themes, with the usual cap where none is given, beside their members."""
    d = theme_definitions(spark, _THEMES)
    members = src.theme_membership(spark, sf).where("exposure > 0").select("theme", "ticker").distinct()
    return d.join(members, "theme", "left").groupBy("theme", "cap", "header", F.size("keywords").cast("long").alias("n_keywords")).agg(F.count("ticker").alias("members"))


# --- S23


def _u(place: str, row: str, kind: int) -> str:
    x = f"(({place} * 7919 + {row} * 104729 + {kind * 15485863 + 42 * 1299709}) % 2147483647)"
    for _ in range(2):
        x = f"(({x} * {x} + 12345) % 2147483647 * 48271 % 2147483647)"
    return f"(({x} + 1) / 2147483648.0::DOUBLE)"


def _n(place: str, row: str, kind: int) -> str:
    return f"(sqrt(-2 * ln({_u(place, row, kind)})) * cos(2 * pi() * {_u(place, row, kind + 1)}))"


SYNTHETIC = (
    ", t AS (SELECT 'T' || s_suppkey AS ticker, s_suppkey AS p FROM supplier), cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r FROM (" + ORACLE_SQL["s24_last_weekdays"] + ")), "
    f"y0 AS (SELECT ticker, p, r, date, (20 + 180 * {_u('p', '0', 17)}) * exp(sum((-0.2 + 0.6 * {_u('p', '0', 11)}) / 252 + (0.2 + 0.4 * {_u('p', '0', 13)}) * sqrt(1.0::DOUBLE / 252) * {_n('p', 'r', 101)}) OVER (PARTITION BY ticker ORDER BY r)) AS close FROM t, cal), "
    f"y1 AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY r), close) AS last FROM y0), y2 AS (SELECT *, last * (1 + 0.005 * {_n('p', 'r', 201)}) AS open FROM y1), "
    f"made AS (SELECT ticker, p, r, date, open, greatest(open, close) * (1 + abs(0.008 * {_n('p', 'r', 401)})) AS high, least(open, close) * (1 - abs(0.008 * {_n('p', 'r', 501)})) AS low, close, greatest(floor((3e5 + 3e7 * {_u('p', '0', 19)}) * exp(0.3 * {_n('p', 'r', 301)}) * CASE WHEN close >= last THEN 1.1 ELSE 0.95 END), 1) AS volume FROM y2)"
)


def _synthetic(spark, sf):
    tickers = src.table(spark, sf, "supplier").select(src.ticker(F.col("s_suppkey")).alias("ticker"), F.col("s_suppkey").alias("place"))
    return tickers, synthetic.bars(tickers, s24_last_weekdays(spark, sf))


@query(SYNTHETIC + " SELECT ticker, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, CAST(round(volume / 100) AS BIGINT) AS lots FROM made")
def s23_synthetic_bars(spark, sf):
    """A walk for every supplier, the same whatever the partitioning."""
    b = _synthetic(spark, sf)[1]
    return rounded(b.select("ticker", "date", "open", "high", "low", "close", F.round(F.col("volume") / 100).cast("long").alias("lots")), 4)


@query(
    SYNTHETIC + ", l AS (SELECT ticker, p, date, close FROM made WHERE r = 319), k AS (SELECT *, CASE p WHEN 0 THEN 'loss' WHEN 1 THEN 'deep_loss' WHEN 2 THEN 'stale' WHEN 3 THEN 'overdue' WHEN 4 THEN 'none' ELSE 'normal' END AS kind FROM l), q AS (SELECT k.*, q, CASE kind WHEN 'stale' THEN 130 WHEN 'overdue' THEN 230 ELSE 50 END AS age FROM k, (SELECT unnest(range(8)) AS q) WHERE kind <> 'none'), "
    f"f AS (SELECT ticker, p, q, kind, date, date - CAST(age + 91 * (7 - q) AS INTEGER) AS pe, floor(1e7 + 1e9 * {_u('p', '0', 23)}) AS sh, floor(1e7 + 1e9 * {_u('p', '0', 23)}) * close / (2.5 + 11.5 * {_u('p', '0', 29)}) * pow(1.01 + 0.015 * {_u('p', '0', 31)}, q - 7) AS rev FROM q) "
    f"SELECT ticker, pe AS period_end, least(pe + CAST(35 + floor(11 * {_u('p', 'q', 53)}) AS INTEGER), date) AS filed_date, round(rev / sh, 4) AS revenue_per_share, round(rev * CASE WHEN kind = 'deep_loss' THEN -(0.02 + 0.08 * {_u('p', 'q', 43)}) ELSE 0.12 + 0.23 * {_u('p', '0', 47)} END / sh, 4) AS ebitda_per_share, "
    f"round(rev * CASE WHEN kind IN ('loss', 'deep_loss') THEN -(0.05 + 0.2 * {_u('p', '0', 37)}) ELSE 0.04 + 0.14 * {_u('p', '0', 41)} END / sh, 4) AS eps_ttm FROM f"
)
def s23_synthetic_filings(spark, sf):
    """Eight quarters of every filer, with the edge cases at the first five places."""
    tickers, b = _synthetic(spark, sf)
    last = b.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    f = synthetic.filings(tickers, last)
    return rounded(f.select("ticker", "period_end", "filed_date", (F.col("revenue_ttm") / F.col("shares")).alias("revenue_per_share"), (F.col("ebitda_ttm") / F.col("shares")).alias("ebitda_per_share"), "eps_ttm"), 4)


# --- A2, L2, M5, Q12

_RANGES = ("rs_pct", "c_rs", "c_high", "c_trend", "c_vol", "c_accel", "composite")


@query(" UNION ALL ".join(f"SELECT '{c}' AS measure, round(min({c}), 6) AS least, round(max({c}), 6) AS most, count({c}) AS n FROM scored" for c in _RANGES))
def a2_extrema(spark, sf):
    """A2: the smallest and largest value of every component, in one pass."""
    rows = extended.screen.composite(extended.base._signals(spark, sf))
    found = rows.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in _RANGES for f in (F.min, F.max, F.count)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(f"min_{c}").alias("least"), F.col(f"max_{c}").alias("most"), F.col(f"count_{c}").alias("n")) for c in _RANGES)))
    return rounded(found.select(each.alias("x")).select("x.*"))


@query(
    ", w AS (SELECT doc_id, string_agg(chr(10) || '--- (offset ' || start || ') ---' || chr(10) || piece, chr(10) ORDER BY start) AS pieces FROM (SELECT * EXCLUDE (piece_md5), piece FROM (" + ORACLE_SQL["l2_keyword_windows"].replace("md5(substring(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))) AS piece_md5", "substring(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) AS piece, '' AS piece_md5") + ")) GROUP BY doc_id), "
    "h AS (SELECT doc_id, text, coalesce(nullif(strpos(text, ' of '), 0), 1) AS spot FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(e) AS n_chars, md5(e) AS evidence_md5 FROM (SELECT doc_id, substring(substring(text, spot, 14000) || coalesce(chr(10) || pieces, ''), 1, 36000) AS e FROM h LEFT JOIN w USING (doc_id))"
)
def l2_evidence(spark, sf):
    """L2: from a marker on 14,000 characters, then the windows around a word, 36,000 characters at most."""
    found = text.evidence(src.table(spark, sf, "documents"), "doc_id", "text", marker=" of ", pattern="that")
    return found.select("doc_id", F.length("evidence").cast("long").alias("n_chars"), F.md5("evidence").alias("evidence_md5"))


@query("SELECT ticker, date, close, NULL::DOUBLE AS spread, volume FROM (SELECT ticker, date, close, volume FROM bars WHERE year(date) < 2000) UNION ALL SELECT ticker, date, close, high - low, volume FROM bars WHERE year(date) >= 2000")
def m5_schema_change(spark, sf):
    """M5: old rows without a column and with one that is dropped meet new rows whose columns stand in another order; names decide."""
    b = src.daily_bars(spark, sf)
    old = b.where("year(date) < 2000").select("volume", "date", "ticker", "close", F.lit("x").alias("note"))
    new = b.where("year(date) >= 2000").select((F.col("high") - F.col("low")).alias("spread"), "close", "volume", "ticker", "date")
    return tables.evolved(old, new, ["ticker", "date", "close", "spread", "volume"])


@query(
    "SELECT ticker, place, decade FROM (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY h, ticker, place) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY h, place) AS own FROM (SELECT e.ticker, e.place, year(b.date) // 10 * 10 AS decade, (CAST(substr(e.ticker, 2) AS BIGINT) * 7919 + e.place * 104729 + 1299709) % 2147483647 * 48271 % 2147483647 AS h FROM ("
    + ORACLE_SQL["q11_smooth_winners"] + ") e JOIN (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM bars) b ON b.ticker = e.ticker AND b.i = e.place)) WHERE own = 1) WHERE n <= 10"
)
def q12_stratified_sample(spark, sf):
    """Q12: ten smooth rises of each decade, no ticker twice, in an order that arithmetic gives."""
    numbered = src.daily_bars(spark, sf).select("ticker", "date", (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).cast("long").alias("place"))
    events = extended.q11_smooth_winners(spark, sf).select("ticker", F.col("place").cast("long").alias("place")).join(numbered, ["ticker", "place"])
    h = (F.substring("ticker", 2, 20).cast("long") * 7919 + F.col("place") * 104729 + 1299709) % 2147483647 * 48271 % 2147483647
    events = events.withColumn("decade", (F.floor(F.year("date") / 10) * 10).cast("long")).withColumn("h", h)
    own = events.withColumn("own", F.row_number().over(Window.partitionBy("ticker").orderBy("h", "place"))).where("own = 1")
    return own.withColumn("n", F.row_number().over(Window.partitionBy("decade").orderBy("h", "ticker", "place"))).where("n <= 10").select("ticker", "place", "decade")
