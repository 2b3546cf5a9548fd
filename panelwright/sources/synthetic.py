"""A synthetic panel for given tickers: the same rows however they are partitioned, with one ticker for each edge case.

All draws are arithmetic on (ticker's place, row, kind of draw, seed), so no generator has a state that the order of
rows could change; paths are sums over a ticker's own days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a ticker's place in the list makes it, and how old its last filing is then.
PROFILES = {0: "loss", 1: "deep_loss", 2: "stale", 3: "overdue", 4: "none"}
LAST_AGE = {"stale": 130, "overdue": 230}
AGE, QUARTER_DAYS, QUARTERS = 50, 91, 8


def uniform(place: Column, row: Column, kind: int, seed: int) -> Column:
    """A number in (0, 1) for a place, a row and a kind of draw."""
    x = (place * 7919 + row * 104729 + F.lit(kind * 15485863 + seed * 1299709)) % 2147483647
    for _ in range(2):  # squares, as multiples alone leave neighbouring rows in a row
        x = (x * x + 12345) % 2147483647 * 48271 % 2147483647
    return (x + 1) / F.lit(2147483648.0)


def normal(place: Column, row: Column, kind: int, seed: int) -> Column:
    """A standard normal number out of two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(place, row, kind, seed))) * F.cos(2 * F.pi() * uniform(place, row, kind + 1, seed))


def weekdays(days: DataFrame, n: int) -> DataFrame:
    """(date): the last ``n`` Mondays to Fridays up to the one date ``end`` of ``days`` (one row)."""
    span = F.sequence(F.date_sub("end", (n // 5 + 2) * 7), F.col("end"))
    kept = F.filter(span, lambda d: F.weekday(d) < 5)
    return days.select(F.explode(F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n)).alias("date"))


def bars(tickers: DataFrame, calendar: DataFrame, seed: int = 42) -> DataFrame:
    """(ticker, date, open, high, low, close, adj_close, volume) from (ticker, place): a geometric walk with a drift and volatility of the ticker's own."""
    place, row = F.col("place"), F.col("row")
    days = calendar.select("date", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).cast("long").alias("row"))  # one row a day
    whole = tickers.select("ticker", F.col("place").cast("long").alias("place")).crossJoin(F.broadcast(days))
    one = F.lit(0).cast("long")
    drift, spread, start = -0.2 + 0.6 * uniform(place, one, 11, seed), 0.2 + 0.4 * uniform(place, one, 13, seed), 20 + 180 * uniform(place, one, 17, seed)
    by = Window.partitionBy("ticker").orderBy("row")
    step = drift / 252 + spread * F.sqrt(F.lit(1 / 252)) * normal(place, row, 101, seed)
    rows = whole.withColumn("close", start * F.exp(F.sum(step).over(by))).withColumn("last", F.coalesce(F.lag("close").over(by), F.col("close")))
    rows = rows.withColumn("open", F.col("last") * (1 + 0.005 * normal(place, row, 201, seed)))
    volume = (3e5 + 3e7 * uniform(place, one, 19, seed)) * F.exp(0.3 * normal(place, row, 301, seed)) * F.when(F.col("close") >= F.col("last"), 1.10).otherwise(0.95)
    high, low = F.greatest("open", "close") * (1 + F.abs(0.008 * normal(place, row, 401, seed))), F.least("open", "close") * (1 - F.abs(0.008 * normal(place, row, 501, seed)))
    return rows.select("ticker", "date", "open", high.alias("high"), low.alias("low"), "close", F.col("close").alias("adj_close"), F.greatest(F.floor(volume), F.lit(1)).cast("long").alias("volume"))


def profile(place: Column) -> Column:
    out = F.lit("normal")
    for at, name in PROFILES.items():
        out = F.when(place == at, name).otherwise(out)
    return out


def filings(tickers: DataFrame, last: DataFrame, seed: int = 42) -> DataFrame:
    """(ticker, period_end, filed_date, revenue_ttm, shares, total_debt, cash, ebitda_ttm, eps_ttm): eight quarters up to ``last`` (ticker, date, close).

    The newest period's age makes a filer fresh, stale or overdue; losses have negative earnings, deep ones a negative
    operating result too, and one ticker never files.
    """
    place, q = F.col("place").cast("long"), F.col("q")
    one = F.lit(0).cast("long")
    kind = profile(F.col("place"))
    age = F.when(kind == "stale", LAST_AGE["stale"]).when(kind == "overdue", LAST_AGE["overdue"]).otherwise(AGE)
    rows = tickers.join(last, "ticker").withColumn("kind", kind).where("kind != 'none'").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(QUARTERS - 1).cast("long"))))
    shares = F.floor(1e7 + 1e9 * uniform(place, one, 23, seed))
    revenue = shares * F.col("close") / (2.5 + 11.5 * uniform(place, one, 29, seed)) * F.pow(1.01 + 0.015 * uniform(place, one, 31, seed), q - (QUARTERS - 1))
    margin = F.when(F.col("kind").isin("loss", "deep_loss"), -(0.05 + 0.2 * uniform(place, one, 37, seed))).otherwise(0.04 + 0.14 * uniform(place, one, 41, seed))
    earned = F.when(F.col("kind") == "deep_loss", -(0.02 + 0.08 * uniform(place, q, 43, seed))).otherwise(0.12 + 0.23 * uniform(place, one, 47, seed))
    end = F.date_sub("date", (age + QUARTER_DAYS * (QUARTERS - 1 - q)).cast("int"))
    filed = F.least(F.date_add(end, (35 + F.floor(11 * uniform(place, q, 53, seed))).cast("int")), F.col("date"))
    return rows.select("ticker", end.alias("period_end"), filed.alias("filed_date"), revenue.alias("revenue_ttm"), shares.cast("double").alias("shares"), (revenue * (0.1 + 0.7 * uniform(place, one, 59, seed))).alias("total_debt"),
        (revenue * (0.05 + 0.45 * uniform(place, one, 61, seed))).alias("cash"), (revenue * earned).alias("ebitda_ttm"), (revenue * margin / shares).alias("eps_ttm"))
