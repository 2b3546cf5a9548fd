"""Canonical panel tables, derived from the star-schema tables that are given.

Sums that feed prices are taken over decimals, so they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(c: Column, digits: int = 2) -> Column:
    return F.sum(c.cast(f"decimal(18,{digits})")).cast("double")


def ticker(key: Column) -> Column:
    return F.concat(F.lit("T"), key.cast("string"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, open, high, low, close, adj_close, volume): one row per supplier and ship date.

    Lines are dealt by ticker before they are summed: there is hardly more than one a ticker and date, they are a
    fraction of the sums' size, and windows over a ticker need no other exchange. All that reads bars in a query shares
    the one exchange.
    """
    unit = F.try_divide("l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate is not null and l_suppkey is not null").select(ticker(F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    # joins ask for both keys; said here, all readers' exchanges are the same one
    rows = rows.where("ticker is not null and date is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ticker")
    out = rows.groupBy("ticker", "date").agg(
        F.try_divide(exact_sum(F.col("l_extendedprice")), exact_sum(F.col("l_quantity"))).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum(F.col("l_quantity").cast("long")).alias("volume")
    )
    return out.select("ticker", "date", ((F.col("low") + F.col("high")) / 2).alias("open"), "high", "low", "close", F.col("close").alias("adj_close"), "volume")


def bar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date): the dates of ``daily_bars``, one row each, without the bars."""
    return table(spark, sf_dir, "lineitem").where("l_shipdate is not null and l_suppkey is not null").select(F.to_date("l_shipdate").alias("date")).distinct()


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, close): the price of everything traded on a date."""
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate is not null").groupBy(F.to_date("l_shipdate").alias("date"))
    return rows.agg(F.try_divide(exact_sum(F.col("l_extendedprice")), exact_sum(F.col("l_quantity"))).alias("close"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, name, sector, industry, mktcap): small dimensions are left to Spark's own broadcast threshold."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return rows.select(ticker(F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), (F.col("s_acctbal") * 1e6).alias("mktcap"))


def sector_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket_type, bucket, date, close): price of a sector on a date, kept apart from the tickers' bars."""
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate is not null").withColumn("ticker", ticker(F.col("l_suppkey"))).join(universe(spark, sf_dir).select("ticker", "sector"), "ticker")
    out = rows.groupBy(F.col("sector").alias("bucket"), F.to_date("l_shipdate").alias("date")).agg(F.try_divide(exact_sum(F.col("l_extendedprice")), exact_sum(F.col("l_quantity"))).alias("close"))
    return out.select(F.lit("sector").alias("bucket_type"), "bucket", "date", "close")


def quarterly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, k, period_end, revenue): what a supplier shipped in a calendar quarter."""
    end = F.date_sub(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 3), 1)
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate is not null").select(F.col("l_suppkey").alias("k"), end.alias("period_end"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return rows.groupBy("k", "period_end").agg(exact_sum(F.col("net"), 4).alias("revenue")).select(ticker(F.col("k")).alias("ticker"), "k", "period_end", "revenue")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, period_end, filed_date, effective_eod_date, revenue_ttm, shares, total_debt, cash, ebitda_ttm, eps_ttm).

    Keys ending in 4 never file; those ending in 2 stop in 2000.
    """
    w = Window.partitionBy("ticker").orderBy("period_end")
    four = w.rowsBetween(-3, 0)
    q = quarterly_revenue(spark, sf_dir).withColumn("ttm", F.sum("revenue").over(four)).withColumn("n", F.count("revenue").over(four)).withColumn("first", F.min("period_end").over(four))
    q = q.where((F.col("n") == 4) & F.datediff("period_end", "first").between(250, 295)).where("k % 10 != 4 and (k % 10 != 2 or period_end < date'2000-01-01')")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    q = q.join(s, "k", "left").withColumn("filed_date", F.date_add("period_end", (35 + F.col("k") % 11).cast("int")))
    ttm = F.col("ttm")
    return q.select(
        *("ticker", "period_end", "filed_date"), F.col("filed_date").alias("effective_eod_date"), ttm.alias("revenue_ttm"), (1000.0 + F.col("k")).alias("shares"),
        (ttm * 0.3).alias("total_debt"), (ttm * 0.1).alias("cash"), (ttm * 0.2).alias("ebitda_ttm"), (F.col("s_acctbal") / 1000).alias("eps_ttm"),
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ex_date, ratio)"""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    two = s.where("s_suppkey % 7 = 0").select(ticker(F.col("s_suppkey")).alias("ticker"), F.lit("2001-03-01").cast("date").alias("ex_date"), F.lit(2.0).alias("ratio"))
    fifth = s.where("s_suppkey % 11 = 0").select(ticker(F.col("s_suppkey")).alias("ticker"), F.lit("2001-06-01").cast("date").alias("ex_date"), F.lit(0.2).alias("ratio"))
    return two.unionByName(fifth)


def theme_membership(spark: SparkSession, sf_dir: str, least: float = 0.15) -> DataFrame:
    """(ticker, theme, exposure, as_of_date): each year's shares by customer segment, stated on the next 1 January; small ones as 0."""
    l, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).where("l_shipdate is not null")
    year = F.year("l_shipdate")
    part = rows.groupBy(F.col("l_suppkey").alias("k"), year.alias("y"), F.col("c_mktsegment").alias("theme")).agg(exact_sum(F.col("l_extendedprice")).alias("part"))
    whole = Window.partitionBy("k", "y")
    share = F.round(F.col("part") / F.sum(F.col("part").cast("decimal(18,2)")).over(whole).cast("double"), 6)
    rows = part.withColumn("share", share)
    return rows.select(ticker(F.col("k")).alias("ticker"), "theme", F.when(F.col("share") < least, 0.0).otherwise(F.col("share")).alias("exposure"), F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("as_of_date"))
