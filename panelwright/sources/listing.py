"""Listings of a screener, identifiers of filers, definitions of themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "symbol string, name string, sector string, industry string, country string, marketCap string"
#: fixed value: the most that one member weighs in a theme that doesn't say
CAP = 0.30


def tidy(c: str) -> Column:
    """Trimmed, and NULL where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def money(c: str) -> Column:
    """A number out of text with a currency sign and separators; NULL for 0 and for what is no number."""
    return F.nullif(F.expr(f"try_cast(regexp_replace({c}, '[$, ]', '') as double)"), F.lit(0.0))


def listed(rows: DataFrame, json: str) -> DataFrame:
    """(ticker, name, sector, country, mktcap) of a listing's JSON rows: no share classes, and of a ticker's rows the largest."""
    x = rows.select(F.from_json(json, ROW).alias("x")).select("x.*")
    x = x.select(F.upper(F.trim("symbol")).alias("ticker"), *(tidy(c).alias(c) for c in ("name", "sector", "country")), money("marketCap").alias("mktcap"))
    kept = x.where("ticker != '' and not ticker rlike '[\\\\^/]'")
    size = F.coalesce("mktcap", F.lit(0.0))
    return kept.groupBy("ticker").agg(F.max_by(F.struct("name", "sector", "country", "mktcap"), F.struct(size, F.coalesce("name", F.lit("")))).alias("x")).select("ticker", "x.*")


def with_identifiers(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """``targets`` (ticker) with ``identifier``: ten digits with zeros in front, NULL where the map (ticker, id) has none."""
    known = ids.select(F.upper(F.trim("ticker")).alias("ticker"), F.lpad(F.col("id").cast("string"), 10, "0").alias("identifier")).dropDuplicates(["ticker"])
    return targets.join(known, "ticker", "left")


def theme_definitions(spark: SparkSession, definitions: dict[str, dict]) -> DataFrame:
    """(theme, cap, header, keywords) of a dictionary such as a configuration file holds; a theme without a header has its key, without a cap the usual one."""
    rows = [(key, float(d.get("cap", CAP)), d.get("header", key), list(d.get("keywords", []))) for key, d in definitions.items()]
    return spark.createDataFrame(rows, "theme string, cap double, header string, keywords array<string>")
