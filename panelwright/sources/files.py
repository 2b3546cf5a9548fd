"""Readers of small text formats and writers of snapshot documents. All go through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seed_list(spark: SparkSession, path: str) -> DataFrame:
    """(ticker): one per line; what follows # is a comment."""
    t = F.upper(F.trim(F.split("value", "#")[0]))
    return spark.read.text(path).select(t.alias("ticker")).where("ticker != ''").distinct()


def last_token_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, code): the last word of a line is the code of what stands before it."""
    line = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("l")).where("l != ''")
    return line.select(F.trim(F.regexp_extract("l", "^(.*)\\s(\\S+)$", 1)).alias("name"), F.regexp_extract("l", "^(.*)\\s(\\S+)$", 2).alias("code"))


def sentinel_csv(spark: SparkSession, path: str, missing: str = ".") -> DataFrame:
    """(date, value) of a two-column CSV in which a sign stands for no value; such rows are left out."""
    rows = spark.read.csv(path, header=True, nullValue=missing).toDF("date", "value")
    return rows.select(F.to_date("date").alias("date"), F.expr("try_cast(value as double)").alias("value")).where("date is not null and value is not null")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one small file with their numbers: the file is one row, its lines an array."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def block_csv(spark: SparkSession, path: str, title: str, missing: tuple[float, ...] = (-99.99, -999.0)) -> DataFrame:
    """(date, place, value): the rows with an 8-digit date in the block under a title, up to the first line that is none."""
    lines = _numbered(spark, path).withColumn("row", F.col("line").rlike("^\\s*\\d{8}\\s*,"))
    w = Window.partitionBy(F.lit(0)).orderBy("n")
    seen = lines.withColumn("title", F.max(F.when(F.contains("line", F.lit(title)), F.col("n"))).over(w))
    body = seen.where("title is not null and n > title").withColumn("start", F.min(F.when(F.col("row"), F.col("n"))).over(Window.partitionBy(F.lit(0))))
    stop = F.min(F.when(~F.col("row") & (F.col("n") > F.col("start")), F.col("n"))).over(Window.partitionBy(F.lit(0)))
    block = body.withColumn("stop", stop).where("row and n >= start and (stop is null or n < stop)")
    parts = block.select(F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("p"))
    cells = parts.select(F.to_date(F.col("p")[0], "yyyyMMdd").alias("date"), F.posexplode(F.slice("p", 2, 1000)).alias("place", "v"))
    value = F.expr("try_cast(v as double)")
    return cells.select("date", "place", F.when(value.isin(*missing), None).otherwise(value).alias("value"))


def sectioned_list(spark: SparkSession, path: str, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((theme, ticker), unmapped headers): a header line sets the theme of the tickers that follow it.

    Headers end with a colon; ``headers`` maps their text to a theme.
    """
    lines = _numbered(spark, path).withColumn("line", F.trim("line")).where("line != ''")
    is_head = F.col("line").endswith(":")
    w = Window.partitionBy(F.lit(0)).orderBy("n")
    rows = lines.withColumn("header", F.last(F.when(is_head, F.expr("substring(line, 1, length(line) - 1)")), ignorenulls=True).over(w)).where(~is_head)
    mapped = rows.join(headers, "header", "left")
    members = mapped.where("theme is not null").select("theme", F.upper("line").alias("ticker")).distinct()
    return members, mapped.where("theme is null and header is not null").select("header").distinct()


def approved_members(spark: SparkSession, path: str, themes: DataFrame) -> DataFrame:
    """(theme, ticker, exposure, approved_by) of a JSON array; rows without an approver, of unknown themes or out of [0, 1] are left out."""
    rows = spark.read.json(path, multiLine=True, schema="theme string, ticker string, exposure double, approved_by string")
    return rows.where("exposure between 0 and 1 and trim(approved_by) != ''").join(themes.select("theme").distinct(), "theme", "left_semi").select("theme", F.upper("ticker").alias("ticker"), "exposure", "approved_by")


def write_snapshot(rows: DataFrame, path: str) -> DataFrame:
    """One Parquet file of a small cross-section, and a frame with what was written: rows and distinct tickers."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot with its dates as ISO text."""
    rows = spark.read.parquet(path)
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, t in rows.dtypes if t == "date"})


def write_documents(rows: DataFrame, path: str, shard: str | None = None) -> None:
    """One compact JSON document per row; with ``shard``, in a folder per value, and folders of values that are gone go."""
    if shard is None:
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
    else:
        rows.select(F.col(shard), F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").partitionBy(shard).text(path)
