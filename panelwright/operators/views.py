"""Shapes that reports are made of: grids over common dates, aligned series, places of dates in a calendar, splits of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.asof import as_of

# fixed values: sector names of a listing source and the taxonomy's names for them; all others pass through
SECTOR_NAMES = {"Technology": "Information Technology", "Finance": "Financials", "Telecommunications": "Communication Services", "Basic Materials": "Materials"}


def renamed(x: Column, names: dict[str, str] | None = None) -> Column:
    """Names of one taxonomy in another; what the map does not have stays, NULL and empty are NULL."""
    pairs = [F.lit(v) for pair in (SECTOR_NAMES if names is None else names).items() for v in pair]
    return F.nullif(F.coalesce(F.create_map(*pairs)[x], x), F.lit(""))


def panel_grid(rows: DataFrame, dates: int) -> DataFrame:
    """(ticker, place, date, columns of rows): tickers with a row on the last date, on each of the last ``dates`` dates; NULL where they have none."""
    columns = [c for c in rows.columns if c not in ("ticker", "date")]
    axis = rows.select("date").distinct().orderBy(F.desc("date")).limit(dates)
    days = axis.agg(F.array_sort(F.collect_list("date")).alias("days"))  # one short row
    shown = rows.join(F.broadcast(days), F.col("date") == F.element_at("days", -1)).select("ticker", F.posexplode("days").alias("place", "date"))
    return shown.join(rows, ["ticker", "date"], "left").select("ticker", "place", "date", *columns)


def aligned(series: DataFrame, key: str, at: str, value: str, keys: list[str]) -> DataFrame:
    """One column per series on the dates that all of them have."""
    return series.groupBy(at).pivot(key, keys).agg(F.first(value)).dropna()


def trading_day_index(rows: DataFrame, bars: DataFrame, at: str) -> DataFrame:
    """``rows`` with the place, from 0, of the ticker's last trading day up to a date (NULL before its first)."""
    days = bars.select("ticker", "date", (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).alias("day_index"))
    return as_of(rows, days, "ticker", at, "date")


def leave_one_out(rows: DataFrame, at: str, episodes: list[tuple[str, str, str]], purge: int) -> DataFrame:
    """(episode, part, rows): for each episode its rows as test, and as train those more than ``purge`` days away from it."""
    day = F.col(at)
    spans = F.array(*(F.struct(F.lit(n).alias("episode"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in episodes))
    out = rows.select("*", F.explode(spans).alias("e"))
    part = F.when(day.between(F.col("e.a"), F.col("e.b")), "test").when((day < F.date_sub("e.a", purge)) | (day > F.date_add("e.b", purge)), "train")
    return out.select(F.col("e.episode").alias("episode"), part.alias("part"), *rows.columns).where("part is not null")


def instant_value(filings: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """``filings`` with the value at the latest end up to ``period_end`` of a balance, whose first filing of each end counts."""
    first = facts.groupBy("ticker", "end").agg(F.min_by("val", F.struct("filed", "val")).alias(name))
    return as_of(filings, first, "ticker", "period_end", "end")


def between_snapshots(grid: DataFrame, x: str, y: str, state: str, phases: list[float]) -> DataFrame:
    """(ticker, place, phase, x, y, state, fade): a point on its way from each place of a panel grid to the next.

    ``x`` moves evenly in its logarithm, ``y`` evenly, and ``state`` is the nearer place's. Where one of the two places
    has no point, the other's stands still and fades; where neither has one there is no row.
    """
    by = Window.partitionBy("ticker").orderBy("place")
    here, there = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(x, y, state)), F.col("there")
    pairs = grid.select("ticker", "place", here.alias("here"), F.lead(here).over(by).alias("there"), F.lead("place").over(by).alias("next")).where("next is not null and (here is not null or there is not null)")
    rows = pairs.select("*", F.explode(F.array(*(F.lit(float(p)) for p in phases))).alias("phase"))
    here, t, both = F.col("here"), F.col("phase"), F.col("here").isNotNull() & F.col("there").isNotNull()
    low, high = (F.log10(F.greatest(p[x], F.lit(1e-9))) for p in (here, there))
    only = F.coalesce(here, there)
    return rows.select(
        "ticker", "place", "phase",
        F.when(both, F.pow(F.lit(10.0), low + (high - low) * t)).otherwise(only[x]).alias(x), F.when(both, here[y] + (there[y] - here[y]) * t).otherwise(only[y]).alias(y),
        F.when(both & (t >= 0.5), there[state]).otherwise(only[state]).alias(state), F.when(both, 1.0).when(here.isNotNull(), 1.0 - t).otherwise(t).alias("fade"),
    )
