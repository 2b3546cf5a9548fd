"""How rises begin: ignition, first days above a threshold, signatures against nested baselines, variants of the screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import average_rank, average_rank_share, by_ticker, lagged_return, rolling
from panelwright.operators.asof import meet
from panelwright.operators.series import spaced

IGNITION = ("accel", "expand", "vsurge", "breakout", "rsturn")


def ignition(bars: DataFrame, market: DataFrame, *carried: str) -> DataFrame:
    """(ticker, date, accel, expand, vsurge, breakout, rsturn, ignition, ignition_pct), with columns of ``bars`` carried along.

    Five measures of a ticker against its own past: pace of 10 rows less that of 50, size of daily steps and volume
    against the last 60, closeness to the high of 60 while above the average of 50, and the turn of its line against
    the market. ``ignition`` is 100 times the mean of their rank shares on a date, of those that are known, and
    ``ignition_pct`` its own rank share.
    """
    px, by = F.col("adj_close"), by_ticker()
    rows = bars.select("ticker", "date", "adj_close", *carried, F.coalesce(F.col("volume"), F.lit(0)).cast("double").alias("v")).join(F.broadcast(market.select("date", F.col("close").alias("m"))), "date", "left")  # one row a date
    rows = rows.withColumn("line", F.try_divide(px, F.last("m", ignorenulls=True).over(by))).withColumn("move", F.abs(px - F.lag(px).over(by)))
    line = F.col("line")
    above = F.coalesce((px > rolling(F.avg, px, 50)).cast("double"), F.lit(0.0))
    rows = rows.select(
        *("ticker", "date", *carried), (lagged_return(px, 10) / 10 - lagged_return(px, 50) / 50).alias("accel"),
        F.try_divide(rolling(F.avg, F.col("move"), 10), F.nullif(rolling(F.avg, F.col("move"), 60), F.lit(0.0))).alias("expand"),
        F.try_divide(rolling(F.avg, F.col("v"), 5), F.nullif(rolling(F.avg, F.col("v"), 60), F.lit(0.0))).alias("vsurge"),
        (F.try_divide(px, rolling(F.max, px, 60)) * above).alias("breakout"), (lagged_return(line, 10) - lagged_return(line, 30) / 3).alias("rsturn"),
    )
    shares = F.array_compact(F.array(*(F.col(f"__{c}") for c in IGNITION)))
    ranked = rows.withColumns({f"__{c}": average_rank_share(F.col(c), "date") for c in IGNITION})
    ranked = ranked.withColumn("ignition", 100 * F.try_divide(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.size(shares))).drop(*(f"__{c}" for c in IGNITION))
    return ranked.withColumn("ignition_pct", 100 * average_rank_share(F.round("ignition", 9), "date"))


def launch_dates(bars: DataFrame, high_share: float = 0.35, window: int = 60, least: int = 20, gain: float = 1.15, fallback: float = 0.20) -> DataFrame:
    """(ticker, t0, p0): the first day above the high of the ``window`` rows before it, below ``high_share`` of the ticker's
    highest price ever, after which a close within ``window`` rows is over ``gain`` times its own; else the first day
    above ``fallback`` of that highest price."""
    px, by = F.col("adj_close"), by_ticker()
    top = F.max("adj_close").over(Window.partitionBy("ticker"))
    before = F.when(F.count("adj_close").over(by.rowsBetween(-window, -1)) >= least, F.max("adj_close").over(by.rowsBetween(-window, -1)))
    rows = bars.where("adj_close is not null").select("ticker", "date", "adj_close", top.alias("top"), before.alias("before"), F.max("adj_close").over(by.rowsBetween(1, window)).alias("next"))
    launch = (px > F.col("before")) & (px < high_share * F.col("top")) & (F.col("next") > px * gain)
    out = rows.groupBy("ticker").agg(F.min(F.when(launch, F.struct("date", "adj_close"))).alias("x"), F.min(F.when(px > fallback * F.col("top"), F.struct("date", "adj_close"))).alias("y"))
    return out.select("ticker", F.coalesce("x.date", "y.date").alias("t0"), F.coalesce("x.adj_close", "y.adj_close").alias("p0"))


def first_lit(launches: DataFrame, scores: DataFrame, bars: DataFrame, names: list[str], threshold: float = 90.0) -> DataFrame:
    """(ticker, t0, p0, and for each score its first date from t0 on at the threshold, whole weeks until then, and the rise since p0).

    A ticker and date may have several rows of ``scores``, each with some of them. Only rows at the threshold go to the
    bars' places, as a flag a score.
    """
    lit = [(F.col(n) >= threshold).alias(n) for n in names]
    hits = scores.select("ticker", "date", *lit).where(" or ".join(f"`{n}`" for n in names)).groupBy("ticker", "date").agg(*(F.max(n).alias(n) for n in names))
    met = meet(bars.select("ticker", "date", "adj_close", F.lit(True).alias("__bar")), hits, "ticker", "date").where(F.col("__bar") & F.coalesce(*names).isNotNull())
    after = met.join(launches.select("ticker", "t0"), "ticker").where(F.col("date") >= F.col("t0"))
    found = after.groupBy("ticker").agg(*(F.min(F.when(F.col(n), F.struct("date", "adj_close"))).alias(n) for n in names))
    out = launches.join(found, "ticker", "left")
    each = [(F.col(f"{n}.date").alias(f"{n}_lit"), F.floor(F.datediff(f"{n}.date", "t0") / 7).cast("long").alias(f"{n}_weeks"), (F.try_divide(f"{n}.adj_close", "p0") - 1).alias(f"{n}_runup")) for n in names]
    return out.select("ticker", "t0", "p0", *(c for three in each for c in three))


def signature_features(bars: DataFrame) -> DataFrame:
    """(ticker, date, i, close, dd252, min_dd_126, rvol126, dist_ma200, reclaim): how washed out and how volatile a ticker is, and whether it has just crossed above its average of 50."""
    px, by = F.col("close"), by_ticker()
    rows = bars.where("close is not null").select(
        *("ticker", "date", "close"), (F.row_number().over(by) - 1).cast("long").alias("i"), F.coalesce(F.ln(px) - F.ln(F.lag(px).over(by)), F.lit(0.0)).alias("step"),
        (F.try_divide(px, rolling(F.max, px, 252, 120)) - 1).alias("dd252"), (F.try_divide(px, rolling(F.avg, px, 200, 120)) - 1).alias("dist_ma200"), F.coalesce(px > rolling(F.avg, px, 50), F.lit(False)).alias("above"),
    )
    return rows.select(
        *("ticker", "date", "i", "close", "dd252"), rolling(F.min, F.col("dd252"), 126, 40).alias("min_dd_126"), (rolling(F.stddev_samp, F.col("step"), 126, 60) * F.sqrt(F.lit(252.0))).alias("rvol126"),
        "dist_ma200", (F.col("above") & ~F.coalesce(F.lag("above").over(by), F.lit(False))).alias("reclaim"),
    )


def launch_signature(features: DataFrame, low_rows: int = 504, least: int = 300) -> DataFrame:
    """(ticker, low, launch, dd252, min_dd_126, rvol126, dist_ma200): each ticker's features at the first crossing from its lowest close of the last ``low_rows`` rows on, or at that low."""
    w = Window.partitionBy("ticker")
    rows = features.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= least)
    low = F.min(F.when(F.col("i") >= F.col("n") - low_rows, F.struct("close", "i"))).over(w)
    rows = rows.withColumn("low_i", low["i"])
    state = F.struct("date", "dd252", "min_dd_126", "rvol126", "dist_ma200")
    found = rows.groupBy("ticker").agg(F.min(F.when(F.col("i") == F.col("low_i"), F.col("date"))).alias("low"), F.min_by(state, F.when(F.col("i") == F.col("low_i"), F.col("i"))).alias("at_low"),
        F.min_by(state, F.when(F.col("reclaim") & (F.col("i") >= F.col("low_i")), F.col("i"))).alias("turn"))
    return found.withColumn("x", F.coalesce("turn", "at_low")).select("ticker", "low", F.col("x.date").alias("launch"), "x.dd252", "x.min_dd_126", "x.rvol126", "x.dist_ma200")


def baselines(features: DataFrame, h: int, rise: float, washout: float, vol: float, reclaim: bool = True, spacing: int = 126, least: int = 300) -> DataFrame:
    """(population, n, k): rows whose best close of the next ``h`` rows is up by ``rise``, out of all rows with h rows ahead,
    the volatile ones, those that are washed out as well, and the signal's events, ``spacing`` rows apart in a ticker."""
    by = by_ticker()
    best = F.when(F.lead("close", h).over(by).isNotNull(), F.max("close").over(by.rowsBetween(1, h)))
    rows = features.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).withColumn("drawup", F.try_divide(best, "close") - 1).where((F.col("n") >= least + h) & F.col("drawup").isNotNull())
    volatile, washed = F.coalesce(F.col("rvol126") >= vol, F.lit(False)), F.coalesce(F.col("min_dd_126") <= -washout, F.lit(False))
    rows = rows.select("ticker", "i", (F.col("drawup") >= rise).cast("int").alias("y"), volatile.alias("volatile"), (volatile & washed).alias("washed"), (volatile & washed & (F.col("reclaim") | F.lit(not reclaim))).alias("signal"))
    parts = {"all": F.lit(True), "volatile": F.col("volatile"), "volatile and washed out": F.col("washed")}
    count = lambda held: F.struct(F.sum(held.cast("long")).alias("n"), F.sum(F.when(held, F.col("y")).otherwise(0)).alias("k"))
    events = F.array_sort(F.collect_list(F.when(F.col("signal"), F.struct("i", "y"))))
    # a ticker's rows lie together here, so all is counted in the pass that windows them
    each = rows.groupBy("ticker").agg(*(count(held).alias(p) for p, held in parts.items()), spaced(events, "i", spacing).alias("events"))
    each = each.withColumn("signal", F.struct(F.size("events").cast("long").alias("n"), F.aggregate("events.y", F.lit(0).cast("long"), lambda a, y: a + y).alias("k")))
    total = each.agg(F.array(*(F.struct(F.lit(p).alias("population"), *(F.sum(F.col(f"`{p}`.{x}")).alias(x) for x in "nk")) for p in (*parts, "signal"))).alias("found"))
    return total.select(F.explode("found").alias("x")).select("x.population", "x.n", "x.k").where("n > 0")


#: The five gates that a screen can have, each with what it ranks by.
def variants() -> dict[str, Column]:
    c, up = F.col, F.col("net10") > 0
    return {
        "net": c("net10"), "strict": F.when((c("ker10") >= 0.6) & (c("ddw10") >= -0.05) & up, c("net10")), "net_times_ker": F.when(up, c("net10") * c("ker10")),
        "up_days": F.when((c("up10") >= 0.6) & up, c("net10")), "loose": F.when((c("ker10") >= 0.5) & (c("ddw10") >= -0.08) & up, c("net10")),
    }


def variant_ranks(metrics: DataFrame) -> DataFrame:
    """(variant, ticker, date, place): the rank of every row by every variant on its date, ties sharing their mean place; rows that a gate shuts out are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), score.alias("score")) for n, score in variants().items())))
    rows = metrics.select("ticker", "date", each.alias("x")).select("ticker", "date", "x.variant", "x.score").where("score is not null")
    return rows.select("variant", "ticker", "date", average_rank(-F.col("score"), "variant", "date").alias("place"))


def pick_quality(metrics: DataFrame, ranks: DataFrame, bars: DataFrame, top_n: int, h: int = 21) -> DataFrame:
    """(variant, n, net10, ker10, up10, ddw10, spike, ret): medians over all picks; ``spike`` is the largest daily step of ten against the whole move, ``ret`` the return of the next h rows."""
    px, by = F.col("adj_close"), by_ticker()
    rows = bars.select("ticker", "date", "adj_close", (F.ln(px) - F.ln(F.lag(px).over(by))).alias("step"))
    total = F.abs(rolling(F.sum, F.col("step"), 10))
    rows = rows.select("ticker", "date", (rolling(F.max, F.col("step"), 10) / F.greatest(total, F.lit(1e-9))).alias("spike"), (F.try_divide(F.lead(px, h).over(by), px) - 1).alias("ret"))
    picks = ranks.where(F.col("place") <= top_n).join(metrics.select("ticker", "date", "net10", "ker10", "up10", "ddw10"), ["ticker", "date"]).join(rows, ["ticker", "date"])
    return picks.groupBy("variant").agg(F.count("*").alias("n"), *(F.median(c).alias(c) for c in ("net10", "ker10", "up10", "ddw10", "spike", "ret")))


def list_overlap(ranks: DataFrame, dates: DataFrame, top_n: int) -> DataFrame:
    """(variant, days, jaccard): median overlap of the lists of neighbouring dates, of those of which one isn't empty."""
    order = Window.partitionBy(F.lit(0)).orderBy("date")
    numbered = dates.select("date").distinct().select("date", F.lead("date").over(order).alias("next"))  # one row a date
    picks = ranks.where(F.col("place") <= top_n).select("variant", "ticker", "date")
    later = picks.join(numbered.select("date", F.col("next")), "date").where("next is not null").select("variant", "ticker", F.col("next").alias("date"), F.lit(1).alias("was"))
    seen = picks.join(numbered, "date").withColumn("is", F.lit(1)).join(later, ["variant", "ticker", "date"], "full").join(numbered.agg(F.min("date").alias("first")), F.col("date") > F.col("first"))
    days = seen.groupBy("variant", "date").agg((F.sum(F.coalesce(F.col("is") * F.col("was"), F.lit(0))) / F.count("*")).alias("j"))
    return days.groupBy("variant").agg(F.count("*").alias("days"), F.median("j").alias("jaccard"))


def biggest_runs(bars: DataFrame, rows_before: int = 189) -> DataFrame:
    """(ticker, trough, peak, trough_i, peak_i, run): the day of a ticker's highest price, and of the lowest among that and the ``rows_before`` - 1 rows before it."""
    rows = bars.where("adj_close is not null").select("ticker", "date", "adj_close", (F.row_number().over(by_ticker()) - 1).cast("long").alias("i"))
    w = Window.partitionBy("ticker")
    top = F.max(F.struct("adj_close", (-F.col("i")).alias("back"))).over(w)
    rows = rows.withColumn("peak_i", -top["back"]).where((F.col("i") <= F.col("peak_i")) & (F.col("i") > F.col("peak_i") - rows_before))
    low = rows.groupBy("ticker", "peak_i").agg(F.min(F.struct("adj_close", "i", "date")).alias("low"), F.max(F.when(F.col("i") == F.col("peak_i"), F.struct("adj_close", "date"))).alias("high"))
    return low.select("ticker", F.col("low.date").alias("trough"), F.col("high.date").alias("peak"), F.col("low.i").alias("trough_i"), "peak_i", (F.try_divide("high.adj_close", "low.adj_close") - 1).alias("run"))


def first_listed(runs: DataFrame, ranks: DataFrame, bars: DataFrame, top_n: int) -> DataFrame:
    """(ticker, variant, trough, peak, run, listed, day, gained): the first day from trough to peak on each variant's list, rows since the trough and the rise until then; NULL where there is none."""
    numbered = bars.where("adj_close is not null").select("ticker", "date", "adj_close", (F.row_number().over(by_ticker()) - 1).cast("long").alias("i"))
    hits = ranks.where(F.col("place") <= top_n).join(runs.select("ticker", "trough", "peak"), "ticker").where((F.col("date") >= F.col("trough")) & (F.col("date") <= F.col("peak")))
    first = hits.groupBy("ticker", "variant").agg(F.min("date").alias("listed")).join(numbered.select("ticker", F.col("date").alias("listed"), F.col("i").alias("at"), F.col("adj_close").alias("price")), ["ticker", "listed"])
    base = runs.join(numbered.select("ticker", F.col("i").alias("trough_i"), F.col("adj_close").alias("low")), ["ticker", "trough_i"])
    names = base.withColumn("variant", F.explode(F.array(*(F.lit(n) for n in variants()))))
    return names.join(first, ["ticker", "variant"], "left").select("ticker", "variant", "trough", "peak", "run", "listed", (F.col("at") - F.col("trough_i")).alias("day"), (F.try_divide("price", "low") - 1).alias("gained"))
