"""Market regimes: term structure, a panel of features on one calendar, and models fitted fold by fold.

These are series of one row a date, some thousands of rows however large the panel is that they were summed from, so
windows over a whole series are small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.functions.windows import rolling
from panelwright.operators.series import expanding_share_at_most

# fixed values: edges of the ratio of a short to a long volatility, and the regimes between them
TERM_EDGES = ((-1.0, 0.90, "deep contango"), (0.90, 0.97, "contango"), (0.97, 1.00, "flat"), (1.00, 1.05, "backwardation"), (1.05, 9.0, "deep backwardation"))

#: Bins of a unit of return, in which values are counted before those around the middle are put in order.
BINS = 1024


def dates() -> WindowSpec:
    return Window.partitionBy(F.lit(0)).orderBy("date")


def term_structure(short: DataFrame, long: DataFrame, least: int = 252) -> DataFrame:
    """(date, short, long, ratio, state, days, pct) on the dates that both series (date, value) have.

    ``state`` is backwardation while the ratio is above 1, else contango; ``days`` counts the dates since it last
    changed, ``pct`` is the ratio's share of its own history up to the date.
    """
    both = short.select("date", F.col("value").alias("short")).where("short is not null").join(long.select("date", F.col("value").alias("long")).where("long is not null"), "date")
    rows = both.withColumn("ratio", F.try_divide("short", "long")).where("ratio is not null").withColumn("state", F.when(F.col("ratio") > 1, "backwardation").otherwise("contango"))
    fresh = (~F.col("state").eqNullSafe(F.lag("state").over(dates()))).cast("int")
    rows = rows.withColumn("spell", F.sum(fresh).over(dates()))
    rows = rows.withColumn("days", F.row_number().over(Window.partitionBy("spell").orderBy("date"))).drop("spell")
    share = expanding_share_at_most(rows.withColumn("one", F.lit(1)), "one", "date", "ratio", least).select("date", F.col("share").alias("pct"))
    return rows.join(share, "date", "left")


def returns_by_regime(rows: DataFrame, price: str, horizons: list[int], least: int, edges: tuple = TERM_EDGES) -> DataFrame:
    """(regime, n, and fwd{h} for each horizon): yearly return from the mean of what follows days whose ``ratio`` is in (low, high]; regimes of under ``least`` days are left out."""
    first = horizons[0]
    ahead = rows.withColumns({f"f{h}": F.try_divide(F.lead(price, h).over(dates()), price) - 1 for h in horizons})
    which: Column = F.lit(None).cast("string")
    for low, high, name in edges:
        which = F.when((F.col("ratio") > low) & (F.col("ratio") <= high), name).otherwise(which)
    known = ahead.withColumn("regime", which).where(F.col("regime").isNotNull() & F.col(f"f{first}").isNotNull())
    return known.groupBy("regime").agg(F.count("*").alias("n"), *((F.pow(1 + F.avg(f"f{h}"), F.lit(252.0 / h)) - 1).alias(f"fwd{h}") for h in horizons)).where(F.col("n") >= least)


def lead_lag(rows: DataFrame, level: str, price: str, h: int) -> DataFrame:
    """One row: correlation of a level with the price's return over the h rows before and the h rows after, on days that have both."""
    both = rows.withColumn("before", F.try_divide(price, F.lag(price, h).over(dates())) - 1).withColumn("after", F.try_divide(F.lead(price, h).over(dates()), price) - 1)
    known = both.where(F.col("before").isNotNull() & F.col("after").isNotNull() & F.col(level).isNotNull())
    return known.agg(F.count("*").alias("n"), F.corr(level, "before").alias("with_past"), F.corr(level, "after").alias("with_future"))


def on_calendar(series: DataFrame, calendar: DataFrame, names: list[str], stale: int) -> DataFrame:
    """One row a date of ``calendar``, one column for each name of ``series`` (name, date, value); a gap is filled from at most ``stale`` dates back."""
    wide = calendar.select("date").distinct().join(series.where(F.col("name").isin(names)).groupBy("date").pivot("name", names).agg(F.first("value")), "date", "left")
    recent = dates().rowsBetween(-stale, 0)
    return wide.select("date", *((F.last(n, ignorenulls=True).over(recent) if stale else F.col(n)).alias(n) for n in names))


def price_features(panel: DataFrame, prices: list[str]) -> dict[str, Column]:
    """Volatility, return and fall of each price."""
    by = dates()
    out = {}
    for p in prices:
        out |= {f"{p}_rv{k}": rolling(F.stddev_samp, F.col(f"__{p}"), k, by=by) * F.sqrt(F.lit(252.0)) for k in (5, 22, 63)}
        out |= {f"{p}_ret{k}": F.try_divide(p, F.lag(p, k).over(by)) - 1 for k in (5, 20, 63)}
        out[f"{p}_dd"] = F.try_divide(p, rolling(F.max, F.col(p), 252, 63, by)) - 1
    return out


def score_of(x: Column, by: WindowSpec) -> Column:
    """How many deviations x lies above its mean of 252 rows (63 at least)."""
    return F.try_divide(x - rolling(F.avg, x, 252, 63, by), F.nullif(rolling(F.stddev_samp, x, 252, 63, by), F.lit(0.0)))


def features(panel: DataFrame, prices: list[str], ratios: dict[str, tuple[str, str]], group: list[str], levels: dict[str, list[int]], least: int = 252) -> DataFrame:
    """One row a date with every feature, all of them known on it.

    ``ratios`` names pairs of prices, whose quotient's changes and score are features; ``group`` are prices whose daily
    steps' spread is the dispersion; ``levels`` names other series with the spans of their changes, and each has its
    share of its own history. ``panel`` is the result of ``on_calendar``.
    """
    by = dates()
    steps = {f"__{p}": F.ln(p) - F.ln(F.lag(p).over(by)) for p in {*prices, *group}}
    rows = panel.withColumns(steps | {f"__{n}": F.try_divide(a, b) for n, (a, b) in ratios.items()})
    known = F.array_compact(F.array(*(F.col(f"__{p}") for p in group)))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    spread = F.when(F.size(known) > 0, F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(known)))
    rows = rows.withColumn("dispersion", spread)
    out = price_features(rows, prices)
    for n in ratios:
        x = F.col(f"__{n}")
        out |= {f"{n}_chg{k}": F.try_divide(x, F.lag(x, k).over(by)) - 1 for k in (20, 63)} | {f"{n}_z": score_of(x, by)}
    out["dispersion_z"] = score_of(F.col("dispersion"), by)
    for n, spans in levels.items():
        out |= {f"{n}_chg{k}": F.col(n) - F.lag(n, k).over(by) for k in spans}
    found = rows.select("date", "dispersion", *levels, *(c.alias(n) for n, c in out.items()))
    for n in levels:
        share = expanding_share_at_most(panel.select("date", F.lit(1).alias("one"), n), "one", "date", n, least).select("date", F.col("share").alias(f"{n}_pct"))
        found = found.join(share, "date", "left")
    return found


def logistic(columns: list[str]) -> Pipeline:
    """Medians for what is missing, unit deviations, a logistic model."""
    filled = [f"__{c}" for c in columns]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=columns, outputCols=filled, relativeError=1e-6), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="label", maxIter=100, regParam=1e-3)])


def boosted(columns: list[str], rounds: int = 10, depth: int = 3) -> Pipeline:
    filled = [f"__{c}" for c in columns]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=columns, outputCols=filled, relativeError=1e-6), VectorAssembler(inputCols=filled, outputCol="features"), GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, seed=1)])


def fold_scores(rows: DataFrame, columns: list[str], model: Callable[[list[str]], Pipeline], least: int = 100) -> DataFrame:
    """(fold, date, label, score) of the test rows of ``walk_forward`` (fold, part, date, label, columns): one model a fold, fitted on its train rows alone.

    Rows without a label are neither learnt from nor scored, columns that no train row of a fold has are left out of its model. Folds of fewer than ``least`` labelled train rows, or of one
    label only, are left out. The folds are a handful, each a few jobs of pyspark.ml; scores stay distributed.
    """
    known = rows.where("label is not null").withColumn("label", F.col("label").cast("double"))
    sizes = known.where("part = 'train'").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("label").alias("kinds")).where((F.col("n") >= least) & (F.col("kinds") == 2))
    out = None
    for fold in sorted(r["fold"] for r in sizes.select("fold").collect()):  # a handful of folds
        mine = known.where(F.col("fold") == fold)
        train = mine.where("part = 'train'")
        seen = train.agg(*(F.count(c).alias(c) for c in columns)).first()  # a column that no train row has says nothing
        fitted = model([c for c in columns if seen[c]]).fit(train)
        scored = fitted.transform(mine.where("part = 'test'")).select("fold", "date", "label", vector_to_array("probability")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return known.select("fold", "date", "label", F.lit(0.0).alias("score")).limit(0) if out is None else out


def har_scores(rows: DataFrame, parts: list[str], target: str, least: int = 100) -> DataFrame:
    """(fold, date, label, score): the volatility ahead by least squares on volatilities of a day, a week and a month, fitted on each fold's train rows."""
    known = rows.where("label is not null").dropna(subset=parts)
    train = known.where("part = 'train'").dropna(subset=[target])
    out = None
    for fold in sorted(r["fold"] for r in train.groupBy("fold").count().where(F.col("count") >= least).select("fold").collect()):  # a handful of folds
        make = VectorAssembler(inputCols=parts, outputCol="features")
        fitted = LinearRegression(labelCol=target, solver="normal").fit(make.transform(train.where(F.col("fold") == fold)))
        scored = fitted.transform(make.transform(known.where((F.col("fold") == fold) & (F.col("part") == "test")))).select("fold", "date", F.col("label").cast("double").alias("label"), F.col("prediction").alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return known.select("fold", "date", F.col("label").cast("double").alias("label"), F.lit(0.0).alias("score")).limit(0) if out is None else out


def against_baselines(metrics: DataFrame, model: str) -> DataFrame:
    """(folds, auc_mean, auc_std, auc_min, gap_mean, win_rate) from (model, fold, auc): a model's areas, and how they differ fold by fold from the best of the others'."""
    own = metrics.where(F.col("model") == model).select("fold", F.col("auc").alias("own"))
    best = metrics.where(F.col("model") != model).groupBy("fold").agg(F.max("auc").alias("best"))
    both = own.join(best, "fold", "left").where("own is not null")
    gap = F.col("own") - F.col("best")
    return both.agg(F.count("*").alias("folds"), F.avg("own").alias("auc_mean"), F.stddev_pop("own").alias("auc_std"), F.min("own").alias("auc_min"), F.avg(gap).alias("gap_mean"), F.avg((gap > 0).cast("int")).alias("win_rate"))


def entry_study(rows: DataFrame, score: str, entries: dict[str, float], returns: list[str], persist: int = 5) -> DataFrame:
    """(segment, variant, horizon, n, event_median, base_median, lift, event_over_10, base_over_10): days on which a score first reaches a threshold, against all days of the segment.

    ``entries`` names thresholds; for the first of them there is a variant that also asks for the score to be there
    ``persist`` rows on. ``rows`` has ticker, date, segment, the score and the returns ahead, which are clipped.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    steps = sorted(set(entries.values()))
    # all that is asked of a score is which thresholds it reaches, so rows are dealt by ticker with a byte and not the score
    rows = rows.select("ticker", "date", "segment", *returns, F.when(F.col(score).isNotNull(), sum(((F.col(score) >= t).cast("byte") for t in steps), F.lit(0).cast("byte"))).cast("byte").alias("__level"))
    s, before, later = F.col("__level"), F.lag("__level").over(w), F.lead("__level", persist).over(w)
    place = {t: k for k, t in enumerate(steps, 1)}
    (first, low), *_ = entries.items()
    flags = {name: (s >= place[t]) & (before < place[t]) for name, t in entries.items()} | {f"{first}, stays": (s >= place[low]) & (before < place[low]) & (later >= place[low])}
    marked = rows.select("segment", *returns, *(F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("horizon"), F.greatest(F.lit(-0.95), F.least(F.lit(10.0), F.col(r))).alias("x"), F.col(r).isNotNull().alias("ok")) for r in returns)))
    long = marked.select("segment", each.alias("h"), *flags).where("h.ok").select("segment", "h.horizon", "h.x", F.floor(F.col("h.x") * BINS).alias("bin"), *flags)
    found = _medians(long, {"": F.lit(True)} | {n: F.col(n) for n in flags})
    of_all = lambda c: F.max(F.when(F.col("variant") == "", F.col(c))).over(Window.partitionBy("segment", "horizon"))
    found = found.select("segment", "horizon", "variant", "n", F.col("median").alias("event_median"), of_all("median").alias("base_median"), F.col("over").alias("event_over_10"), of_all("over").alias("base_over_10")).where("variant <> ''")
    return found.withColumn("lift", F.col("event_median") - F.col("base_median"))


def _medians(long: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """(segment, horizon, variant, n, median, over: the share above 0.10) of the rows of ``long`` (segment, horizon, x, bin, ...) that each variant takes.

    Values are counted by bin first, which says in which bins the middle ones lie, and only values of these bins are
    put in order. So no group's values meet in one task, and the rows, read twice, aren't dealt again.
    """
    group = ["segment", "horizon", "variant"]
    whole = Window.partitionBy(*group)
    counts = long.groupBy("segment", "horizon", "bin").agg(F.array(*(F.struct(F.lit(v).alias("variant"), F.count(F.when(c, 1)).alias("n"), F.count(F.when(c & (F.col("x") > 0.10), 1)).alias("over")) for v, c in variants.items())).alias("found"))
    counts = counts.select("segment", "horizon", "bin", F.inline("found")).where("n > 0")
    until = F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select(*group, "bin", "n", (until - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"), F.sum("over").over(whole).alias("over"))
    first, second = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda place: (place >= F.col("before")) & (place < F.col("before") + F.col("n"))
    middle = placed.where(holds(first) | holds(second)).select(*group, "bin", "before", "total", "over")  # two bins of a group at most

    taken = long.select("segment", "horizon", "x", "bin", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(v)) for v, c in variants.items())))).alias("variant"))
    values = taken.join(F.broadcast(middle), [*group, "bin"]).groupBy(*group, "bin", "x").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("before", "total", "over")))
    until = F.col("before") + F.sum("n").over(Window.partitionBy(*group, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("before", F.coalesce(until, "before"))
    ends = values.groupBy(*group).agg(F.first("total").alias("n"), F.first("over").alias("over"), *(F.max(F.when(holds(place), F.col("x"))).alias(c) for c, place in (("a", first), ("b", second))))
    return ends.select(*group, "n", (F.col("a") * 0.5 + F.col("b") * 0.5).alias("median"), (F.col("over") / F.col("n")).alias("over"))


def segment_of(rows: DataFrame, share: float = 0.6, dates: DataFrame | None = None) -> DataFrame:
    """Adds ``segment``: TRAIN on dates before the one at ``share`` of all dates, TEST from it on. ``dates``: the dates of ``rows``, where they are had for less."""
    whole = Window.partitionBy(F.lit(0))
    days = (rows if dates is None else dates).select("date").distinct().select("date", (F.row_number().over(whole.orderBy("date")) - 1).alias("o"), F.count(F.lit(1)).over(whole).alias("c"))  # one row a date
    return rows.join(F.broadcast(days.select("date", F.when(F.col("o") < F.floor(F.col("c") * share), "TRAIN").otherwise("TEST").alias("segment"))), "date")
