"""Predicates and guards of single values and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def data_age(d: Column, today: Column) -> Column:
    """fresh up to 3 days, aging up to 7; stale beyond, ahead of today or unknown."""
    n = F.datediff(today, d)
    return F.when(n.isNull() | (n < 0), "stale").when(n <= 3, "fresh").when(n <= 7, "aging").otherwise("stale")


def safe_number(x: Column) -> Column:
    """NULL for what no document may hold: NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def renderable(x: Column, digits: int = 2) -> Column:
    return F.when(F.round(x, digits) > 0, F.round(x, digits))


def in_rectangle(x: str, y: str, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Inside the rectangle of two corners, in whatever order they are given."""
    return F.col(x).between(min(a[0], b[0]), max(a[0], b[0])) & F.col(y).between(min(a[1], b[1]), max(a[1], b[1]))


#: Different places of a cell that a query looks at one by one; halvings of a cell's sides in a round, and rounds at most.
LEAF, HALVINGS, ROUNDS = 32, 2, 12


def nearest(queries: DataFrame, points: DataFrame, key: str, at: tuple[str, str], radius: float) -> DataFrame:
    """(key, nearest): for each stated point the closest other one within the radius (smallest key among equals).

    Points at one place are one row with their two smallest keys. Places lie in a grid of about the radius, whose cells are
    divided round by round until none holds more than LEAF places. Each query starts with the nine cells around its own
    and keeps, of each round's cells, those whose nearest corner is no farther than the farthest corner of a cell that
    surely holds another point; the corners are those of the points inside. So it meets the places near it and no others,
    however crowded a cell is, and the closest one always stays.
    """
    known = lambda df: df.where(" and ".join(f"abs({c}) < double('inf')" for c in ("__x", "__y")))  # noqa: E731  neither NULL nor NaN
    where = [F.col(c).cast("double").alias(n) for c, n in zip(at, ("__x", "__y"), strict=True)]
    own = known(points.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), *where))
    first = own.groupBy("__x", "__y").agg(F.min("__k").alias("__k1"), F.max("__k").alias("__top"))
    second = own.join(first.where("__k1 != __top").drop("__top"), ["__x", "__y"]).where("__k != __k1").groupBy("__x", "__y").agg(F.min("__k").alias("__k2"))
    places = first.join(second, ["__x", "__y"], "left").select("__x", "__y", "__k1", "__k2", "__top")

    # a little wider than the radius, so that rounding puts no point two cells away; halved exactly, so that parts lie within their cell
    side, parts = radius * 1.001, 1 << HALVINGS
    in_cell = lambda c, rounds: F.floor(F.col(c) / (side / parts**rounds)).cast("long")
    crowd = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), in_cell("__x", r).alias("i"), in_cell("__y", r).alias("j")) for r in range(ROUNDS + 1))))
    held = places.select(crowd.alias("c")).groupBy("c").agg(F.count("*").alias("n")).groupBy("c.r").agg(F.max("n").alias("n"))
    rounds = min([r.r for r in held.where(F.col("n") <= LEAF).collect()], default=ROUNDS)  # at most ROUNDS + 1 rows

    def cells(r: int) -> DataFrame:
        """Cells of round r with their parent's place, corners and the range of their keys."""
        up = [F.shiftright(c, HALVINGS).alias(p) if r else F.col(c).alias(p) for c, p in (("__i", "__pi"), ("__j", "__pj"))]
        found = places.groupBy(in_cell("__x", r).alias("__i"), in_cell("__y", r).alias("__j")).agg(
            F.min("__x").alias("__x0"), F.max("__x").alias("__x1"), F.min("__y").alias("__y0"), F.max("__y").alias("__y1"), F.min("__k1").alias("__low"), F.max("__top").alias("__high")
        )
        return found.select("*", *up)

    square = lambda dx, dy: dx * dx + dy * dy
    x, y, q = F.col("__qx"), F.col("__qy"), F.col("__q")
    near = square(*(F.greatest(F.col(f"{c}0") - v, F.lit(0.0), v - F.col(f"{c}1")) for c, v in (("__x", x), ("__y", y))))
    far = square(*(F.greatest(F.col(f"{c}1") - v, v - F.col(f"{c}0")) for c, v in (("__x", x), ("__y", y))))
    stated = known(queries.where(F.col(key).isNotNull()).select(F.col(key).alias("__q"), *where)).distinct().select("__q", F.col("__x").alias("__qx"), F.col("__y").alias("__qy"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    asked = stated.select("*", F.explode(steps).alias("s")).select("__q", "__qx", "__qy", (in_cell("__qx", 0) + F.col("s.i")).alias("__pi"), (in_cell("__qy", 0) + F.col("s.j")).alias("__pj"))
    bound = F.least(F.min("__far").over(Window.partitionBy("__q")), F.lit(float(radius) * float(radius)))
    for r in range(rounds + 1):
        met = asked.join(cells(r), ["__pi", "__pj"]).where((F.col("__low") != q) | (F.col("__high") != q))
        met = met.select("__q", "__qx", "__qy", "__i", "__j", near.alias("__near"), far.alias("__far")).withColumn("__bound", bound)
        asked = met.where("__near <= __bound").select("__q", "__qx", "__qy", F.col("__i").alias("__pi"), F.col("__j").alias("__pj"))

    leaves = places.select("__x", "__y", "__k1", "__k2", in_cell("__x", rounds).alias("__pi"), in_cell("__y", rounds).alias("__pj"))
    found = asked.join(leaves, ["__pi", "__pj"]).select("__q", square(F.col("__x") - x, F.col("__y") - y).alias("__d"), F.when(F.col("__k1") != q, F.col("__k1")).otherwise(F.col("__k2")).alias("__k"))
    found = found.where(F.col("__k").isNotNull() & (F.col("__d") <= radius * radius))
    return found.groupBy(F.col("__q").alias(key)).agg(F.min_by("__k", F.struct("__d", "__k")).alias("nearest"))
