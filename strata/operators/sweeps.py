"""Sorted sweeps in place of products: running sums over ranges, nearest neighbours, the lowest free place, coverage by intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.rounds import cut


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with ``name``: the sum of value over the rows of the group up to each one.

    Rows are dealt by ranges of (group, order), so a group of any share of the rows is cut; sums are taken inside each range, then over the ranges' totals.
    Groups and orders must not be null.
    """
    dealt = cut(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy(*group, "__part").agg(F.sum(value).alias("__t"))
    before = F.sum("__t").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*group, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, inside).join(totals, [*group, "__part"]).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def nearest(left: DataFrame, right: DataFrame, key: str, most: int, apart: bool = False) -> DataFrame:
    """(id, other, distance, place): the ``most`` rows of right of the same key nearest in value to each row of left, nearest first, then by id.

    Both have key, id and value; ids of right are unique in a key, and with ``apart`` a row isn't its own neighbour. Right's rows are numbered in the order of their values and
    left's rows find their place among them; the neighbours are those with the next numbers on either side, so a row meets 2 * (most + 1) others, however many share its key.
    Rows without a value or key have and are no neighbours.
    """
    own = [df.where(F.col(key).isNotNull() & F.col("value").isNotNull()).select(key, "id", "value", F.lit(kind).cast("long").alias("kind")) for df, kind in ((right, 1), (left, 0))]
    # Of equal values right's rows come first: a row of left has as many before it as have its value or less.
    numbered = running_sums(own[0].unionByName(own[1]).withColumn("__late", 1 - F.col("kind")), [key], ["value", "__late", "id"], "kind", "n")
    numbered = cut(numbered.select(key, "id", "value", "kind", "n"))
    up = numbered.where("kind = 1").select(key, F.col("id").alias("other"), F.col("value").alias("there"), "n")
    # Downwards, equal values count from the least id too.
    same = up.groupBy(key, "there").agg((F.min("n") + F.max("n")).alias("__sum"))
    down = up.join(same, [key, "there"]).select(key, "other", "there", (F.col("__sum") - F.col("n")).alias("n"))
    k = most + (1 if apart else 0)
    asked = numbered.where("kind = 0").select(key, "id", "value", F.col("n").alias("__at"))
    reach = lambda low, high: asked.withColumn("n", F.explode(F.sequence(F.col("__at") + low, F.col("__at") + high)))
    met = reach(1 - k, 0).join(down, [key, "n"]).unionByName(reach(1, k).join(up, [key, "n"]))
    met = met.where(F.col("id") != F.col("other")) if apart else met
    met = met.withColumn("distance", F.abs(F.col("value") - F.col("there")))
    place = F.row_number().over(Window.partitionBy(key, "id").orderBy("distance", "other"))
    return met.withColumn("place", place).where(F.col("place") <= most).select(key, "id", "other", "distance", "place")


def lowest_free(blocks: DataFrame, obstacles: DataFrame, key: str, height: int, column: int) -> DataFrame:
    """(key, id, y): the lowest place at or below each block's where no obstacle of its key leaves it too little room.

    ``blocks``: key, id, y and need (width); ``obstacles``: key, top, bottom and width, taken from the column. An obstacle is in the way of a block of the height at z if top < z + height, bottom > z
    and column - width < need. For every width that obstacles of a key have, those at least as wide are merged into islands; a block is held up by the islands of the least width
    that is too much for it, and goes to the end of the one it is in. Positions are whole numbers.
    """
    widths = obstacles.where("bottom > top").select(key, "width").distinct()
    rows = widths.select(key, F.col("width").alias("at"), F.lit(1).alias("kind"), F.lit(None).alias("row"), F.col("width").alias("level"))
    asks = blocks.select(key, (column - F.col("need")).alias("at"), F.lit(0).alias("kind"), F.struct(*blocks.columns).alias("row"), F.lit(None).alias("level"))
    over = Window.partitionBy(key).orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    levelled = asks.unionByName(rows).withColumn("level", F.last("level", ignorenulls=True).over(over)).where("kind = 0").select("row.*", "level")
    walls = obstacles.where("bottom > top").select(key, F.col("top") - height, "bottom", "width").toDF(key, "low", "high", "width")
    walls = walls.join(widths.withColumnRenamed("width", "level"), key).where("level <= width")
    w = Window.partitionBy(key, "level").orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = walls.withColumn("new", (F.col("low") >= F.coalesce(reach, F.col("low"))).cast("long")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(key, "level", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    here = levelled.where("level IS NOT NULL").select(key, "level", F.col("y").alias("at"), F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("high"))
    ends = merged.select(key, "level", F.col("low").alias("at"), F.lit(1).alias("kind"), F.lit(None).alias("id"), F.col("high").cast("long").alias("high"))
    so_far = Window.partitionBy(key, "level").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = here.unionByName(ends).withColumn("high", F.last("high", ignorenulls=True).over(so_far)).where("kind = 0").select(key, "id", F.greatest("at", F.coalesce("high", "at")).alias("y"))
    return levelled.where("level IS NULL").select(key, "id", "y").unionByName(held)


def covered(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """points (key, at) with ``covered``: whether an interval [low, high] of the key holds the point; one sort of both."""
    rows = points.select(key, F.col("at").alias("__at"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__row"), F.lit(None).cast("long").alias("__high"))
    ends = intervals.select(key, F.col("low").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).alias("__row"), F.col("high").cast("long").alias("__high"))
    reach = F.max("__high").over(Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    return rows.unionByName(ends).withColumn("__reach", reach).where("__kind = 1").select("__row.*", F.coalesce(F.col("__reach") >= F.col("__at"), F.lit(False)).alias("covered"))


def first_covering(points: DataFrame, intervals: DataFrame, bits: int = 21) -> DataFrame:
    """(at, name): of the intervals (low, high, rank, name) that hold a point, the one of least rank.

    An interval is taken apart into aligned powers of two (two of each size at most), of each of which only the best name is kept; a point asks the ``bits`` + 1 that it is in.
    So no row is made for a point of an interval, nor for a pair of overlapping ones. Points and bounds are from 0 to 2^bits - 1.
    """
    # Of size 2^k: the block at low, if low is an odd multiple of it, and the one before high + 1, as in a segment tree.
    ends = intervals.where("low <= high").select("rank", "name", F.col("low").cast("long").alias("a"), (F.col("high") + 1).cast("long").alias("b"))
    blocks = F.expr(f"""flatten(transform(sequence(0, {bits}), k -> transform(array(named_struct('a', ((a + shiftleft(1L, k) - 1) div shiftleft(1L, k)), 'b', b div shiftleft(1L, k))),
        x -> filter(array(if(x.a < x.b and x.a % 2 = 1, named_struct('k', k, 'n', x.a), null), if(x.a < x.b and x.b % 2 = 1, named_struct('k', k, 'n', x.b - 1), null)), y -> y is not null))[0]))""")
    held = ends.select("rank", "name", F.explode(blocks).alias("x")).groupBy("x.k", "x.n").agg(F.min(F.struct("rank", "name")).alias("best"))
    asked = points.select("at").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("n", F.expr("at div shiftleft(1L, k)"))
    return asked.join(held, ["k", "n"]).groupBy("at").agg(F.min("best").alias("best")).select("at", F.col("best.name").alias("name"))
