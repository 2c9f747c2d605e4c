"""Grids and intervals: free spans, column extents, widths from content and edge conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free_spans(df: DataFrame, keys: Sequence[str], low: str, high: str, least: int = 1) -> DataFrame:
    """(keys, free_from, free_to): gaps between the covered intervals of a key, of ``least`` units or more."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = df.select(*keys, reach.alias("free_from"), F.col(low).alias("free_to"))
    return gaps.where(F.col("free_to") - F.col("free_from") >= least)


def merged_spans(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Unions of intervals that overlap or touch, with the number of members."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("__new", F.when(reach.isNull() | (F.col(low) > reach), 1).otherwise(0))
    grouped = new.withColumn("__span", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__span").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("members")).drop("__span")


def extents(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Narrowest (longest word) and widest (longest line) content of each key, in characters."""
    words = F.array_max(F.transform(F.split(text, "[ \\t\\n\\r\\f\\x0B]+"), F.length))
    lines = F.array_max(F.transform(F.split(text, "\n"), F.length))
    return df.select(*keys, words.alias("__w"), lines.alias("__l")).groupBy(*keys).agg(F.max("__w").alias("narrowest"), F.max("__l").alias("widest"))


def edge_winner(df: DataFrame, left: tuple[Column, Column], right: tuple[Column, Column]) -> DataFrame:
    """Of two (style, width) that meet: an undrawn one loses, the wider wins, a tie goes to the first; a double line counts three times."""
    def weight(style: Column, width: Column) -> Column:
        return F.when(style.isNull() | (style == "nil"), -1).otherwise(width * F.when(style == "double", 3).otherwise(1))

    a, b = weight(*left), weight(*right)
    return df.withColumn("edge_style", F.when(b > a, right[0]).otherwise(left[0])).withColumn("edge_width", F.greatest(a, b, F.lit(0)))


def content_widths(df: DataFrame, keys: Sequence[str], order: str, narrowest: str, widest: str, stated: str, room: int) -> DataFrame:
    """Column widths from content within ``room``.

    A column wants the greater of its stated (else widest) and narrowest width. Grids that fit keep what they
    want; others keep every narrowest width and share what is left by want - narrowest; if not even
    the narrowest fit, room is shared by them. Shares are floored cumulatively, so they add up.
    """
    want = F.greatest(F.coalesce(F.col(stated), F.col(widest)), F.col(narrowest))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__want", want).withColumn("__wants", F.sum(want).over(whole)).withColumn("__least", F.sum(narrowest).over(whole))
    rows = rows.withColumn("__case", F.when(F.col("__wants") <= room, 0).when(F.col("__least") <= room, 1).otherwise(2))
    part = F.when(F.col("__case") == 1, F.col("__want") - F.col(narrowest)).otherwise(F.col(narrowest))
    rows = rows.withColumn("__part", part).withColumn("__parts", F.sum("__part").over(whole)).withColumn("__upto", F.sum("__part").over(upto))
    pool = F.when(F.col("__case") == 1, room - F.col("__least")).otherwise(room)
    rows = rows.withColumn("__pool", pool).withColumn("__edge", F.when(F.col("__parts") > 0, F.expr("(__pool * __upto) div __parts")).otherwise(0))
    share = F.col("__edge") - F.coalesce(F.lag("__edge").over(whole.orderBy(order)), F.lit(0))
    width = F.when(F.col("__case") == 0, F.col("__want")).when(F.col("__case") == 1, F.col(narrowest) + share).otherwise(share)
    return rows.withColumn("width", width).select(*df.columns, "width")


def equal_columns(width: Column, gap: Column, count: Column) -> Column:
    """The truncated width of equal text columns."""
    return ((width - gap * (count - 1)) / count).cast("long")
