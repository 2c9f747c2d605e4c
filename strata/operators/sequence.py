"""Windows over document order: counters, islands, as-of values, merges and prefix sums.

Every window has a partition key (a document, story or user), so its work is split by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.rounds import dealt

Keys = Sequence[str]


def _before(keys: Keys, order: Keys) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _up_to(keys: Keys, order: Keys) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def counter(df: DataFrame, keys: Keys, order: Keys, name: str, reset: Column, step: Column, out: str = "value") -> DataFrame:
    """Named counters: every row adds ``step`` to its name's counter; a row with ``reset`` sets all of a key's counters back first."""
    grouped = df.withColumn("__era", F.count(F.when(reset, 1)).over(_up_to(keys, order)))
    return grouped.withColumn(out, F.sum(step).over(_up_to([*keys, "__era", name], order))).drop("__era")


def set_counter(df: DataFrame, keys: Keys, order: Keys, stated: str, step: Column, out: str = "value") -> DataFrame:
    """A counter that a stated value sets, and that otherwise goes on by ``step``."""
    w = _up_to(keys, order)
    eras = df.withColumn("__era", F.count(stated).over(w))
    base = F.first(stated, ignorenulls=True).over(Window.partitionBy(*keys, "__era"))
    more = F.sum(F.when(F.col(stated).isNull(), step).otherwise(0)).over(_up_to([*keys, "__era"], order))
    return eras.withColumn(out, F.coalesce(base, F.lit(0)) + more).drop("__era")


def islands(df: DataFrame, keys: Keys, order: Keys, value: Column, out: str = "island") -> DataFrame:
    """Numbers runs of equal values from 1; nulls equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = value.eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)
    return df.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn(out, F.sum("__new").over(_up_to(keys, order))).drop("__new")


def island_sides(df: DataFrame, keys: Keys, order: Keys, value: Column) -> DataFrame:
    """Equal neighbours merge: top on a run's first row, bottom on its last, between inside."""
    w = Window.partitionBy(*keys).orderBy(*order)
    has = F.row_number().over(w) > 1
    left = df.withColumn("top", ~(has & value.eqNullSafe(F.lag(value).over(w))))
    return left.withColumn("bottom", F.coalesce(F.lead("top").over(w), F.lit(True))).withColumn("between", ~F.col("bottom"))


def sections(df: DataFrame, keys: Keys, order: Keys, ends: Column, out: str = "section") -> DataFrame:
    """Sections whose properties stand on their last row: the number of ends strictly before, from 0."""
    return df.withColumn(out, F.coalesce(F.count(F.when(ends, 1)).over(_before(keys, order)), F.lit(0)))


def merge_with_next(df: DataFrame, keys: Keys, order: str, deleted: Column, parts: Column, sep: str = "") -> DataFrame:
    """Rows whose end mark is deleted join the next row, chains into the last; a rest without one stays together.

    One row per merged block: keys, first, last (by order), n and text.
    """
    back = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    grouped = df.select(*keys, order, parts.alias("__part"), F.count(F.when(~deleted, 1)).over(back).alias("__block"))
    items = F.sort_array(F.collect_list(F.struct(order, "__part")))
    text = F.array_join(F.transform(items, lambda x: x["__part"]), sep)
    return grouped.groupBy(*keys, "__block").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), text.alias("text")).drop("__block")


def as_of(df: DataFrame, keys: Keys, order: Keys, value: Column, out: str = "found") -> DataFrame:
    """The last value strictly before each row, else the first at or after it."""
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(_before(keys, order)), F.first(value, ignorenulls=True).over(after)))


def as_of_page(df: DataFrame, keys: Keys, page: str, order: Keys, value: Column, last: bool = False) -> DataFrame:
    """(keys, page, found): the page's first value (or last), else the last of an earlier page, else the first of a later one."""
    place = F.struct(*order)
    held = F.when(value.isNotNull(), place)
    first, end = F.min_by(value, held), F.max_by(value, held)
    pages = df.groupBy(*keys, page).agg(first.alias("__first"), end.alias("__last"))
    w = Window.partitionBy(*keys).orderBy(page)
    own = F.col("__last" if last else "__first")
    earlier = F.last("__last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("__first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return pages.select(*keys, page, F.coalesce(own, earlier, later).alias("found"))


def inherit(df: DataFrame, keys: Keys, order: Keys, value: str, out: str = "value") -> DataFrame:
    """Each row's own value or the last stated one before it."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_up_to(keys, order)))


def next_value(df: DataFrame, keys: Keys, order: Keys, value: Column, out: str = "next") -> DataFrame:
    return df.withColumn(out, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))


def collapsed_gaps(df: DataFrame, keys: Keys, order: Keys, before: str, after: str) -> DataFrame:
    """gap_before: what the space before adds beyond the space after of the row above."""
    last = F.coalesce(F.lag(after).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))
    return df.withColumn("gap_before", F.greatest(F.col(before) - last, F.lit(0)))


def places(df: DataFrame, keys: Keys, order: Keys, section: str, page: str) -> DataFrame:
    """Each row's place in its document, section and page."""
    count = lambda *by: F.count(F.lit(1)).over(_up_to([*keys, *by], order))
    return dealt(df, keys).withColumn("in_document", count()).withColumn("in_section", count(section)).withColumn("in_page", count(page))


def offsets(df: DataFrame, keys: Keys, order: Keys, length: Column) -> DataFrame:
    """start_at: the sum of the lengths before each row."""
    return df.withColumn("start_at", F.coalesce(F.sum(length).over(_before(keys, order)), F.lit(0)))


def floored_shares(df: DataFrame, keys: Keys, order: Keys, weight: str, total: int, out: str = "share") -> DataFrame:
    """Parts of ``total`` by weight, as differences of floored cumulative sums, so that they add up."""
    all_ = F.sum(weight).over(Window.partitionBy(*keys))
    upto = F.expr(f"{total}L * __sum div __all")
    sums = df.withColumn("__all", all_).withColumn("__sum", F.sum(weight).over(_up_to(keys, order)))
    edge = sums.withColumn("__edge", F.when(F.col("__all") > 0, upto).otherwise(0))
    last = F.coalesce(F.lag("__edge").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))
    return edge.withColumn(out, F.col("__edge") - last).drop("__all", "__sum", "__edge")


def first_seen(df: DataFrame, what: Keys, order: Keys) -> DataFrame:
    """The first row of each distinct ``what``, in order: an ordered log without repeats."""
    w = Window.partitionBy(*what).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def leading_run(df: DataFrame, keys: Keys, order: Keys, flag: Column, out: str = "leading") -> DataFrame:
    """Whether a row and all before it have the flag (header rows at the top)."""
    return df.withColumn(out, F.min(F.when(flag, 1).otherwise(0)).over(_up_to(keys, order)) == 1)


def largest_fit(df: DataFrame, keys: Keys, order: Keys, size: str, allowed: Column, room: int) -> DataFrame:
    """(keys, least, fits, rest): the least prefix that may end, the largest such prefix within room, and what remains."""
    sums = df.withColumn("__sum", F.sum(size).over(_up_to(keys, order))).withColumn("__ok", allowed)
    fits = F.max(F.when(F.col("__ok") & (F.col("__sum") <= room), F.col("__sum")))
    agg = sums.groupBy(*keys).agg(F.min(F.when(F.col("__ok"), F.col("__sum"))).alias("least"), F.coalesce(fits, F.lit(0)).alias("fits"), F.max("__sum").alias("__all"))
    return agg.withColumn("rest", F.col("__all") - F.col("fits")).drop("__all")
