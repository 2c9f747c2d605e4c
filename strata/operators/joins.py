"""Lookups between records: marks, references, fallbacks, overlaps and ancestors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_marks(starts: DataFrame, ends: DataFrame, keys: Sequence[str], name: str, order: str) -> DataFrame:
    """(keys, name, start_at, end_at): the first start of each name, and the first end at or after it or null."""
    first = starts.groupBy(*keys, name).agg(F.min(order).alias("start_at"))
    joined = first.join(ends.select(*keys, name, F.col(order).alias("__end")), [*keys, name], "left")
    end = F.min(F.when(F.col("__end") >= F.col("start_at"), F.col("__end")))
    return joined.groupBy(*keys, name, "start_at").agg(end.alias("end_at"))


def text_between(marks: DataFrame, runs: DataFrame, keys: Sequence[str], order: str, text: str, sep: str = " ") -> DataFrame:
    """The runs from start_at up to, but without, end_at as one text; marks without an end have none."""
    inside = marks.where("end_at IS NOT NULL").join(runs, list(keys)).where(F.col(order).between(F.col("start_at"), F.col("end_at") - 1))
    items = F.sort_array(F.collect_list(F.struct(order, text)))
    return inside.groupBy(*marks.columns).agg(F.array_join(F.transform(items, lambda x: x[text]), sep).alias("text"))


def first_answer(df: DataFrame, candidates: Sequence[tuple[str, Column]]) -> DataFrame:
    """found and found_by: the first candidate, in order, that isn't null."""
    by = F.lit("missing")
    for name, value in reversed(candidates):
        by = F.when(value.isNotNull(), name).otherwise(by)
    return df.withColumn("found", F.coalesce(*(v for _, v in candidates))).withColumn("found_by", by)


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], band: int) -> DataFrame:
    """Pairs of intervals of one key that strictly overlap (touching ones do not).

    Both sides are dealt to the bands of ``band`` units they reach; a pair is taken
    in the first band that both share, so it comes once and equal keys need no full product.
    """
    def banded(df: DataFrame, low: str, high: str) -> DataFrame:
        reach = F.sequence(F.floor(F.col(low) / band), F.floor((F.col(high) - 1) / band))
        return df.where(F.col(low) < F.col(high)).withColumn("__band", F.explode(reach))

    x, y = banded(left, *a), banded(right, *b)
    pairs = x.join(y, [*keys, "__band"])
    meet = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    first = F.col("__band") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / band)
    return pairs.where(meet & first).drop("__band")


def ancestors(df: DataFrame, path: Column, sep: str = "/") -> DataFrame:
    """level and prefix for every prefix of a path, the shortest first."""
    steps = F.filter(F.split(path, sep), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), sep))
    return df.select("*", F.posexplode(F.when(F.size(steps) > 0, prefixes).otherwise(F.array().cast("array<string>"))).alias("level", "prefix"))


def number_of(positions: DataFrame, lines: DataFrame, keys: Sequence[str], at: str, start: str) -> DataFrame:
    """For each position the last line that starts at or before it: one sort of both, no range join."""
    both = positions.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*positions.columns).alias("__row"), F.lit(None).cast("long").alias("__line"))
    own = lines.select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).alias("__row"), F.col("line").cast("long").alias("__line"))
    w = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(own).withColumn("line", F.last("__line", ignorenulls=True).over(w)).where("__kind = 1")
    return found.select("__row.*", "line")


def pick_story(titled: Column, first: Column, even: Column, odd_even: Column) -> Column:
    """first on the first page of a titled section, even on even numbers where these differ, else default."""
    return F.when(titled & first, "first").when(odd_even & even, "even").otherwise("default")
