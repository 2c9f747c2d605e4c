"""Differences between two versions: keyed, by stretches, from both ends; and shifted ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or changed; equal rows are left out."""
    a, b = old.select(key, F.col(digest).alias("__old")), new.select(key, F.col(digest).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").where(~F.col("__old").eqNullSafe(F.col("__new"))).select(key, change.alias("change"))


def common_ends(old: DataFrame, new: DataFrame, keys: Sequence[str], ord_: str, digest: str) -> DataFrame:
    """(keys, prefix, suffix): how many rows two ordered lists share at their start and, beyond it, at their end."""
    sizes = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m")).join(new.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), list(keys))
    a = old.select(*keys, F.col(ord_).alias("__i"), F.col(digest).alias("__a")).join(sizes, list(keys))
    b = new.select(*keys, F.col(ord_).alias("__j"), F.col(digest).alias("__b")).join(sizes.select(*keys), list(keys))

    def equal_run(left: Column, right: Column, out: str) -> DataFrame:
        x = a.withColumn("__p", left)
        y = b.join(sizes, list(keys)).withColumn("__p", right).select(*keys, "__p", "__b")
        first = F.min(F.when(~F.col("__a").eqNullSafe(F.col("__b")), F.col("__p")))
        return x.join(y, [*keys, "__p"], "left").groupBy(*keys).agg(F.coalesce(first, F.min("__m")).alias(out))

    prefix = equal_run(F.col("__i"), F.col("__j"), "prefix")
    suffix = equal_run(F.col("__m") - 1 - F.col("__i"), F.col("__n") - 1 - F.col("__j"), "__suffix")
    both = prefix.join(suffix, list(keys)).join(sizes, list(keys))
    return both.select(*keys, "prefix", F.least(F.col("__suffix"), F.least("__m", "__n") - F.col("prefix")).alias("suffix"))


def changed_windows(changed: DataFrame, keys: Sequence[str], ord_: str, margin: int = 1) -> DataFrame:
    """(keys, first, last): changed ordinals widened by ``margin`` rows on each side, those that overlap or touch merged."""
    wide = changed.select(*keys, F.greatest(F.col(ord_) - margin, F.lit(0)).alias("__lo"), (F.col(ord_) + margin).alias("__hi"))
    w = Window.partitionBy(*keys).orderBy("__lo", "__hi")
    reach = F.max("__hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = wide.withColumn("__new", F.when(reach.isNull() | (F.col("__lo") > reach + 1), 1).otherwise(0))
    numbered = new.withColumn("__w", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__w").agg(F.min("__lo").alias("first"), F.max("__hi").alias("last")).drop("__w")


def shifted(df: DataFrame, ord_: str, from_: int, by: int) -> DataFrame:
    """Ordinals from an index on moved by an amount."""
    return df.withColumn(ord_, F.when(F.col(ord_) >= from_, F.col(ord_) + by).otherwise(F.col(ord_)))
