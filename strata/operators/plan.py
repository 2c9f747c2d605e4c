"""Recomputing after an edit: why, what to keep, what to forget, and the log of what went wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(checks: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first check that holds."""
    out = F.lit(otherwise).cast("string")
    for name, holds in reversed(checks):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def change_plan(old: DataFrame, new: DataFrame, key: str, parts: Sequence[tuple[str, bool]]) -> DataFrame:
    """(key, reason, measurements_kept) from digests of the parts, in order: the first that differs is the reason.

    ``parts``: column and whether measurements survive a change of it. New and removed documents have those reasons; equal ones 'none'.
    """
    b = new.select(key, F.struct(*(p for p, _ in parts)).alias("b"))
    both = old.select(key, F.struct(*(p for p, _ in parts)).alias("a")).join(b, key, "full")
    checks = [("new", F.col("a").isNull()), ("removed", F.col("b").isNull()), *((p, ~F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}"))) for p, _ in parts)]
    kept = F.coalesce(F.map_from_arrays(F.lit([p for p, _ in parts]), F.lit([k for _, k in parts]))[F.col("reason")], F.col("reason") == "none")
    return both.select(key, first_reason(checks, "none").alias("reason")).withColumn("measurements_kept", kept)


def spliced(old: DataFrame, new: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    """Rows of new with ``source``: 'kept' before the first page whose state differs and from the first one on from which all states are the old ones again, else 'fresh'.

    The last key orders pages; the others are the document. A page that only one version has differs.
    """
    page, docs = keys[-1], list(keys[:-1])
    both = new.select(*keys, F.col(state).alias("b")).join(old.select(*keys, F.col(state).alias("a")), list(keys), "full")
    differs = F.when(~F.col("a").eqNullSafe(F.col("b")), F.col(page))
    edge = both.groupBy(*docs).agg(F.min(differs).alias("first"), F.max(differs).alias("last"))
    inside = (F.col(page) >= F.col("first")) & (F.col(page) <= F.col("last"))
    return new.join(edge, docs).withColumn("source", F.when(F.coalesce(inside, F.lit(False)), "fresh").otherwise("kept")).drop("first", "last")


def bounded(entries: DataFrame, lineage: Sequence[str], used_at: Sequence[str], each: int) -> DataFrame:
    """The ``each`` entries of every lineage that were used last."""
    place = F.row_number().over(Window.partitionBy(*lineage).orderBy(*(F.desc(c) for c in used_at)))
    return entries.withColumn("place", place).where(F.col("place") <= each).drop("place")


def warning_log(events: DataFrame, document: Sequence[str], code: str, message: str, order: Sequence[str]) -> DataFrame:
    """Each (document, code, message) once: how often it came, and the first place."""
    return events.groupBy(*document, code, message).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*order)).alias("first")).select(*document, code, message, "times", *(F.col(f"first.{c}").alias(f"first_{c}") for c in order))


def nesting(df: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Column, end: Column) -> DataFrame:
    """df with ``depth``: markers open at each row, its own included if it opens; an end without a begin is passed over."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(begin, 1).when(end, -1).otherwise(0)
    total = F.sum(step).over(w)
    rows = df.withColumn("total", total)
    # Ends without a begin push the sum to new lows; depth counts from the lowest so far.
    lowest = F.least(F.min("total").over(w), F.lit(0))
    return rows.withColumn("depth", F.col("total") - lowest).drop("total")
