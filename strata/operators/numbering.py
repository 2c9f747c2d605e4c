"""Numbers of list items as lists count them: shared counts, overrides, restart rules and level templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.numbers import number_text


def list_items(df: DataFrame, keys: Sequence[str], order: Sequence[str], levels: DataFrame, depth: int = 9) -> DataFrame:
    """df (keys, order, instance, level, ...) with ``number`` and ``label``.

    ``levels``: instance, level, list, start, restart, format, text, legal, override. Instances of one list
    share its counts. An item counts at its level; each level above that has no count since it restarted gets its start; each level below
    restarts if its ``restart`` allows (null: after any level above; k: after levels under k; 0: never). The first item of an instance whose start is an
    override begins anew. '%k' in the text stands for level k's number, in decimal if legal. An item of an unknown level has no label.

    Every level is a few running windows over one order; nothing is folded, so a story of any length is one sort.
    """
    told = ("start", "restart", "format", "text", "legal", "override")
    each = levels.groupBy("instance").agg(F.first("list").alias("list"), F.map_from_entries(F.collect_list(F.struct("level", F.struct(*told)))).alias("levels"))
    rows = df.join(each, "instance", "left")
    rows = rows.withColumn("own", F.try_element_at("levels", F.col("level"))).withColumn("counts", F.col("own.text").isNotNull())
    once = F.row_number().over(Window.partitionBy(*keys, "list", "instance", "level", "counts").orderBy(*order))
    rows = rows.withColumn("anew", F.col("counts") & (once == 1) & F.coalesce(F.col("own.override"), F.lit(False)))
    w = Window.partitionBy(*keys, "list").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spec = lambda k: F.try_element_at("levels", F.lit(k).cast("int"))
    numbers = []
    for k in range(depth):
        here = F.col("counts") & (F.col("level") == k)
        below = F.col("counts") & (F.col("level") >= k)
        reset = F.col("counts") & (F.col("level") < k) & (F.col("level") < F.coalesce(spec(k)["restart"], F.lit(k)))
        rows = rows.withColumn(f"r{k}", F.sum(here.cast("long")).over(w)).withColumn(f"e{k}", F.sum(below.cast("long")).over(w))
        rows = rows.withColumn(f"z{k}", F.coalesce(F.last(F.when(reset, F.col(f"e{k}")), ignorenulls=True).over(w), F.lit(0)))
        made = (below & (F.col(f"e{k}") - F.col(f"z{k}") == 1)) | (F.col("anew") & here)
        rows = rows.withColumn(f"v{k}", F.last(F.when(made, F.struct(F.coalesce(spec(k)["start"], F.lit(1)).alias("v"), F.col(f"r{k}").alias("r"))), ignorenulls=True).over(w))
        alive = F.col(f"e{k}") > F.col(f"z{k}")
        numbers.append(F.when(alive, F.col(f"v{k}.v") + F.col(f"r{k}") - F.col(f"v{k}.r")))
    rows = rows.withColumn("n", F.array(*numbers)).drop(*(f"{c}{k}" for c in "rezv" for k in range(depth)))
    label: Column = F.col("own.text")
    for k in range(depth):
        form = F.when(F.col("own.legal") & ~F.coalesce(spec(k)["format"], F.lit("decimal")).isin("bullet", "none"), F.lit("decimal")).otherwise(F.coalesce(spec(k)["format"], F.lit("decimal")))
        value = F.coalesce(F.get("n", F.lit(k)), spec(k)["start"], F.lit(1))
        label = F.replace(label, F.lit(f"%{k + 1}"), F.coalesce(number_text(value, form), F.lit("")))
    number = F.when(F.col("counts"), F.get("n", F.col("level")))
    return rows.withColumn("number", number).withColumn("label", label).drop("list", "levels", "own", "counts", "anew", "n")
