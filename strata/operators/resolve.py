"""Layered properties: precedence with lineage, toggles, chains of ancestors and map merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.trees import ancestors_of


def cascade(declared: DataFrame, keys: Sequence[str], name: str, value: str, rank: str, origin: str) -> DataFrame:
    """The value of the highest level that declares a property, and the level that decided it."""
    stated = declared.where(F.col(value).isNotNull())
    best = F.max_by(F.struct(value, origin), F.col(rank))
    return stated.groupBy(*keys, name).agg(best.alias("__best"), F.count(F.lit(1)).alias("levels")).select(*keys, name, f"__best.{value}", f"__best.{origin}", "levels")


def toggled(base: Column, levels: Sequence[Column], direct: Column) -> Column:
    """A toggle: starts at the default, each level that states something else flips it, a direct value replaces it."""
    out = F.coalesce(base, F.lit(False))
    start = out
    for level in levels:
        out = F.when(level.isNotNull() & (level != start), ~out).otherwise(out)
    return F.coalesce(direct, out)


def chains(nodes: DataFrame, id_: str, parent: str, kind: str) -> DataFrame:
    """(id, depth, ancestor): each node's ancestors of its own kind, itself first; a cycle or another kind ends the chain.

    Chains of any length: rounds double what is known, see ``trees.ancestors_of``.
    """
    own = nodes.select(F.col(id_).alias("id"), F.col(parent).alias("up"), F.col(kind).alias("kind"))
    above = nodes.select(F.col(id_).alias("up"), F.col(kind).alias("kind"))
    return ancestors_of(own.join(above, ["up", "kind"]).select("id", "up"), own.select("id")).select("id", F.col("depth").cast("int").alias("depth"), "ancestor")


def merged_stops(layers: DataFrame, keys: Sequence[str], at: str, kind: str, rank: str) -> DataFrame:
    """Tab stops by position over all layers: the last layer's kind wins, and 'clear' removes the stop."""
    return layers.groupBy(*keys, at).agg(F.max_by(kind, rank).alias(kind)).where(F.col(kind) != "clear")


def bands(row: Column, column: Column, rows: Column, columns: Column) -> Column:
    """The conditional formats of a cell, in the order in which they apply."""
    inner_row, inner_column = (row > 0) & (row < rows - 1), (column > 0) & (column < columns - 1)
    parts = [
        F.lit("whole"),
        F.when(inner_column, F.when((column - 1) % 2 == 0, "band1Vert").otherwise("band2Vert")),
        F.when(inner_row, F.when((row - 1) % 2 == 0, "band1Horz").otherwise("band2Horz")),
        F.when(column == 0, "firstCol"),
        F.when(column == columns - 1, "lastCol"),
        F.when(row == 0, "firstRow"),
        F.when(row == rows - 1, "lastRow"),
        F.when((row == 0) & (column == 0), "nwCell"),
        F.when((row == 0) & (column == columns - 1), "neCell"),
        F.when((row == rows - 1) & (column == 0), "swCell"),
        F.when((row == rows - 1) & (column == columns - 1), "seCell"),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def resolve_distinct(df: DataFrame, inputs: Sequence[str], resolve: Column, out: str) -> DataFrame:
    """Resolve each distinct input once and join the result back."""
    once = df.select(*inputs).distinct().withColumn(out, resolve)
    for c in inputs:
        once = once.withColumnRenamed(c, f"__{c}")
    joined = df.join(once, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in inputs], "left")
    return joined.drop(*(f"__{c}" for c in inputs))
