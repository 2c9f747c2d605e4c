"""Connected components of a link table by rounds of joins, without any collected group."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.staging import Stage


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(id, component) for each id in edges (a, b): the least id it reaches.

    Each round an id takes the least label among its own, its neighbours' and that of its label (which
    halves the way); rounds go on until none changes, as labels only get less. Every round is staged.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stage.put(both, f"{name}_edges")
    labels = stage.put(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), f"{name}_0")
    for k in count(1):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = labels.join(near, "id", "left").join(far, "component", "left")
        new = new.select("id", F.least("component", "near", "far").alias("component"), F.col("component").alias("old"))
        new = stage.put(new, f"{name}_{k}")
        changed = not new.where("component <> old").isEmpty()
        stage.drop(f"{name}_{k - 1}")
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise AssertionError  # count() has no end
