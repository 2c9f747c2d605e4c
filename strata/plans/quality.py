"""A quality report: what of each document was laid out, approximated or left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, keys: list[str], skipped: Column, approximate: Column, missing: Column) -> DataFrame:
    """(keys, blocks, laid_out, approximations, missing, status): complete, approximate or partial."""
    count = lambda c: F.count(F.when(c, 1))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), count(skipped).alias("__s"), count(approximate).alias("approximations"), count(missing).alias("missing"))
    status = F.when(F.col("__s") > 0, "partial").when((F.col("approximations") > 0) | (F.col("missing") > 0), "approximate").otherwise("complete")
    return out.select(*keys, "blocks", (F.col("blocks") - F.col("__s")).alias("laid_out"), "approximations", "missing", status.alias("status"))
