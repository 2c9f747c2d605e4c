"""Hyphenation files: patterns and word lists as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(file, pattern) of pattern files, plain or gzipped: one pattern a line; comments, names of encodings and settings in capitals are passed over."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim(F.regexp_replace("value", "%.*$", "")).alias("pattern"))
    return lines.where("pattern <> '' AND NOT pattern RLIKE '^[A-Z#]' AND NOT pattern RLIKE '^(UTF|ISO)[-0-9A-Za-z]*'").distinct()


def read_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """(word, points) of word lists with '-' at each point: 'ta-ble' is table with a point after 2 letters."""
    words = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "%.*$", ""))).alias("w")).where("w <> ''").distinct()
    parts = F.split("w", "-")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.length(F.array_join(F.slice(parts, F.lit(1), k), "")))
    points = F.array_join(F.slice(ends, F.lit(1), F.size(parts) - 1).cast("array<string>"), ",")
    return words.select(F.replace("w", F.lit("-"), F.lit("")).alias("word"), points.alias("points")).groupBy("word").agg(F.min("points").alias("points"))
