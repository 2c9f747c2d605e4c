"""Runs one query over a folder of tables and writes its rows: python -m strata NAME TABLES OUT [--format FORMAT] [--strict]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from strata.plans import catalogue, document, general, packages  # noqa: F401
from strata.plans.registry import QUERIES


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if rows were written; 2 for an unknown query, or with --strict if there are none."""
    parser = argparse.ArgumentParser(prog="strata", description=__doc__)
    parser.add_argument("name", help="'list' shows all names")
    parser.add_argument("tables", nargs="?")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--strict", action="store_true")
    told = parser.parse_args(arguments)
    if told.name == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if told.name not in QUERIES or not told.out:
        print(f"unknown query {told.name}" if told.out else "TABLES and OUT are needed", file=sys.stderr)
        return 2
    session = spark or SparkSession.builder.appName("strata").getOrCreate()
    QUERIES[told.name](session, told.tables).write.mode("overwrite").format(told.format).save(told.out)
    return 2 if told.strict and session.read.format(told.format).load(told.out).isEmpty() else 0


if __name__ == "__main__":
    raise SystemExit(main())
