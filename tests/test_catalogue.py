"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from strata.plans import catalogue, document, general, nesting, packages, paging, words  # noqa: F401
from strata.plans.registry import ORACLE, QUERIES

pytestmark = pytest.mark.filterwarnings("ignore")


def normal(value):
    return round(value, 6) if isinstance(value, float) else str(value) if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    want = [tuple(map(normal, (row[columns.index(c)] for c in sorted(columns)))) for row in result.fetchall()]
    got = [tuple(normal(row[c]) for c in sorted(columns)) for row in found.collect()]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_the_rest_runs(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_recursion_goes_on_beyond_a_million_rows_and_a_hundred_levels(spark, sf_dir):
    deep = "WITH RECURSIVE r(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM r WHERE n < 150) SELECT max(n) AS n FROM r"
    wide = "WITH RECURSIVE r(id, n) AS (SELECT id, 0 FROM range(400000) UNION ALL SELECT id, n + 1 FROM r WHERE n < 2) SELECT count(*) AS n FROM r"
    assert [general.sql(spark, sf_dir, text).first().n for text in (deep, wide)] == [150, 1_200_000]
