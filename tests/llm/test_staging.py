"""Staged data: deleted by scope, kept in the shared folder the session names."""

from pathlib import Path

import pytest
from test_llm import awkward  # noqa: F401

from strata.llm import staging
from strata.llm.ngram_join import drop_similar
from strata.llm.suffix_dedup import drop_repeated_strings


def left(spark):
    folder = Path(staging.shared_dir(spark).removeprefix("file://"))
    return {p.name for p in folder.iterdir()} if folder.exists() else set(), {t.name for t in spark.catalog.listTables()}


def test_scope_deletes_what_operators_staged(spark, awkward):  # noqa: F811
    before = left(spark)
    with staging.scope():
        assert drop_repeated_strings(awkward).count() == 20
        with staging.scope():
            assert drop_similar(awkward).count() > 0
    folders, tables = left(spark)
    assert tables == before[1] and folders == before[0]


def test_clusters_must_name_a_shared_folder():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        staging.shared_dir(Session())
