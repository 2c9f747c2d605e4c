"""Verdicts of the two fitted models against plain walks of what was fitted, on all rows; edge cases of exact dedup; SQL of the training-data queries."""

import duckdb
import numpy as np
import pytest
from brute import attention_score, counts, sha, tree_features, tree_score
from pyspark.sql import functions as F
from test_llm import AWKWARD, awkward, by_id, rows_of  # noqa: F401

import corpus_pipeline
from strata.llm import queries, staging
from strata.llm.exact_dedup import drop_exact_copies, exact_groups
from strata.llm.packing import WordTokenizer
from strata.llm.quality_classifier import BUCKETS, PASSAGE, classify_quality, fit_quality
from strata.llm.quality_rules import fit_rules, quality_rules
from strata.llm.text import slice_hashes


def hashed(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(slice_hashes(raw, np.array([0]), np.array([len(raw)]), seed=3)[0])


def test_op4_verdicts_are_those_of_a_plain_walk(spark, sf_dir, awkward):  # noqa: F811
    labels = queries.table(spark, sf_dir, "labels")
    docs = queries.table(spark, sf_dir, "documents")
    trees = fit_rules(docs, labels, "doc_id", "text", "quality", 20_000, 256 << 20)
    assert len(trees.roots) == 60
    both = docs.select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = by_id(quality_rules(docs, labels), "score", "kept")
    assert got == by_id(queries.op4_quality_rules(spark, sf_dir), "score", "kept")
    texts = dict(rows_of(spark, sf_dir)) | {i + 10**6: t for i, t in AWKWARD}
    # Fitted on the table alone: ids of the awkward rows are unlabelled.
    got = by_id(quality_rules(both.repartition(3), labels), "base_failed", "score", "kept")
    for i, text in texts.items():
        n, *_, repeated = counts(text)
        failed, score = n < 20 or 100 * repeated > 30 * n, tree_score(trees, tree_features(text))
        assert got[i][1] == pytest.approx(score, abs=1e-9) and got[i][0] == failed and got[i][2] == (not failed and score >= 0.5)


def test_op6_scores_are_those_of_a_plain_pass(spark, sf_dir, awkward):  # noqa: F811
    labels = queries.table(spark, sf_dir, "labels")
    docs = queries.table(spark, sf_dir, "documents")
    model = fit_quality(docs, labels, "doc_id", "text", "quality", 4, 2, 3000, 64 << 20)
    both = docs.select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = by_id(classify_quality(both.repartition(3), labels), "score")
    for i, text in (dict(rows_of(spark, sf_dir)) | {i + 10**6: t for i, t in AWKWARD}).items():
        assert got[i][0] == pytest.approx(attention_score(model, text, PASSAGE, BUCKETS, hashed), abs=1e-6)


def test_fitted_bytes_and_repeated_ids_are_bounded(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    labels = queries.table(spark, sf_dir, "labels")
    more = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 20"))
    one, two = (fit_quality(d, labels, "doc_id", "text", "quality", 4, 2, 3000, 64 << 20) for d in (docs, more))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)
    small = fit_quality(docs, labels, "doc_id", "text", "quality", 4, 2, 3000, 100_000)
    assert any((one.p[k] != small.p[k]).any() for k in one.p)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_op8_splits_texts_of_one_hash(spark, awkward, keep):  # noqa: F811
    """A hash of one hexadecimal digit: most groups hold texts that differ."""
    weak = lambda t: F.substring(F.md5(t), 1, 1)
    rows = [*AWKWARD, AWKWARD[5], (None, "a"), (None, "a"), (None, "only without an id"), (6, "other text of id 6")]
    docs = awkward.unionByName(awkward.where("doc_id = 6")).select("doc_id", "text").unionByName(spark.createDataFrame(rows[-4:], "doc_id long, text string"))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, keep=keep, content_hash=weak).collect()]
    want = []
    for i, t in rows:
        own = [j for j, u in rows if (u or "") == (t or "")]
        best = (min if keep == "min" else max)([j for j in own if j is not None], default=None)
        want.append((i, best, len(own), i == best, sha((t or "").encode())))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_copies_go_whatever_the_columns_are_called(spark):
    names = ["row", "id", "sha", "__sha", "__id", "kept_id", "kept_sha", "tie", "given", "place", "h", "t"]
    rows = [(i, x, *(f"{c}{i}" for c in names)) for i, x in [(1, None), (1, ""), (2, "a"), (2, "a"), (3, "a"), (None, "b"), (None, "b")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(1, None), (2, "a"), (None, "b")]


def test_tokenizers_that_see_white_space_are_refused():
    import json

    definition = json.loads(open(queries.tokenizer_path()).read())
    definition["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    with pytest.raises(ValueError):
        WordTokenizer(json.dumps(definition))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in result.description]
    want = [tuple(row[columns.index(c)] for c in sorted(columns)) for row in result.fetchall()]
    found = queries.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in sorted(columns))) for r in found.collect())


def made(spark, tmp_path, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return docs


def test_pipeline_on_awkward_rows(spark, sf_dir, tmp_path):
    """Nulls, empty and repeated rows beside good documents: what stays is a document once, and nothing staged is left."""
    good = [(i, t, f"src{i % 3}") for i, t in rows_of(spark, sf_dir)]
    rows = good + [(10**6 + i, t, None if i % 2 else "src0") for i, t in AWKWARD] + good[:5] + [(None, None, None), (None, "", "src1"), (None, good[0][1], None)]
    made(spark, tmp_path, rows)
    queries.table(spark, sf_dir, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    with staging.scope():
        pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {(i, t) for i, t, _ in rows}
    ids = [r.doc_id for r in pieces if r.start == 0]
    assert len(ids) == len(set(ids)) and set(ids) <= {i for i, _ in texts} and len(ids) > 50
    for r in pieces:
        assert 0 < r.length and r.start + r.length <= r.doc_tokens


def test_pipeline_on_empty_tables(spark, tmp_path):
    made(spark, tmp_path, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
