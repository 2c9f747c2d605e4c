"""Toxicity against a plain noisy-or, held-out labels and planted sentences."""

import re

import numpy as np
import pytest
from brute import LOWER
from pyspark.sql import functions as F
from test_llm import AWKWARD, awkward, by_id, empty, rows_of  # noqa: F401

from strata.llm import queries
from strata.llm.noisy_or import either, fit_noisy_or
from strata.llm.text import slice_hashes
from strata.llm.toxicity import BUCKETS, LONGEST, STEM, fit_toxicity, score_toxicity

MODEL = ("doc_id", "text", "toxic", 4, 2, 4000, 24 << 20)


def bucket(raw, seed):
    return int(slice_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), seed=seed)[0]) % BUCKETS


def plain(model, text):
    """Score and the probabilities of the sentences, one by one."""
    odds = []
    for part in re.split(r"[.!?\n]", (text or "").translate(LOWER)):
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", part)
        for k in range(0, len(own), LONGEST):
            raw = [w.encode() for w in own[k : k + LONGEST]]
            seen = {bucket(w, 11) for w in raw} | {bucket(w[:STEM], 12) for w in raw}
            odds.append(model.bias + sum(model.weights[b] for b in seen))
    p = 1 / (1 + np.exp(-np.array(odds)))
    return 1 - np.prod(1 - p), p


def test_scores_are_those_of_a_plain_pass(spark, sf_dir, awkward):  # noqa: F811
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, *MODEL)
    both = docs.select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = by_id(score_toxicity(both.repartition(3), labels), "score", "predicted", "n_sentences", "offending")
    for i, text in (dict(rows_of(spark, sf_dir)) | {i + 10**6: t for i, t in AWKWARD}).items():
        score, p = plain(model, text)
        assert got[i][0] == pytest.approx(score, abs=1e-9) and got[i][1] == int(score >= 0.3) and got[i][2] == len(p)
        assert [x.probability for x in got[i][3]] == pytest.approx([v for v in p if v >= 0.1 or (score >= 0.3 and v >= p.max() - 1e-12)])


def test_planted_sentences_are_found(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{k:03d}" for k in range(300)]
    sentence = lambda bad="": " ".join([*rng.choice(vocabulary, 8), *([bad] if bad else [])]).capitalize() + "."
    rows, labels = [], []
    for i in range(600):
        own = [sentence() for _ in range(int(rng.integers(1, 12)))]
        toxic = int(i % 5 == 0)
        if toxic:
            own[int(rng.integers(len(own)))] = sentence(["Scum", "éidiot"][i % 2])
        rows.append((i, " ".join(own)))
        labels.append((i, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(score_toxicity(docs, marks), "predicted", "offending")
    for i, text in rows:
        assert got[i][0] == labels[i][1]
        found = [text.encode()[x.start : x.end].decode() for x in got[i][1]]
        assert len(found) == labels[i][1] and all("scum" in x or "éidiot" in x for x in found)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    got = by_id(queries.op12_toxicity(spark, sf), "held_out", "score", "predicted")
    held = [(got[i][1], got[i][2], y) for i, y in marks.items() if got[i][0]]
    clean = [s for s, _, y in held if not y]
    assert np.mean([np.mean([s > c for c in clean]) for s, _, y in held if y]) > 0.9
    assert sum(p for _, p, y in held if not y) <= 2 and sum(p for _, p, y in held if y) >= 7


def test_no_labels_and_no_rows(spark, awkward, empty):  # noqa: F811
    none = spark.createDataFrame([(None, None), (1, None), (99, 1)], "doc_id long, toxic int")
    got = by_id(score_toxicity(awkward, none), "score", "predicted", "n_sentences")
    assert all(0 <= s <= 1 and (s == 0) == (n == 0) for s, _, n in got.values()) and len(got) == len(AWKWARD)
    assert score_toxicity(empty, none).count() == 0
    twice = score_toxicity(awkward.unionByName(awkward), none)
    assert twice.count() == 2 * len(AWKWARD) and twice.columns == ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"]


def test_a_bag_is_a_noisy_or():
    z = np.array([-1.0, 0.5, 2.0])
    p = 1 / (1 + np.exp(-z))
    assert either(z, np.array([0, 2, 2, 3])) == pytest.approx([1 - (1 - p[0]) * (1 - p[1]), 0, p[2]])
    one = fit_noisy_or(np.zeros(0, int), np.zeros(0, int), np.zeros(1, int), np.zeros(0), 8)
    assert not one.weights.any()
