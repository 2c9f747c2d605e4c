"""Language-model scores against a plain model; the filter's two places; block messages."""

import math

import numpy as np
import pytest
from brute import PairModel
from test_llm import AWKWARD, awkward, by_id, empty, rows_of, small_parts  # noqa: F401

from strata.llm import blocks, queries
from strata.llm.lm_scoring import history_of, score_texts
from strata.llm.text import mix, unmix

COLUMNS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize("filter_bytes", [64 << 20, 0])
def test_scores_are_the_plain_models(spark, sf_dir, awkward, empty, small_parts, filter_bytes):  # noqa: F811
    """48 bits a level and 20 probes leave no false positives."""
    for docs, rows in ((queries.table(spark, sf_dir, "documents"), rows_of(spark, sf_dir)), (awkward, AWKWARD)):
        model = PairModel(rows)
        got = by_id(score_texts(docs, bits_each=48, probes=20, most_filter_bytes=filter_bytes), *COLUMNS)
        assert set(got) == {i for i, _ in rows}
        for i, found in got.items():
            want = model.row(i)
            assert found[:4] == want[:4]
            assert found[4:] == pytest.approx(want[4:], rel=1e-9, abs=1e-9)
    assert score_texts(empty).count() == 0


def test_false_positives_change_little(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    model = PairModel(rows)
    got = by_id(queries.op7_lm_scoring(spark, sf_dir), *COLUMNS)
    off = [abs(got[i][5] - model.row(i)[5]) / got[i][1] for i, _ in rows]
    assert np.mean(off) < 0.02 and all(got[i][:4] == model.row(i)[:4] for i, _ in rows)


def test_probabilities_sum_to_one(spark):
    """One-word texts: P(w after an end) * P(end after w), the second from the plain model; w over all words and one unknown."""
    rows = [(1, "a b"), (2, "a b"), (3, "a c"), (4, "a c d a"), (5, "b b b"), (7, None)]
    model = PairModel(rows)
    for h in (None, "a", "b", "c", "d", "unseen"):
        assert sum(model.after(h, w) for w in [*model.one, "unknown"]) == pytest.approx(1)
    tests = [(i, w) for i, w in zip((6, 29, 37, 40, 48), ["a", "b", "c", "d", "unknown"], strict=True)]
    got = by_id(score_texts(spark.createDataFrame(rows + tests, "doc_id long, text string"), bits_each=64, probes=20), *COLUMNS)
    assert all(got[i][0] for i, _ in tests)
    mass = model.after(None, None) + sum(10 ** got[i][5] / model.after(w if w != "unknown" else "unseen", None) for i, w in tests)
    assert mass == pytest.approx(1) and math.isclose(got[7][5], math.log10(model.after(None, None)), rel_tol=1e-9)


def test_scores_do_not_depend_on_the_bound(spark, sf_dir, small_parts):  # noqa: F811
    """Two bits a level: so many false positives that exact counts would give other scores."""
    docs = queries.table(spark, sf_dir, "documents")
    shared, ranged = (by_id(score_texts(docs, bits_each=2, most_filter_bytes=most), "score") for most in (64 << 20, 0))
    assert shared == ranged


def test_pairs_help_on_held_out_text(spark):
    found = queries.op7_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(base_score) AS b", "sum(score) AS s").first()
    assert found.s > found.b


def test_mix_goes_back_and_pairs_name_their_history():
    keys = np.random.default_rng(3).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2)
    assert (unmix(mix(keys)) == keys).all()
    assert (history_of(mix(keys)) == keys >> np.uint64(32)).all()


def test_messages_come_back_by_block():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.int64), np.array([1, 2, 3], np.uint8), np.array([True, False])]
    for form in (blocks.flat, blocks.pack):
        for count in (1, 4):
            assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays[:count], blocks.unpack(form(*arrays[:count])), strict=True))
    sent = [(7, blocks.flat(arrays[0])), (3, blocks.flat(arrays[2])), (9, blocks.flat(arrays[1]))]
    numbers, payloads = blocks.unbundle([blocks.bundle(*map(list, zip(*sent[:2], strict=True))), blocks.bundle(*map(list, zip(*sent[2:], strict=True)))])
    assert numbers.tolist() == [3, 7, 9] and [blocks.unpack(p)[0].tolist() for p in payloads] == [[1, 2, 3], [0, 1, 2, 3, 4], []]


def test_message_bytes_stay_flat_when_blocks_multiply():
    """The same keys from four times the blocks, each with a quarter of them, over as many ranges."""
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 40_000).astype(np.uint64))
    size = {}
    for count in (10, 40):
        parts = [keys[k::count] for k in range(count)]
        held = {}
        for number, own in enumerate(parts):
            for bucket, a, b in blocks.split_sorted(own * np.uint64(2), 64):
                held.setdefault(bucket, []).append((number, blocks.flat(own[a:b])))
        size[count] = sum(len(blocks.bundle(*map(list, zip(*m, strict=True)))) for m in held.values())
    assert size[40] < 1.25 * size[10]
