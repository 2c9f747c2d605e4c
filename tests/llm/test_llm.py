"""Operators for training data against brute force, on given tables and on awkward rows."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from brute import LOWER, counts, sha, similar, string_dedup, window_dedup, words
from strata.llm import blocks, ngram_join, queries
from strata.llm.boosting import fit_trees
from strata.llm.count_filter import CountFilter, build_segment
from strata.llm.exact_dedup import drop_exact_copies, exact_groups
from strata.llm.mil import fit_attention
from strata.llm.ngram_join import drop_similar, join_similar, verify_links
from strata.llm.packing import WordTokenizer, first_fit_decreasing, lay_out, pack_documents
from strata.llm.quality_classifier import classify_quality, drop_low_quality
from strata.llm.quality_rules import quality_rules
from strata.llm.substring_dedup import drop_repeated_windows
from strata.llm.suffix import repeated_later
from strata.llm.suffix_dedup import drop_repeated_strings

LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(40_000))
BASE = " ".join(f"Base{i}" for i in range(120))
#: Nulls, empty, white space only, very long, equal texts, near copies and non-ASCII; ids are unique.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, LONG), (5, LONG), (6, BASE), (7, BASE), (8, BASE + " tail"), (9, BASE.replace("Base7 ", "Other ")),
    (10, "é ü\u00a0ß 漢字 a"), (11, "A"), (12, "a"), (13, "one two three"), (14, "One TWO three"), (15, "x" * 5000), (16, "x" * 5000), (17, "ab" * 99), (18, "line\nline\nline\n\n#"),
    (19, " ".join([BASE] * 3)), (20, "!" * 150 + BASE[:200]),
]


@pytest.fixture
def awkward(spark):
    rows = [(i, t, "en", "s", 0, "clash", 1, 2) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, id long, t int")


@pytest.fixture
def empty(awkward):
    return awkward.where("false")


@pytest.fixture
def small_parts(monkeypatch):
    """Many blocks and parts, as with large inputs."""
    monkeypatch.setattr(blocks, "BLOCK", 3000)
    monkeypatch.setattr(ngram_join, "PART", 3)
    monkeypatch.setattr(ngram_join, "ELEMENTS", 300)


def rows_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_suffix_sort_matches_a_set():
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = rng.integers(0, rng.integers(1, 5), 300).astype(np.uint8)
        text = np.concatenate([base[rng.integers(0, 150) :][: rng.integers(5, 200)] for _ in range(8)])
        width = int(rng.choice([8, 12, 33]))
        at = np.flatnonzero(rng.random(max(0, len(text) - width + 1)) < 0.8)
        seen, want = set(), []
        for p in at:
            want.append(text[p : p + width].tobytes() in seen)
            seen.add(text[p : p + width].tobytes())
        assert (repeated_later(text, at, width, bucket=40) == np.array(want, bool)).all()


def test_op1_on_table_and_awkward_rows(spark, sf_dir, awkward, empty, small_parts):
    got = by_id(queries.op1_suffix_dedup(spark, sf_dir), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == string_dedup(rows_of(spark, sf_dir), 100)
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed_from), sha(bytes(r.kept))) for r in drop_repeated_strings(awkward).collect()}
    assert found == string_dedup(AWKWARD, 100)
    assert drop_repeated_strings(empty).count() == 0


def test_op2_round_trip(spark, sf_dir, awkward, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for docs, texts in ((queries.table(spark, sf_dir, "documents"), rows_of(spark, sf_dir)), (awkward, AWKWARD)):
        pieces = pack_documents(docs, queries.tokenizer_path()).toPandas()
        for i, text in texts:
            own = pieces[pieces.doc_id == i].sort_values("start")
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            assert b"".join(own.ids.map(bytes)) == ids.tobytes() and (own.doc_tokens == len(ids)).all()
            assert own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        padded = 0
        for _, own in pieces.sort_values("offset").groupby("sequence_id"):
            total = int(own.length.sum())
            assert total <= 4096 and own.offset.tolist() == [0, *own.length.cumsum()[:-1]]
            padded += 4096 - total if total & (total - 1) else 0
        assert padded <= 16 * pieces.sequence_id.nunique()
    assert pack_documents(empty, queries.tokenizer_path()).count() == 0


def test_first_fit_decreasing_is_first_fit():
    sizes = np.random.default_rng(2).integers(1, 100, 300)
    room, want = [], np.zeros(300, int)
    for item in np.argsort(-sizes, kind="stable"):
        fit = next((b for b, r in enumerate(room) if r >= sizes[item]), None)
        if fit is None:
            fit = len(room)
            room.append(100)
        room[fit] -= sizes[item]
        want[item] = fit
    assert (first_fit_decreasing(sizes, 100) == want).all()
    assert sum(r[2] for r in lay_out(sizes, 128, 4)) == sizes.sum()


def test_words_tokenize_alone_as_in_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b İstanbul", "é́ x y   ΑΣ ΣΑΣ.", "don't I'LL 12 345", "\x00\x1f á", "", "ﬁ ẞ İ\u2003x"]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids, bounds = WordTokenizer(open(queries.tokenizer_path()).read()).encode(pa.array(texts), 2)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_op3_on_table_and_awkward_rows(spark, sf_dir, awkward, empty, small_parts):
    got = by_id(queries.op3_ngram_join(spark, sf_dir), "n_shingles", "component_id")
    assert got == similar(rows_of(spark, sf_dir), 4, 85)
    assert by_id(join_similar(awkward, n=4, percent=85), "n_shingles", "component_id") == similar(AWKWARD, 4, 85)
    assert join_similar(empty).count() == 0
    kept = drop_similar(awkward)
    assert kept.columns == awkward.columns
    want = {i for i, (_, c) in similar(AWKWARD, 5, 80).items() if i == c}
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in AWKWARD if i in want}


def test_links_of_a_large_group_of_near_copies(spark, small_parts):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        own = [f"w{k}" for k in range(60)]
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            own[k] = f"e{rng.integers(0, 3)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(join_similar(docs, n=4, percent=85), "n_shingles", "component_id") == similar(rows, 4, 85)


def test_pairs_across_sides_only():
    sets = [np.arange(10, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)]
    assert len(set(verify_links(sets, np.array([0, 0, 1]), True, 80))) == 1
    assert len(set(verify_links(sets[:2], np.array([0, 0]), True, 80))) == 2


def test_links_of_cells_are_those_of_all_pairs():
    rng = np.random.default_rng(9)
    for percent in (50, 80, 95):
        base = [rng.choice(200, rng.integers(1, 40), replace=False) for _ in range(12)]
        sets = []
        for _ in range(80):
            own = base[rng.integers(0, 12)]
            own = np.union1d(own[rng.random(len(own)) < 0.9], rng.integers(0, 300, rng.integers(0, 4)))
            sets.append(own.astype(np.uint64))
        label = np.arange(80)
        for i in range(80):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[label == label[i]] = label[j]
        got = verify_links(sets, np.zeros(80), False, percent)
        assert (np.equal.outer(got, got) == np.equal.outer(label, label)).all()


def test_op4_counts_and_verdicts(spark, sf_dir, awkward, empty):
    got = by_id(queries.op4_quality_rules(spark, sf_dir), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, text in rows_of(spark, sf_dir):
        want = counts(text)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[i][:6] == (*want, failed) and not (failed and got[i][6])
    labels = queries.table(spark, sf_dir, "labels")
    right = [got[r.doc_id][6] == (r.quality == 1) for r in labels.collect() if not got[r.doc_id][5]]
    assert np.mean(right) > 0.95
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    found = by_id(quality_rules(awkward, none), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept")
    assert {i: v[:5] for i, v in found.items()} == {i: counts(t) for i, t in AWKWARD}
    assert quality_rules(empty, labels).count() == 0


def test_trees_keep_their_constraint():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) + rng.normal(0, 0.5, 2000) > 0).astype(float)
    trees = fit_trees(x, y, np.array([1, -1, 0]))
    grid = np.repeat(x[:50], 40, axis=0)
    for f, sign in ((0, 1), (1, -1)):
        moved = grid.copy()
        moved[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (sign * np.diff(trees.margin(moved).reshape(50, 40), axis=1) >= -1e-9).all()
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.8


def test_op5_on_table_and_awkward_rows(spark, sf_dir, awkward, empty, small_parts):
    got = by_id(queries.op5_substring_dedup(spark, sf_dir), "n_words", "n_removed", "kept_sha256")
    assert got == window_dedup(rows_of(spark, sf_dir), 50)
    found = {r.doc_id: (r.n_words, r.n_removed, sha(r.kept_text.encode())) for r in drop_repeated_windows(awkward).collect()}
    assert found == window_dedup(AWKWARD, 50)
    assert drop_repeated_windows(empty).count() == 0


def test_op6_held_out_accuracy(spark, awkward, empty):
    sf = "/root/testdata/sf0.01"
    got = by_id(queries.op6_quality_classifier(spark, sf), "held_out", "score", "predicted")
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= s <= 1 and p == int(s >= 0.7) for i, (h, s, p) in got.items())
    labels = queries.table(spark, sf, "labels").collect()
    assert np.mean([got[r.doc_id][2] == r.quality for r in labels if got[r.doc_id][0]]) > 0.93
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {s for _, s, _ in by_id(classify_quality(awkward, none), "held_out", "score", "predicted").values()} == {0.5}
    assert classify_quality(empty, none).count() == 0
    assert drop_low_quality(awkward, queries.table(spark, sf, "labels")).columns == awkward.columns


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 600)
    bags = np.concatenate([[0], np.cumsum(sizes)])
    x, y = rng.normal(size=(bags[-1], 4)), (rng.random(600) < 0.5).astype(float)
    x[bags[:-1][y == 1] + rng.integers(0, sizes[y == 1]), 2] += 5
    model = fit_attention(x[: bags[400]], bags[:401], y[:400])
    score = model.score(x[bags[400] :], bags[400:] - bags[400])
    assert ((score > 0.5) == (y[400:] == 1)).mean() > 0.9


def test_count_filter_levels():
    keys = np.random.default_rng(6).integers(0, 2**63, 4000).astype(np.uint64)
    levels = np.arange(4000) % 4
    bits = build_segment(keys[levels > 0], levels[levels > 0], 12, 6)
    found = CountFilter(bits, np.array([0]), np.array([8 * len(bits)]), 6).levels(keys)
    assert (found >= levels).all() and (found != levels).mean() < 0.02


def test_op8_groups(spark, awkward, empty):
    doubled = awkward.unionByName(awkward.where("doc_id = 6"))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(doubled, keep="max").collect()]
    rows = [*AWKWARD, AWKWARD[5]]
    want = []
    for i, t in rows:
        own = [j for j, u in rows if (u or "") == (t or "")]
        want.append((i, max(own), len(own), i == max(own), sha((t or "").encode())))
    assert sorted(got) == sorted(want)
    kept = drop_exact_copies(doubled)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 8, 9, 10, 11, 12, 13, 14, 15, 17, 18, 19, 20]
    assert exact_groups(empty).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns = docs.columns
    texts = dict(rows_of(spark, sf_dir))
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = step(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= before and all(texts[i] == t for i, t in after.items())
        if name == "exact_dedup":
            assert len(after) == len({texts[i] for i in before})
        if name == "ngram_join":
            assert set(after) == {i for i, (_, c) in similar([(i, texts[i]) for i in before], 5, 80).items() if i == c}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == len(after)
    assert corpus_pipeline.run(spark, sf_dir).count() == pieces.count()
