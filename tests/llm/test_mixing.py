"""Mixing against a plain earliest-deadline-first loop, on rows and on awkward columns."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import mixing, queries
from strata.llm.mixing import mix_sources, mixed, schedule
from strata.llm.packing import pack_in_order
from strata.llm.staging import Stage


def plain_slots(weights, slots):
    """The source of each slot: of the released blocks the one due first, then the heavier, then the smaller name."""
    total, had, out = sum(weights.values()), Counter(), []
    ceil = lambda a, b: -(-a // b)
    for t in range(slots):
        ready = [(ceil((had[s] + 1) * total, w), -w, s) for s, w in weights.items() if had[s] * total // w <= t]
        out.append(min(ready)[2])
        had[out[-1]] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 7, "b": 3, "c": 1, "d": 5}, {"a": 4, "b": 2, "c": 2}, {f"s{i:03}": 1 + 8 * (i == 5) for i in range(300)}, {"a": 1}])
def test_schedule_is_earliest_deadline_first(spark, weights):
    classes = Counter(weights.values())
    names = {w: sorted(s for s in weights if weights[s] == w) for w in classes}
    got = sorted(schedule(spark, classes).collect(), key=lambda r: r.slot)
    assert [names[r.weight][r.place] for r in got] == plain_slots(weights, len(got))
    total, had = sum(weights.values()), Counter()
    for r in got:
        assert r.release_at <= r.slot < r.due_at
        had[names[r.weight][r.place]] += 1
        assert all(abs(had[s] - Fraction((r.slot + 1) * w, total)) < 1 for s, w in weights.items())


def test_weights_beyond_any_small_period(spark):
    got = schedule(spark, {10_007: 1, 3: 2, 1: 900})
    assert got.count() == 10_007 + 6 + 900
    with pytest.raises(ValueError):
        schedule(spark, {0: 1})


def check(docs, weights, block_rows):
    """Rows stand in their source's slots in id order, and while in_mix each source is under one block from its target."""
    rows = mix_sources(docs, weights, block_rows=block_rows).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    of = lambda r: r.source or ""
    full = {of(r): weights.get(of(r), 1) for r in rows}
    total = sum(full.values())
    by = defaultdict(list)
    for r in rows:
        by[of(r)].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.doc_id)
        assert own == sorted(own, key=lambda r: (r.mix_slot, r.mix_offset))
        assert [r.mix_offset for r in own] == [i % block_rows for i in range(len(own))]
    order = plain_slots(full, max(r.mix_slot for r in rows) + 1)
    assert all(order[r.mix_slot] == of(r) for r in rows)
    inside = sorted((r for r in rows if r.in_mix), key=lambda r: r.mix_slot)
    end = min(next(t for t, s in enumerate(order + [s]) if s == x and order[:t].count(x) == len(own) // block_rows) if order.count(x) > len(own) // block_rows else len(order) for x, own in by.items() for s in [x])
    assert {r.mix_slot for r in inside} == set(range(end))
    had = Counter()
    for t in range(end):
        had.update(of(r) for r in inside if r.mix_slot == t)
        assert all(abs(had[s] - Fraction((t + 1) * w * block_rows, total)) < block_rows for s, w in full.items())
    return rows


def test_rows_keep_the_weights_at_any_size(spark, sf_dir):
    for n in (40, 600):
        docs = spark.createDataFrame([(i * 977 % 100_003, None if i % 7 == 0 else f"s{i % 3}") for i in range(n)], "doc_id long, source string")
        check(docs, {"s0": 3}, 4)
    check(queries.table(spark, sf_dir, "documents").select("doc_id", "source"), queries.MIX_WEIGHTS, 8)


def test_clashing_names_ties_nulls_and_no_rows(spark):
    names = ["slot", "weight", "release_at", "due_at", "turn", "turns", "place", "p", "n", "i", "part", "before", "block", "row", "rows", "tie", "id", "at", "own", "own_source", "full", "c", "__source", "__n", "__block", "mix_slot"]
    rows = [(i if i % 5 else None, f"s{i % 2}", *(f"{c}{i}" for c in names)) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, source string, " + ", ".join(f"{c} string" for c in names))
    kept = [c for c in docs.columns if c != "mix_slot"]
    for _ in range(2):
        found = mix_sources(docs, {"s0": 2}, block_rows=4)
        assert found.columns == [*kept, *mixing.NEW]
        places = sorted((str(r.doc_id), r.slot, r.mix_slot, r.mix_offset) for r in found.repartition(7).collect())
        assert sorted(r[1] for r in places) == sorted(r.slot for r in docs.collect()) and len({r[2:] for r in places}) == 63
    assert places == sorted((str(r.doc_id), r.slot, r.mix_slot, r.mix_offset) for r in mix_sources(docs.repartition(5), {"s0": 2}, block_rows=4).collect())
    got = mixed(docs, {"s0": 2}, block_rows=4, whole=True)
    assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))
    none = docs.where("false")
    assert mix_sources(none).count() == 0 and mixed(none).columns == docs.columns and mixed(none, whole=True).count() == 0
    assert all(r.in_mix for r in mix_sources(docs, {"s0": 2}, ends="last").collect())


def test_pipeline_mixing_keeps_every_row_in_slot_order(spark):
    rows = [(i, None if i % 31 == 0 else f"src{i % 2}", "keep") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    slots = {r.doc_id: (r.mix_slot, r.mix_offset) for r in mix_sources(docs, queries.MIX_WEIGHTS).collect()}
    found = [r.doc_id for r in corpus_pipeline.mixing(spark, docs, "").collect()]
    assert found == sorted(range(500), key=slots.get)
    inside = [r.doc_id for r in mixed(docs, queries.MIX_WEIGHTS).collect()]
    assert len(inside) < 500 and set(inside) < set(found)


def test_pipeline_packs_stretches_of_the_mixture(spark, tmp_path):
    rows = [(i, f"src{i % 3}" if i % 2 else "wiki", f"{i} word" * (1 + i % 40)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1)
    stage = Stage(spark, "mixture")
    docs = stage.put(docs, "given")
    corpus_pipeline.mixing(spark, docs, "").write.option("maxRecordsPerFile", 90).parquet(str(tmp_path / "mixed"))
    found = spark.read.parquet(str(tmp_path / "mixed"))
    order = [r.doc_id for r in found.orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()]
    assert order != sorted(order)
    groups = defaultdict(list)
    for r in pack_in_order(found, queries.tokenizer_path(), group_bytes=4096).collect():
        groups[r.sequence_id >> 32].append(r)
    at = 0
    for _, own in sorted(groups.items()):
        ids = {r.doc_id for r in own}
        assert ids == set(order[at : at + len(ids)])
        at += len(ids)
        for r in own:
            assert zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.offset + r.length <= 4096
    assert at == 400 and len(groups) > 4
    # What the mixture comes to is seen in the corpus: the same documents in another order are packed otherwise.
    sequences = lambda df: sorted((r.sequence_id, r.offset, r.doc_id) for r in corpus_pipeline.packing(spark, df, "").collect())
    assert sequences(docs) != sequences(found)
    stage.clear()
