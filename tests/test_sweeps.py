"""Sweeps against products of all pairs."""

import random

import pytest

from strata.operators import style, sweeps


def test_running_sums_of_a_group_that_has_nearly_all_rows(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.9 else 2, rng.randrange(50), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, a int, b int, v int").repartition(5)
    got = {r.b: r.s for r in sweeps.running_sums(df, ["g"], ["a", "b"], "v", "s").collect()}
    for g in (1, 2):
        total = 0
        for _, _, b, v in sorted(r for r in rows if r[0] == g):
            total += v
            assert got[b] == total


@pytest.mark.parametrize("apart", [False, True])
def test_nearest_neighbours(spark, apart):
    rng = random.Random(2)
    left = [(rng.randrange(3), i, rng.choice([0.5, 1.0, 2.5, 7.0, rng.random() * 9])) for i in range(200)] + [(0, 900, None), (None, 901, 1.0), (7, 902, 1.0)]
    right = [(rng.randrange(3), i, rng.choice([0.5, 1.0, 2.5, 7.0, rng.random() * 9])) for i in range(60)] + [(0, 903, None), (None, 904, 1.0)]
    schema = "k int, id int, value double"
    got = {}
    for r in sweeps.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", 4, apart).collect():
        got.setdefault((r.k, r.id), {})[r.place] = (r.other, r.distance)
    for k, i, v in left:
        want = sorted((abs(v - w), j) for q, j, w in right if q == k and w is not None and not (apart and i == j))[:4] if k is not None and v is not None else []
        assert got.get((k, i), {}) == {n + 1: (j, d) for n, (d, j) in enumerate(want)}


def test_lowest_free_places(spark):
    rng = random.Random(3)
    obstacles = [(rng.randrange(4), top := rng.randrange(200), top + rng.choice([0, 5, 20, 40]), rng.choice([0, 30, 60, 90])) for _ in range(60)]
    blocks = [(rng.randrange(5), i, rng.randrange(220), rng.choice([5, 20, 50, 80, 120])) for i in range(200)]
    got = {r.id: r.y for r in sweeps.lowest_free(spark.createDataFrame(blocks, "k int, id int, y int, need int"), spark.createDataFrame(obstacles, "k int, top int, bottom int, width int"), "k", 7, 100).collect()}
    for k, i, y, need in blocks:
        while any(q == k and b > t and t < y + 7 and b > y and 100 - w < need for q, t, b, w in obstacles):
            y += 1
        assert got[i] == y


def test_coverage_by_intervals(spark):
    rng = random.Random(4)
    faces = [(f"f{i}", i) for i in range(6)]
    held = [(f"f{rng.randrange(1, 6)}", low := rng.randrange(300), low + rng.choice([0, 1, 9, 70])) for _ in range(25)] + [("f5", 0x1F600, 0x1F64F), ("f2", 50, 40)]
    chars = [(f"f{rng.randrange(6)}", at) for at in [*(rng.randrange(420) for _ in range(250)), 0x1F600, 0x1F64F, 0x1F650, 2**21 - 1]]
    got = sorted((r.face, r.at, r.drawn_by) for r in style.by_coverage(spark.createDataFrame(chars, "face string, at int"), spark.createDataFrame(faces, "face string, rank int"), spark.createDataFrame(held, "face string, low int, high int")).collect())
    has = lambda f, at: any(g == f and a <= at <= b for g, a, b in held)
    want = [(f, at, f if has(f, at) else next((g for g, _ in faces if has(g, at)), None)) for f, at in chars]
    assert got == sorted(want)
