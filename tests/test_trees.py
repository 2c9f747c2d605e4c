"""Ancestors, composed maps and nested tables against walks one by one."""

import math
import os
import random
from contextlib import suppress

import pytest
from pyspark.sql import functions as F

from strata.operators import trees
from strata.operators.rounds import shared_folder


def test_ancestors_of_forests_and_cycles(spark):
    rng = random.Random(2)
    up = {i: rng.choice([None, rng.randrange(i) if i else None]) for i in range(150)}
    up |= {i: i - 1 for i in range(200, 300)} | {200: None}  # a long chain
    up |= {400: 401, 401: 402, 402: 400, 403: 402, 404: 403, 405: 405, 406: 9999}  # cycles, and one unknown
    links = spark.createDataFrame(list(up.items()), "id long, up long")
    got = {}
    for r in trees.ancestors_of(links.where("up <> 9999 OR up IS NULL"), links.select("id")).collect():
        got.setdefault(r.id, {})[r.depth] = r.ancestor
    for i in up:
        walk, at = [], i
        while at is not None and at in up and at not in walk:
            walk.append(at)
            at = up[at]
        assert got[i] == dict(enumerate(walk))


def test_maps_compose_to_the_page(spark):
    rng = random.Random(3)
    rows, maps = [], {}
    for i in range(120):
        parent = rng.randrange(i) if i and rng.random() < 0.9 else None
        maps[i] = (parent, [rng.choice([1.0, 2.0, 0.5, -1.0]), 0.0, 0.0, rng.choice([1.0, 0.5, -1.0]), float(rng.randrange(50)), float(rng.randrange(50))])
        rows.append((i, parent, tuple(maps[i][1])))
    rows += [(500, 501, rows[0][2]), (501, 500, rows[0][2]), (502, 501, rows[0][2]), (503, 999, rows[0][2])]
    kind = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    got = {r.id: tuple(r.map) for r in trees.composed(spark.createDataFrame(rows, f"id long, up long, map {kind}")).collect()}
    assert sorted(got) == list(range(120))
    for i in range(120):
        points = []
        for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0)):
            at = i
            while at is not None:
                at, (a, b, c, d, e, f) = maps[at]
                x, y = a * x + c * y + e, b * x + d * y + f
            points.append((x, y))
        (e, f), (ax, by), (cx, dy) = points
        assert got[i] == pytest.approx((ax - e, by - f, cx - e, dy - f, e, f))


@pytest.mark.parametrize("turn", [0, 5_400_000, 10_800_000, -5_400_000, 1_234_567])
def test_a_group_is_scaled_mirrored_and_turned_about_its_middle(spark, turn):
    lit = lambda *v: tuple(F.lit(x) for x in v)
    m = trees.group_map(lit(100, 50), lit(40, 20), lit(10, 10), lit(80, 20), F.lit(turn), F.lit(True), F.lit(False))
    x, y = trees.mapped("m", F.lit(30), F.lit(15))
    got = spark.range(1).select(m.alias("m")).select(x.alias("x"), y.alias("y")).first()
    px, py = 100 + (30 - 10) * 0.5, 50 + (15 - 10) * 1.0  # in the frame
    px = 240 - px  # mirrored about x = 120
    angle = math.radians(turn / 60_000)
    dx, dy = px - 120, py - 60
    assert (got.x, got.y) == pytest.approx((120 + dx * math.cos(angle) - dy * math.sin(angle), 60 + dx * math.sin(angle) + dy * math.cos(angle)))


def plain(tables, cells):
    """tables: id -> (up, row, column); cells: (table, row, column, rows, content)."""
    heights = {}

    def of(table):
        if table not in heights:
            own = [(r, c, n, h + sum(sum(of(t)) for t in tables if tables[t] == (table, r, c))) for t_, r, c, n, h in cells if t_ == table]
            count = max((r + n for r, _, n, _ in own), default=0)
            rows = [max([h for r, _, n, h in own if r == k and n == 1], default=0) for k in range(count)]
            for r, _, n, h in sorted(x for x in own if x[2] > 1):
                rows[r + n - 1] += max(h - sum(rows[r : r + n]), 0)
            heights[table] = rows
        return heights[table]

    def top(table):
        up, row, column = tables[table]
        if up is None:
            return 0
        content = next(h for t_, r, c, _, h in cells if (t_, r, c) == (up, row, column))
        return top(up) + sum(of(up)[:row]) + content + sum(sum(of(t)) for t in tables if tables[t] == (up, row, column) and t < table)

    out = []
    for table in tables:
        line, at = [table], table
        while tables[at][0] is not None:
            at = tables[at][0]
            line.append(at)
        for k, h in enumerate(of(table)):
            outermost = k if len(line) == 1 else tables[line[-2]][1]
            out.append((table, len(line) - 1, line[-1], k, h, top(table) + sum(of(table)[:k]), outermost))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_nested_tables_against_a_recursive_walk(spark, seed):
    rng = random.Random(seed)
    tables, cells = {}, []
    for i in range(25):
        rows, columns = rng.randint(1, 5), rng.randint(1, 3)
        free = [[True] * columns for _ in range(rows)]
        for r in range(rows):
            for c in range(columns):
                if free[r][c]:
                    n = rng.choice([1, 1, 1, 2, 3])
                    n = max(k for k in range(1, n + 1) if r + k <= rows and all(free[r + j][c] for j in range(k)))
                    for j in range(n):
                        free[r + j][c] = False
                    cells.append((i, r, c, n, rng.choice([0, 1, 3, 12])))
        holder = rng.choice([x for x in cells if x[0] != i] or [None]) if rng.random() < 0.8 else None
        tables[i] = (None, None, None) if holder is None else holder[:3]
    given = spark.createDataFrame([(k, *v) for k, v in tables.items()] + [(90, 91, 0, 0), (91, 90, 0, 0)], "table long, up long, up_row long, up_column long")
    grid = spark.createDataFrame([*cells, (90, 0, 0, 1, 1), (91, 0, 0, 1, 1)], "table long, row long, column long, rows long, content int")
    found = trees.nested_tables(given, grid)
    assert sorted(tuple(r) for r in found.select("table", "depth", "root", "row", "height", "y", "root_row").collect()) == plain(tables, cells)
    assert trees.nested_tables(given.where("false"), grid).count() == 0


def test_spanning_cells_are_carried_over_pages(spark):
    rows = spark.createDataFrame([(1, 0, 10, 1), (1, 1, 20, 1), (1, 2, 30, 2), (1, 3, 5, 3)], "table long, row long, height long, page long")
    cells = spark.createDataFrame([(1, 0, 0, 4, 1), (1, 0, 1, 1, 1), (1, 2, 1, 2, 1)], "table long, row long, column long, rows long, content long")
    got = sorted(tuple(r) for r in trees.spanning_pieces(cells, rows).collect())
    assert got == [(1, 0, 0, 1, 30, False), (1, 0, 0, 2, 30, True), (1, 0, 0, 3, 5, True), (1, 2, 1, 2, 30, False), (1, 2, 1, 3, 5, True)]


def chain_of_tables(spark, depth):
    """``depth`` tables in one another, three rows each, the second with two rows under a spanning cell."""
    tables = [(f"t{k}", f"t{k - 1}" if k else None, 1 if k else None, 1 if k else None) for k in range(depth)]
    cells = [(f"t{k}", r, c, 1, 1 + (k + r + c) % 3) for k in range(depth) for r in range(3) for c in range(2)] + [(f"t{k}", 0, 2, 2, 4 + k) for k in range(0, depth, 2)]
    return tables, cells, spark.createDataFrame(tables, "table string, up string, up_row long, up_column long"), spark.createDataFrame(cells, "table string, row long, column long, rows long, content long")


def test_the_cells_of_tables_in_tables_are_read_a_fixed_number_of_times(spark):
    tables, cells, given, grid = chain_of_tables(spark, 5)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = trees.nested_tables(given, grid.mapInArrow(counted, grid.schema))
    assert sorted(tuple(r) for r in found.select("table", "depth", "root", "row", "height", "y", "root_row").collect()) == plain({t: tuple(v) for t, *v in tables} | {"t0": (None, None, None)}, cells)
    assert seen.value <= 2 * len(cells)  # counted and dealt; before, once for each level and more


def test_outermost_rows_are_those_of_the_whole_and_marks_reach_all_inside(spark):
    tables, cells, given, grid = chain_of_tables(spark, 3)
    whole = plain({t: tuple(v) for t, *v in tables} | {"t0": (None, None, None)}, cells)
    outer = sorted(tuple(r) for r in trees.outermost_rows(given, grid).select("table", "row", "height").collect())
    assert outer == [(t, row, height) for t, depth, _, row, height, _, _ in whole if depth == 0]
    marked = trees.nested_tables(given, grid, marks=lambda rows: rows.select("table", "row", (F.col("row") * 10).alias("mark")))
    assert sorted((r.table, r.row, r.mark) for r in marked.collect()) == sorted((t, row, 10 * root_row) for t, _, _, row, _, _, root_row in whole)
    assert trees.outermost_rows(given.where("false"), grid).count() == 0
    assert trees.nested_tables(given.where("false"), grid, marks=lambda rows: rows).columns[-1] == "mark"


def files_of(spark):
    """Bytes of shuffles, checkpoints and kept tables that are on disk."""
    jvm = spark.sparkContext._jvm
    tops = [d.toString() for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    tops += [x.removeprefix("file:") for x in (spark.conf.get("spark.sql.warehouse.dir"), shared_folder(spark))]
    total = 0
    for file in (f"{d}/{f}" for top in tops for d, _, names in os.walk(top) for f in names):
        with suppress(FileNotFoundError):
            total += os.lstat(file).st_size
    return total


def test_tables_in_tables_leave_little_on_disk_and_rows_move_once(spark):
    outer, held = 1_000, 20
    up = F.concat(F.lit("c:"), (F.col("id") / held).cast("long"))
    inner = spark.range(outer * held).select(F.concat(F.lit("o:"), "id").alias("table"), up.alias("up"), (F.col("id") % held).alias("up_row"), F.lit(1).cast("long").alias("up_column"))
    none = F.lit(None).cast("long")
    tables = inner.unionByName(inner.select(F.col("up").alias("table"), F.lit(None).cast("string").alias("up"), none.alias("up_row"), none.alias("up_column")).distinct())
    ones = [F.lit(1).cast("long").alias(c) for c in ("rows", "content")]
    cells = spark.range(outer * held * 10).select(F.concat(F.lit("o:"), F.col("id") % (outer * held)).alias("table"), (F.col("id") / (outer * held)).cast("long").alias("row"), F.lit(0).alias("column"), *ones)
    cells = cells.unionByName(inner.select(F.col("up").alias("table"), F.col("up_row").alias("row"), F.lit(1).alias("column"), *ones))
    before = files_of(spark)
    found = trees.nested_tables(tables, cells, marks=lambda rows: rows.select("table", "row", (F.col("row") * 10).alias("mark")))
    left = files_of(spark) - before
    assert left < 10 * outer * held * 11  # bytes for so many rows; it was 54 a row, as checkpoints and the shuffle files of all steps stayed
    # What is left to do reads rows and places where both lie.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        rows = found.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("y") + F.col("height")).alias("low"), F.max("mark").alias("mark")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(tuple(r) for r in rows) == [(0, outer * held, 11 * held, 190), (1, outer * held * 10, 11 * held, 190)]
