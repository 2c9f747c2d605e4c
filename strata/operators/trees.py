"""Trees of records: ancestors and composed maps by pointer doubling, in a logarithmic number of rounds; nested tables level by level from the leaves up."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.rounds import Shelf, cut, parts_of, stacked


def ancestors_of(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, depth, ancestor) for every node (id), itself first, along ``links`` (id, up); a cycle ends where it would come back.

    With all ancestors less than m steps away and the one at m (a jump), two joins give all those less than 2 m away: chains of a million take twenty rounds.
    """
    found = cut(nodes.select("id", F.lit(0).cast("long").alias("depth"), F.col("id").alias("ancestor")))
    jump, m = links.where("up IS NOT NULL").select("id", F.col("up").alias("to")), 1
    while True:
        further = found.select(F.col("id").alias("to"), (F.col("depth") + m).alias("depth"), "ancestor")
        more = jump.join(further, "to").groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))
        more = cut(more.join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti").select("id", "depth", "ancestor"))
        if more.isEmpty():
            return found
        found = cut(found.unionByName(more))
        jump, m = cut(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"))), 2 * m


#: An affine map: x' = a x + c y + e, y' = b x + d y + f.
PARTS = ("a", "b", "c", "d", "e", "f")


def _after(outer: str, inner: str) -> Column:
    """The map that takes ``inner`` first and then ``outer``."""
    o, i = (lambda k, n=name: F.col(f"{n}.{k}") for name in (outer, inner))
    return F.struct(
        (o("a") * i("a") + o("c") * i("b")).alias("a"),
        (o("b") * i("a") + o("d") * i("b")).alias("b"),
        (o("a") * i("c") + o("c") * i("d")).alias("c"),
        (o("b") * i("c") + o("d") * i("d")).alias("d"),
        (o("a") * i("e") + o("c") * i("f") + o("e")).alias("e"),
        (o("b") * i("e") + o("d") * i("f") + o("f")).alias("f"),
    )


def composed(nodes: DataFrame) -> DataFrame:
    """(id, map): from each node's own space to the page's, by the maps of all that it is in.

    ``nodes``: id, up (null for a root) and map, from its space to that of what it is in. Each round joins a node with the one its map reaches so far, which has
    done as many steps itself. Nodes that are in themselves, or in such a one, have no place and are left out; so are those in an unknown one.
    """
    now = cut(nodes.select("id", "up", F.col("map").alias("own")))
    while True:
        reached = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("own").alias("then"))
        open_ = now.where("up IS NOT NULL").join(reached, "up")
        step = cut(now.where("up IS NULL").unionByName(open_.select("id", F.col("next").alias("up"), _after("then", "own").alias("own"))))
        left = step.where("up IS NOT NULL").count()
        if left == 0 or step.where("up IS NULL").count() == now.where("up IS NULL").count():
            return step.where("up IS NULL").select("id", F.col("own").alias("map"))
        now = step


def group_map(off: tuple[Column, Column], extent: tuple[Column, Column], child_off: tuple[Column, Column], child_extent: tuple[Column, Column], turn: Column, flip_h: Column, flip_v: Column) -> Column:
    """The map of a group of shapes, from its children's space to its own surroundings.

    The children's frame is scaled to the group's, mirrored and then turned clockwise (in 60,000ths of a degree) about its middle. A frame without extent isn't scaled.
    """
    scale = [F.when(c == 0, F.lit(1.0)).otherwise(e / c) for e, c in zip(extent, child_extent, strict=True)]
    mirror = [F.when(flip, F.lit(-1.0)).otherwise(F.lit(1.0)) for flip in (flip_h, flip_v)]
    right = F.pmod(turn, F.lit(21_600_000)) / 5_400_000
    angle = F.radians(turn / 60_000)
    exact = lambda at_0, at_1, other: F.when(right == 0, at_0).when(right == 1, at_1).when(right == 2, -at_0).when(right == 3, -at_1).otherwise(other)
    cos, sin = exact(F.lit(1.0), F.lit(0.0), F.cos(angle)), exact(F.lit(0.0), F.lit(1.0), F.sin(angle))
    middle = [o + e / 2 for o, e in zip(off, extent, strict=True)]
    # Relative to the middle: mirror * (off + (child - child_off) * scale - middle).
    k = [m * s for m, s in zip(mirror, scale, strict=True)]
    t = [m * (o - c * s - mid) for m, o, c, s, mid in zip(mirror, off, child_off, scale, middle, strict=True)]
    parts = (cos * k[0], sin * k[0], -sin * k[1], cos * k[1], cos * t[0] - sin * t[1] + middle[0], sin * t[0] + cos * t[1] + middle[1])
    return F.struct(*(p.cast("double").alias(n) for n, p in zip(PARTS, parts, strict=True)))


def mapped(map_: str, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a map."""
    m = lambda k: F.col(f"{map_}.{k}")
    return m("a") * x + m("c") * y + m("e"), m("b") * x + m("d") * y + m("f")


def _islands(spanning: DataFrame) -> DataFrame:
    """(table, row, island, cells) of the rows under spanning cells: spans that meet one another are an island, whose first row has its cells by row and column."""
    w = Window.partitionBy("table").orderBy("row", "column")
    reach = F.max(F.col("row") + F.col("rows")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cells = spanning.withColumn("new", (F.col("row") >= F.coalesce(reach, F.lit(-1))).cast("long")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = cells.groupBy("table", "island").agg(F.min("row").alias("low"), F.max(F.col("row") + F.col("rows")).alias("high"), F.array_sort(F.collect_list(F.struct("row", "column", "rows", "content"))).alias("cells"))
    covered = islands.select("table", "island", "low", "cells", F.explode(F.sequence("low", F.col("high") - 1)).alias("row"))
    return covered.select("table", "row", "island", F.when(F.col("row") == F.col("low"), F.col("cells")).alias("cells"))


def _settled(rows: DataFrame) -> DataFrame:
    """``rows`` (table, row, height, held, and island and cells as of ``_islands``) with their heights after the cells that span rows: each makes the last of its rows taller where all are too low.

    Only the rows of an island are folded together.
    """

    def grow(heights: Column, cell: Column, low: Column) -> Column:
        first, last = cell["row"] - low, cell["row"] - low + cell["rows"] - 1
        there = F.aggregate(F.slice(heights, (first + 1).cast("int"), cell["rows"].cast("int")), F.lit(0).cast("long"), lambda a, h: a + h)
        return F.transform(heights, lambda h, k: h + F.when(k == last, F.greatest(cell["content"] - there, F.lit(0))).otherwise(0))

    own = F.array_sort(F.collect_list(F.struct("row", "height", "held"))).alias("own")
    islands = rows.where("island IS NOT NULL").groupBy("table", "island").agg(own, F.first("cells", ignorenulls=True).alias("cells"))
    grown = islands.select("table", "own", F.aggregate("cells", F.col("own.height"), lambda h, c: grow(h, c, F.col("own")[0]["row"])).alias("heights"))
    after = grown.select("table", F.explode(F.transform("own", lambda r, k: F.struct(r["row"].alias("row"), F.get("heights", k).alias("height"), r["held"].alias("held")))).alias("r")).select("table", "r.*")
    return stacked("table", rows.where("island IS NULL").select("table", "row", "height", "held"), after)


_CELL = ["table", "row", "column"]
_IN = ["up", "up_row", "up_column"]


def _named(df: DataFrame, old: list[str], new: list[str], *more: str | Column) -> DataFrame:
    return df.select(*(F.col(o).alias(n) for o, n in zip(old, new, strict=True)), *more)


def _levels(tables: DataFrame, shelf: Shelf) -> list[DataFrame]:
    """``tables`` by depth, kept by table: the outermost ones, those in them, and so on. What no outermost one holds is left out. All that are in others are kept by ``up`` as ``inner``."""
    tables = tables.select("table", *_IN)
    inner = shelf.put("inner", tables.where("up IS NOT NULL").repartition(shelf.parts, "up"), "up")
    levels, level = [], shelf.put("level0", tables.where("up IS NULL").repartition(shelf.parts, "table"), "table")
    while not level.isEmpty():
        levels.append(level)
        found = inner.join(level.select(F.col("table").alias("up")), "up", "left_semi")
        level = shelf.put(f"level{len(levels)}", found.repartition(shelf.parts, "table"), "table")
    return levels


def _measured(tables: DataFrame, cells: DataFrame, parts: int | None) -> tuple[Shelf, int]:
    """A shelf with the rows of each depth (``rows0`` and on: table, row, height, at, held: has a table in a cell; by table), and the number of depths.

    It also has the tables of each depth but the outermost, by what they are in (``put1`` and on: table, _IN, total height), and the cells (``flat``, by table).
    Cells move once, to be dealt by table; after that only what is known of whole tables does. Cells that span rows or hold a table are taken apart from the others, as they grow.
    """
    none = F.lit(None).cast("long")
    shelf = Shelf(cells.sparkSession, parts or parts_of(cells))
    levels = _levels(tables, shelf)
    if not levels:
        shelf.drop()
        return shelf, 0
    cells = cells.select(*_CELL, F.greatest(F.col("rows"), F.lit(1)).cast("long").alias("rows"), F.col("content").cast("long").alias("content"), F.lit(False).alias("held"))
    cells = cells.repartition(shelf.parts, "table")  # left out where they are so already
    holding = _named(shelf.get("inner"), _IN, _CELL, none.alias("rows"), none.alias("content"), F.lit(True).alias("held"))
    marked = stacked("table", cells, holding).withColumn("held", F.max("held").over(Window.partitionBy(*_CELL))).where("rows IS NOT NULL")
    every = stacked("table", *(level.select("table", F.lit(k).alias("depth")) for k, level in enumerate(levels)))
    apart = F.col("held") | (F.col("rows") > 1)
    flat = shelf.put("flat", marked.join(every, "table"), "table")
    shelf.drop("inner", "level0", f"level{len(levels)}")
    spanned = {r.depth for r in flat.groupBy("depth").agg(F.max("rows").alias("most")).where("most > 1").collect()}  # one row for each level at most
    so_far = Window.partitionBy("table").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    largest = [F.coalesce(F.max("content"), F.lit(0)).alias("height"), F.coalesce(F.max("held"), F.lit(False)).alias("held")]
    for depth in reversed(range(len(levels))):
        own = flat.where(F.col("depth") == depth)
        special = own.where(apart).select(*_CELL, "rows", "content", "held")
        if depth + 1 < len(levels):
            held = _named(shelf.get(f"put{depth + 1}"), _IN, _CELL, F.col("total").alias("inner"))
            both = stacked("table", special, held).groupBy(*_CELL)
            both = both.agg(F.max("rows").alias("rows"), F.max("content").alias("content"), F.max("held").alias("held"), F.sum("inner").alias("inner"))
            special = both.where("rows IS NOT NULL").withColumn("content", F.col("content") + F.coalesce("inner", F.lit(0))).drop("inner")
        special = shelf.put("special", special, "table") if depth in spanned else special
        reached = special.select("table", F.explode(F.sequence("row", F.col("row") + F.col("rows") - 1)).alias("row"), F.when(F.col("rows") == 1, F.col("content")).alias("content"), "held")
        plain = own.where(~apart).select("table", "row", "content", "held")
        if depth in spanned:
            rows = stacked("table", plain, reached, _islands(special.where("rows > 1"))).groupBy("table", "row")
            rows = _settled(shelf.put("unsettled", rows.agg(*largest, F.max("island").alias("island"), F.first("cells", ignorenulls=True).alias("cells")), "table"))
        else:
            rows = stacked("table", plain, reached).groupBy("table", "row").agg(*largest)
        rows = shelf.put(f"rows{depth}", rows.withColumn("at", F.coalesce(F.sum("height").over(so_far), F.lit(0))), "table")
        if depth:
            total = levels[depth].join(rows.groupBy("table").agg(F.sum("height").alias("total")), "table", "left")
            shelf.put(f"put{depth}", total.repartition(shelf.parts, "up"), "up")
            shelf.drop(f"level{depth}")
        if depth in spanned:
            shelf.drop("special", "unsettled")
    return shelf, len(levels)


def outermost_rows(tables: DataFrame, cells: DataFrame, parts: int | None = None) -> DataFrame:
    """(table, row, height) of the outermost tables alone, see ``nested_tables``: nothing has to be placed for them."""
    shelf, depths = _measured(tables, cells, parts)
    if not depths:
        return tables.select("table", *(F.lit(0).cast("long").alias(c) for c in ("row", "height"))).where("false")
    shelf.drop("flat", *(f"{kind}{depth}" for depth in range(1, depths) for kind in ("rows", "put")))
    return shelf.get("rows0").select("table", "row", "height")


def nested_tables(tables: DataFrame, cells: DataFrame, marks: Callable[[DataFrame], DataFrame] | None = None, parts: int | None = None) -> DataFrame:
    """(table, depth, root, row, height, y, root_row): rows of tables in tables, their heights from the innermost out, and their place below the outermost table's top.

    ``tables``: table, and the cell it is in (up, up_row, up_column; null for outermost ones); several in one cell are stacked below its own content, by id.
    ``cells``: table, row, column, rows (that it spans, 1 at least, all of them with a cell of their own or not) and content. A row is as high as its highest cell of one row; a
    spanning cell that is higher than its rows makes the last one taller, in order. Levels are taken from the deepest one up, one round for each. Rows are numbered from 0 without gaps.
    A table in itself, or in an unknown one, has no place and is left out.
    ``marks`` takes the outermost rows (table, row, height) and gives (table, row, mark), such as their page: every row has that of the outermost row that it is in, as ``mark``.
    ``parts``: into how many cells are dealt by table; those that are so already don't move. Without it they are counted first.

    All steps but the last are done when this returns, and only what the last one reads is left of them (see ``Shelf``): it joins rows to the places of their tables where both lie.
    """
    zero = F.lit(0).cast("long")
    shelf, depths = _measured(tables, cells, parts)
    mark = ["mark"] if marks else []
    if not depths:
        return tables.where("false").select("table", F.lit(0).cast("long").alias("depth"), F.col("table").alias("root"), *(zero.alias(c) for c in ("row", "height", "y", "root_row")), *(zero.alias(c) for c in mark))
    outer = shelf.get("rows0")
    if marks:
        given = marks(outer.select("table", "row", "height")).select("table", "row", "mark", F.lit(True).alias("given")).repartition(shelf.parts, "table")
        both = stacked("table", outer, given).groupBy("table", "row")
        both = both.agg(F.max("height").alias("height"), F.max("at").alias("at"), F.first("mark", ignorenulls=True).alias("mark"), F.max("given").alias("given"))
        outer = shelf.put("outer", both.where("given AND height IS NOT NULL").drop("given"), "table")
        shelf.drop("rows0")
    place = lambda df, depth, root, y, root_row: df.select("table", F.lit(depth).cast("long").alias("depth"), F.col(root).alias("root"), "row", "height", y.alias("y"), F.col(root_row).alias("root_row"), *mark)
    out, above = [place(outer, 0, "table", F.col("at"), "row")], None
    cell, row = Window.partitionBy(*_CELL), Window.partitionBy("table", "row")
    beside = cell.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    for depth in range(1, depths):
        # A table's place in its outer table: its row, the cell's own content, and the tables before it there.
        put = _named(shelf.get(f"put{depth}"), [*_IN, "table", "total"], [*_CELL, "id", "total"])
        content = shelf.get("flat").where((F.col("depth") == depth - 1) & F.col("held")).select(*_CELL, "content")
        at = outer.select("table", "row", "at", *mark) if depth == 1 else shelf.get(f"rows{depth - 1}").where("held").select("table", "row", "at")
        put = stacked("table", put, content, at)
        put = put.withColumn("before", F.coalesce(F.sum("total").over(beside), F.lit(0))).withColumn("content", F.max("content").over(cell)).withColumn("at", F.max("at").over(row))
        top = F.coalesce(F.col("at") + F.col("content"), F.lit(0)) + F.col("before")
        if depth == 1:  # the outermost row that a table is in
            put = put.withColumn("mark", F.first("mark", ignorenulls=True).over(row)).where("at IS NOT NULL") if marks else put
            put = put.where("id IS NOT NULL").select(F.col("id").alias("table"), F.col("table").alias("root"), top.alias("top"), F.col("row").alias("root_row"), *mark)
        else:
            put = put.where("id IS NOT NULL").select("table", "id", top.alias("below")).join(above, "table")
            put = put.select(F.col("id").alias("table"), "root", (F.col("top") + F.col("below")).alias("top"), "root_row", *mark)
        above = shelf.put(f"above{depth}", put.repartition(shelf.parts, "table"), "table")
        shelf.drop(f"put{depth}")
        out.append(place(shelf.get(f"rows{depth}").join(above, "table"), depth, "root", F.col("top") + F.col("at"), "root_row"))
    shelf.drop("flat")
    return reduce(DataFrame.unionByName, out)


def spanning_pieces(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(table, row, column, page, height, carried): what each page shows of a cell that spans rows; ``rows``: table, row, height, page."""
    all_rows = cells.where("rows > 1").withColumn("at", F.explode(F.sequence("row", F.col("row") + F.col("rows") - 1)))
    own = all_rows.join(rows.select("table", F.col("row").alias("at"), "height", "page"), ["table", "at"])
    pieces = own.groupBy("table", "row", "column", "page").agg(F.sum("height").alias("height"))
    return pieces.withColumn("carried", F.col("page") > F.min("page").over(Window.partitionBy("table", "row", "column")))
