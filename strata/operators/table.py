"""Tables: grids widened to their rows, cells by place, stacks inside cells and placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: twips of an added column whose cell states no width.
UNSIZED = 360


def cell_columns(cells: DataFrame, keys: Sequence[str], order: str, span: str, before: str) -> DataFrame:
    """cells with ``first_column`` and ``end_column``: columns skipped before the row, then the spans so far."""
    w = Window.partitionBy(*keys).orderBy(order)
    end = F.col(before) + F.sum(span).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("end_column", end).withColumn("first_column", F.col("end_column") - F.col(span))


def fitted_grid(cells: DataFrame, table: str, row: str, grid: DataFrame) -> DataFrame:
    """(table, column, width): the stated grid, widened to the rows that reach past it.

    ``cells``: table, row, first_column, end_column, stated (twips or null); ``grid``: table, column (from 0), width. Cells widen it
    in order of row and place, so that each sees the columns that those before have added: the part of its stated width past the grid is
    dealt over its added columns, the first ones a twip more; one without such a width adds columns of UNSIZED. One
    fold per table, over only the cells that reach past its grid.
    """
    grids = grid.groupBy(table).agg(F.array_sort(F.collect_list(F.struct("column", F.col("width").cast("long").alias("w")))).alias("g"))
    grids = grids.select(table, F.transform("g", lambda x: x["w"]).alias("g"))
    past = cells.join(grids.select(table, F.size("g").alias("own")), table).where(F.col("end_column") > F.col("own"))
    todo = past.groupBy(table).agg(F.array_sort(F.collect_list(F.struct(row, F.col("first_column").cast("int").alias("a"), F.col("end_column").cast("int").alias("b"), F.col("stated").cast("long").alias("s")))).alias("todo"))

    def widen(g: Column, c: Column) -> Column:
        size = F.size(g)
        added = c["b"] - F.greatest(size, c["a"])
        covered = F.aggregate(F.filter(g, lambda _, i: i >= c["a"]), F.lit(0).cast("long"), lambda x, y: x + y)
        rest = F.when(c["s"] > covered, c["s"] - covered).otherwise(F.lit(UNSIZED) * added)
        gap = F.array_repeat(F.lit(UNSIZED).cast("long"), F.greatest(c["a"] - size, F.lit(0)))
        each = ((rest - rest % added) / added).cast("long")
        new = F.transform(F.sequence(F.lit(0), F.greatest(added, F.lit(1)) - 1), lambda k: each + F.when(k < rest % added, 1).otherwise(0))
        return F.when(c["b"] <= size, g).otherwise(F.concat(g, gap, new))

    folded = grids.join(todo, table, "left").select(table, F.when(F.col("todo").isNull(), F.col("g")).otherwise(F.aggregate("todo", F.col("g"), widen)).alias("g"))
    return folded.select(table, F.posexplode("g").alias("column", "width"))


def cell_of_block(blocks: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """blocks (keys, ord) with row and cell: those of the cell whose blocks [first_ord, end_ord) hold it; null for blocks outside and in nested tables.

    ``cells``: keys, row, cell, first_ord, end_ord, nested. Cells of one table don't overlap, so the last one that begins at or before
    a block decides: a window over both, not a range join.
    """
    marks = cells.where("NOT nested").select(*keys, F.col("first_ord").alias("ord"), F.struct("row", "cell", "end_ord").alias("c"))
    both = blocks.select(*keys, "ord", F.lit(None).cast(marks.schema["c"].dataType).alias("c"), F.lit(1).alias("is_block")).unionByName(marks.withColumn("is_block", F.lit(0)))
    last = F.last("c", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ord", "is_block").rowsBetween(Window.unboundedPreceding, 0))
    held = both.withColumn("l", last).where("is_block = 1")
    inside = F.col("l.end_ord") > F.col("ord")
    return held.select(*keys, "ord", F.when(inside, F.col("l.row")).alias("row"), F.when(inside, F.col("l.cell")).alias("cell"))


def stacked_gaps(df: DataFrame, keys: Sequence[str], order: str, kind: str, style: str, before: str, after: str, contextual: Column) -> DataFrame:
    """df with ``gap``: space above each block of a cell.

    Between paragraphs the greater of the two spaces; none between paragraphs of one style that both ask for contextual spacing. A table keeps
    the space after of the paragraph above it and gives none itself. The first block of a cell has its own space, unless contextual.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("ctx", contextual)
    last = {c: F.lag(c).over(w) for c in (kind, style, after, "ctx")}
    both = F.col("ctx") & last["ctx"] & (F.col(style) == last[style])
    gap = (
        F.when(last[kind].isNull(), F.when(F.col("ctx") | (F.col(kind) == "table"), 0).otherwise(F.col(before)))
        .when((F.col(kind) == "paragraph") & (last[kind] == "paragraph"), F.when(both, 0).otherwise(F.greatest(F.col(before), last[after])))
        .when(F.col(kind) == "table", F.when(last[kind] == "paragraph", last[after]).otherwise(0))
        .otherwise(F.col(before))
    )
    return rows.withColumn("gap", gap).drop("ctx")


def stacked_fit(df: DataFrame, keys: Sequence[str], order: str, height: str, room: int, widow: Column) -> DataFrame:
    """(keys, fits, all): how many of a cell's lines fit into ``room``; where ``widow`` holds, not all but one and not just one of several."""
    upto = F.sum(height).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # Heights are not negative, so the lines that fit come first.
    counted = df.withColumn("upto", upto).groupBy(*keys).agg(F.count(F.when(F.col("upto") <= room, 1)).alias("n"), F.count(F.lit(1)).alias("all"), F.max(widow).alias("rule"))
    n = F.when(F.col("rule") & (F.col("all") - F.col("n") == 1), F.col("n") - 1).otherwise(F.col("n"))
    return counted.withColumn("n", n).select(*keys, F.when(F.col("rule") & (F.col("n") == 1) & (F.col("all") > 1), 0).otherwise(F.col("n")).alias("fits"), "all")


def table_left(align: Column, indent: Column, width: Column, low: Column, high: Column, padding: Column, modern: Column) -> Column:
    """Left edge of a table: centred and right ones by the room, left ones by the indent; before mode 15 its padding stands out of the margin."""
    room = high - low - width
    half = ((room - F.pmod(room, F.lit(2))) / 2).cast("long")
    return F.when(align == "center", low + half).when(align == "right", low + room).otherwise(low + indent - F.when(modern, 0).otherwise(padding))


def text_box(margin: Column, reach: Column) -> Column:
    """A margin pushed in by a header or footer that reaches past it; a negative margin stays where it is."""
    return F.when(margin < 0, -margin).otherwise(F.greatest(margin, reach))
