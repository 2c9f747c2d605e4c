"""Greedy folds: words into lines, items into pages, lines into balanced columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = "[ \\t\\n\\r\\f\\x0B]+"


def wrapped(text: Column, width: int) -> Column:
    """Lines and used width of the last one when words are set greedily; a word on its own line may exceed width."""
    return _set_words(text, lambda _: F.lit(width))


def wrapped_beside(text: Column, widths: Column, rest: int) -> Column:
    """As ``wrapped``, with a width of its own for each of the first lines (an array), and ``rest`` for all further ones."""
    return _set_words(text, lambda line: F.coalesce(F.get(widths, (line - 1).cast("int")), F.lit(rest)))


def _set_words(text: Column, width: Callable[[Column], Column]) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORDS), lambda w: w != "")
    start = F.struct(F.lit(1).cast("long").alias("lines"), F.lit(0).cast("long").alias("pen"))

    def put(a: Column, w: Column) -> Column:
        n = F.length(w).cast("long")
        fits = (a["pen"] == 0) | (a["pen"] + 1 + n <= width(a["lines"]))
        return F.struct(
            F.when(fits, a["lines"]).otherwise(a["lines"] + 1).alias("lines"),
            F.when(a["pen"] == 0, n).when(fits, a["pen"] + 1 + n).otherwise(n).alias("pen"),
        )

    return F.aggregate(words, start, put)


def packed(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, capacity: int) -> DataFrame:
    """pages and last_fill of each key when its items, in order, are stacked first-fit; a first item is always placed."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(size).alias("__size")))), lambda x: x["__size"].cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("pages"), F.lit(0).cast("long").alias("fill"))

    def put(a: Column, s: Column) -> Column:
        fits = (a["fill"] == 0) | (a["fill"] + s <= capacity)
        return F.struct(F.when(fits, a["pages"]).otherwise(a["pages"] + 1).alias("pages"), F.when(fits, a["fill"] + s).otherwise(s).alias("fill"))

    return df.groupBy(*keys).agg(F.aggregate(items, start, put).alias("__p")).select(*keys, F.col("__p.pages").alias("pages"), F.col("__p.fill").alias("last_fill"))


def fold_pages(blocks: Sequence[tuple[int, int, bool, bool, bool]], room: int, widows: int) -> list[tuple[int, int, int, int]]:
    """(block, first line, lines, page) of the pieces of (block, lines, keep_lines, keep_next, break_before), see ``paginate``."""
    out: list[tuple[int, int, int, int]] = []
    page, used, top, at, line = 1, 0, 0, 0, 0
    while at < len(blocks):
        block, lines, keep_lines, _, breaks = blocks[at]
        if breaks and line == 0 and used:
            page, used, top = page + 1, 0, at
        left = lines - line
        if used + left <= room:
            if left:
                out.append((block, line, left, page))
            used, at, line = used + left, at + 1, 0
            continue
        n = room - used
        if keep_lines and line == 0 and used:
            n = 0
        elif left - n < widows:
            n = max(0, left - widows)
        if line == 0 and 0 < n < widows:
            n = 0
        if n <= 0 and used:
            back = at
            while line == 0 and back > top and blocks[back - 1][3]:
                back -= 1
            if top < back < at:
                # The blocks that move along stand whole at the end of this page.
                moved = {blocks[k][0] for k in range(back, at)}
                while out and out[-1][0] in moved:
                    out.pop()
                at = back
            page, used, top = page + 1, 0, at
            continue
        n = max(1, min(n if n > 0 else room, left, room))
        out.append((block, line, n, page))
        page, used, line, top = page + 1, 0, line + n, at
        if line >= lines:
            at, line, top = at + 1, 0, at + 1
    return out


def paginate(blocks: DataFrame, room: int, widows: int = 2) -> DataFrame:
    """Pages of blocks of lines under keep rules: doc_id, block, first_line, lines, page for every piece.

    ``blocks``: doc_id, block, lines, keep_lines, keep_next, break_before. At an overflow a
    block that keeps its lines moves whole; else at least ``widows`` lines stay on
    each side; a block that moves whole takes along those before it that keep with it. If a
    page would be left empty, the keeps are ignored there. One fold per document.
    """
    told = F.struct("block", "lines", "keep_lines", "keep_next", "break_before")
    return paginate_rows(blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(told)).alias("blocks")), room, widows)


def paginate_rows(documents: DataFrame, room: int, widows: int = 2) -> DataFrame:
    """As ``paginate``, of rows (doc_id, blocks) that have each document's blocks in order: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = [], []
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = fold_pages([(b["block"], b["lines"], bool(b["keep_lines"]), bool(b["keep_next"]), bool(b["break_before"])) for b in own or ()], room, widows)
                ids += [doc_id] * len(found)
                pieces += found
            columns = [pa.array(ids, pa.int64()), *(pa.array([p[k] for p in pieces], pa.int64()) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "block", "first_line", "lines", "page"])

    return documents.select("doc_id", "blocks").mapInArrow(run, "doc_id long, block long, first_line long, lines long, page long")


def balanced_height(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, columns: int) -> DataFrame:
    """The least column height at which ``columns`` columns hold all items in order.

    It lies between the greatest item and the sum; halvings, 40 at most and each one fold over the items, find it. None is made once both ends meet.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(size).alias("__size")))), lambda x: x["__size"].cast("long"))
    grouped = df.groupBy(*keys).agg(items.alias("__items"))

    def needed(height: Column) -> Column:
        start = F.struct(F.lit(1).alias("c"), F.lit(0).cast("long").alias("y"))
        put = lambda a, s: F.struct(F.when(a["y"] + s <= height, a["c"]).otherwise(a["c"] + 1).alias("c"), F.when(a["y"] + s <= height, a["y"] + s).otherwise(s).alias("y"))
        return F.aggregate("__items", start, put, lambda a: a["c"])

    bounds = F.struct(F.array_max("__items").alias("low"), F.aggregate("__items", F.lit(0).cast("long"), lambda a, s: a + s).alias("high"))

    def halve(b: Column, _: Column) -> Column:
        # What is used twice is bound by a transform of one element, or it would be folded twice.
        middle = F.array(((b["low"] + b["high"]) / 2).cast("long"))
        told = F.transform(middle, lambda m: F.struct(m.alias("m"), (needed(m) <= columns).alias("enough")))
        half = lambda x: F.struct(F.when(x["enough"], b["low"]).otherwise(F.least(x["m"] + 1, b["high"])).alias("low"), F.when(x["enough"], x["m"]).otherwise(b["high"]).alias("high"))
        return F.when(b["low"] >= b["high"], b).otherwise(F.transform(told, half)[0])

    return grouped.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(40)), bounds, halve, lambda b: b["high"]).alias("height"))
