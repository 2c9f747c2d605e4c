"""Lists, page numbers, hyphenation, positions and packing with state: the sequential rules of layout.

Each fold runs once per document, list, table or line, so it is split by that key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.numbering import list_items
from strata.operators.rounds import cut


def list_labels(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, levels: int = 9, start: int = 1) -> DataFrame:
    """label for each list item: counters of its level and all above, like '2.1.3'.

    An item adds one at its level (or starts it), missing levels above it start, and levels below
    it restart: one list of ``list_items`` with the plainest templates.
    """
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("id").cast("int") + 1), lambda k: F.concat(F.lit("%"), k)), ".")
    none = F.lit(None).cast("long").alias("restart")
    told = df.sparkSession.range(levels).select(F.lit(1).alias("instance"), F.col("id").cast("int").alias("level"), F.lit("").alias("list"), F.lit(start).cast("long").alias("start"), none, F.lit("decimal").alias("format"), text.alias("text"), F.lit(False).alias("legal"), F.lit(False).alias("override"))
    items = df.select(*keys, *order, F.col(level).cast("int").alias("level"), F.lit(1).alias("instance"))
    return list_items(items, keys, order, told, levels).select(*keys, *order, F.col("level").alias(level), "label")


def page_numbers(sections: DataFrame, keys: Sequence[str], order: str, pages: str, stated: str, parity: str) -> DataFrame:
    """first_number and blank of each section: a stated start, else the last number + 1.

    A section that must start on an odd or even number (parity 'odd' or 'even') gets a blank page before it when the
    number that would follow has the other parity. Such a section's parity is known whatever stands before it, and so
    is a stated number's: whether a page is blank follows from the pages since the last of these, by running sums.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    want = F.when(F.col(parity) == "odd", 1).when(F.col(parity) == "even", 0)
    rows = sections.withColumn("__p", F.coalesce(F.sum(pages).over(before), F.lit(0))).withColumn("__want", want)
    known = F.coalesce("__want", F.pmod(stated, F.lit(2)))
    rows = rows.withColumn("__last", F.last(F.when(known.isNotNull(), F.struct(known.alias("a"), F.col("__p").alias("p"))), ignorenulls=True).over(before))
    plain = F.coalesce(F.pmod(stated, F.lit(2)), F.pmod(F.coalesce(F.col("__last.a") - F.col("__last.p"), F.lit(1)) + F.col("__p"), F.lit(2)))
    rows = rows.withColumn("blank", F.coalesce(F.col("__want") != plain, F.lit(False)))
    rows = rows.withColumn("__b", F.sum(F.col("blank").cast("long")).over(upto))
    told = F.struct(F.col(stated).alias("n"), F.col("__p").alias("p"), (F.col("__b") - F.col("blank").cast("long")).alias("b"))
    rows = rows.withColumn("__from", F.last(F.when(F.col(stated).isNotNull(), told), ignorenulls=True).over(upto))
    origin = F.coalesce(F.col("__from.n") - F.col("__from.p") - F.col("__from.b"), F.lit(1))
    return rows.select(*keys, order, (origin + F.col("__p") + F.col("__b")).alias("first_number"), "blank")


def hyphen_points(words: DataFrame, word: str, patterns: DataFrame, exceptions: DataFrame | None = None, left: int = 2, right: int = 2) -> DataFrame:
    """(word, points) of distinct words by competing patterns: letters with digits between them.

    ``patterns``: pattern (like 'a1b' or '.un1'). Of all patterns found in '.word.' the greatest digit of each gap
    counts, and odd ones may break, ``left`` and ``right`` letters from the ends. ``exceptions`` (word, points) go
    first. Substrings join the patterns by equality; no word meets all patterns.
    """
    rules = patterns.select(F.regexp_replace("pattern", "[0-9]", "").alias("__letters"), F.col("pattern").alias("__rule")).distinct()
    digits = F.transform(F.split(F.regexp_replace("__rule", "(?<=[^0-9])(?=[^0-9])|^(?=[^0-9])|(?<=[^0-9])$", "0"), "[^0-9]"), lambda d: d.cast("int"))
    rules = rules.select("__letters", digits.alias("__digits"))
    once = words.select(F.col(word).alias("__word")).where(F.length(word) > 0).distinct()
    dotted = F.concat(F.lit("."), F.lower("__word"), F.lit("."))
    starts = once.select("__word", dotted.alias("__d"), F.explode(F.sequence(F.lit(1), F.length("__word") + 2)).alias("__at"))
    longest = rules.agg(F.max(F.length("__letters"))).first()[0] or 1
    parts = starts.select("__word", "__at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("__d") - F.col("__at") + 1))).alias("__n"), "__d")
    parts = parts.select("__word", "__at", F.expr("substring(__d, __at, __n)").alias("__letters"))
    found = parts.join(rules, "__letters").select("__word", "__at", F.posexplode("__digits").alias("__k", "__digit"))
    # Gap g stands before letter g (from 1) of the word itself.
    gaps = found.groupBy("__word", (F.col("__at") + F.col("__k") - 2).alias("__gap")).agg(F.max("__digit").alias("__digit"))
    good = gaps.where((F.col("__digit") % 2 == 1) & (F.col("__gap") >= left) & (F.col("__gap") <= F.length("__word") - right))
    points = good.groupBy("__word").agg(F.array_join(F.sort_array(F.collect_list("__gap")), ",").alias("__points"))
    out = once.join(points, "__word", "left").withColumn("__points", F.coalesce("__points", F.lit("")))
    if exceptions is not None:
        known = exceptions.select(F.col("word").alias("__e"), F.col("points").alias("__stated"))
        out = out.join(known, F.lower("__word") == F.col("__e"), "left").withColumn("__points", F.coalesce("__stated", "__points"))
    return out.select(F.col("__word").alias(word), F.col("__points").alias("points"))


def soft_hyphens(text: Column, points: Column) -> Column:
    """A word with a soft hyphen at each of its points, a list of numbers like '2,5' (letters before the gap)."""
    at = F.filter(F.split(points, ","), lambda p: p != "")
    bounds = F.concat(F.array(F.lit(0)), at.cast("array<int>"), F.array(F.length(text)))
    parts = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.substring(text, F.get(bounds, k - 1) + 1, F.get(bounds, k) - F.get(bounds, k - 1)))
    return F.array_join(parts, "\u00ad")


def word_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: str, space: int, room: int, align: Column) -> DataFrame:
    """x of each word of a line: left, center, right, or justify with the slack floored cumulatively over the gaps."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(*order)
    rows = df.withColumn("__i", F.row_number().over(upto) - 1).withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__sum", F.sum(width).over(whole))
    rows = rows.withColumn("__slack", F.greatest(room - F.col("__sum") - space * (F.col("__n") - 1), F.lit(0))).withColumn("__align", align)
    before = F.coalesce(F.sum(width).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.expr("CASE __align WHEN 'center' THEN __slack div 2 WHEN 'right' THEN __slack WHEN 'justify' THEN CASE WHEN __n > 1 THEN (__slack * __i) div (__n - 1) ELSE 0 END ELSE 0 END")
    return rows.withColumn("x", before + space * F.col("__i") + extra).select(*df.columns, "x")


def kerned_width(df: DataFrame, key: str, text: str, advances: DataFrame, kerns: DataFrame) -> DataFrame:
    """(key, width): advances of all characters (unknown ones 500) plus the adjustment of each adjacent pair."""
    chars = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "")).alias("__i", "r")).where("r <> ''")
    # Pairs are counted per text first: lookups then work on distinct pairs.
    pairs = chars.withColumn("l", F.lag("r").over(Window.partitionBy(key).orderBy("__i"))).groupBy(key, "l", "r").agg(F.count(F.lit(1)).alias("__n"))
    wide = pairs.join(advances.select(F.col("ch").alias("r"), "adv"), "r", "left").join(kerns.select("l", "r", "adj"), ["l", "r"], "left")
    return wide.groupBy(key).agg(F.sum((F.coalesce("adv", F.lit(500)) + F.coalesce("adj", F.lit(0))) * F.col("__n")).cast("long").alias("width"))


def scaled_widths(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: str, padding: int, target: int) -> DataFrame:
    """Columns scaled to a target: padding is kept, the rest is scaled with floored edges, so the last edge is the target."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(*order)
    rows = df.withColumn("__body", F.greatest(F.col(width) - padding, F.lit(0))).withColumn("__i", F.row_number().over(upto))
    rows = rows.withColumn("__all", F.sum("__body").over(whole)).withColumn("__upto", F.sum("__body").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__pool", F.greatest(target - padding * F.count(F.lit(1)).over(whole), F.lit(0)))
    rows = rows.withColumn("__edge", padding * F.col("__i") + F.when(F.col("__all") > 0, F.expr("(__pool * __upto) div __all")).otherwise(0))
    return rows.withColumn("scaled", F.col("__edge") - F.coalesce(F.lag("__edge").over(upto), F.lit(0))).select(*df.columns, "scaled")


def _folded(df: DataFrame, key: str, order: str, columns: Sequence[str], step: Callable[[tuple | None, tuple], tuple[tuple, int | None]], name: str) -> DataFrame:
    """(key, order, name): what step says of each row, from the state that the row before it in its key left (None before the first).

    A key's rows pass one by one, in order, so a key may have any number of them.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"), *columns).repartition("k").sortWithinPartitions("k", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, None, False
        for batch in batches:
            found = []
            keys = batch.column(0).to_pylist()
            for k, row in zip(keys, zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True), strict=True):
                if k != at or not begun:
                    at, state, begun = k, None, True
                state, value = step(state, row)
                found.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=[key, order, name])

    return rows.mapInArrow(run, f"{key} long, {order} long, {name} long")


def packed_rows(df: DataFrame, table: str, order: str, height: str, header: str, room: int) -> DataFrame:
    """page of each table row; leading header rows are repeated on every further page and take its room."""
    by = Window.partitionBy(table)
    so_far = by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    leading = df.withColumn("__leads", F.min(F.coalesce(F.col(header), F.lit(False))).over(so_far))
    heads = F.coalesce(F.sum(F.when(F.col("__leads"), F.col(height))).over(by), F.lit(0))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, int]:
        (page, used), (own, heads) = state or (1, None), row
        if used is not None and used + own > room:
            page, used = page + 1, heads if heads < room else 0
        return (page, (used or 0) + own), page

    return _folded(leading.withColumn("__heads", heads), table, order, [height, "__heads"], step, "page")


def fill_segments(words: DataFrame, segments: DataFrame, key: str, order: str, width: str, space: int, least: int) -> DataFrame:
    """(key, order, segment): words set into free segments from left to right; segments under ``least`` are dropped.

    A segment that can't hold the next word is passed over; words beyond the last segment have null. The segments go before their key's words,
    so only they are kept in memory.
    """
    free = segments.where(F.col("free_to") - F.col("free_from") >= least)
    nothing = F.lit(None).cast("long")
    rows = words.select(key, F.col(order).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.col(width).cast("long").alias("__size"), F.col(order).cast("long").alias(order))
    spans = free.select(key, F.col("free_from").cast("long").alias("__at"), F.lit(0).alias("__kind"), (F.col("free_to") - F.col("free_from")).cast("long").alias("__size"), nothing.alias(order))
    both = rows.unionByName(spans).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__kind", "__at", F.desc("__size"))))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, int | None]:
        (rooms, at, pen), (kind, size) = state or ([], 0, 0), row
        if kind == 0:
            rooms.append(size)
            return (rooms, 0, 0), None
        while at < len(rooms) and pen + (space if pen else 0) + size > rooms[at]:
            at, pen = at + 1, 0
        return (rooms, at, pen + (space if pen else 0) + size), at if at < len(rooms) else None

    found = _folded(both, key, "__n", ["__kind", "__size"], step, "segment")
    return found.join(both.where("__kind = 1").select(key, "__n", order), [key, "__n"]).select(key, order, "segment")


def anchored(align: Column, offset: Column, size: Column, low: Column, high: Column) -> Column:
    """Position in the frame [low, high): by alignment where there is one, else by offset."""
    room = high - low - size
    return F.when(align == "left", low).when(align == "right", low + room).when(align == "center", low + ((room - F.pmod(room, F.lit(2))) / 2).cast("long")).otherwise(low + offset)


def in_group(at: Column, origin: Column, child_origin: Column, extent: Column, child_extent: Column) -> Column:
    """A child coordinate of a group in its parent's: origin + (at - child origin) * extent div child extent."""
    scaled = (at - child_origin) * extent
    return origin + F.when(child_extent == 0, 0).otherwise(((scaled - F.pmod(scaled, child_extent)) / child_extent).cast("long"))


def line_pitch(rule: Column, stated: Column, natural: Column) -> Column:
    """exact: as stated; atLeast: the greater; auto: a multiple in 240ths of the natural height, half up."""
    multiple = ((natural * stated + 120 - F.pmod(natural * stated + 120, F.lit(240))) / 240).cast("long")
    return F.when(rule == "exact", stated).when(rule == "atLeast", F.greatest(stated, natural)).otherwise(multiple)


def _content(df: DataFrame) -> tuple:
    """Count and sums of two hashes of all rows: equal for equal tables, whatever their order. One row for each task is shuffled."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    halves = (F.xxhash64(row), F.xxhash64(F.lit("second"), row))
    return tuple(df.agg(F.count(F.lit(1)), *(F.sum(h.cast("decimal(20, 0)")) for h in halves)).first())


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 4) -> tuple[DataFrame, int, bool]:
    """Repeat step until its rows are those of the last pass, ``most`` times at the utmost.

    Returns the last table, the passes and whether it settled; each pass is checkpointed, so its lineage stays short. Passes are compared by 128 bits of hashes, summed.
    """
    now, before = start, _content(start)
    for passes in range(1, most + 1):
        now = cut(step(now))
        after = _content(now)
        if after == before:
            return now, passes, True
        before = after
    return now, most, False


def changed_results(old: DataFrame, new: DataFrame, key: str, drawing: str) -> DataFrame:
    """Pages whose drawing, identifiers aside, differs from that of the same number, and new pages."""
    bare = F.sha2(F.regexp_replace(drawing, r' id="[^"]*"', ""), 256)
    a, b = old.select(key, bare.alias("__a")), new.select(key, bare.alias("__b"))
    return b.join(a, key, "left").where(F.col("__a").isNull() | (F.col("__a") != F.col("__b"))).select(key)
