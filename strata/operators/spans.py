"""Top-level elements of markup by running depth of its tags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.rounds import cut

# Fixed value: elements that have no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def _pieces(df: DataFrame, key: str, markup: str) -> DataFrame:
    """The markup cut before every '<': i, name, size, step (what the tag does to the depth), at (where it begins) and depth after it."""
    pieces = df.select(key, F.posexplode(F.split(F.coalesce(markup, F.lit("")), "<")).alias("i", "piece")).where("i > 0 OR piece <> ''")
    w = Window.partitionBy(key).orderBy("i")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    name = F.lower(F.regexp_extract("piece", "^/?([A-Za-z][A-Za-z0-9]*)", 1))
    size = F.length("piece") + F.when(F.col("i") > 0, 1).otherwise(0)
    opens = (F.col("i") > 0) & (name != "") & ~F.col("piece").startswith("/") & ~name.isin(*VOID) & ~F.col("piece").rlike("^[^>]*/>")
    step = F.when(opens, 1).when((F.col("i") > 0) & F.col("piece").startswith("/") & (name != "") & ~name.isin(*VOID), -1).otherwise(0)
    rows = pieces.withColumn("name", name).withColumn("size", size).withColumn("step", step)
    return rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("depth", F.sum("step").over(upto))


def top_level(df: DataFrame, key: str, markup: str, below: int = 0) -> DataFrame:
    """(key, n, first, length, tag): the elements at depth ``below``, with their place in the markup and how long they are.

    The markup is cut before every '<'; a piece opens, closes or does neither. An element runs from
    the piece that leaves its depth to the one that comes back. Unclosed elements run to the end.
    """
    w = Window.partitionBy(key).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = _pieces(df, key, markup)
    begins = (F.col("step") == 1) & (F.col("depth") == below + 1)
    rows = rows.withColumn("begins", begins).withColumn("n", F.sum(begins.cast("long")).over(upto)).where("n > 0")
    inside = rows.withColumn("gone", F.coalesce(F.max(((F.col("depth") <= below) & ~F.col("begins")).cast("int")).over(Window.partitionBy(key, "n").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("gone = 0")
    return inside.groupBy(key, "n").agg(F.min("at").alias("first"), F.sum("size").alias("length"), F.min_by("name", "i").alias("tag"))


def common_ends(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, head, tail): characters that two texts share at their beginnings, and at their ends beyond that."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for x, y in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                x, y = (np.frombuffer(v.encode("utf-32-le"), np.uint32) for v in (x, y))
                most = min(len(x), len(y))
                differ = x[:most] != y[:most]
                head = int(differ.argmax()) if differ.any() else most
                differ = x[::-1][: most - head] != y[::-1][: most - head]
                heads.append(head)
                tails.append(int(differ.argmax()) if differ.any() else most - head)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.int64()), pa.array(tails, pa.int64())], names=[key, "head", "tail"])

    return df.select(key, a, b).mapInArrow(run, f"{key} {kind}, head long, tail long")


def tidy(df: DataFrame, key: str, markup: str) -> DataFrame:
    """key and net of the markups that never close more than is open; net is how much is open at the end."""
    found = _pieces(df, key, markup).groupBy(key).agg(F.min("depth").alias("__least"), F.sum("step").alias("net"))
    return found.where("__least >= 0").select(key, "net")


def rescanned(old: DataFrame, new: DataFrame, found: DataFrame, orderly: DataFrame, key: str, markup: str) -> DataFrame:
    """``top_level`` of new with ``source``, from ``found``, which is top_level(old), and ``orderly``, tidy(old): only what lies between the texts' common ends is scanned.

    Elements that end before the first character that differs are kept, those that begin after the last one are moved, and the stretch between is scanned. All is scanned
    (source ``whole``) where that can't be trusted: a new text, one that wasn't tidy, comments, CDATA or instructions, or a stretch that leaves something open.
    """
    doubtful = F.col("__b").rlike(r"<!--|<!\[CDATA\[|<\?") | F.col("__a").rlike(r"<!--|<!\[CDATA\[|<\?")
    texts = new.select(key, F.coalesce(markup, F.lit("")).alias("__b")).join(old.select(key, F.coalesce(markup, F.lit("")).alias("__a")), key, "left").join(orderly.select(key, F.lit(True).alias("__tidy")), key, "left")
    texts = texts.withColumn("__try", F.coalesce(F.col("__tidy") & ~doubtful, F.lit(False)))
    texts = texts.where("__try")
    ends = texts.join(common_ends(texts, key, "__a", "__b"), key).select(key, "__b", F.length("__a").alias("__old"), (F.length("__b") - F.length("__a")).alias("__delta"), F.col("head").alias("__head"), (F.length("__a") - F.col("tail")).alias("__after"))
    ends = cut(ends)
    # An element takes along the text up to the next '<', so that must stand in both; one that runs to the end of the text may not have been closed.
    sided = found.join(ends.drop("__b"), key).withColumn("__end", F.col("first") + F.col("length"))
    sided = sided.withColumn("source", F.when((F.col("__end") < F.col("__head")) & (F.col("__end") < F.col("__old")), "kept").when(F.col("first") >= F.col("__after"), "moved"))
    sided = cut(sided)
    edges = sided.groupBy(key).agg(F.max(F.when(F.col("source") == "kept", F.col("__end"))).alias("__from"), F.min(F.when(F.col("source") == "moved", F.col("first") + F.col("__delta"))).alias("__to"))
    middle = ends.join(edges, key, "left").withColumn("__from", F.coalesce("__from", F.lit(0)))
    middle = cut(middle.select(key, "__from", "__to", F.expr("substring(__b, int(__from) + 1, int(coalesce(__to, length(__b)) - __from))").alias("__text")))
    closed = middle.join(tidy(middle.where("__text <> ''"), key, "__text"), key, "left").select(key, ((F.col("__text") == "") | (F.col("net").isNotNull() & (F.col("__to").isNull() | (F.col("net") == 0)))).alias("__closed"))
    good = cut(closed.where("__closed").select(key))
    scanned = top_level(middle.join(good, key, "left_semi"), key, "__text").join(middle.select(key, "__from"), key).select(key, (F.col("first") + F.col("__from")).alias("first"), "length", "tag", F.lit("scanned").alias("source"))
    sides = sided.where("source IS NOT NULL").join(good, key, "left_semi").select(key, (F.col("first") + F.when(F.col("source") == "moved", F.col("__delta")).otherwise(0)).alias("first"), "length", "tag", "source")
    whole = top_level(new.join(good, key, "left_anti"), key, markup).select(key, "first", "length", "tag", F.lit("whole").alias("source"))
    every = sides.unionByName(scanned).unionByName(whole)
    return every.select(key, F.row_number().over(Window.partitionBy(key).orderBy("first")).cast("long").alias("n"), "first", "length", "tag", "source")
