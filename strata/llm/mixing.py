"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source's rows, in id order, form blocks of ``block_rows``. With integer
weights w that sum to W, block i of a source is released at floor(i * W / w) and due
at ceil((i + 1) * W / w). One slot holds one block, and each slot takes, of the released blocks,
the one due first (on a tie the greater weight, then the smaller source name). Because the
weights fill every slot exactly, after any number of slots each source is
less than one block from its target.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.staging import Stage

NEW = ("mix_slot", "mix_offset", "mix_release", "mix_due", "in_mix")
_STEP = 256


def schedule(spark: SparkSession, classes: Mapping[int, int]) -> DataFrame:
    """Earliest deadline first over one period: slot, weight, place, turn, release_at, due_at, p.

    ``classes``: how many sources there are of each weight; place numbers
    them by name. Sources of one weight have the same windows, so they take turns by name and the
    fold's state is one counter for each different weight, whatever the number of
    sources. The period is the weights' sum over their greatest common divisor; its slots are folded in steps, so that no long array is copied.
    """
    weights = sorted(classes)
    if not weights or weights[0] < 1:
        raise ValueError("weights must be positive integers")
    share = gcd(*weights)
    period = sum(w * classes[w] for w in weights) // share
    # Of class k: the turn of its next block, and the key that orders it among the released ones.
    turn = "(had[k] div n[k])"
    due = f"(({turn} + 1) * p + w[k] - 1) div w[k]"
    key = f"array(named_struct('due', {due}, 'light', -w[k], 'k', k))"
    pick = f"array_min(flatten(transform(sequence(0, size(w) - 1), k -> if(({turn} * p) div w[k] <= t, {key}, filter({key}, y -> false))))).k"
    taken = "cast(array() as array<struct<k:int,i:bigint>>)"
    inner = f"""aggregate(sequence(c * {_STEP}L, least(p, (c + 1) * {_STEP}L) - 1), named_struct('had', o.had, 'out', {taken}),
        (s, t) -> transform(array(named_struct('s', s, 'k', transform(array(s.had), had -> {pick})[0])),
            x -> named_struct('had', transform(x.s.had, (h, j) -> if(j = x.k, h + 1, h)), 'out', concat(x.s.out, array(named_struct('k', x.k, 'i', x.s.had[x.k])))))[0])"""
    fold = f"""aggregate(sequence(0L, (p - 1) div {_STEP}L), named_struct('had', transform(w, x -> 0L), 'out', cast(array() as array<array<struct<k:int,i:bigint>>>)),
        (o, c) -> transform(array({inner}), r -> named_struct('had', r.had, 'out', concat(o.out, array(r.out))))[0],
        o -> flatten(o.out))"""
    longs = lambda xs: "array(" + ", ".join(f"{int(x)}L" for x in xs) + ")"
    one = spark.range(1).select(F.expr(longs(w // share for w in weights)).alias("w"), F.expr(longs(classes[w] for w in weights)).alias("n"), F.lit(period).cast("long").alias("p"))
    slots = one.select("w", "n", "p", F.posexplode(F.expr(fold)).alias("slot", "x"))
    slots = slots.select(F.col("slot").cast("long").alias("slot"), F.expr("w[x.k]").alias("w"), F.expr("x.i % n[x.k]").alias("place"), F.expr("x.i div n[x.k]").alias("turn"), "p")
    return slots.select("slot", (F.col("w") * share).alias("weight"), "place", "turn", F.expr("(turn * p) div w").alias("release_at"), F.expr("((turn + 1) * p + w - 1) div w").alias("due_at"), F.col("w").alias("turns"), "p")


def numbered(rows: DataFrame, stage: Stage, name: str, group: str, order: Sequence[str]) -> DataFrame:
    """rows with ``n``: each row's number, from 0, within its group by order.

    Rows are dealt by ranges of (group, order), so a large group is cut wherever its values lie; numbers are counted inside each
    range, then over the ranges' counts. The ranges are staged, so they don't change when a task is run again.
    """
    dealt = stage.put(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), name)
    counts = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(group, "part").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return dealt.withColumn("i", inside).join(counts, [group, "part"]).withColumn("n", F.col("before") + F.col("i") - 1).drop("part", "i", "before")


def _tie(docs: DataFrame, *used: str) -> Column:
    """A hash of the columns beside those used: orders rows that tie, the same in every run."""
    rest = sorted(c for c in docs.columns if c not in used)
    return F.xxhash64(F.to_json(F.struct(*(docs[c] for c in rest)))) if rest else F.lit(0).cast("long")


def mix_sources(docs: DataFrame, weights: Mapping[str, int] | None = None, default_weight: int = 1, block_rows: int = 8, id_col: str = "doc_id", source_col: str = "source", ends: str = "first") -> DataFrame:
    """docs with mix_slot, mix_offset, mix_release, mix_due and in_mix.

    ``weights``: integer target weight by source; other sources have
    ``default_weight``. There may be any number of sources. Every row gets its slot, at any size. The
    mixture ends (``in_mix`` is false from there) at the first slot for which
    a source has no full block left: up to there all sources keep their weights, less than one block off. With ``ends="last"`` it
    goes on to the last row and slots of sources that have run out pass empty.

    A null source counts as ''. A null id comes first. Rows that tie in id are ordered by a hash of their other columns, so
    only rows equal in all columns can change places. An empty table gives no rows. Columns of docs named like the
    five new ones are replaced; all others are kept, whatever their names.
    """
    if ends not in ("first", "last"):
        raise ValueError("ends must be 'first' or 'last'")
    spark = docs.sparkSession
    docs = docs.drop(*NEW)
    stage = Stage(spark, "mixing")
    source = F.coalesce(docs[source_col].cast("string"), F.lit(""))
    rows = docs.select(source.alias("source"), docs[id_col].alias("id"), _tie(docs, id_col, source_col).alias("tie"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = numbered(rows, stage, "rows", "source", ["id", "tie"])

    weight = F.lit(int(default_weight)).cast("long")
    if weights:
        names = list(weights)
        weight = F.coalesce(F.map_from_arrays(F.lit(names), F.lit([int(weights[s]) for s in names]))[F.col("source")].cast("long"), weight)
    sizes = docs.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("rows")).withColumn("weight", weight)
    sizes = stage.put(numbered(sizes, stage, "sources", "weight", ["source"]).withColumnRenamed("n", "place"), "sizes")
    # One row for each different weight: no more than the weights given and the default.
    classes = {r.weight: r.sources for r in sizes.groupBy("weight").agg(F.count(F.lit(1)).alias("sources")).collect()}
    if not classes:
        return docs.select("*", *(F.lit(None).cast("long").alias(c) for c in NEW[:4]), F.lit(None).cast("boolean").alias("in_mix"))
    plan = stage.put(schedule(spark, classes), "schedule")
    last = sizes.withColumn("full", F.expr(f"rows div {int(block_rows)}")).join(plan, ["weight", "place"]).where("turn = full % turns")
    end = last.agg(F.min(F.expr("(full div turns) * p + slot"))).first()[0]
    turns = plan.groupBy("weight").agg(F.first("turns").alias("turns"))

    block = F.expr(f"n div {int(block_rows)}")
    placed = rows.withColumn("block", block).join(sizes.select("source", "weight", "place").join(turns, "weight"), "source").withColumn("turn", F.expr("block % turns"))
    placed = placed.join(plan.drop("turns"), ["weight", "place", "turn"])
    cycle = F.expr("(block div turns) * p")
    slot = cycle + F.col("slot")
    return placed.select(
        "row.*",
        slot.alias("mix_slot"),
        F.expr(f"n % {int(block_rows)}").alias("mix_offset"),
        (cycle + F.col("release_at")).alias("mix_release"),
        (cycle + F.col("due_at")).alias("mix_due"),
        (slot < end if ends == "first" else F.lit(True)).alias("in_mix"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, int] | None = None, default_weight: int = 1, block_rows: int = 8, id_col: str = "doc_id", source_col: str = "source", whole: bool = False) -> DataFrame:
    """The rows of docs that are in the mixture, with all their columns, in files and rows of ascending slot.

    ``whole``: all rows, in the mixture or not; the slots of sources that have run out pass empty.
    The schedule is made from ids and sources alone; texts move once to their rows' slots. Rows that share
    their id and source all go to the first place that one of them has.
    """
    plan = mix_sources(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source")), weights, default_weight, block_rows, "id", "source")
    plan = plan.where(F.lit(whole) | F.col("in_mix")).groupBy("id", "source").agg(F.min(F.struct("mix_slot", "mix_offset")).alias("at"))
    rows = docs.select(docs[id_col].alias("own"), docs[source_col].alias("own_source"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = rows.join(plan, rows["own"].eqNullSafe(plan["id"]) & rows["own_source"].eqNullSafe(plan["source"]))
    return rows.repartitionByRange("at").sortWithinPartitions("at").select("row.*")
