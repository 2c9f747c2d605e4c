"""Exact deduplication by 128-bit content hash with a byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.staging import Stage


def md5_bytes(text: Column) -> Column:
    """128 bits of the text's content."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a hash of their whole text (``content_hash``: MD5); the row with the smallest
    (``keep="min"``) or largest (``keep="max"``) id stays. Only (hash, id) pairs are
    shuffled for this, pre-aggregated per task, so a group of any size is one
    row per task. Then the texts of groups with two or more rows are compared byte for byte
    with the text of the row that stays; rows that differ (a hash collision) are
    regrouped by the text itself. That join has one row per key on one side, so
    adaptive execution can split a hot group.

    Null text counts as empty and empty texts are one group. Equal ids with equal
    texts are counted as separate rows of their group and all have the group's
    verdict; a null id is never preferred to another, and stays only where the group has no other. An empty table gives no
    rows. Other columns are ignored.
    """
    best = F.max if keep == "max" else F.min
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    hashed = rows.select("id", content_hash(F.col("t")).alias("h"), F.sha2("t", 256).alias("text_sha256"))
    groups = hashed.groupBy("h").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    stage = Stage(docs.sparkSession, "exact_dedup")
    repeated = stage.put(groups.where("group_size > 1"), "repeated")

    texts = rows.select("id", "t", content_hash(F.col("t")).alias("h"))
    members = stage.put(texts.join(repeated, "h", "left_semi"), "members")
    chosen = repeated.select(F.col("keep_id").alias("best"), F.col("h").alias("k"))
    stays = members.join(chosen, (F.col("h") == F.col("k")) & F.col("id").eqNullSafe(F.col("best")), "left_semi")
    # Texts of one hash and id may differ too: the least of them stays.
    stays = stage.put(stays.groupBy("h").agg(F.min("t").alias("kept_text")), "stays")
    clash = stage.put(members.join(stays, "h").where(F.col("t") != F.col("kept_text")), "clash")

    joined = hashed.join(repeated, "h", "left").withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")))
    joined = joined.withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    if clash.isEmpty():
        joined = joined.select("*", F.lit(None).cast("long").alias("alone_size"), F.lit(None).cast("long").alias("elsewhere"), F.lit(None).alias("alone_id"))
    else:
        split = clash.groupBy("h", F.sha2("t", 256).alias("text_sha256"), "t").agg(best("id").alias("alone_id"), F.count(F.lit(1)).alias("alone_size"))
        split = stage.put(split.select("h", "text_sha256", "alone_id", "alone_size"), "split")
        removed = split.groupBy("h").agg(F.sum("alone_size").alias("elsewhere"))
        joined = joined.join(split, ["h", "text_sha256"], "left").join(removed, "h", "left")
    stage.drop("members", "stays", "clash")
    keep_id = F.coalesce("alone_id", "keep_id")
    size = F.coalesce("alone_size", F.col("group_size") - F.coalesce("elsewhere", F.lit(0)))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        size.cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    Rows with one id and text leave one: that with the least hash of its other columns.
    """
    stay = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    rest = sorted(c for c in docs.columns if c not in (id_col, text_col))
    tie = F.xxhash64(F.to_json(F.struct(*(docs[c] for c in rest)))) if rest else F.lit(0)
    sha = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    # Of null and empty texts with one id the null one comes first.
    marked = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), sha.alias("sha"), docs[text_col].isNotNull().alias("given"), tie.alias("tie"))
    kept = marked.join(stay, marked["id"].eqNullSafe(stay["kept_id"]) & (marked["sha"] == stay["kept_sha"]), "left_semi")
    place = F.row_number().over(Window.partitionBy("id", "sha").orderBy("given", "tie"))
    return kept.withColumn("place", place).where("place = 1").select("row.*")
