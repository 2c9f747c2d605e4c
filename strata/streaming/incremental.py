"""Recompute only what an edit reaches: a memo keyed by content digests, for batches and for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def digest(*columns: str) -> Column:
    """A digest of everything a result depends on; a null is distinct from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def recompute(docs: DataFrame, memo: DataFrame | None, key: str, inputs: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute's columns for all docs with ``digest`` and ``reused``.

    Rows whose digest stands in the memo take its result; only distinct other inputs are computed.
    """
    rows = docs.withColumn("digest", digest(*inputs))
    if memo is None:
        fresh = compute(rows.dropDuplicates(["digest"]).select("digest", *inputs)).drop(*inputs)
        return rows.select(key, "digest").join(fresh, "digest").withColumn("reused", F.lit(False))
    known = memo.drop(key, "reused").dropDuplicates(["digest"])
    new = rows.join(known, "digest", "left_anti").dropDuplicates(["digest"])
    fresh = compute(new.select("digest", *inputs)).drop(*inputs).withColumn("reused", F.lit(False))
    results = known.withColumn("reused", F.lit(True)).unionByName(fresh)
    return rows.select(key, "digest").join(results, "digest")


def current(spark: SparkSession, state: str, batch: int | None = None) -> DataFrame:
    """The current results below ``state``, as of a micro-batch or the last one."""
    last = batch
    if last is None:
        last = spark.read.parquet(f"{state}/manifest").agg(F.max("batch")).first()[0]
    parts = [f"{state}/data/batch={r.written}/bucket={r.bucket}" for r in spark.read.parquet(f"{state}/manifest/batch={last}").collect()]
    return spark.read.parquet(*parts)


def keep_current(spark: SparkSession, edits: DataFrame, state: str, key: str, version: str, inputs: list[str], compute: Callable[[DataFrame], DataFrame], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """A stream of edits (key, version, inputs) kept as a table of current results below ``state`` (see ``current``).

    Results lie in ``buckets`` parts by hash of their key. Each micro-batch takes the last version of each key, computes what the table doesn't hold
    by digest, and writes only the parts it touches anew; a manifest of ``buckets`` rows says which batch wrote each part last. The batch number names
    what is written, so a repeated batch writes the same again. Parts that neither this batch's manifest nor the last one's name are deleted.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*inputs), version).alias("__r"), F.max(version).alias(version)).select(key, version, "__r.*")
        held = {r.bucket: r.written for r in spark.read.parquet(f"{state}/manifest/batch={number - 1}").collect()} if number else {}
        old = current(spark, state, number - 1) if held else None
        done = recompute(last, None if old is None else old.drop(version), key, inputs, compute).join(last.select(key, version), key)
        touched = {r[0] for r in last.select(place).distinct().collect()}
        if old is not None:
            near = old.where(place.isin(list(touched)))
            newer = done.select(key, F.col(version).alias("__v"))
            stays = near.join(newer, key, "left").where(F.col("__v").isNull() | (F.col("__v") < F.col(version))).drop("__v")
            done = done.join(stays.select(key), key, "left_anti").unionByName(stays.drop("reused").withColumn("reused", F.lit(True)))
        done.withColumn("bucket", place).write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/data/batch={number}")
        names = {**held, **dict.fromkeys(touched, number)}
        rows = ", ".join(f"({b}, CAST({n} AS BIGINT))" for b, n in sorted(names.items()))
        if rows:
            spark.sql(f"SELECT * FROM VALUES {rows} AS x(bucket, written)").coalesce(1).write.mode("overwrite").parquet(f"{state}/manifest/batch={number}")
        before = {r.bucket: r.written for r in spark.read.parquet(f"{state}/manifest/batch={number - 2}").collect()} if number > 1 else {}
        for b, n in before.items():
            if held.get(b) != n and names.get(b) != n:
                _delete(spark, f"{state}/data/batch={n}/bucket={b}")

    return edits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def event_windows(events: DataFrame, at: str, key: str, length: str, late: str) -> DataFrame:
    """Counts by key in tumbling windows of event time, with a watermark; for batches and streams alike."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
