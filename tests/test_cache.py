"""The cache as a stream's state against an ordered dictionary, over batches, restarts and silence."""

import random
from collections import OrderedDict

from pyspark.sql import functions as F

from strata.streaming.cache import cached, with_store

SCHEMA = "lineage string, key string, size long, seq long, at timestamp"


def run(spark, folder, name, entries, room=1 << 62, idle=None):
    with_store(spark)
    given = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    given = given.withWatermark("at", "0 seconds") if idle else given
    out = cached(given, entries, room, idle).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state")
    assert out.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(f"{folder}/{name}").collect()


def put(spark, folder, rows):
    spark.createDataFrame(rows, "lineage string, key string, size long, seq long, at long").withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def plain(rows, entries, room):
    held, uses, out = {}, {}, []
    for lineage, key, size, seq, _ in sorted(rows, key=lambda r: r[3]):
        own = held.setdefault(lineage, OrderedDict())
        uses[lineage] = uses.get(lineage, 0) + 1
        hit = own.pop(key, None) is not None
        if size <= room:
            own[key] = size
        gone = []
        while len(own) > entries or sum(own.values()) > room:
            gone.append(own.popitem(last=False)[0])
        out.append((lineage, seq, key, hit, gone, uses[lineage]))
    return sorted(out)


def test_entries_and_room_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"l{rng.randrange(4)}", f"k{rng.randrange(8)}", rng.randrange(1, 9), i, 1000 + i) for i in range(240)]
    got = []
    for part in range(2):  # the second run goes on from the first one's state
        for k in range(2):
            put(spark, tmp_path, rows[120 * part + 60 * k : 120 * part + 60 * (k + 1)])
        got = run(spark, tmp_path, "out", 4, 14)
    assert sorted((r.lineage, r.seq, r.key, r.hit, list(r.evicted), r.version) for r in got) == plain(rows, 4, 14)


def test_a_silent_lineage_gives_up_its_entries(spark, tmp_path):
    put(spark, tmp_path, [("a", "x", 1, 1, 1000), ("a", "y", 1, 2, 1001), ("b", "x", 1, 3, 1002)])
    put(spark, tmp_path, [("b", "x", 1, 4, 1500)])
    put(spark, tmp_path, [("b", "y", 1, 5, 1501)])
    put(spark, tmp_path, [("a", "x", 1, 6, 1502)])
    got = run(spark, tmp_path, "out", 4, idle=100_000)
    assert [(r.seq, r.hit, r.version) for r in sorted(got, key=lambda r: r.seq or 0) if r.lineage == "a"] == [(None, None, 2), (1, False, 1), (2, False, 2), (6, False, 3)]
    assert [list(r.evicted) for r in got if r.seq is None and r.lineage == "a"] == [["x", "y"]]
