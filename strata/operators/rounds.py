"""Cutting the lineage of iterative work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which executors share. A session that names none gets a temporary one if it runs on one machine; else it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rounds-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def parts_of(df: DataFrame, rows: int = 500_000) -> int:
    """As many partitions as about ``rows`` rows of df in each need, and no fewer than a shuffle has. Of Parquet the number of rows stands in the files' footers."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt(df: DataFrame, keys: Sequence[str], rows: int = 500_000) -> DataFrame:
    """df dealt by keys to as many partitions as about ``rows`` rows in each need, so that what a task sorts doesn't grow with the table.

    The number of rows is counted first; of Parquet it stands in the files' footers.
    """
    return df.repartition(parts_of(df, rows), *keys)


def stacked(key: str, first: DataFrame, *more: DataFrame) -> DataFrame:
    """The rows of all, columns by name, null where one has none. If all are dealt by key to as many parts, so are these, and a group by key moves nothing.

    Spark sees that only where the first one's key has got a name of its own, which it gets here.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), more, first.withColumn(key, F.col(key)))


#: How a shelf is written: shuffle files go with the query that wrote them, and a task with rows of one bucket needn't sort them by bucket.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "1"}


class Shelf:
    """Tables of one call of an operator, each computed once and kept compressed in the warehouse in ``parts`` buckets by a key.

    A join on that key, and a group or window by it and more, reads them where they lie, and so does a union of such tables (or of one and rows dealt by the key
    to as many parts). A step's shuffle files go when it is written, not when the driver happens to collect its garbage; what later steps don't need should be dropped.
    """

    def __init__(self, spark: SparkSession, parts: int):
        self.spark, self.parts, self.names = spark, parts, {}

    def put(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """df as a table. It should be dealt by key to as many parts already: then each task writes one bucket."""
        self.names[name] = table = f"shelf_{uuid.uuid4().hex}"
        before = {k: self.spark.conf.get(k) for k in _WRITING}
        try:
            for k, v in _WRITING.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").bucketBy(self.parts, key).saveAsTable(table)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def drop(self, *names: str) -> None:
        """Delete tables by name, or with no name all that are left."""
        for name in names or list(self.names):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(name)} PURGE")
