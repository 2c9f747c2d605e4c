"""Tables staged in the cluster's shared folder, and their removal.

Intermediate results are cut from their lineage by writing Parquet below the
folder that ``spark.checkpoint.dir`` names, so that a lost executor never forces
a re-computation from the raw documents and no executor depends on another's
local disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only a session on one machine may leave it unset: it then gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCOPES: list[list[Stage]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end all that operators called inside have staged: their results must have been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for stage in _SCOPES.pop():
            stage.clear()


class Stage:
    """Staged tables of one operator call, below one folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.key = f"{name}_{uuid.uuid4().hex[:12]}"
        self.root = f"{shared_dir(spark)}/{self.key}"
        self.tables: list[str] = []
        if _SCOPES:
            _SCOPES[-1].append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """Write df as a table bucketed by key: later joins on key don't move its rows."""
        table = f"{self.key}_{name}"
        df.write.mode("overwrite").option("compression", "none").bucketBy(buckets, key).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Delete staged Parquet by name, or with no name every bucketed table."""
        if not names:
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table} PURGE")
            self.tables = []
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Delete all that was staged here."""
        self.drop()
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
