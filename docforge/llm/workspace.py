"""Shared tables for multi-step operators.

Lineage is cut by writing Parquet tables below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see that folder, so a lost executor
costs only the tasks that it was running. Where the setting is absent a temporary folder is
made in local mode (tests); on a cluster that is an error. Tables are deleted when the JVM's file systems close.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For tables with rows of megabytes. Parquet's writer looks at sizes after 100 rows only and keeps the least and greatest value of each row group until the file ends; its reader gives the rows of a row group at once.
ROW_A_GROUP = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _fallback.setdefault("dir", "")
        if not found:
            found = _fallback["dir"] = "file://" + tempfile.mkdtemp(prefix="docforge-")
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, for actions within the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """A folder of its own below the shared one, for the tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docforge/{label}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        """Write ``df`` and return the written table; the schema is known, so none is inferred.

        The table takes the place of the plan, so the plan's shuffle files are removed with the write. ``options`` go
        to the Parquet writer.
        """
        schema = df.schema
        with settings(self.spark, {CLEANUP: "true"}):
            df.write.mode("overwrite").option("compression", "zstd").options(**options or {}).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)
