"""Written intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own_dir: list[str] = []


def staging_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    A local master is one process and may do without; anywhere else executors
    would write to disks of their own, so a missing setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="keydrift-"))
    return _own_dir[0]


class Staging:
    """A folder for the tables that one scan writes, removed by ``close`` and at the latest when the JVM ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{staging_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        _file_system(spark, self.path, lambda fs, path: fs.deleteOnExit(path))

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back.

        The written table cuts the lineage, survives the loss of executors and is
        columnar, so later passes read only the columns they use.
        """
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        _file_system(self.spark, self.path, lambda fs, path: fs.delete(path, True))


def _file_system(spark: SparkSession, path: str, act: Callable) -> None:
    """Act on a folder through the file system that its name belongs to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)
