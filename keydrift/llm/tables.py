"""Reading the given tables, and tables written between two jobs in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: \x20 and \x09-\x0D, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
_local_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. A local master may do without that setting, since its executors and
    driver are one process; anywhere else it has to be set, because executors must see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="llm-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet and read back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The array of runs of characters other than white space; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, without building strings that are kept."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{SPACE}+")
    ends = (F.element_at(parts, 1) == "").cast("long") + (F.element_at(parts, -1) == "").cast("long")
    return F.greatest(F.size(parts).cast("long") - ends, F.lit(0)).cast("long")


def crc(c: Column) -> Column:
    """Unsigned CRC32 of a value's text; null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def cut_buckets(df: DataFrame, rows_per_bucket: int = 200_000) -> int:
    """The number of hash buckets that keeps each near a fixed size whatever the table's; at least one a shuffle partition."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // rows_per_bucket))
