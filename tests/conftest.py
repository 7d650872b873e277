import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FILES = "repo_id string, path string, content string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def source(spark):
    """source_files from {path: content} of one repository, or {(repo, path): content}."""

    def build(tree):
        rows = [(*(k if isinstance(k, tuple) else ("r", k)), v) for k, v in tree.items()]
        return spark.createDataFrame(rows, FILES)

    return build


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a Column expression over one string column ``s`` for each input."""

    def run(column, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
        return [r[1] for r in df.select("i", column.alias("out")).orderBy("i").collect()]

    return run
