"""A column named language in the input is not the language of the code."""

import pytest

from keydrift.operators import files, usages
from keydrift.plans.scan import DriftScan
from keydrift.sources import trees


@pytest.mark.parametrize("label", ["en", "Python", None])
def test_an_unrelated_language_column_hides_nothing(spark, tmp_path, label):
    columns = "repo_id string, path string, content string, language string"
    rows = spark.createDataFrame([("r", "a.py", "os.getenv('A')", label), ("r", ".env", "B=1", label)], columns)
    assert [r.key for r in DriftScan(rows, spark.createDataFrame([], "repo_id string, key string")).missing.collect()] == ["A"]
    path = str(tmp_path / "corpus")
    trees.write_corpus(rows, path)
    assert [r.key for r in usages.extract_usages(files.code_files(spark.read.parquet(path))).collect()] == ["A"]
