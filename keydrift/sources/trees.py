"""Reading source trees from a shared file system into ``source_files``.

Spark's own file sources skip names that start with '.' or '_', which are the
very files wanted here. Listing and reading therefore run as ``mapInPandas``
over tables of directories and of paths: Spark spreads both over the executors,
each call is a small helper that lists one directory or reads one file.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.functions import paths
from keydrift.operators.definitions import AREA, is_config
from keydrift.operators.files import LANGUAGE_PART
from keydrift.plans.staging import Staging

BATCH_BYTES = 64 << 20
_LISTED = "repo_id string, root string, path string, is_dir boolean"


def _children(root: str, path: str, names: frozenset[str]) -> Iterator[tuple[str, bool]]:
    """A folder that is missing or unreadable has none: it is one repository's fault, not the fleet's."""
    try:
        entries = os.scandir(os.path.join(root, path))
    except OSError:
        return
    with entries:
        for entry in entries:
            is_dir = entry.is_dir(follow_symlinks=False)
            if not (is_dir and entry.name in names):
                yield f"{path}/{entry.name}" if path else entry.name, is_dir


def _expand(budget: int, names: frozenset[str]):
    """Replace folders by what is below them, level by level, until a task has listed ``budget`` of them; folders that
    are not listed yet are passed on as such."""

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["repo_id", "root", "path", "is_dir"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = budget
        for batch in batches:
            todo, found = deque((r.repo_id, r.root, r.path) for r in batch.itertuples()), []
            while todo and left > 0:
                repo_id, root, path = todo.popleft()
                left -= 1
                for child, is_dir in _children(root, path, names):
                    if is_dir:
                        todo.append((repo_id, root, child))
                    else:
                        found.append((repo_id, root, child, False))
                if len(found) >= 10_000:
                    yield frame(found)
                    found = []
            yield frame(found + [(*folder, True) for folder in todo])

    return run


#: Folders that a task lists in the first round and in any; the first is small so that a wide tree is soon spread.
FIRST_FOLDERS, MOST_FOLDERS = 200, 20_000


def list_trees(roots: DataFrame, first: int = FIRST_FOLDERS, most: int = MOST_FOLDERS) -> DataFrame:
    """``roots`` (repo_id, root) -> repo_id, root, path of every file, directories never scanned left out.

    Listing goes in rounds. In each, the folders found and not listed yet are spread over all tasks, and a task lists a
    bounded number of them and of those below; what is left is the next round's. So a huge repository, a wide folder or a
    deep chain keeps no task longer than any other, and rounds are as many as the folders need. Each round is written:
    an executor that is lost costs its round's share.
    """
    names = frozenset(paths.PRUNED_DIRS)
    staging = Staging(roots.sparkSession, "listing")
    folders = roots.select("repo_id", "root", F.lit("").alias("path"))
    rounds, budget = [], first
    while True:
        spread = folders.repartition("repo_id", "path")
        rounds.append(staging.stage(spread.mapInPandas(_expand(budget, names), _LISTED), "round"))
        folders = rounds[-1].filter("is_dir").drop("is_dir")
        if not folders.take(1):
            return reduce(DataFrame.union, rounds).filter(~F.col("is_dir")).drop("is_dir")
        budget = min(most, 4 * budget)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["repo_id", "path", "content"])

    for batch in batches:
        rows, size = [], 0
        for row in batch.itertuples():
            try:
                with open(os.path.join(row.root, row.path), "rb") as f:
                    content = f.read()
            except OSError:
                continue  # an unreadable file is skipped, the scan goes on
            rows.append((row.repo_id, row.path, content.decode("utf-8", "replace")))
            size += len(content)
            if size >= BATCH_BYTES:
                yield frame(rows)
                rows, size = [], 0
        if rows:
            yield frame(rows)


def read_contents(listed: DataFrame) -> DataFrame:
    """Read the listed files; filter before calling, what is left is read."""
    spread = listed.repartition("repo_id", "path")
    return spread.mapInPandas(_read, "repo_id string, path string, content string")


def wanted(listed: DataFrame, extra_env_files: Sequence[str] = ()) -> DataFrame:
    """Only files a scan reads: code, config of the scan root, and extra env files."""
    code = paths.detect_language(F.col("path")) != paths.UNKNOWN
    return listed.filter(code | is_config(F.col("path"), extra_env_files))


def write_corpus(source_files: DataFrame, path: str, extra_env_files: Sequence[str] = ()) -> None:
    """Store ``source_files`` as Parquet, code and config apart.

    ``area`` and ``keydrift_language`` are partition columns, so reading definitions never touches
    the code, which is nearly all of the bytes, and one language's code is read alone.
    """
    area = F.when(is_config(F.col("path"), extra_env_files), F.lit("config")).otherwise(F.lit("code"))
    parts = {AREA: area, LANGUAGE_PART: paths.detect_language(F.col("path"))}
    source_files.withColumns(parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def problems(roots: DataFrame, listed: DataFrame) -> DataFrame:
    """repo_id, path, reason: scan roots that cannot be listed, and listed files that cannot be opened."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                at = os.path.join(row.root, row.path)
                try:
                    if row.path:
                        open(at, "rb").close()
                    else:
                        os.scandir(at).close()
                except OSError as e:
                    rows.append((row.repo_id, row.path, e.strerror or type(e).__name__))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "reason"])

    every = roots.select("repo_id", "root", F.lit("").alias("path")).unionByName(listed.select("repo_id", "root", "path"))
    return every.repartition("repo_id", "path").mapInPandas(opened, "repo_id string, path string, reason string")
