"""File-level filters, folder rules and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.functions import paths
from keydrift.operators.skew import spread_join

# Partition column of ``write_corpus``: no input has it by chance.
LANGUAGE_PART = "keydrift_language"

# Report order and short names of the languages.
LANGUAGE_LABELS = {
    "javascript": "js",
    "typescript": "ts",
    "go": "go",
    "python": "python",
    "rust": "rust",
    "java": "java",
}


def detect_language(source_files: DataFrame) -> DataFrame:
    """Adds the language by path; a corpus stored by ``write_corpus`` keeps its own, which prunes partitions.

    A column named ``language`` that the input happens to have is replaced.
    """
    stored = LANGUAGE_PART in source_files.columns
    found = F.col(LANGUAGE_PART) if stored else paths.detect_language(F.col("path"))
    return source_files.withColumn("language", found).drop(LANGUAGE_PART)


def filter_known_language(files: DataFrame) -> DataFrame:
    return files.filter(F.col("language") != paths.UNKNOWN)


def prune_dirs_by_name(source_files: DataFrame, names: Sequence[str] = paths.PRUNED_DIRS) -> DataFrame:
    """Drop files below a directory of one of these names; the file's own name does not count."""
    return source_files.filter(~paths.in_pruned_dir(F.col("path"), names))


def filter_globs(
    source_files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), root: str = "/"
) -> DataFrame:
    """Include globs win outright; without them, exclude globs apply."""
    if include:
        return source_files.filter(paths.matches_globs(F.col("path"), include, root))
    if exclude:
        return source_files.filter(~paths.matches_globs(F.col("path"), exclude, root))
    return source_files


def code_files(source_files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Files to scan, with their language. Path tests only: ``content`` is read for what is left."""
    kept = prune_dirs_by_name(source_files)
    return filter_known_language(detect_language(filter_globs(kept, include, exclude)))


# ---------------------------------------------------------------- folder rules


def split_folder_rules(rules: DataFrame) -> DataFrame:
    """Folder rules with a separator are path patterns, others directory names."""
    separator = F.col("pattern").contains("/") | F.col("pattern").contains("\\")
    kind = F.when(separator, F.lit("path")).otherwise(F.lit("name"))
    return rules.filter(F.col("kind") == "folder").select("repo_id", "pattern", kind.alias("rule_kind"))


def folder_rules_by_repo(rules: DataFrame) -> DataFrame:
    """One row per repository: ``names`` and path ``prefixes``.

    The rules of a repository come from one small file of it, so the arrays are
    bounded by the size of that one row. A pattern ``p/*`` stands for ``p`` too.
    """
    split = split_folder_rules(rules)
    pattern = F.col("pattern")
    bare = F.when(pattern.endswith("/*"), F.regexp_replace(pattern, r"/\*$", ""))
    is_name = F.col("rule_kind") == "name"
    return split.groupBy("repo_id").agg(
        F.collect_set(F.when(is_name, pattern)).alias("names"),
        F.array_union(F.collect_set(F.when(~is_name, pattern)), F.collect_set(F.when(~is_name, bare))).alias("prefixes"),
    )


def apply_folder_rules(
    rows: DataFrame, rules: DataFrame, hot_repos: DataFrame, path: str = "path", spread_by: Sequence[str] = ("path",)
) -> DataFrame:
    """Drop rows below a directory named by a rule; flag rows under a path pattern.

    A pattern covers a file when it equals one of the file's leading paths, so
    the prefix test is a lookup of the path's ancestors. It runs on narrow rows
    (paths or usages), never on file contents.
    """
    by_repo = folder_rules_by_repo(rules)
    joined = spread_join(rows, by_repo, ["repo_id"], "left", spread_by, hot_repos)
    none = F.array().cast("array<string>")
    pruned = F.arrays_overlap(paths.directories(F.col(path)), F.coalesce("names", none))
    flagged = F.arrays_overlap(paths.ancestors(F.col(path)), F.coalesce("prefixes", none))
    return joined.filter(~pruned).withColumn("in_ignored_path", flagged).drop("names", "prefixes")


# ---------------------------------------------------------------- counts


def count_files_by_language(files: DataFrame) -> DataFrame:
    """repo_id, lang_order, language (short name), n_files."""
    language = F.col("language")
    order = label = F
    for pos, (name, short) in enumerate(LANGUAGE_LABELS.items()):
        order = order.when(language == name, F.lit(pos))
        label = label.when(language == name, F.lit(short))
    return (
        files.groupBy("repo_id", "language")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .select(
            "repo_id",
            order.otherwise(F.lit(len(LANGUAGE_LABELS))).alias("lang_order"),
            label.otherwise(language).alias("language"),
            "n_files",
        )
    )
