"""Ignore rules from the rules file of each repository, and exported names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.functions.text import inline_once, let
from keydrift.operators import yaml
from keydrift.operators.definitions import AREA

RULES_FILE = ".envdrift.config"
_KINDS = {"missing": "missing", "folders": "folder"}


def read_ignore_rules(source_files: DataFrame, rules_file: str = RULES_FILE) -> DataFrame:
    """repo_id, kind ('missing' | 'folder'), pattern.

    No rules file gives no rules; one that cannot be read as two lists of
    strings gives none either.
    """

    def rules(leaves):
        def under(leaf, name):
            p = leaf["yaml_path"]
            return (F.size(p) >= 2) & (p[0] == "ignores") & (F.get(p, F.lit(1)) == name)

        def listed(name, kind):
            hits = F.filter(
                leaves,
                lambda leaf: F.coalesce(under(leaf, name) & (F.get(leaf["yaml_path"], F.lit(2)) == yaml.ITEM), F.lit(False)),
            )
            return F.transform(hits, lambda leaf: F.struct(F.lit(kind).alias("kind"), leaf["value"].alias("pattern")))

        def misplaced(leaf):
            scalar = (F.size(leaf["yaml_path"]) == 2) & (leaf["quoted"] | ~leaf["value"].isin("null", "~", "Null", "NULL"))
            return F.coalesce((under(leaf, "missing") | under(leaf, "folders")) & scalar, F.lit(False))

        both = F.concat(*[listed(name, kind) for name, kind in _KINDS.items()])
        return F.when(F.exists(leaves, misplaced), F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(both)

    files = source_files.filter(F.col("path") == rules_file)
    if AREA in source_files.columns and rules_file.startswith(".env"):
        files = files.filter(F.col(AREA) == "config")
    return inline_once(files, ["repo_id"], let(yaml.leaves(), rules))


def rules_problems(source_files: DataFrame, rules_file: str = RULES_FILE) -> DataFrame:
    """repo_id, reason: rules files that give no rules although they hold something, for a warning."""
    files = source_files.filter(F.col("path") == rules_file)
    if AREA in source_files.columns and rules_file.startswith(".env"):
        files = files.filter(F.col(AREA) == "config")
    text = F.regexp_replace("content", r"(?m)#.*$|^---\s*$", "")
    read = files.select("repo_id", (F.trim(F.regexp_replace(text, r"\s+", " ")) != "").alias("holds"), yaml.leaves().alias("leaves"))

    def misplaced(leaf):
        p = leaf["yaml_path"]
        under = (F.get(p, F.lit(0)) == "ignores") & ((F.size(p) == 1) | F.get(p, F.lit(1)).isin(*_KINDS))
        null = ~leaf["quoted"] & leaf["value"].isin("null", "~", "Null", "NULL")
        return F.coalesce(under & (F.size(p) <= 2) & ~null, F.lit(False))

    reason = F.when(F.col("holds") & (F.size("leaves") == 0), F.lit("no valid YAML")).when(
        F.exists("leaves", misplaced), F.lit("a list is expected below 'ignores'")
    )
    return read.select("repo_id", reason.alias("reason")).filter("reason IS NOT NULL")


def exported_names(exported: DataFrame) -> DataFrame:
    """Names of the exported environment; ``NAME=value`` entries keep the name only.

    Values never enter the tables: only what is before the first '=' is read.
    """
    entry = F.col("entry")
    names = exported.filter(entry.contains("=")).select("repo_id", F.substring_index(entry, "=", 1).alias("key"))
    return names.distinct()
