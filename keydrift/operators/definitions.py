"""Variable definitions: config files -> key/value rows, then merged by precedence.

``env_files``    repo_id, path, file_type, load_tier, load_pos, content
``definitions``  repo_id, path, file_type, load_tier, load_pos, seq, key, value
``env``          repo_id, key, value, source_file, from_file; with ``redacted_value`` for value where it is written
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keydrift.functions import paths
from keydrift.functions.text import decode_base64, inline_once, let, redact_value, trim_quotes_env, trim_space
from keydrift.operators import yaml

# The files looked for by name, in load order.
DEFAULT_ENV_FILES = (".env", ".env.local", "env.example")
# Fixed value: what stands for the value of a name that is only exported.
EXPORTED_VALUE = "[from environment]"
# Fixed value: a line of this many bytes makes a line-based file unreadable.
LINE_LIMIT = 65536

EXPLICIT, DETECTED = 0, 1
# Partition column of a stored corpus: 'config' or 'code'.
AREA = "area"
ORDER = ["load_tier", "load_pos", "path", "seq"]


# ---------------------------------------------------------------- which files


def is_config(path: Column, extra: Sequence[str] = ()) -> Column:
    """Whether a file may define variables: named, or detected in the scan root."""
    detected = ~path.contains("/") & ((paths.detect_file_type(path) != "env") | path.startswith(".env"))
    return detected | path.isin(*DEFAULT_ENV_FILES, *map(posixpath.normpath, extra))


def select_env_files(source_files: DataFrame, extra: Sequence[str] = (), auto_detect: bool = True) -> DataFrame:
    """Files that define variables, with their load order.

    Named files come first in the order given (a file named twice takes its last
    place), detected files of the scan root follow by name. The order is a pair
    of columns instead of a running number, so no repository has to pass
    through one task to be numbered.
    """
    named = {posixpath.normpath(p): pos for pos, p in enumerate([*DEFAULT_ENV_FILES, *extra])}
    path = F.col("path")
    load_pos = F
    for name, pos in named.items():
        load_pos = load_pos.when(path == name, F.lit(pos))
    explicit = path.isin(*named)
    kept = source_files.filter(is_config(path, extra) if auto_detect else explicit)
    if AREA in source_files.columns:
        # the layout of ``write_corpus``: leave the code partition unread
        kept = kept.filter(F.col(AREA) == "config").drop(AREA)
    return (
        kept.withColumn("file_type", paths.detect_file_type(path))
        .withColumn("load_tier", F.when(explicit, F.lit(EXPLICIT)).otherwise(F.lit(DETECTED)))
        .withColumn("load_pos", load_pos.otherwise(F.lit(0)))
    )


def readable_lines(content: Column) -> Column:
    """Whether a line-based file can be read: no line reaches the limit."""
    too_long = F.exists(F.split(content, "\n"), lambda line: F.octet_length(line) >= LINE_LIMIT)
    # a file below the limit cannot hold such a line: most files skip the split
    return (F.octet_length(content) < LINE_LIMIT) | ~too_long


def reject_long_line_files(env_files: DataFrame) -> DataFrame:
    """A line-based file with one over-long line contributes nothing."""
    line_based = ~F.col("file_type").isin(*YAML_TYPES)
    return env_files.filter(~line_based | readable_lines(F.col("content")))


# ------------------------------------------- parsers: content -> array of entries
#
# Each parser is a Column expression, so that all formats are one projection over
# one scan of the files: a union of per-format branches would read them once each.

ENTRIES = "array<struct<seq:int,key:string,value:string>>"


def _entry(seq: Column, key: Column, value: Column) -> Column:
    return F.struct(seq.cast("int").alias("seq"), key.alias("key"), value.alias("value"))


def _line_entries(content: Column, entry: Callable[[Column, Column], Column]) -> Column:
    """``entry(line, seq)`` of each trimmed line that is no comment and holds '='."""
    numbered = F.transform(
        F.split(content, "\n"), lambda raw, i: F.struct((i + 1).alias("seq"), trim_space(raw).alias("text"))
    )
    wanted = F.filter(numbered, lambda line: line["text"].contains("=") & ~line["text"].startswith("#"))
    entries = F.filter(F.transform(wanted, lambda line: entry(line["text"], line["seq"])), lambda e: e["key"] != "")
    return F.when(readable_lines(content), entries).otherwise(F.array().cast(ENTRIES))


def parse_dotenv(content: Column) -> Column:
    def entry(text: Column, seq: Column) -> Column:
        value = F.substring(text, F.length(F.substring_index(text, "=", 1)) + 2, F.length(text))
        return _entry(seq, trim_space(F.substring_index(text, "=", 1)), trim_quotes_env(value))

    return _line_entries(content, entry)


# The two line formats. (?s): a line may hold separators other than \n, at which Java's dot stops.
_EXPORT = r"(?s)^export\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"


def parse_exports(content: Column) -> Column:
    """direnv files and shell scripts: ``export NAME=value`` lines."""

    def entry(text: Column, seq: Column) -> Column:
        value = trim_quotes_env(F.regexp_extract(text, _EXPORT, 2))
        return _entry(seq, F.regexp_extract(text, _EXPORT, 1), value)

    return _line_entries(content, entry)


parse_envrc = parse_exports
parse_shell = parse_exports


def parse_systemd(content: Column) -> Column:
    """``Environment=K=V`` lines; the whole assignment may be quoted."""

    def entry(text: Column, seq: Column) -> Column:
        def split(assignment: Column) -> Column:
            name = F.substring_index(assignment, "=", 1)
            value = F.substring(assignment, F.length(name) + 2, F.length(assignment))
            key = F.when(assignment.contains("="), trim_space(name)).otherwise(F.lit(""))
            return _entry(seq, key, trim_space(value))

        return let(trim_quotes_env(F.regexp_extract(text, r"(?s)^Environment\s*=\s*(.+)$", 1)), split)

    return _line_entries(content, entry)


def _leaf_entries(leaves: Column, hit, key, value) -> Column:
    numbered = F.transform(leaves, lambda leaf, i: F.struct(i.alias("seq"), leaf.alias("leaf")))
    return F.transform(
        F.filter(numbered, lambda n: hit(n["leaf"])),
        lambda n: _entry(n["seq"], key(n["leaf"]), value(n["leaf"])),
    )


def _in_environment(leaf: Column, listed: bool) -> Column:
    p = leaf["yaml_path"]
    under = leaf["named"] & (F.size(p) == 4) & (F.get(p, F.lit(0)) == "services") & (F.get(p, F.lit(2)) == "environment")
    is_item = F.get(p, F.lit(3)) == yaml.ITEM
    return F.coalesce(under & (is_item if listed else ~is_item), F.lit(False))


def parse_compose_map(leaves: Column) -> Column:
    """``services.*.environment`` written as a mapping; other scalars as text."""
    return _leaf_entries(
        leaves,
        lambda leaf: _in_environment(leaf, listed=False),
        lambda leaf: leaf["yaml_path"][3],
        # a collection is printed already, and counts as quoted
        lambda leaf: yaml.scalar_text(leaf["value"], leaf["quoted"]),
    )


def parse_compose_list(leaves: Column) -> Column:
    """``services.*.environment`` written as a list of ``K=V`` strings."""

    def rest(leaf: Column) -> Column:
        name = F.substring_index(leaf["value"], "=", 1)
        return trim_space(F.substring(leaf["value"], F.length(name) + 2, F.length(leaf["value"])))

    return _leaf_entries(
        leaves,
        lambda leaf: _in_environment(leaf, listed=True) & leaf["value"].contains("=") & ~leaf["collection"],
        lambda leaf: trim_space(F.substring_index(leaf["value"], "=", 1)),
        rest,
    )


def _k8s_entries(leaves: Column, kind: str, value: Callable[[Column], Column]) -> Column:
    """String entries of ``data`` when the object is of the given kind."""
    of_kind = F.exists(
        leaves, lambda leaf: (leaf["yaml_path"] == F.array(F.lit("kind"))) & (leaf["value"] == kind)
    )

    def hit(leaf: Column) -> Column:
        p = leaf["yaml_path"]
        entry = leaf["named"] & (F.size(p) == 2) & (p[0] == "data") & (F.get(p, F.lit(1)) != yaml.ITEM)
        return F.coalesce(entry & yaml.is_string(leaf["value"], leaf["quoted"]), F.lit(False))

    entries = _leaf_entries(leaves, hit, lambda leaf: leaf["yaml_path"][1], lambda leaf: value(leaf["value"]))
    return F.when(of_kind, entries).otherwise(F.array().cast(ENTRIES))


def parse_k8s_configmap(leaves: Column) -> Column:
    return _k8s_entries(leaves, "ConfigMap", lambda value: value)


def parse_k8s_secret(leaves: Column) -> Column:
    return _k8s_entries(leaves, "Secret", decode_base64)


YAML_TYPES = ("docker-compose", "k8s")
# Length of the path of an entry of ``services.*.environment``; what is below is its value.
ENTRY_DEPTH = 4


def parse_yaml(file_type: Column) -> Column:
    """Entries of a Compose or Kubernetes file; its leaves are listed once."""

    def entries(leaves: Column) -> Column:
        compose = F.concat(parse_compose_map(leaves), parse_compose_list(leaves))
        k8s = F.concat(parse_k8s_configmap(leaves), parse_k8s_secret(leaves))
        return F.when(file_type == "docker-compose", compose).otherwise(k8s)

    return let(yaml.leaves(F.when(file_type.isin(*YAML_TYPES), F.col("content")), ENTRY_DEPTH), entries)


def parse_with(env_files: DataFrame, entries: Column) -> DataFrame:
    """One row per entry of a parser applied to each file."""
    return inline_once(env_files, ["repo_id", "path", "file_type", "load_tier", "load_pos"], entries)


def parse_block_yaml(files: DataFrame) -> DataFrame:
    """repo_id, path and one row per YAML leaf."""
    return inline_once(files, ["repo_id", "path"], yaml.leaves())


@lru_cache(maxsize=8)
def _entries_of_file(gateway: object) -> Column:
    """CASE over the file types, built once per JVM."""
    file_type, content = F.col("file_type"), F.col("content")
    return (
        F.when(file_type.isin(*YAML_TYPES), parse_yaml(file_type))
        .when(file_type.isin("envrc", "shell"), parse_exports(content))
        .when(file_type == "systemd", parse_systemd(content))
        .otherwise(parse_dotenv(content))
    )


def parse_definitions(env_files: DataFrame) -> DataFrame:
    """Every env file through the parser of its type, in one scan."""
    return parse_with(env_files, _entries_of_file(SparkContext._gateway))


# ---------------------------------------------------------------- merging


def merge_last_wins(definitions: DataFrame) -> DataFrame:
    """Per key the value and the file of the last definition in load order."""
    last = F.max_by(F.struct("value", "path"), F.struct(*ORDER))
    merged = definitions.groupBy("repo_id", "key").agg(last.alias("last"))
    return merged.select("repo_id", "key", F.col("last.value").alias("value"), F.col("last.path").alias("source_file"))


def merge_values_only(definitions: DataFrame) -> DataFrame:
    return merge_last_wins(definitions).drop("source_file")


def overlay_exported(definitions: DataFrame, exported: DataFrame) -> DataFrame:
    """The effective environment: file values, and exported names no file defines.

    An exported name is treated as a definition below every file, so files and
    exported names merge in one aggregation with a map-side step.
    """
    below = F.lit(-1)
    names = exported.select(
        "repo_id",
        below.alias("load_tier"),
        below.alias("load_pos"),
        F.lit("").alias("path"),
        below.alias("seq"),
        "key",
        F.lit(EXPORTED_VALUE).alias("value"),
    )
    both = definitions.select("repo_id", *ORDER, "key", "value").unionByName(names)
    last = F.max_by(F.struct("value", "path", "load_tier"), F.struct(*ORDER))
    merged = both.groupBy("repo_id", "key").agg(last.alias("last"))
    from_file = F.col("last.load_tier") >= 0
    return merged.select(
        "repo_id",
        "key",
        F.col("last.value").alias("value"),
        F.when(from_file, F.col("last.path")).alias("source_file"),
        from_file.alias("from_file"),
    )


def redacted(env: DataFrame) -> DataFrame:
    """The environment as it may be written: values redacted."""
    return env.withColumn("value", redact_value(F.col("value"))).withColumnRenamed("value", "redacted_value")


def file_vars_only(env: DataFrame) -> DataFrame:
    return env.filter("from_file").drop("from_file")
