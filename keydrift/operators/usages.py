"""Usage extraction: code files -> one row per environment-variable access.

One narrow projection per file and one ``inline``: the text never leaves its
task, only the few usage rows do. The steps, all inside the projection:

1. ``may_hold_access``  a substring test that spares most files all else
2. ``access_sites``     one pass over the file's tokens gives the arguments of each
                        access (``functions.accesses``), their lines, and each such line once
3. ``access_keys``      each argument is classified as static key, dynamic
                        expression, variable reference or nothing
4. ``first_per_line``   one usage per (key, line), the first in text order
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from keydrift.functions.accesses import placed
from keydrift.functions.languages import LANGUAGES, Language
from keydrift.functions.text import WHITE_SPACE, first_string, inline_once, last_string, let, trim_quotes_code

USAGE_COLUMNS = ["key", "line", "code_snippet", "is_partial", "is_var_ref", "full_expr"]
_CARRIED = ["at", "is_partial", "is_var_ref", "full_expr"]


def _per_language(language: Column, languages: Sequence[Language], body: Callable[[Language], Column]) -> Column:
    """CASE over the languages, so that each regex stays a literal and is compiled once."""
    out = F
    for rule in languages:
        out = out.when(language.isin(*rule.names), body(rule))
    return out.otherwise(F.lit(None))


def may_hold_access(content: Column, language: Column, languages: Sequence[Language] = LANGUAGES) -> Column:
    """Cheap substring test that spares most files the regex pass."""

    def any_needle(rule: Language) -> Column:
        found = F.lit(False)
        for texts in rule.needles:
            every = F.lit(True)
            for text in texts:
                every = every & content.contains(text)
            found = found | every
        return found

    return F.coalesce(_per_language(language, languages, any_needle), F.lit(False))


_SITE = {"line": pa.int32(), "at": pa.int32(), "expr": pa.string(), "blank": pa.string(), "literal": pa.bool_(), "bracketed": pa.bool_()}
_FILE = pa.struct([("lines", pa.list_(pa.string())), ("sites", pa.list_(pa.struct(list(_SITE.items()))))])
_TYPES = {pa.int32(): IntegerType(), pa.string(): StringType(), pa.bool_(): BooleanType()}


def access_sites(content: Column, language: Column, languages: Sequence[Language] = LANGUAGES) -> Column:
    """struct<lines, sites>: the lines that hold an argument of an access, and every such argument with its line."""
    rules = {name: rule for rule in languages for name in rule.names}

    def read(contents: pa.Array, names: pa.Array) -> pa.Array:
        found = []
        for text, name in zip(contents.to_pylist(), names.to_pylist(), strict=True):
            lines, sites = placed(text, rules[name], WHITE_SPACE) if text and name in rules else ([], [])
            found.append({"lines": lines, "sites": [dict(zip(_SITE, site, strict=True)) for site in sites]})
        return pa.array(found, _FILE)

    site = StructType([StructField(name, _TYPES[kind]) for name, kind in _SITE.items()])
    result = StructType([StructField("lines", ArrayType(StringType())), StructField("sites", ArrayType(site))])
    return F.arrow_udf(read, result)(content, language)


def access_keys(sites: Column, language: Column, languages: Sequence[Language] = LANGUAGES) -> Column:
    """array<struct<key, line, at, ...>> of the arguments that name a variable."""

    def classify(site: Column) -> Column:
        static = ~site["bracketed"] | site["literal"]
        var_ref = _per_language(language, languages, lambda r: site["expr"].rlike(r.name_regex))
        binary = _per_language(language, languages, lambda r: site["blank"].rlike(r.binary_regex))
        kind = F.when(static, F.lit("static")).when(var_ref, F.lit("var_ref")).when(binary, F.lit("dynamic"))
        return let(kind, lambda k: usage(site, k))

    def usage(site: Column, kind: Column) -> Column:
        expr = site["expr"]
        dynamic_key = F.when(language.isin("javascript", "typescript"), _javascript_key(expr)).otherwise(expr)
        return F.struct(
            F.when(kind == "static", trim_quotes_code(expr))
            .when(kind == "dynamic", dynamic_key)
            .when(kind == "var_ref", expr)
            .otherwise(F.lit(""))
            .alias("key"),
            site["line"].alias("line"),
            site["at"].alias("at"),
            F.coalesce(kind != "static", F.lit(False)).alias("is_partial"),
            F.coalesce(kind == "var_ref", F.lit(False)).alias("is_var_ref"),
            F.when(kind == "dynamic", expr).otherwise(F.lit("")).alias("full_expr"),
        )

    return F.filter(F.transform(sites, classify), lambda u: u["key"] != "")


def _javascript_key(expr: Column) -> Column:
    """First string literal in the expression, else the last, else all of it."""
    first, last = first_string(expr), last_string(expr)
    return F.when(first != "", first).when(last != "", last).otherwise(expr)


def first_per_line(usages: Column) -> Column:
    """Keep the first usage of each (key, line) of a file; sorted neighbours, no shuffle."""
    ranked = F.array_sort(
        F.transform(
            usages,
            lambda u, i: F.struct(
                u["key"].alias("key"), u["line"].alias("line"), i.alias("pos"), *[u[c].alias(c) for c in _CARRIED]
            ),
        )
    )

    def keep(all_: Column) -> Column:
        def is_first(u: Column, i: Column) -> Column:
            prev = all_[i - 1]
            return F.when(i == 0, F.lit(True)).otherwise((prev["key"] != u["key"]) | (prev["line"] != u["line"]))

        return F.filter(all_, is_first)

    return let(ranked, keep)


@lru_cache(maxsize=32)
def _usages_of_file(gateway: object, languages: Sequence[Language], dedup: bool) -> tuple[Column, Column, Column]:
    """The file test, the sites and the usages array, built once per JVM: they depend on the rules only."""
    language, content = F.col("language"), F.col("content")
    found = access_keys(F.col("_file.sites"), language, languages)
    sites = access_sites(content, language, languages)
    return may_hold_access(content, language, languages), sites, first_per_line(found) if dedup else found


def extract_usages(files: DataFrame, languages: Sequence[Language] = LANGUAGES, dedup: bool = True) -> DataFrame:
    """``code_files`` -> repo_id, file, language, key, line, code_snippet, is_partial, is_var_ref, full_expr.

    A snippet is looked up when its row is made: a line with many accesses is held once.
    """
    worth_a_look, sites, usages = _usages_of_file(SparkContext._gateway, tuple(languages), dedup)
    kept = ["repo_id", F.col("path").alias("file"), "language", F.col("_file.lines").alias("_lines")]
    rows = inline_once(files.filter(worth_a_look).withColumn("_file", sites), kept, usages)
    snippet = F.get(F.col("_lines"), F.col("at")).alias("code_snippet")
    return rows.select("repo_id", "file", "language", "key", "line", snippet, *USAGE_COLUMNS[3:])


def extract(files: DataFrame, language: Language, kind: str) -> DataFrame:
    """Usages of one language and one kind: 'static', 'dynamic' or 'var_ref'."""
    kinds = {
        "static": ~F.col("is_partial"),
        "dynamic": F.col("is_partial") & ~F.col("is_var_ref"),
        "var_ref": F.col("is_var_ref"),
    }
    of_language = files.filter(F.col("language").isin(*language.names))
    return extract_usages(of_language, (language,)).filter(kinds[kind])


def static_keys(usages: DataFrame) -> DataFrame:
    """Keys of the non-partial usages only."""
    return usages.filter(~F.col("is_partial")).select("repo_id", "file", "key")
