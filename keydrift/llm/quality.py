"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Defined cases: a null text has no words and fails; an empty table gives an empty table; repeated rows are judged one by
one; further columns of the input, whatever their names, are kept by ``accepted`` and never read. A ratio whose divisor is
0 counts as 0. There is no limit on a text's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import tables

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in that is was for it with as on be at by this are from or an which not but they".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas plus au ne se ce il avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más es pero".split(),
}


@dataclass(frozen=True)
class Rule:
    """The measure must lie between the bounds, both included; None leaves a side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Base rules first; the others are the method's own. Integers are compared exactly.
BASE_RULES = (Rule("few_words", "n_words", least=50), Rule("repeats", "repeat_percent_excess", most=0))
RULES = (
    Rule("word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", most=0.10),
    Rule("duplicate_lines", "duplicate_line_share", most=0.50),
    Rule("stop_words", "stop_word_share", least=0.02),
    Rule("letters", "exclamations_per_word", most=0.20),
)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are hashed once; most texts end there, as no hash
    repeats. Otherwise the hashes are sorted with their positions, and the union of the windows of equal neighbours is
    summed over their sorted positions."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def union(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = _let(placed, lambda s: F.zip_with(
            s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
        ))
        hits = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
        return _let(hits, lambda p: 3 + F.aggregate(
            F.zip_with(F.slice(p, 2, F.size(p)), p, lambda b, a: F.when(b.isNull(), F.lit(0)).otherwise(F.least(F.lit(3), b - a))),
            F.lit(0), lambda a, x: a + x,
        ))

    some = F.when(n < 4, F.array().cast("array<bigint>")).otherwise(hashes)
    return _let(some, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(union(h))).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, the input's columns, and the counts; one narrow projection, no shuffle."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    stop = sorted({v for ws in STOP_WORDS.values() for x in ws for v in (x, x.capitalize())})
    lines = F.filter(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), t.alias("_t"))
    out = out.withColumns({"_w": tables.words(F.col("_t")), "_lines": lines})
    return out.select(
        "row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", f"{tables.SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("_t", r"[^!]+", "")).cast("long").alias("n_exclamations"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))


MEASURES = {
    "n_words": lambda: F.col("n_words"),
    "repeat_percent_excess": lambda: 100 * F.col("n_repeat_words") - 50 * F.col("n_words"),
    "mean_word_length": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "duplicate_line_share": lambda: _ratio("n_dup_lines", "n_lines"),
    "stop_word_share": lambda: _ratio("n_stop_words", "n_words"),
    "exclamations_per_word": lambda: _ratio("n_exclamations", "n_words"),
}


def failed(rules: tuple[Rule, ...]) -> Column:
    """True where any rule of the table is broken."""
    broken = F.lit(False)
    for r in rules:
        m = MEASURES[r.measure]()
        if r.least is not None:
            broken = broken | (m < r.least)
        if r.most is not None:
            broken = broken | (m > r.most)
    return broken


COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words n_exclamations".split()


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``row``, the input's columns, and the counts with ``base_failed`` and ``kept``."""
    base = failed(BASE_RULES)
    verdict = F.struct(*COUNTS, base.alias("base_failed"), (~base & ~failed(rules)).alias("kept"))
    # the verdict leaves as one generated row: a later filter on it can't be pushed below and repeat the measures
    return measured(docs, text).select("row", F.inline(F.array(verdict)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents' columns, followed by the counts and the verdict, which replace columns of the same names."""
    found = verdicts(docs, rules, text)
    own = found.columns[1:]
    return found.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in own), *own)


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    return verdicts(docs, rules, text).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judge(docs).select(*columns)


def _stop_list() -> str:
    return ", ".join(f"'{v}'" for v in sorted({v for ws in STOP_WORDS.values() for x in ws for v in (x, x.capitalize())}))


SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), tri AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM tri) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r
), m AS (
  SELECT w.r, doc_id, len(w) AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_stop_list()}))) AS n_stop,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS n_excl
  FROM w LEFT JOIN covered USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words
         AND n_symbols / n_words <= 0.10 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.50)
         AND n_stop / n_words >= 0.02 AND n_excl / n_words <= 0.20 AS kept
FROM b
"""
