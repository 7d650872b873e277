"""Report rows and the JSON report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keydrift.functions.text import format_location
from keydrift.operators.skew import hot_groups, spread_join

MISSING, PARTIAL, UNUSED = "missing", "partial_matches", "unused"


def display_unused(unused: DataFrame) -> DataFrame:
    """Unused keys for display: value redacted, source defaulting to ``.env``."""
    source = F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.lit(".env"))
    return unused.select("repo_id", "key", "redacted_value", source.alias("source_file"))


def report_rows(
    missing: DataFrame, partial: DataFrame, unused: DataFrame, skip_unused: bool = False, no_dynamic: bool = False
) -> DataFrame:
    """repo_id, section, key, location: everything a report lists, in long form."""

    def located(rows: DataFrame, section: str) -> DataFrame:
        location = format_location(F.col("file"), F.col("line"), F.col("code_snippet"))
        return rows.select("repo_id", F.lit(section).alias("section"), "key", location.alias("location"))

    keys = unused.select("repo_id", F.lit(UNUSED).alias("section"), "key", F.lit(None).cast("string").alias("location"))
    return (
        located(missing, MISSING)
        .unionByName(located(partial, PARTIAL).filter(F.lit(not no_dynamic)))
        .unionByName(keys.filter(F.lit(not skip_unused)))
    )


def json_lines(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """repo_id, line: a JSON object for each report row and one with the counters of each repository.

    The layout is the same for every size, and nothing is shuffled or gathered for it.
    """
    places = rows.select("repo_id", F.to_json(F.struct("repo_id", "section", "key", "location")).alias("line"))
    counters = F.struct("repo_id", F.lit("summary").alias("section"), "ignored_missing", "ignored_from_folders")
    return places.unionByName(summary.select("repo_id", F.to_json(counters).alias("line")))


def with_document_part(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Number of the nested document a report row goes to.

    Without ``limit`` a repository is one document. With it, one of more rows is
    spread by hash over as many documents as it needs, so that neither a hot
    repository nor a hot key is gathered in one task; every row is in exactly one.
    """
    if limit is None:
        return rows.withColumn("part", F.lit(0))
    counts = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.select("repo_id", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    spread = ["section", "key", "location"]
    out = spread_join(rows, parts, ["repo_id"], "inner", spread, hot_groups(counts, ["repo_id"]))
    return out.withColumn("part", F.pmod(F.xxhash64(*spread), F.col("parts")).cast("int")).drop("parts")


def group_locations(rows: DataFrame) -> DataFrame:
    """Locations per key as a sorted array; needs ``part`` to bound the arrays."""
    located = F.sort_array(F.collect_list("location"))
    return rows.groupBy("repo_id", "part", "section", "key").agg(located.alias("locations"))


def json_report(rows: DataFrame, summary: DataFrame, limit: int | None = None) -> DataFrame:
    """repo_id, part, report: one JSON document per repository, or per part of a large one.

    Every document has the same five fields; keys ascend by bytes, locations as
    text. The counters stand in part 0 and are 0 elsewhere, so the parts of a
    repository add up. The summary joins the rows as one more row per repository:
    a repository without rows gets its document too, and nothing is joined.
    """
    grouped = group_locations(with_document_part(rows, limit))
    zero = F.lit(0).cast("bigint")
    listed = grouped.withColumns({"ignored_missing": zero, "ignored_from_folders": zero})
    counters = summary.select("repo_id", F.lit(0).alias("part"), "ignored_missing", "ignored_from_folders")

    def entries(section: str, value: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("section") == section, value))).alias(section)

    located = F.struct("key", "locations")
    documents = (
        listed.unionByName(counters, allowMissingColumns=True)
        .groupBy("repo_id", "part")
        .agg(
            entries(MISSING, located),
            entries(PARTIAL, located),
            entries(UNUSED, F.col("key")),
            F.sum("ignored_missing").alias("ignored_missing"),
            F.sum("ignored_from_folders").alias("ignored_from_folders"),
        )
    )
    fields = [c for c in documents.columns if c not in ("repo_id", "part")]
    return documents.select("repo_id", "part", F.to_json(F.struct(*fields)).alias("report"))


# Report order of the sections; what closes a document stands behind them.
_SECTIONS = (MISSING, PARTIAL, UNUSED)
_END = len(_SECTIONS)


def _fragment(before: Column, row: Column) -> Column:
    """What a row adds to its repository's document behind the row before (null: the first of the repository).

    Both are (section, key); a row of section ``_END`` closes the document.
    """
    name = lambda k: F.lit(f'"{_SECTIONS[k]}":[')
    last, section = F.coalesce(before["section"], F.lit(-1)), row["section"]
    same_section = last == section
    same_key = same_section & (before["key"] == row["key"])
    located = lambda s: (s >= 0) & (s < _SECTIONS.index(UNUSED))
    closed_key = F.when(located(last) & ~same_key, F.lit("]}")).otherwise(F.lit(""))
    # arrays between the last row's and this one's are closed and opened
    arrays = F.lit("")
    for k in range(_END):
        begun = F.when((last < k) & (section >= k), F.concat(F.lit("{" if k == 0 else ","), name(k))).otherwise(F.lit(""))
        ended = F.when((last <= k) & (section > k), F.lit("]")).otherwise(F.lit(""))
        arrays = F.concat(arrays, begun, ended)
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("s"))), 6, 2147483647)  # noqa: E731  {"s":"..."} from the quote on
    text = lambda c: F.left(quoted(c), F.length(quoted(c)) - 1)
    comma = lambda same: F.when(same, F.lit(",")).otherwise(F.lit(""))
    key = F.concat(comma(same_section), F.lit('{"key":'), text(row["key"]), F.lit(',"locations":['))
    place = F.when(same_key, F.lit(",")).otherwise(key)
    counters = F.concat(
        F.lit(',"ignored_missing":'), row["ignored_missing"].cast("string"),
        F.lit(',"ignored_from_folders":'), row["ignored_from_folders"].cast("string"), F.lit("}"),
    )
    item = (
        F.when(section == _END, counters)
        .when(section == _SECTIONS.index(UNUSED), F.concat(comma(same_section), text(row["key"])))
        .otherwise(F.concat(place, text(row["location"])))
    )
    return F.concat(closed_key, arrays, item)


def sorted_parts(rows: DataFrame, summary: DataFrame, stage: Callable[[DataFrame, str], DataFrame], parts: int | None = None) -> DataFrame:
    """repo_id, section, key, location, counters, part, seq: the report rows and one closing row for each repository in
    report order, written in range partitions. ``part`` and ``seq`` number them; a repository goes through as many
    partitions as it needs."""
    number = F.lit(-1)
    for k, name in enumerate(_SECTIONS):
        number = F.when(F.col("section") == name, F.lit(k)).otherwise(number)
    zero = F.lit(0).cast("bigint")
    listed = rows.select("repo_id", number.alias("section"), "key", "location", zero.alias("ignored_missing"), zero.alias("ignored_from_folders"))
    ends = summary.select(
        "repo_id", F.lit(_END).alias("section"), F.lit("").alias("key"), F.lit("").alias("location"), "ignored_missing", "ignored_from_folders"
    )
    order = ["repo_id", "section", "key", "location"]
    every = listed.unionByName(ends)
    ranged = every.repartitionByRange(parts, *order) if parts else every.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return stage(ranged.withColumn("seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sorted")


def json_fragments(parts: DataFrame) -> DataFrame:
    """repo_id, section, key, location, part, seq, text: one fragment for each row of ``sorted_parts``. A repository's
    fragments in the order of (part, seq) are its JSON document, the same as the nested view's.

    A fragment depends on its row and the one before. That is the same partition's, or the last one of the partition
    before: one row for each partition carries over, so nothing but a range partition is ever in one place.
    """
    within = Window.partitionBy("part").orderBy("seq")
    row = F.struct("repo_id", "section", "key")
    last = parts.groupBy("part").agg(F.max_by(row, "seq").alias("carried"))
    carried = last.select(F.lead("part").over(Window.orderBy("part")).alias("part"), "carried")
    met = parts.withColumn("_lag", F.lag(row).over(within)).join(carried.filter("part IS NOT NULL"), "part", "left")
    before = F.coalesce("_lag", "carried")
    same = F.when(before["repo_id"] == F.col("repo_id"), before)
    here = F.struct("section", "key", "location", "ignored_missing", "ignored_from_folders")
    names = F.array(*map(F.lit, (*_SECTIONS, "end")))
    return met.withColumn("_before", same).select(
        "repo_id", F.get(names, F.col("section")).alias("section"), "key", "location", "part", "seq",
        _fragment(F.col("_before"), here).alias("text"),
    )


def write_documents(fragments: DataFrame, path: str) -> None:
    """Write the documents as they are, a fragment a line, and ``manifest``: which lines of which parts are whose.

    ``documents/part=N`` holds the lines of part N in order; a document is the lines from (first_part, first_line) to
    (last_part, last_line) one after the other. Line breaks between fragments are white space in JSON.
    """
    line = Window.partitionBy("part").orderBy("seq")
    ordered = fragments.withColumn("line", F.row_number().over(line) - 1)
    place = F.struct("part", "line")
    whose = ordered.groupBy("repo_id").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("text") + 1).alias("bytes")
    )
    whose.select(
        "repo_id", F.col("first.part").alias("first_part"), F.col("first.line").alias("first_line"),
        F.col("last.part").alias("last_part"), F.col("last.line").alias("last_line"), "lines", "bytes",
    ).write.mode("overwrite").parquet(f"{path}/manifest")
    # one task for each part, as a part is one range of the sorted rows
    spread = fragments.repartition("part").sortWithinPartitions("part", "seq")
    spread.select("part", "text").write.mode("overwrite").partitionBy("part").text(f"{path}/documents")


def sort_keys(df: DataFrame) -> DataFrame:
    """By repository and key, bytewise: a range-partitioned total order."""
    return df.orderBy("repo_id", "key")


def write_json(report: DataFrame, path: str) -> None:
    """One JSON line per document or ``json_lines`` row, written in parallel."""
    report.select("report" if "report" in report.columns else "line").write.mode("overwrite").text(path)
