"""Registered queries: one per operator, over whole tables derived from the benchmark data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.corpus import fleet
from keydrift.corpus import oracle as o
from keydrift.functions import languages, paths, text
from keydrift.operators import definitions, drift, files, report, usages
from keydrift.plans.scan import DriftScan
from keydrift.sources.rules import RULES_FILE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_scans: dict[tuple[str, str], DriftScan] = {}

PLACE = ["file", "line", "code_snippet"]
USAGE = ["repo_id", "file", "language", "key", "line", "code_snippet", "is_partial", "is_var_ref", "full_expr"]


def scan(spark: SparkSession, sf_dir: str) -> DriftScan:
    """One scan per session and scale, so the queries share its staged tables."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _scans:
        _scans[at] = DriftScan(fleet.source_files(spark, sf_dir), fleet.exported(spark, sf_dir))
    return _scans[at]


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def on_scan(name: str, body: Callable[[DriftScan], DataFrame], sql: str | None = None) -> None:
    add(name, lambda spark, sf_dir: body(scan(spark, sf_dir)), sql)


def on_layout(name: str, exprs: Callable[[], list], sql: str) -> None:
    """Expressions over the columns behind the code files."""
    add(name, lambda spark, sf_dir: fleet.layout(spark, sf_dir).select("id", *exprs()), sql)


ALL_PATHS = f"""
paths AS (
  SELECT repo_id, path, 'env' AS file_type, NULL AS load_tier, NULL AS load_pos FROM ({o.LAYOUT})
  UNION ALL SELECT DISTINCT repo_id, path, file_type, load_tier, load_pos FROM defs
  UNION ALL SELECT repo_id, '{RULES_FILE}', 'env', 1, 0 FROM customers
  UNION ALL SELECT repo_id, 'docs/.env', 'env', NULL, NULL FROM customers
)
"""
WITH_PATHS = f"WITH {o.RULES}, {o.DEFINITIONS}, {ALL_PATHS}"

# ------------------------------------------------------------ sources and sinks

on_scan("src_files", lambda s: s.source_files.select("repo_id", "path"), f"{WITH_PATHS} SELECT repo_id, path FROM paths")
on_scan(
    "src_env_files",
    lambda s: s.env_files.select("repo_id", "path", "file_type"),
    f"{WITH_PATHS} SELECT repo_id, path, file_type FROM paths WHERE load_tier IS NOT NULL",
)
on_scan("src_exported_env", lambda s: s.exported, f"WITH customers AS ({o.CUSTOMERS}), {o.EXPORTED} SELECT * FROM exported")
on_scan("src_ignore_rules", lambda s: s.rules, f"WITH {o.RULES} SELECT * FROM rules")
on_scan(
    "sink_json",
    lambda s: s.json_report,
    f"""{o.WITH_REPORT}
    SELECT s.repo_id, CAST(0 AS int) AS part, CAST(to_json({{
      'missing': coalesce((SELECT list({{'key': key, 'locations': locations}} ORDER BY key) FROM grouped g
                           WHERE g.repo_id = s.repo_id AND section = 'missing'), []),
      'partial_matches': coalesce((SELECT list({{'key': key, 'locations': locations}} ORDER BY key) FROM grouped g
                                   WHERE g.repo_id = s.repo_id AND section = 'partial_matches'), []),
      'unused': coalesce((SELECT list(key ORDER BY key) FROM grouped g
                          WHERE g.repo_id = s.repo_id AND section = 'unused'), []),
      'ignored_missing': ignored_missing, 'ignored_from_folders': ignored_from_folders}}) AS string) AS report
    FROM summary s""",
)
on_scan(
    "sink_json_lines",
    lambda s: s.json_lines,
    f"""{o.WITH_REPORT}
    SELECT repo_id, CAST(to_json({{'repo_id': repo_id, 'section': section, 'key': key, 'location': location}}) AS string) AS line
    FROM lines WHERE location IS NOT NULL
    UNION ALL SELECT repo_id, CAST(to_json({{'repo_id': repo_id, 'section': section, 'key': key}}) AS string) FROM lines WHERE location IS NULL
    UNION ALL SELECT repo_id, CAST(to_json({{'repo_id': repo_id, 'section': 'summary', 'ignored_missing': ignored_missing,
      'ignored_from_folders': ignored_from_folders}}) AS string) FROM summary""",
)

# A row's fragment from the row before it: what it closes, opens and adds.
on_scan(
    "sink_json_fragments",
    lambda s: s.json_fragments.select("repo_id", "section", "key", "location", "text"),
    f"""{o.WITH_REPORT}, rows AS (
      SELECT repo_id, CASE section WHEN 'missing' THEN 0 WHEN 'partial_matches' THEN 1 ELSE 2 END AS s, section, key, location,
             0 AS m, 0 AS f FROM lines
      UNION ALL SELECT repo_id, 3, 'end', '', '', ignored_missing, ignored_from_folders FROM summary),
    chained AS (SELECT *, coalesce(lag(s) OVER w, -1) AS ps, lag(key) OVER w AS pk FROM rows
                WINDOW w AS (PARTITION BY repo_id ORDER BY s, key, location NULLS FIRST))
    SELECT repo_id, section, key, location,
      CASE WHEN ps IN (0, 1) AND (ps <> s OR pk <> key) THEN ']' || chr(125) ELSE '' END
      || CASE WHEN ps < 0 THEN chr(123) || '"missing":[' ELSE '' END || CASE WHEN ps <= 0 AND s > 0 THEN ']' ELSE '' END
      || CASE WHEN ps < 1 AND s >= 1 THEN ',"partial_matches":[' ELSE '' END || CASE WHEN ps <= 1 AND s > 1 THEN ']' ELSE '' END
      || CASE WHEN ps < 2 AND s >= 2 THEN ',"unused":[' ELSE '' END || CASE WHEN ps <= 2 AND s > 2 THEN ']' ELSE '' END
      || CASE WHEN s = 3 THEN ',"ignored_missing":' || m || ',"ignored_from_folders":' || f || chr(125)
              WHEN s = 2 THEN CASE WHEN ps = s THEN ',' ELSE '' END || CAST(to_json(key) AS string)
              WHEN ps = s AND pk = key THEN ',' || CAST(to_json(location) AS string)
              ELSE CASE WHEN ps = s THEN ',' ELSE '' END || chr(123) || '"key":' || CAST(to_json(key) AS string) || ',"locations":['
                   || CAST(to_json(location) AS string) END AS text
    FROM chained""",
)

# ------------------------------------------------------------ filters, predicates, paths

on_scan(
    "detect_language",
    lambda s: files.detect_language(s.source_files).select("repo_id", "path", "language"),
    f"""{WITH_PATHS} SELECT p.repo_id, p.path, coalesce(language, 'unknown') AS language
    FROM paths p LEFT JOIN ({o.LAYOUT}) l ON l.path = p.path""",
)
on_scan(
    "filter_known_language",
    lambda s: files.filter_known_language(files.detect_language(s.source_files)).select("repo_id", "path", "language"),
    f"SELECT repo_id, path, language FROM ({o.LAYOUT}) WHERE language <> 'unknown'",
)
on_scan(
    "prune_dirs_by_name",
    lambda s: files.prune_dirs_by_name(s.source_files).select("repo_id", "path"),
    f"{WITH_PATHS} SELECT repo_id, path FROM paths WHERE NOT starts_with(path, 'node_modules/')",
)
on_scan(
    "split_folder_rules",
    lambda s: files.split_folder_rules(s.rules),
    f"""WITH {o.RULES} SELECT repo_id, pattern, CASE pattern WHEN 'gen' THEN 'name' ELSE 'path' END AS rule_kind
    FROM rules WHERE kind = 'folder'""",
)
on_scan(
    "flag_ignored_path",
    lambda s: s.scanned_files.select("repo_id", "path", "in_ignored_path"),
    f"WITH {o.RULES}, {o.FILES}, {o.SCANNED} SELECT repo_id, path, in_ignored_path FROM scanned",
)
on_scan(
    "filter_globs",
    lambda s: files.filter_globs(s.source_files, include=("*.g[a-z]", "f*.p?", "/src/f*1.tsx")).select("repo_id", "path"),
    f"""SELECT repo_id, path FROM ({o.LAYOUT}) WHERE ext IN ('.go', '.py')
    OR (ext = '.tsx' AND dir = 'src' AND id % 10 = 1)""",
)
add(
    "relativize_path",
    lambda spark, sf_dir: fleet.layout(spark, sf_dir).select(
        "id",
        paths.relativize(
            F.concat(F.when(F.col("id") % 3 == 0, F.lit("/other/")).otherwise(F.lit("/root/")), "path"), F.lit("/root/")
        ).alias("path"),
    ),
    f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'f' || id || ext ELSE dir || '/f' || id || ext END AS path
    FROM ({o.LAYOUT})""",
)
on_scan(
    "detect_file_type",
    lambda s: s.source_files.select("repo_id", "path", paths.detect_file_type(F.col("path")).alias("file_type")),
    f"{WITH_PATHS} SELECT repo_id, path, file_type FROM paths",
)
on_scan(
    "tag_usages_ignored",
    lambda s: s.usages.select("repo_id", "file", "key", "line", "in_ignored_path"),
    f"{o.WITH_FILES} SELECT repo_id, file, key, line, in_ignored_path FROM usages",
)

# ------------------------------------------------------------ usage extraction

_KINDS = {
    "static": ("static", "NOT is_partial"),
    "dynamic": ("dynamic", "is_partial AND NOT is_var_ref"),
    "varref": ("var_ref", "is_var_ref"),
}
_LANGUAGES = {
    "js": languages.JAVASCRIPT,
    "go": languages.GO,
    "py": languages.PYTHON,
    "rust": languages.RUST,
    "java": languages.JAVA,
}


def _extract_query(language: languages.Language, kind: str) -> Callable[[DriftScan], DataFrame]:
    return lambda s: usages.extract(s.code_files, language, kind).select("repo_id", *PLACE, "key", "full_expr")


for _short, _language in _LANGUAGES.items():
    for _kind, (_engine_kind, _test) in _KINDS.items():
        _names = ", ".join(f"'{n}'" for n in _language.names)
        on_scan(
            f"extract_{_short}_{_kind}",
            _extract_query(_language, _engine_kind),
            f"""{o.RAW_USAGES} SELECT repo_id, file, line, code_snippet, key, full_expr FROM usages
            WHERE language IN ({_names}) AND {_test}""",
        )

on_scan(
    "extract_usages",
    lambda s: usages.extract_usages(s.code_files),
    f"{o.RAW_USAGES} SELECT {', '.join(USAGE)} FROM usages",
)
on_scan(
    "extract_static_only",
    lambda s: usages.static_keys(usages.extract_usages(s.code_files)),
    f"{o.RAW_USAGES} SELECT repo_id, file, key FROM usages WHERE NOT is_partial",
)
on_scan(
    "usage_line",
    lambda s: usages.extract_usages(s.code_files).select("repo_id", "file", "key", "line"),
    f"{o.RAW_USAGES} SELECT repo_id, file, key, line FROM usages",
)
on_scan(
    "usage_snippet",
    lambda s: usages.extract_usages(s.code_files).select("repo_id", "file", "line", "code_snippet"),
    f"{o.RAW_USAGES} SELECT repo_id, file, line, code_snippet FROM usages",
)


def _repeated_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file reads one key twice on a line, again below, and as a variable of the same name."""
    access = F.concat("opening", F.lit('"'), "k", F.lit('"'), "closing", F.lit(";"))
    by_name = F.concat("opening", "k", "closing", F.lit(";"))
    content = F.concat(access, access, F.lit("\n"), access, F.lit("\n\n"), access, by_name, F.lit("\n"), by_name)
    return fleet.layout(spark, sf_dir).select("repo_id", "path", "language", content.alias("content"))


add(
    "dedup_usages",
    lambda spark, sf_dir: usages.extract_usages(_repeated_accesses(spark, sf_dir)).select(
        "repo_id", "file", "key", "line", "is_var_ref"
    ),
    f"""SELECT repo_id, path AS file, k AS key, CAST(n AS int) AS line, n = 5 AS is_var_ref
    FROM ({o.LAYOUT.replace('f.*,', 'f.* EXCLUDE (n),')}) , (VALUES (1), (2), (4), (5)) v(n) WHERE language <> 'unknown'""",
)

def _mixed() -> Column:
    """Two literals among three names."""
    return F.concat(F.lit('"'), "prefix", F.lit('" + '), "v", F.lit(" + '"), "k", F.lit("' + "), "name")


on_layout(
    "first_string",
    lambda: [
        text.first_string(_mixed()).alias("mixed"),
        text.first_string(F.concat("v", F.lit(" + `"), "k", F.lit("`"))).alias("behind"),
        text.first_string(F.concat(F.lit('"'), "k", F.lit("' + '"), "v")).alias("unclosed"),
    ],
    f"SELECT id, prefix AS mixed, k AS behind, '' AS unclosed FROM ({o.LAYOUT})",
)
on_layout(
    "last_string",
    lambda: [
        text.last_string(_mixed()).alias("mixed"),
        text.last_string(F.concat(F.lit("`"), "k", F.lit("` + "), "v")).alias("front"),
    ],
    f"SELECT id, k AS mixed, k AS front FROM ({o.LAYOUT})",
)
on_layout(
    "trim_quotes_code",
    lambda: [
        text.trim_quotes_code(F.concat(F.lit('"'), "k", F.lit('"'))).alias("double"),
        text.trim_quotes_code(F.concat(F.lit("'"), "k", F.lit('"'))).alias("mixed"),
        text.trim_quotes_code(F.concat(F.lit(" `"), "k", F.lit("`"))).alias("spaced"),
        text.trim_quotes_code(F.concat(F.lit('"""'), "k", F.lit('"""'))).alias("triple"),
    ],
    f"""SELECT id, k AS double, '''' || k || '"' AS mixed, ' `' || k || '`' AS spaced, '""' || k || '""' AS triple
    FROM ({o.LAYOUT})""",
)

# ------------------------------------------------------------ definitions

DEF = ["repo_id", "path", "key", "value"]


def _by_type(*types: str) -> Callable[[DriftScan], DataFrame]:
    return lambda s: s.definitions.filter(F.col("file_type").isin(*types)).select(*DEF)


def _defs_sql(test: str) -> str:
    return f"WITH {o.RULES}, {o.DEFINITIONS} SELECT repo_id, path, key, value FROM defs WHERE {test}"


_WS = text.WHITE_SPACE


def _documents_as_dotenv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and pages read as dotenv files: free text with some '=' in it."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    as_files = documents.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"))
    as_files = as_files.unionByName(pages.select(F.concat(F.lit("p"), "page_id").alias("path"), F.col("html").alias("content")))
    return text.inline_once(as_files.repartition("path"), ["path"], definitions.parse_dotenv(F.col("content")))


add(
    "parse_dotenv_text",
    _documents_as_dotenv,
    f"""WITH texts AS (
      SELECT 'd' || doc_id AS path, text AS content FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages),
    readable AS (SELECT * FROM texts t WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT unnest(string_split(t.content, chr(10))) AS l) WHERE strlen(l) >= 65536)),
    lines AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS seq,
                     trim(unnest(string_split(content, chr(10))), '{_WS}') AS line FROM readable),
    parts AS (SELECT path, seq, trim(line[:instr(line, '=') - 1], '{_WS}') AS key,
                     trim(line[instr(line, '=') + 1:], '{_WS}') AS raw
              FROM lines WHERE contains(line, '=') AND NOT starts_with(line, '#'))
    SELECT path, CAST(seq AS int) AS seq, key,
           CASE WHEN length(raw) >= 2 AND raw[1:1] = raw[-1:] AND raw[1:1] IN ('"', '''', '`')
                THEN raw[2:-2] ELSE raw END AS value
    FROM parts WHERE key <> ''""",
)
on_scan("parse_dotenv", _by_type("env"), _defs_sql("file_type = 'env'"))
on_scan("parse_envrc", _by_type("envrc"), _defs_sql("file_type = 'envrc'"))
on_scan("parse_shell", _by_type("shell"), _defs_sql("file_type = 'shell'"))
on_scan("parse_systemd", _by_type("systemd"), _defs_sql("file_type = 'systemd'"))
_COMPOSE = f"file_type = 'docker-compose' AND {{}}(path = 'docker-compose.yml' AND seq = 3)"


def _from_leaves(parser, file_type: str, columns: list[str] = DEF) -> Callable[[DriftScan], DataFrame]:
    def run(s: DriftScan) -> DataFrame:
        env_files = s.env_files.filter(F.col("file_type") == file_type)
        entries = text.let(definitions.yaml.leaves(whole=definitions.ENTRY_DEPTH), parser)
        return definitions.parse_with(env_files, entries).select(*columns)

    return run


on_scan("parse_compose_map", _from_leaves(definitions.parse_compose_map, "docker-compose"), _defs_sql(_COMPOSE.format("NOT ")))
on_scan("parse_compose_list", _from_leaves(definitions.parse_compose_list, "docker-compose"), _defs_sql(_COMPOSE.format("")))
on_scan(
    "parse_k8s_configmap",
    _from_leaves(definitions.parse_k8s_configmap, "k8s"),
    _defs_sql("ends_with(path, '-configmap.yaml')"),
)
on_scan("parse_k8s_secret", _from_leaves(definitions.parse_k8s_secret, "k8s"), _defs_sql("ends_with(path, '-secret.yml')"))
on_scan(
    "parse_block_yaml",
    lambda s: definitions.parse_block_yaml(s.env_files.filter("file_type = 'k8s'")).select(
        "repo_id", "path", F.array_join("yaml_path", "/").alias("yaml_path"), "value", "quoted"
    ),
    f"""WITH {o.RULES}, {o.DEFINITIONS}
    SELECT repo_id, config_path AS path, y AS yaml_path, CASE y
             WHEN 'kind' THEN CASE form WHEN 3 THEN 'ConfigMap' ELSE 'Secret' END
             WHEN 'data/NUMBER' THEN CAST(id AS string)
             WHEN 'data/' || a THEN CASE form WHEN 3 THEN value ELSE base64(encode(value)) END
             ELSE CASE form WHEN 3 THEN CAST(id AS string) ELSE 'not base64' END END AS value,
           y = 'data/' || b OR (form = 3 AND variant = 2 AND y <> 'data/NUMBER') AS quoted
    FROM configs, LATERAL (SELECT unnest(['kind', 'data/' || a, 'data/' || b, 'data/NUMBER']) AS y) u
    WHERE form = 3 OR (form = 4 AND y <> 'data/NUMBER')""",
)
on_scan(
    "parse_definitions",
    lambda s: s.definitions.select(*DEF, "file_type", "load_tier", "load_pos", "seq"),
    f"""WITH {o.RULES}, {o.DEFINITIONS}
    SELECT repo_id, path, key, value, file_type, load_tier, load_pos, seq FROM defs""",
)
on_layout(
    "trim_quotes_env",
    lambda: [
        text.trim_quotes_env(F.concat(F.lit('\t　"'), "k", F.lit(' "  \r'))).alias("quoted"),
        text.trim_quotes_env(F.concat(F.lit(" '"), "k", F.lit("\n"))).alias("unclosed"),
    ],
    f"SELECT id, k || ' ' AS quoted, '''' || k AS unclosed FROM ({o.LAYOUT})",
)
add(
    "reject_long_line_files",
    lambda spark, sf_dir: definitions.reject_long_line_files(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select(
            "doc_id", F.lit("env").alias("file_type"), F.translate("text", "\n", " ").alias("content")
        )
    ).select("doc_id"),
    "SELECT doc_id FROM documents WHERE strlen(replace(text, chr(10), ' ')) < 65536",
)

# ------------------------------------------------------------ merge and override

on_scan(
    "rank_env_files",
    lambda s: s.env_files.select("repo_id", "path", "load_tier", "load_pos"),
    f"{WITH_PATHS} SELECT repo_id, path, load_tier, load_pos FROM paths WHERE load_tier IS NOT NULL",
)
on_scan("merge_last_wins", lambda s: definitions.merge_last_wins(s.definitions), f"{o.WITH_DEFS} SELECT * FROM file_env")
on_scan(
    "merge_values_only",
    lambda s: definitions.merge_values_only(s.definitions),
    f"{o.WITH_DEFS} SELECT repo_id, key, value FROM file_env",
)


def _merged(s: DriftScan) -> DataFrame:
    """The environment with its values, which the scan itself writes redacted only."""
    return definitions.overlay_exported(s.definitions, s.exported)


on_scan("overlay_exported", _merged, f"{o.WITH_DEFS} SELECT * FROM env")
on_scan("file_vars_only", lambda s: definitions.file_vars_only(_merged(s)), f"{o.WITH_DEFS} SELECT * FROM file_env")

# ------------------------------------------------------------ analysis


def _static_and_partial(s: DriftScan) -> DataFrame:
    static, partial = drift.split_static_partial(s.usages)
    columns = ["repo_id", "file", "line", "group_key", "is_partial"]
    return static.withColumn("group_key", F.col("key")).select(*columns).unionByName(partial.select(*columns))


on_scan(
    "split_static_partial",
    _static_and_partial,
    f"""{o.WITH_FILES} SELECT repo_id, file, line, coalesce(nullif(full_expr, ''), key) AS group_key, is_partial
    FROM usages""",
)


def _candidates(s: DriftScan) -> DataFrame:
    return drift.missing_candidates(drift.key_profile(s.usages), s.env)


on_scan("missing_candidates", _candidates, f"{o.WITH_ALL} SELECT * FROM candidates")
on_scan(
    "suppress_ignored_folders",
    lambda s: drift.mark_ignored_folders(_candidates(s)).select("repo_id", "key", "in_ignored_folders"),
    f"{o.WITH_ALL} SELECT repo_id, key, n_outside = 0 AS in_ignored_folders FROM candidates",
)
on_scan(
    "suppress_ignored_keys",
    lambda s: drift.mark_ignored_keys(_candidates(s), s.rules).select("repo_id", "key", "ignored_key"),
    f"""{o.WITH_ALL} SELECT repo_id, key, (repo_id, key) IN (
      SELECT (repo_id, pattern) FROM rules WHERE kind = 'missing') AS ignored_key FROM candidates""",
)
on_scan("missing", lambda s: s.missing, f"{o.WITH_ALL} SELECT * FROM missing")
on_scan(
    "partial_var_refs",
    lambda s: drift.partial_var_refs(drift.partial_groups(s.usages)).select("repo_id", "group_key", "n_usages"),
    f"{o.WITH_ALL} SELECT repo_id, group_key, n_usages FROM groups WHERE is_var_ref",
)


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions, plain words and dashed words against the whole environment."""
    s = scan(spark, sf_dir)
    groups = drift.partial_groups(s.usages).filter(~F.col("is_var_ref")).select("repo_id", "group_key")
    layout = fleet.layout(spark, sf_dir)
    words = layout.select("repo_id", F.substring(F.col("k"), F.lit(2), F.lit(4)).alias("group_key"))
    spaced = layout.select("repo_id", F.concat(F.lit("ort "), F.left("k", F.lit(6))).alias("group_key"))
    every = groups.unionByName(words).unionByName(spaced).distinct().withColumn("is_var_ref", F.lit(False))
    stage = s.lookups.stage
    return drift.partial_contains(stage(every, "every"), s.env, stage).select("repo_id", "group_key")


add(
    "partial_contains",
    _contained,
    f"""{o.WITH_ALL}, every AS (
      SELECT repo_id, group_key FROM groups WHERE NOT is_var_ref
      UNION SELECT repo_id, substr(k, 2, 4) FROM ({o.LAYOUT})
      UNION SELECT repo_id, 'ort ' || left(k, 6) FROM ({o.LAYOUT}))
    SELECT * FROM every g WHERE NOT EXISTS (
      SELECT 1 FROM env e WHERE e.repo_id = g.repo_id AND contains(e.key, g.group_key))""",
)
on_scan("partial_matches", lambda s: s.partial_matches, f"{o.WITH_ALL} SELECT * FROM partials")
_REDACTED = """CASE WHEN value = '' THEN '""' WHEN length(value) > 20 THEN '[REDACTED]'
           WHEN length(value) > 4 THEN value[1:1] || '...' || value[-1:] ELSE '***' END AS redacted_value"""
on_scan("unused", lambda s: s.unused, f"{o.WITH_ALL} SELECT repo_id, key, {_REDACTED}, source_file FROM unused")
on_scan(
    "count_ignored_in_list",
    lambda s: drift.count_ignored_in_list(s.usages.select("repo_id", "key"), s.rules),
    f"""{o.WITH_FILES} SELECT repo_id, count(*) AS n_ignored FROM usages u WHERE EXISTS (
      SELECT 1 FROM rules r WHERE kind = 'missing' AND r.repo_id = u.repo_id AND r.pattern = u.key) GROUP BY 1""",
)
on_scan("analyze", lambda s: s.report_rows, f"{o.WITH_REPORT} SELECT * FROM lines")

# ------------------------------------------------------------ aggregation and report

on_scan(
    "count_files_by_language",
    lambda s: files.count_files_by_language(s.scanned_files),
    f"""WITH {o.RULES}, {o.FILES}, {o.SCANNED}
    SELECT repo_id, CAST(lang_no AS int) AS lang_order,
           CASE language WHEN 'javascript' THEN 'js' WHEN 'typescript' THEN 'ts' ELSE language END AS language,
           count(*) AS n_files FROM scanned GROUP BY ALL""",
)
on_scan(
    "count_ignored",
    lambda s: s.summary.select("repo_id", "ignored_missing", "ignored_from_folders"),
    f"{o.WITH_ALL} SELECT repo_id, ignored_missing, ignored_from_folders FROM summary",
)
on_scan(
    "summary",
    lambda s: s.summary,
    f"{o.WITH_ALL} SELECT *, missing + partial + unused > 0 AS has_issues FROM summary",
)
on_scan(
    "group_locations",
    lambda s: report.group_locations(report.with_document_part(s.report_rows))
    .filter("section <> 'unused'")
    .select("repo_id", "section", "key", F.array_join("locations", "\n").alias("locations")),
    f"""{o.WITH_REPORT} SELECT repo_id, section, key, array_to_string(locations, chr(10)) AS locations
    FROM grouped WHERE section <> 'unused'""",
)
on_scan(
    "sort_keys",
    lambda s: report.sort_keys(s.ledger.filter("verdict = 'missing'").select("repo_id", "key")),
    f"{o.WITH_ALL} SELECT repo_id, key FROM verdicts WHERE verdict = 'missing' ORDER BY repo_id, key",
)
on_scan(
    "has_issues",
    lambda s: s.summary.select("repo_id", "has_issues"),
    f"{o.WITH_ALL} SELECT repo_id, missing + partial + unused > 0 AS has_issues FROM summary",
)
on_scan(
    "apply_report_flags",
    lambda s: drift.summarize(
        s.source_files.select("repo_id"), s.ledger, s.reported_groups, skip_unused=True, no_dynamic=True
    ),
    f"""{o.WITH_ALL} SELECT repo_id, missing, CAST(0 AS bigint) AS partial, CAST(0 AS bigint) AS unused,
           ignored_missing, ignored_from_folders, missing > 0 AS has_issues FROM summary""",
)

# ------------------------------------------------------------ scalar functions of the report

on_layout(
    "redact_value",
    lambda: [
        text.redact_value(
            F.left(
                F.concat(
                    F.when(F.col("id") % 3 == 0, F.col("k")).otherwise(F.lit("a=b")), F.lit("abcdefghijklmnopqrstuvwxyz")
                ),
                (F.col("id") % 24).cast("int"),
            )
        ).alias("redacted")
    ],
    f"""SELECT id, CASE WHEN s = '' THEN '""' WHEN length(s) > 20 THEN '[REDACTED]'
      WHEN length(s) > 10 AND contains(s, '=') THEN '[REDACTED]'
      WHEN length(s) > 4 THEN s[1:1] || '...' || s[-1:] ELSE '***' END AS redacted
    FROM (SELECT id, left(CASE WHEN id % 3 = 0 THEN k ELSE 'a=b' END || 'abcdefghijklmnopqrstuvwxyz',
                          CAST(id % 24 AS int)) AS s FROM ({o.LAYOUT}))""",
)
on_layout(
    "truncate_snippet",
    lambda: [text.truncate_snippet(F.repeat(F.col("static_text"), (F.col("id") % 5).cast("int"))).alias("snippet")],
    f"""SELECT id, CASE WHEN length(s) > 80 THEN left(s, 77) || '...' ELSE s END AS snippet
    FROM (SELECT id, repeat(static_text, id % 5) AS s FROM ({o.LAYOUT}))""",
)
on_layout(
    "format_location",
    lambda: [
        text.format_location(
            F.col("path"), F.col("static_line"), F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.col("static_text"))
        ).alias("location")
    ],
    f"""SELECT id, path || ':' || static_line || CASE WHEN id % 2 = 0 THEN '' ELSE ' (' || static_text || ')' END
    AS location FROM ({o.LAYOUT})""",
)
on_scan(
    "display_source",
    lambda s: report.display_unused(s.unused),
    f"{o.WITH_ALL} SELECT repo_id, key, coalesce(nullif(source_file, ''), '.env') AS source_file, {_REDACTED} FROM unused",
)
