"""Expected results in DuckDB SQL, computed from columns and never from text."""

from __future__ import annotations

from keydrift.corpus.columns import CUSTOMERS, LAYOUT, ORDER_CONFIGS, key
from keydrift.sources.rules import RULES_FILE

K = {n: key(f"c + {n}") for n in (0, 3, 5, 6, 9, 12, 13, 15, 16, 18, 30, 40, 41)}

# Files under a directory that is never scanned do not appear.
FILES = f"""
files AS (SELECT * FROM ({LAYOUT}) WHERE dir <> 'node_modules/x' AND language <> 'unknown')
"""

# A repository's rules by the number its customer has; 'r0' is customer 0.
RULES = f"""
customers AS ({CUSTOMERS}),
rules AS (
  SELECT repo_id, 'missing' AS kind, {K[0]} AS pattern FROM customers
  UNION ALL SELECT repo_id, 'missing', {K[40]} FROM customers
  UNION ALL SELECT repo_id, 'missing', {K[41]} FROM customers
  UNION ALL SELECT repo_id, 'folder', 'gen' FROM customers WHERE rule_no = 0
  UNION ALL SELECT repo_id, 'folder', 'legacy/*' FROM customers WHERE rule_no = 0
  UNION ALL SELECT repo_id, 'folder', 'legacy/conf' FROM customers WHERE rule_no = 1
  UNION ALL SELECT repo_id, 'folder', 'src/f' FROM customers WHERE rule_no = 3
)
"""

# Scanned files after the folder rules.
SCANNED = """
scanned AS (
  SELECT f.*, dir = 'legacy/conf' AND coalesce(rule_no IN (0, 1), false) AS in_ignored_path
  FROM files f LEFT JOIN customers USING (repo_id)
  WHERE NOT (dir = 'gen/y' AND coalesce(rule_no = 0, false))
)
"""


def usages_of(files: str, extra: str = "") -> str:
    """One row per usage of a table of files; ``extra`` names more columns to keep."""
    js = "language IN ('javascript', 'typescript')"
    head = f"repo_id, path AS file, language{extra}"
    return f"""
  SELECT {head}, k AS key, static_line AS line, static_text AS code_snippet,
         false AS is_partial, false AS is_var_ref, '' AS full_expr FROM {files}
  UNION ALL
  SELECT {head}, CASE WHEN {js} THEN prefix ELSE expr END, dynamic_line, dynamic_text, true, false, expr
  FROM {files} WHERE has_dynamic
  UNION ALL
  SELECT {head}, name, var_ref_line, var_ref_text, true, true, '' FROM {files} WHERE has_var_ref
  UNION ALL
  SELECT {head}, k2, late_line, late_text, false, false, '' FROM {files} WHERE has_late
"""


RAW_USAGES = f"WITH {FILES}, usages AS ({usages_of('files')})"

# All definitions in load order: path, tier, pos, seq as the engine numbers them.
DEFINITIONS = f"""
configs AS ({ORDER_CONFIGS}),
compose AS (SELECT * FROM customers WHERE has_compose),
defs AS (
  SELECT repo_id, '.env' AS path, 'env' AS file_type, 0 AS load_tier, 0 AS load_pos, 2 AS seq, {K[0]} AS key, seg AS value
  FROM customers
  UNION ALL SELECT repo_id, '.env', 'env', 0, 0, 4, {K[3]}, seg || ' one' FROM customers
  UNION ALL SELECT repo_id, '.env', 'env', 0, 0, 5, 'export ' || {K[5]}, 'x' FROM customers
  UNION ALL SELECT repo_id, '.env.local', 'env', 0, 1, 1, {K[3]}, 'local' FROM customers WHERE has_local
  UNION ALL SELECT repo_id, '.env.local', 'env', 0, 1, 2, {K[6]}, 'l' || c FROM customers WHERE has_local
  UNION ALL SELECT repo_id, 'env.example', 'env', 0, 2, 1, {K[9]}, 'example' FROM customers WHERE has_example
  UNION ALL SELECT repo_id, 'env.example', 'env', 0, 2, 2, {K[6]}, 'example' FROM customers WHERE has_example
  UNION ALL SELECT repo_id, '.envrc', 'envrc', 1, 0, 1, {K[12]}, 'rc' || c FROM customers WHERE has_envrc
  UNION ALL SELECT repo_id, 'docker-compose.yml', 'docker-compose', 1, 0, 1, {K[15]}, seg FROM compose
  UNION ALL SELECT repo_id, 'docker-compose.yml', 'docker-compose', 1, 0, 2, {K[16]}, CAST(c AS string) FROM compose
  UNION ALL SELECT repo_id, 'docker-compose.yml', 'docker-compose', 1, 0, 3, {K[18]}, 'j' || c FROM compose
  UNION ALL
  SELECT repo_id, config_path,
         ['env', 'shell', 'systemd', 'k8s', 'k8s', 'docker-compose'][form + 1], 1, 0,
         CASE form WHEN 5 THEN [0, 2, 2, 0, 0, 1, 4][variant + 1] ELSE [1, 2, 2, 1, 1][form + 1] END, a, value FROM configs
  UNION ALL
  SELECT repo_id, config_path,
         ['env', 'shell', 'systemd', 'k8s', 'k8s', 'docker-compose'][form + 1], 1, 0,
         CASE form WHEN 5 THEN [1, 3, 3, 1, 1, 2, 5][variant + 1] ELSE [2, 3, 3, 2, 2][form + 1] END, b,
         CASE form WHEN 3 THEN CAST(id AS string) WHEN 4 THEN 'not base64' WHEN 5 THEN '<nil>' ELSE value END
  FROM configs
)
"""

EXPORTED = f"""
exported AS (
  SELECT repo_id, {K[30]} AS key FROM customers WHERE c % 2 = 1
  UNION SELECT repo_id, k FROM ({LAYOUT}) WHERE id % 16 = 5
)
"""

ENV = """
file_env AS (
  SELECT repo_id, key, value, path AS source_file FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, key
      ORDER BY load_tier DESC, load_pos DESC, path DESC, seq DESC) AS rn FROM defs) WHERE rn = 1
),
env AS (
  SELECT repo_id, key, value, source_file, true AS from_file FROM file_env
  UNION ALL
  SELECT repo_id, key, '[from environment]', NULL, false FROM exported e
  WHERE NOT EXISTS (SELECT 1 FROM file_env f WHERE f.repo_id = e.repo_id AND f.key = e.key)
)
"""

USAGES = f"usages AS ({usages_of('scanned', ', in_ignored_path')})"

PROFILE = """
profile AS (
  SELECT repo_id, key, count(*) AS n_usages, count(*) FILTER (NOT in_ignored_path) AS n_outside
  FROM usages WHERE NOT is_partial GROUP BY ALL
)
"""

VERDICTS = """
candidates AS (SELECT * FROM profile p WHERE NOT EXISTS (
  SELECT 1 FROM env e WHERE e.repo_id = p.repo_id AND e.key = p.key)),
verdicts AS (
  SELECT *, CASE WHEN n_outside = 0 THEN 'ignored_folder'
                 WHEN EXISTS (SELECT 1 FROM rules r WHERE r.kind = 'missing' AND r.repo_id = c.repo_id
                              AND r.pattern = c.key) THEN 'ignored_key'
                 ELSE 'missing' END AS verdict FROM candidates c
),
missing AS (
  SELECT u.repo_id, u.key, file, line, code_snippet FROM usages u
  JOIN verdicts v ON v.repo_id = u.repo_id AND v.key = u.key AND v.verdict = 'missing'
  WHERE NOT is_partial AND NOT in_ignored_path
),
groups AS (
  SELECT repo_id, coalesce(nullif(full_expr, ''), key) AS group_key, bool_or(is_var_ref) AS is_var_ref,
         count(*) AS n_usages
  FROM usages WHERE is_partial GROUP BY ALL
),
reported AS (
  SELECT * FROM groups g WHERE is_var_ref OR NOT EXISTS (
    SELECT 1 FROM env e WHERE e.repo_id = g.repo_id AND contains(e.key, g.group_key))
),
partials AS (
  SELECT u.repo_id, r.group_key AS key, file, line, code_snippet, r.is_var_ref FROM usages u
  JOIN reported r ON r.repo_id = u.repo_id AND r.group_key = coalesce(nullif(u.full_expr, ''), u.key)
  WHERE is_partial
),
unused AS (
  SELECT repo_id, key, value, source_file FROM file_env e WHERE NOT EXISTS (
    SELECT 1 FROM usages u WHERE NOT is_partial AND u.repo_id = e.repo_id AND u.key = e.key)
),
repos AS (SELECT repo_id FROM customers UNION SELECT repo_id FROM files UNION SELECT repo_id FROM configs),
summary AS (
  SELECT repo_id,
         (SELECT count(*) FROM verdicts v WHERE v.repo_id = r.repo_id AND verdict = 'missing') AS missing,
         (SELECT count(*) FROM reported v WHERE v.repo_id = r.repo_id) AS partial,
         (SELECT count(*) FROM unused v WHERE v.repo_id = r.repo_id) AS unused,
         (SELECT count(*) FROM verdicts v WHERE v.repo_id = r.repo_id AND verdict = 'ignored_key') AS ignored_missing,
         (SELECT count(*) FROM verdicts v WHERE v.repo_id = r.repo_id AND verdict = 'ignored_folder')
           AS ignored_from_folders
  FROM repos r
)
"""

REPORT = """
lines AS (
  SELECT repo_id, 'missing' AS section, key, file || ':' || line || ' (' || code_snippet || ')' AS location FROM missing
  UNION ALL
  SELECT repo_id, 'partial_matches', key, file || ':' || line || ' (' || code_snippet || ')' FROM partials
  UNION ALL SELECT repo_id, 'unused', key, NULL FROM unused
),
grouped AS (
  SELECT repo_id, section, key, list(location ORDER BY location) FILTER (location IS NOT NULL) AS locations
  FROM lines GROUP BY ALL
)
"""

WITH_FILES = f"WITH {RULES}, {FILES}, {SCANNED}, {USAGES}"
WITH_DEFS = f"WITH {RULES}, {DEFINITIONS}, {EXPORTED}, {ENV}"
WITH_ALL = f"WITH {RULES}, {FILES}, {SCANNED}, {USAGES}, {DEFINITIONS}, {EXPORTED}, {ENV}, {PROFILE}, {VERDICTS}"
WITH_REPORT = f"{WITH_ALL}, {REPORT}"
