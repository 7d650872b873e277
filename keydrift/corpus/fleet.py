"""``source_files`` and exported names derived from ``orders`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keydrift.corpus.columns import CUSTOMERS, LAYOUT, ORDER_CONFIGS, key
from keydrift.plans.staging import Staging
from keydrift.sources.rules import RULES_FILE, exported_names
from keydrift.sources.trees import write_corpus

_CODE = r"""
SELECT repo_id, path,
       concat(
         remark, opening, '"NOPE"', closing, '\n',
         repeat('let x = "filler text"; // more of it\n', CAST(pad AS int)),
         static_text, '\n',
         CASE WHEN has_dynamic THEN concat(dynamic_text, '\n') ELSE '' END,
         CASE WHEN has_var_ref THEN concat('  ', var_ref_text, '\n') ELSE '' END,
         CASE WHEN has_late THEN concat('let m = ', CASE WHEN holed THEN concat('`$', chr(123)) ELSE '' END, opening, '\n  ', late_text, '\n')
              ELSE '' END,
         'let t = "', opening, '\'NOPE\'', closing, '";\n'
       ) AS content
FROM ({layout})
"""

_CUSTOMER_FILES = r"""
SELECT repo_id, inline(filter(array(
  named_struct('path', '.env', 'content', concat(
    '# settings\n', {k0}, '=', seg, '\n\n  ', {k3}, ' = "', seg, ' one"  \n',
    'export ', {k5}, '=x\nnot a setting\n=nothing\n')),
  named_struct('path', '.env.local', 'content', concat({k3}, '=local\n', {k6}, '=\'l', c, '\'\n')),
  named_struct('path', 'env.example', 'content', concat({k9}, '=example\n', {k6}, '=example\n')),
  named_struct('path', '.envrc', 'content', concat('export ', {k12}, '="rc', c, '"\n', {k13}, '=plain\n')),
  named_struct('path', 'docker-compose.yml', 'content', concat(
    'services:\n  web:\n    image: "x"\n    environment:\n      ', {k15}, ': ', seg, '  # note\n      ', {k16}, ': ', c,
    '\n  job:\n    environment:\n    - ', {k18}, '=j', c, '\n    - NO_VALUE\n    ports:\n      - "80:80"\n')),
  named_struct('path', '{rules_file}', 'content', concat(
    '# rules\nignores:\n  missing:\n    - ', {k0}, '\n    - ', {k40}, '\n    - ', {k41}, '\n  folders:\n',
    CASE rule_no WHEN 0 THEN '    - gen\n    - legacy/*\n' WHEN 1 THEN '    - legacy/conf\n' WHEN 3 THEN '    - src/f\n'
         ELSE '' END)),
  named_struct('path', 'docs/.env', 'content', 'NESTED=1\n')
), f -> CASE f.path WHEN '.env.local' THEN has_local WHEN 'env.example' THEN has_example WHEN '.envrc' THEN has_envrc
                    WHEN 'docker-compose.yml' THEN has_compose ELSE true END))
FROM ({customers})
"""

_ORDER_CONFIGS = r"""
SELECT repo_id, config_path AS path, CASE form
  WHEN 0 THEN concat(a, '=', value, '\n', b, '=`', value, '`\n')
  WHEN 1 THEN concat('#!/bin/bash\nexport ', a, '=', value, '\n  export ', b, '="', value, '"\nLOCAL=1\n')
  WHEN 2 THEN concat('[Service]\nEnvironment=', a, '=', value, '\nEnvironment="', b, '=', value, '"\nUser=app\n')
  WHEN 3 THEN CASE variant
    WHEN 1 THEN concat('kind:\n  ConfigMap\ndata:\n  ? ', a, '\n  : ', value, '\n  ', b, ': !!str ', id, '\n  NUMBER: !!int "', id, '"\n')
    WHEN 2 THEN concat({json_map}, '"kind": "ConfigMap",\n "data": ', {json_map}, '"', a, '": "', value, '", "', b, '": "', id, '", "NUMBER": ', id, {json_end}, {json_end})
    WHEN 3 THEN concat('kind: &k ConfigMap # kind\ndata: !!map\n  ', a, ':\n    ', value, '\n  ', b, ": '", id, "'\n  NUMBER: ", id, '\n')
    ELSE concat('kind: ConfigMap\ndata:\n  ', a, ': ', value, '\n  ', b, ': "', id, '"\n  NUMBER: ', id, '\n') END
  WHEN 4 THEN concat('kind: Secret\ndata:\n  ', a, ': ', base64(encode(value, 'UTF-8')), '\n  ', b, ': "not base64"\n')
  ELSE CASE variant
    WHEN 1 THEN concat('x-env: &e\n  ', a, ': "', value, '"\n  ', b, ':\nservices:\n  app:\n    environment:\n      <<: *e\n')
    WHEN 2 THEN concat('x-env: &e\n  ', a, ': ', value, '\n  ', b, ': ~\nservices:\n  app:\n    environment: *e\n')
    WHEN 3 THEN concat({json_map}, '"services": ', {json_map}, '"app":', {json_map}, '"environment":\n', {json_map}, '"', a, '":"', value, '", "', b,
                       '": null', {json_end}, {json_end}, {json_end}, {json_end})
    WHEN 4 THEN concat('services: ', {json_map}, 'app: ', {json_map}, 'environment: ', {json_map}, a, ': ', value, ',\n  ', b, ': ', {json_end},
                       {json_end}, {json_end}, '\n')
    WHEN 5 THEN concat('x-v: &v ', value, '\nservices:\n  app:\n    environment:\n      ', a, ': *v\n      ', b, ': null\n')
    WHEN 6 THEN concat('x: &x ', {json_map}, a, ': wrong, ', b, ': ', {json_end}, '\ny: &y ', {json_map}, a, ': worse, ', b, ': bad', {json_end},
                       '\nservices:\n  app:\n    environment:\n      <<: [*x, *y]\n      ', a, ': ', value, '\n')
    ELSE concat('services:\n  app:\n    environment:\n      ', a, ': "', value, '"\n      ', b, ':\n') END END AS content
FROM ({configs})
"""


def _views(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("orders", "customer")) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Run SQL over the tables passed as arguments, without registering views."""
    tables = {t: df for t, df in _views(spark, sf_dir).items() if f"FROM {t}" in query}
    for t in tables:
        query = query.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(query, **tables)


def _braces(query: str, **parts: str) -> str:
    for name, text in parts.items():
        query = query.replace("{" + name + "}", text)
    return query


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LAYOUT)


def code_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _braces(_CODE, layout=LAYOUT))


def config_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {f"k{n}": key(f"c + {n}") for n in (0, 3, 5, 6, 9, 12, 13, 15, 16, 18, 40, 41)}
    fixed = _braces(_CUSTOMER_FILES, customers=CUSTOMERS, rules_file=RULES_FILE, **keys)
    by_order = _braces(_ORDER_CONFIGS, configs=ORDER_CONFIGS, json_map="chr(123)", json_end="chr(125)")
    return _sql(spark, sf_dir, fixed).unionByName(_sql(spark, sf_dir, by_order))


_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derive a table once per session and read the written copy from then on."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _written:
        path = Staging(spark, f"fleet-{name}").path
        # small benchmark tables are one file each: spread what is derived from them
        rows = build(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
        if name == "source_files":
            write_corpus(rows, path)
        else:
            rows.write.parquet(path)
        _written[at] = path
    return spark.read.parquet(_written[at])


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_part(spark, sf_dir).unionByName(config_part(spark, sf_dir))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "source_files", _source_files)


def _exported_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, entry ``NAME=value``, as a process environment lists them."""
    by_customer = f"SELECT repo_id, {key('c + 30')} || '=secret' AS entry FROM ({CUSTOMERS}) c WHERE c % 2 = 1"
    by_order = f"SELECT repo_id, k || '=' || v AS entry FROM ({LAYOUT}) f WHERE id % 16 = 5"
    return _sql(spark, sf_dir, by_customer).unionByName(_sql(spark, sf_dir, by_order))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported_names(_once(spark, sf_dir, "exported", _exported_entries))
