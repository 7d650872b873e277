"""SQL fragments that read the same in Spark and in DuckDB.

Every order is one file of code and some orders are a config file too; every
customer is one repository with its fixed-name config files. A third of the
orders belong to repository ``r0``, so one repository is always hot. What a file
says is a function of its row's columns: the engine has to recover it from the
text, the oracle computes it from the columns.
"""


def pick(choices: str, index: str, separator: str = "|") -> str:
    """Entry ``index`` (from 0) of a separated list."""
    return f"split_part('{choices}', '{separator}', CAST({index} AS int) + 1)"


def key(n: str) -> str:
    """Name of variable number ``n`` modulo 60."""
    m = f"(({n}) % 60)"
    return f"({pick('DB|API|CACHE|QUEUE|MAIL', f'({m} % 5)')} || '_' || CAST({m} AS string))"


# By language number, then parity of the order key.
_OPENINGS = (
    "process.env[|process.env[|process.env[|process.env[|os.Getenv(|os.Getenv(|os.environ[|os.getenv(|"
    "std::env::var(|env::var_os(|System.getenv().get(|System.getenv(|System.getenv(|System.getenv("
)
_CLOSINGS = "]|]|]|]|)|)|]|)|)|)|)|)|)|)"
_EXTENSIONS = ".js|.MJS|.tsx|.tsx|.go|.go|.py|.py|.rs|.rs|.java|.java|.txt|.txt"

ORDER_FILES = f"""
SELECT o.*, {key("n")} AS k, {key("n + 7")} AS k2, 'PRE' || CAST(n AS string) || '_' AS prefix,
       'v' || CAST(id % 3 AS string) AS v, 'name' || CAST(id % 4 AS string) AS name
FROM (
  SELECT o_orderkey AS id, (o_orderkey - o_orderkey % 8) AS id8,
         CASE WHEN o_orderkey % 3 = 0 THEN 'r0' ELSE 'r' || CAST(o_custkey AS string) END AS repo_id,
         (o_custkey + o_orderkey) % 60 AS n,
         o_orderkey % 7 AS lang_no, (o_orderkey % 7) * 2 + o_orderkey % 2 AS form_no,
         {pick("javascript|typescript|go|python|rust|java|unknown", "(o_orderkey % 7)")} AS language,
         CASE WHEN o_orderkey % 29 = 0 THEN 'node_modules/x' WHEN o_orderkey % 31 = 0 THEN 'gen/y'
              WHEN o_orderstatus = 'P' THEN 'legacy/conf' ELSE 'src' END AS dir,
         o_custkey % 20 AS pad,
         o_orderkey % 5 = 0 AS has_dynamic, o_orderkey % 11 = 0 AS has_var_ref, o_orderkey % 13 = 0 AS has_late
  FROM orders
) o
"""

# Extension, bracket texts, comment start and the lines of each access, from ORDER_FILES.
LAYOUT = f"""
SELECT f.*,
       dir || '/f' || CAST(id AS string) || ext AS path,
       CAST(pad + 2 AS int) AS static_line,
       CAST(pad + 3 AS int) AS dynamic_line,
       CAST(pad + 3 + CASE WHEN has_dynamic THEN 1 ELSE 0 END AS int) AS var_ref_line,
       -- the key of the last access stands on the line below its start
       CAST(pad + 4 + CASE WHEN has_dynamic THEN 1 ELSE 0 END + CASE WHEN has_var_ref THEN 1 ELSE 0 END AS int)
         AS late_line,
       'let s = ' || before || access || behind || ';' AS static_text,
       'let d = ' || opening || expr || closing || ';' AS dynamic_text,
       'let r = ' || opening || name || closing || ';' AS var_ref_text,
       '"' || k2 || '"' || closing || CASE WHEN holed THEN chr(125) || '`' ELSE '' END || ';' AS late_text
FROM (
  SELECT h.*,
         CASE WHEN lang_no < 2 AND id % 2 = 0 THEN 'process.env.' || k ELSE opening || '"' || k || '"' || closing END AS access,
         '"' || prefix || '" + ' || CASE WHEN id % 17 = 5 THEN repeat('g(', depth) || v || repeat(')', depth) ELSE v END AS expr,
         -- a call's brackets, a hole, an element's text, a regular expression: what an access may stand in
         CASE form WHEN 'calls' THEN repeat('f(', depth) WHEN 'hole' THEN '`a $' || chr(123) || 'c ? ' || chr(123) || 'b: 1' || chr(125) || ' : '
                   WHEN 'element' THEN '<p>don' || chr(39) || 't ' || chr(123) WHEN 'regex' THEN '/[' || chr(39) || '"`]/.test('
                   WHEN 'f-string' THEN 'f' || repeat('"', 3) || 'it' || chr(39) || 's ' || chr(123) || ' [1, ' ELSE '' END AS before,
         CASE form WHEN 'calls' THEN repeat(')', depth) WHEN 'hole' THEN chr(125) || ' it' || chr(39) || 's`'
                   WHEN 'element' THEN chr(125) || ' it' || chr(39) || 's</p>' WHEN 'regex' THEN ')'
                   WHEN 'f-string' THEN ']' || chr(125) || repeat('"', 3) ELSE '' END AS behind
FROM (
  SELECT g.*,
         CAST(id % 201 AS int) AS depth,
         CASE WHEN id % 17 = 3 THEN 'calls' WHEN lang_no < 2 AND id % 5 = 1 THEN 'hole' WHEN lang_no < 2 AND id % 5 = 2 THEN 'element'
              WHEN lang_no < 2 AND id % 5 = 3 THEN 'regex' WHEN lang_no = 3 AND id % 5 = 1 THEN 'f-string' ELSE 'plain' END AS form,
         lang_no < 2 AND id % 5 = 0 AS holed,
         {pick(_EXTENSIONS, "form_no")} AS ext,
         {pick(_OPENINGS, "form_no")} AS opening,
         {pick(_CLOSINGS, "form_no")} AS closing,
         CASE WHEN lang_no = 3 THEN '# ' ELSE '// ' END AS remark
  FROM ({ORDER_FILES}) g
) h
) f
"""

# Config files of a customer's repository: who has which.
CUSTOMERS = """
SELECT c_custkey AS c, 'r' || CAST(c_custkey AS string) AS repo_id, c_mktsegment AS seg,
       c_custkey % 2 = 0 AS has_local, c_custkey % 3 = 0 AS has_example, c_custkey % 4 = 1 AS has_envrc,
       c_custkey % 5 = 0 AS has_compose, c_custkey % 4 AS rule_no
FROM customer
"""

# Orders that are config files too: format by 'form', one file each.
ORDER_CONFIGS = f"""
SELECT h.*, {key("n + 20")} AS a, {key("n + 23")} AS b, 'v' || CAST(id AS string) AS value, id % 7 AS variant,
       CASE form WHEN 0 THEN '.env.o' || CAST(id AS string)
                 WHEN 1 THEN 'o' || CAST(id AS string) || '.sh'
                 WHEN 2 THEN 'o' || CAST(id AS string) || '.service'
                 WHEN 3 THEN 'o' || CAST(id AS string) || '-configmap.yaml'
                 WHEN 4 THEN 'o' || CAST(id AS string) || '-secret.yml'
                 ELSE 'docker-compose.o' || CAST(id AS string) || '.yml' END AS config_path
FROM (
  SELECT id, repo_id, n, CAST(id8 / 8 AS bigint) % 6 AS form FROM ({ORDER_FILES}) f0 WHERE id % 8 = 3
) h
"""
