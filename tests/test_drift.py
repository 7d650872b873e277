import base64
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from keydrift.operators import drift, files, report, skew
from keydrift.plans.scan import DriftScan, ScanOptions
from keydrift.sources.rules import RULES_FILE

USAGE = "repo_id string, file string, line int, key string, code_snippet string, in_ignored_path boolean, is_partial boolean, is_var_ref boolean, full_expr string"


@pytest.fixture(scope="module")
def scan(spark, source):
    def run(tree, exported=(), **options):
        names = spark.createDataFrame([("r", n) for n in exported], "repo_id string, key string")
        return DriftScan(source(tree), names, options=ScanOptions(**options))

    return run


def keys(df):
    return sorted({r.key for r in df.collect()})


# A storefront with a queue worker.
APP = {
    "web/cart.ts": "const currency = process.env.CURRENCY;\nexport const total = () => tax(process.env.TAX_TABLE, currency);\nconst flags = process.env.FEATURE_FLAGS;\n",
    "worker/run.py": "import os\n\nwhile True:\n    poll(os.environ['CURRENCY'], os.getenv('POLL_SECONDS'))\n    archive(os.getenv('TAX_TABLE'))\n",
    "vendor/lib/i.py": "os.getenv('HIDDEN')",
    "notes.txt": "process.env.TEXT",
}


def test_without_definitions_everything_is_missing(scan):
    s = scan(APP)
    assert keys(s.missing) == ["CURRENCY", "FEATURE_FLAGS", "POLL_SECONDS", "TAX_TABLE"]
    assert s.missing.count() == 6
    row = s.summary.first()
    assert (row.missing, row.partial, row.unused, row.ignored_missing, row.ignored_from_folders, row.has_issues) == (4, 0, 0, 0, 0, True)
    counts = {(r.language, r.n_files) for r in files.count_files_by_language(s.scanned_files).collect()}
    assert counts == {("ts", 1), ("python", 1)}


def test_missing_unused_and_clean(scan):
    s = scan({**APP, ".env": "CURRENCY=k\nTAX_TABLE=u\nOLD=12345\n", ".env.local": "POLL_SECONDS=\n"})
    assert keys(s.missing) == ["FEATURE_FLAGS"]
    assert [tuple(r) for r in report.display_unused(s.unused).collect()] == [("r", "OLD", "1...5", ".env")]
    clean = scan({"a.js": "process.env.A", ".env": "A=1"})
    assert not clean.summary.first().has_issues
    assert clean.json_report.first().report == (
        '{"missing":[],"partial_matches":[],"unused":[],"ignored_missing":0,"ignored_from_folders":0}'
    )


def test_exported_names_are_not_missing_nor_unused(scan):
    tree = {"Build.java": 'String s = System.getenv("STAGE") + System.getenv("RUNNER_ID");\nint n = size(System.getenv("POOL"));\n'}
    assert keys(scan(tree).missing) == ["POOL", "RUNNER_ID", "STAGE"]
    s = scan(tree, exported=["RUNNER_ID", "SHELL"])
    assert keys(s.missing) == ["POOL", "STAGE"]
    assert s.unused.count() == 0


# One service whose generated part is not to be reported.
IGNORES = {
    "svc/api.py": "import os\nserve(os.getenv('BIND'), os.getenv('TRACE_ID'), os.getenv('SPAN_ID'))\n",
    "generated/stub.rs": 'let a = env::var("BIND");\nlet b = env::var("WIRE_FORMAT");\nlet c = (env::var("SCHEMA"), env::var(name));\n',
}


@pytest.mark.parametrize(
    ("folder", "from_folders", "bind_usages"),
    [("generated", 0, 1), ("generated/*", 2, 1), ("generated/stub.rs", 2, 1), ("generated/", 0, 2), ("other/x", 0, 2)],
)
def test_ignore_rules(scan, folder, from_folders, bind_usages):
    rules = f"ignores:\n  missing:\n    - TRACE_ID\n    - SPAN_ID\n  folders:\n    - {folder}\n"
    s = scan({**IGNORES, RULES_FILE: rules})
    row = s.summary.first()
    assert row.ignored_missing == 2
    assert row.ignored_from_folders == from_folders
    seen = ["BIND"] if folder.startswith("generated") and folder != "generated/" else ["BIND", "SCHEMA", "WIRE_FORMAT"]
    assert keys(s.missing) == seen
    assert s.missing.filter("key = 'BIND'").count() == bind_usages
    # dynamic usages are not filtered by ignored paths, only by pruned directories
    assert row.partial == (0 if folder == "generated" else 1)


def test_ignored_folder_counts_before_ignored_key(scan):
    rules = "ignores:\n  missing:\n    - SCHEMA\n  folders:\n    - generated/*\n"
    row = scan({**IGNORES, RULES_FILE: rules}).summary.first()
    assert (row.ignored_missing, row.ignored_from_folders) == (0, 2)


def test_usage_in_ignored_path_still_counts_as_use(scan):
    rules = "ignores:\n  folders:\n    - generated/*\n"
    s = scan({**IGNORES, RULES_FILE: rules, ".env": "WIRE_FORMAT=1\nX=1\n"})
    assert keys(s.unused) == ["X"]


MANY_FORMATS = {
    "src/main.js": "".join(f"process.env.{k};\n" for k in "ENV_A SVC_PORT K8S_URL SECRET_TOKEN DB_HOST QUEUE SH_VAR RC_VAR NONE".split()),
    ".env": "ENV_A=1\n",
    "app.service": '[Service]\nEnvironment=SVC_PORT=1\nEnvironment="SVC_LOG=x"\n',
    "configmap.yaml": "kind: ConfigMap\ndata:\n  K8S_URL: u\n  K8S_TIMEOUT: \"30\"\n",
    "secret.yaml": "kind: Secret\ndata:\n  SECRET_TOKEN: aGk=\n",
    "docker-compose.yml": "services:\n  a:\n    environment:\n      DB_HOST: h\n      REDIS: r\n  b:\n    environment:\n      - QUEUE=q\n",
    "setup.sh": "export SH_VAR=1\nLOCAL=1\n",
    ".envrc": "export RC_VAR=1\n",
}


def test_all_formats_together(scan):
    s = scan(MANY_FORMATS)
    assert keys(s.missing) == ["NONE"]
    assert keys(s.unused) == ["K8S_TIMEOUT", "REDIS", "SVC_LOG"]


def test_flags(scan):
    tree = {"a.js": "process.env[x]", ".env": "OLD=1"}
    full = scan(tree).summary.first()
    assert (full.partial, full.unused, full.has_issues) == (1, 1, True)
    s = scan(tree, skip_unused=True, no_dynamic=True)
    row = s.summary.first()
    assert (row.partial, row.unused, row.has_issues) == (0, 0, False)
    assert s.report_rows.count() == 0
    assert s.json_report.first().report.startswith('{"missing":[],"partial_matches":[],"unused":[]')


def test_globs(scan):
    tree = {"a.js": "process.env.A", "b.go": 'os.Getenv("B")', "s/c.py": "os.getenv('C')"}
    assert keys(scan(tree, exclude=("*.go",)).missing) == ["A", "C"]
    assert keys(scan(tree, include=("*.go",), exclude=("*.go",)).missing) == ["B"]


def test_json_report_orders_keys_and_locations(scan):
    code = "\nprocess.env.B" + "\n" * 8 + "process.env.B\nprocess.env.A"
    got = scan({"x.js": code, ".env": "Z=1\nY=1"}).json_report.first().report
    assert got == (
        '{"missing":[{"key":"A","locations":["x.js:11 (process.env.A)"]},'
        '{"key":"B","locations":["x.js:10 (process.env.B)","x.js:2 (process.env.B)"]}],'
        '"partial_matches":[],"unused":["Y","Z"],"ignored_missing":0,"ignored_from_folders":0}'
    )


def test_large_report_is_split_and_whole(spark, scan):
    tree = {f"f{i}.js": "process.env.HOT;\nprocess.env.K%d;\n" % i for i in range(40)}
    s = scan(tree, rows_per_document=10)
    docs = s.json_report.collect()
    assert len(docs) == 8 and len({d.part for d in docs}) == 8
    import json

    places = [loc for d in docs for m in json.loads(d.report)["missing"] for loc in m["locations"]]
    assert len(places) == 80 and len(set(places)) == 80


def test_json_sink(spark, scan, tmp_path):
    path = str(tmp_path / "report")
    report.write_json(scan(APP).json_report, path)
    assert '"key":"FEATURE_FLAGS"' in spark.read.text(path).first()[0]
    report.write_json(scan(APP).json_lines, path)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert len(lines) == 7 and '{"repo_id":"r","section":"summary","ignored_missing":0,"ignored_from_folders":0}' in lines


# ------------------------------------------------------------ single operators


def usage(key, file="a.js", line=1, ignored=False, partial=False, var_ref=False, expr="", repo="r"):
    return (repo, file, line, key, f"use {key}", ignored, partial, var_ref, expr)


def test_partial_contains(spark):
    rows = [
        usage("MY_", partial=True), usage("NOPE_", partial=True), usage("v", partial=True, var_ref=True),
        usage("x", partial=True, expr='"A" + b'), usage("MY_", partial=True, repo="s"), usage("a.b", partial=True),
    ]
    usages = spark.createDataFrame(rows, USAGE)
    env = spark.createDataFrame([("r", "MY_VAR"), ("r", "v_LONG"), ("r", 'x"A" + bc'), ("r", "za.bz")], "repo_id string, key string")
    groups = drift.partial_groups(usages)
    assert sorted((r.repo_id, r.group_key) for r in drift.partial_contains(groups, env).collect()) == [("r", "NOPE_"), ("s", "MY_")]
    reported = drift.reported_groups(groups, env)
    got = drift.partial_matches(usages, reported).collect()
    assert sorted((r.repo_id, r.key, r.is_var_ref) for r in got) == [("r", "NOPE_", False), ("r", "v", True), ("s", "MY_", False)]


def test_containment_agrees_with_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab_.+ é") for _ in range(n))
    names = {("r%d" % rng.randrange(3), word(rng.randrange(1, 90))) for _ in range(300)}
    groups = {("r%d" % rng.randrange(3), word(rng.randrange(1, 6))) for _ in range(200)}
    for repo, name in list(names)[:100]:  # certain hits of any length
        start = rng.randrange(len(name))
        groups.add((repo, name[start : start + rng.randrange(1, 80)]))
    env = spark.createDataFrame(sorted(names), "repo_id string, key string")
    df = spark.createDataFrame(sorted(groups), "repo_id string, group_key string")
    got = {(r.repo_id, r.group_key) for r in drift.contained_groups(df, env).collect()}
    assert got == {g for g in groups if any(g[0] == n[0] and g[1] in n[1] for n in names)}


def test_count_ignored_in_list(spark):
    keys_ = spark.createDataFrame([("r", "A"), ("r", "A"), ("r", "B"), ("s", "A")], "repo_id string, key string")
    rules = spark.createDataFrame([("r", "missing", "A"), ("r", "missing", "A"), ("r", "folder", "B")], "repo_id string, kind string, pattern string")
    assert [tuple(r) for r in drift.count_ignored_in_list(keys_, rules).collect()] == [("r", 2)]


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    many = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id"
    )
    one = many.select("key").distinct().filter("key <> 'k1'").withColumn("x", F.length("key"))
    counts = many.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.hot_groups(counts, ["key"], hot_rows=100)
    assert [r._parts for r in hot.collect()] == [10]
    for how in ("left_semi", "left", "inner", "left_anti"):
        got = skew.spread_join(many, one, ["key"], how, ["id"], hot)
        want = many.join(one, ["key"], how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_results_do_not_depend_on_partitioning(spark, source):
    tree = {**MANY_FORMATS, **APP, **IGNORES}
    none = spark.createDataFrame([], "repo_id string, key string")
    results = []
    for n in (1, 7):
        s = DriftScan(source(tree).orderBy(F.rand(n)).repartition(n), none)
        results.append(sorted(map(tuple, s.report_rows.collect()), key=str))
    assert results[0] == results[1]


def test_reading_counts_skips_contents(scan):
    plan = files.count_files_by_language(scan(APP).scanned_files)
    assert "content" not in plan._jdf.queryExecution().optimizedPlan().toString().split("LocalRelation")[0].split("Join")[0]


def assembled(fragments):
    """Each repository's fragments, one after the other."""
    found = {}
    for r in fragments.orderBy("part", "seq").collect():
        found[r.repo_id] = found.get(r.repo_id, "") + r.text + "\n"
    return found


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_fragments_are_the_nested_report(spark, scan, parts):
    lines = "\n".join(f'process.env.K{k % 7}; process.env["P{k % 3}_" + v]; process.env[n{k % 2}]' for k in range(60))
    tree = {
        ("big", "a.js"): lines, ("big", 'q"uote\\.js'): "process.env.K1 // \"x\" \\ é", ("big", ".env"): "\n".join(f"U{k}=1" for k in range(40)),
        ("clean", "b.js"): "process.env.A", ("clean", ".env"): "A=1", ("partial", "c.py"): "os.getenv(x + 'y')", ("unused", ".env"): "B=1\nC=2",
        ("unused", RULES_FILE): "ignores:\n  missing: [GONE]\n", ("unused", "d.js"): "process.env.GONE",
    }
    s = scan(tree)
    want = {r.repo_id: json.loads(r.report) for r in s.json_report.collect()}
    rows = report.sorted_parts(s.report_rows, s.summary, s.staging.stage, parts)
    got = assembled(report.json_fragments(rows))
    assert {k: json.loads(v) for k, v in got.items()} == want
    # the same text, too, but for the line breaks between fragments
    assert {k: v.replace("\n", "") for k, v in got.items()} == {r.repo_id: r.report for r in s.json_report.collect()}


def test_documents_are_written_with_a_manifest(spark, scan, tmp_path):
    tree = {(f"r{k}", "a.js"): "process.env.A; process.env[b]\n" * (1 + 40 * (k == 3)) for k in range(6)}
    s = scan(tree)
    rows = report.sorted_parts(s.report_rows, s.summary, s.staging.stage, 5)
    report.write_documents(report.json_fragments(rows), str(tmp_path / "out"))
    manifest = spark.read.parquet(str(tmp_path / "out" / "manifest")).collect()
    files = sorted((tmp_path / "out" / "documents").glob("part=*"), key=lambda p: int(p.name.split("=")[1]))
    lines = {int(p.name.split("=")[1]): "".join(f.read_text() for f in sorted(p.glob("part-*"))).splitlines() for p in files}
    want = {r.repo_id: json.loads(r.report) for r in s.json_report.collect()}
    assert {r.repo_id for r in manifest} == set(want)
    for r in manifest:
        text = []
        for part in range(r.first_part, r.last_part + 1):
            own = lines.get(part, [])
            text += own[r.first_line if part == r.first_part else 0 : r.last_line + 1 if part == r.last_part else None]
        assert json.loads("\n".join(text)) == want[r.repo_id]
        assert len(text) == r.lines and sum(len(t.encode()) + 1 for t in text) == r.bytes


def test_no_value_is_written_in_clear_and_nothing_stays(spark, source):
    import os

    secret, plain = "decoded-hunter2-secret", "postgres://user:pass@host/db"
    tree = {
        "a.js": "process.env.USED", ".env": f"USED={plain}\nOLD={plain}\n",
        "x-secret.yml": f"kind: Secret\ndata:\n  S: {base64.b64encode(secret.encode()).decode()}\n",
    }
    with DriftScan(source(tree), spark.createDataFrame([], "repo_id string, key string")) as s:
        assert keys(s.unused) == ["OLD", "S"] and "value" not in s.unused.columns
        for result in (s.missing, s.partial_matches, s.summary, s.json_report, s.json_lines, s.json_fragments, s.unused):
            text = str(result.collect())
            assert secret not in text and plain not in text
        folder = s.staging.path
        tables = sorted(os.listdir(folder))
        assert {t.split("-")[0] for t in tables} == {"found", "usages", "env", "ledger", "groups", "report", "sorted"}
        for t in tables:
            text = str(spark.read.parquet(f"{folder}/{t}").collect())
            assert secret not in text and plain not in text, t
    assert not os.path.exists(folder)


def test_a_key_is_looked_up_by_its_rarest_gram(spark):
    """Names with one long prefix: the candidates of a key are about its hits."""
    names = [f"PAYMENT_SERVICE_{k:05d}_URL" for k in range(3000)]
    groups = [("r", "SERVICE_00042"), ("r", "PAYMENT_SERVICE_01234_URL"), ("r", "PAYMENT_SERVICE_X"), ("r", "02999_U"), ("r", "_SERVICE_")]
    env = spark.createDataFrame([("r", n) for n in names], "repo_id string, key string")
    df = spark.createDataFrame([(*g, False) for g in groups], "repo_id string, group_key string, is_var_ref boolean")
    found = {r.group_key for r in drift.contained_groups(df, env).collect()}
    assert found == {"SERVICE_00042", "PAYMENT_SERVICE_01234_URL", "02999_U", "_SERVICE_"}
    grams = env.select("repo_id", F.explode(drift._grams(F.col("key"), ".")).alias("gram")).groupBy("gram").count()
    probes = df.select("group_key", F.explode(drift._probes(F.col("group_key"), ".")).alias("gram")).join(grams, "gram", "left")
    fewest = {r.group_key: r.n for r in probes.groupBy("group_key").agg(F.min(F.coalesce("count", F.lit(0))).alias("n")).collect()}
    assert fewest["PAYMENT_SERVICE_X"] == 0 and fewest["SERVICE_00042"] <= 10 and fewest["PAYMENT_SERVICE_01234_URL"] <= 10


@pytest.mark.parametrize("names", [1, 50_000])
def test_containment_in_parts(spark, monkeypatch, names):
    monkeypatch.setattr(drift, "PART_NAMES", names)
    rnd = random.Random(4)
    env = {("r" if k % 3 else "s", "".join(rnd.choice("ABc_-.") for _ in range(rnd.randrange(1, 12)))) for k in range(300)}
    groups = {("r" if k % 2 else "s", "".join(rnd.choice("ABc_-. ") for _ in range(rnd.randrange(1, 6)))) for k in range(300)}
    df = spark.createDataFrame([(*g, False) for g in groups], "repo_id string, group_key string, is_var_ref boolean")
    found = {(r.repo_id, r.group_key) for r in drift.contained_groups(df, spark.createDataFrame(list(env), "repo_id string, key string")).collect()}
    assert found == {(repo, g) for repo, g in groups if any(r == repo and g in n for r, n in env)}


def test_containment_plans_each_step_once(spark, tmp_path):
    """Tables with several readers are written, so what is left to plan stays small; names give grams of needed sizes only."""
    env = spark.createDataFrame([("r", "MY_VAR"), ("r", "a.b.c"), ("s", "MY_VAR"), (None, "MY_VAR")], "repo_id string, key string")
    groups = [("r", "Y_VA", False), ("r", ".b", False), ("r", "b", True), ("s", ".b", False), ("s", "", False), (None, "VAR", False), ("s", None, False)]
    df = spark.createDataFrame(groups, "repo_id string, group_key string, is_var_ref boolean")
    written = {}

    def stage(table, name):
        assert name not in written
        written[name] = str(tmp_path / name)
        table.write.parquet(written[name])
        return spark.read.parquet(written[name])

    open_groups = drift.partial_contains(df, env, stage)
    plan = open_groups._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 8 and "regexp" not in plan
    left = lambda rows: sorted((tuple(r) for r in rows.collect()), key=str)
    assert left(open_groups) == left(drift.partial_contains(df, env))
    assert ("r", "Y_VA", False) not in left(open_groups) and ("s", ".b", False) in left(open_groups)
    grams = {(r.repo_id, r.name, r.gram) for r in spark.read.parquet(written["grams"]).collect()}
    assert {g for r, n, g in grams if n == "MY_VAR" and r == "r"} == {"MY_V", "Y_VA", "_VAR"} and not any(r == "s" and n == "MY_VAR" for r, n, g in grams)


def test_rules_files_are_parsed_once(spark, source):
    tree = {".envdrift.config": "ignores:\n  missing:\n    - A\n  folders:\n    - gen/x\n", "gen/x/a.js": "process.env.B", "a.js": "process.env.A"}
    with DriftScan(source(tree), spark.createDataFrame([], "repo_id string, key string")) as s:
        assert [(r.ignored_missing, r.ignored_from_folders) for r in s.summary.collect()] == [(1, 1)]
        assert {(r.path, r.in_ignored_path) for r in s.scanned_files.collect()} == {("a.js", False), ("gen/x/a.js", True)}
        folder = s.lookups.path
        assert sum(t.startswith("rules-") for t in os.listdir(folder)) == 1
    assert not os.path.exists(folder)
