import fnmatch

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keydrift.functions import accesses, languages, paths, text


def test_redact_value(evaluate):
    cases = {
        "": '""',
        "abcd": "***",
        "abcde": "a...e",
        "abcdefghij": "a...j",
        "a=cdefghij": "a...j",
        "abcdefghijk": "a...k",
        "a=cdefghijk": "[REDACTED]",
        "ab/defghijk": "[REDACTED]",
        "ab+defghijk": "[REDACTED]",
        "a" * 20: "a...a",
        "a" * 21: "[REDACTED]",
        "é" * 11: "[REDACTED]",  # 22 bytes
        "éabé": "Ã...©",  # outer bytes, each shown as one character
    }
    assert evaluate(text.redact_value(F.col("s")), cases) == list(cases.values())


def test_truncate_snippet(evaluate):
    values = ["a" * 80, "a" * 81, "a" * 76 + "é" + "b" * 10]
    assert evaluate(text.truncate_snippet(F.col("s")), values) == ["a" * 80, "a" * 77 + "...", "a" * 76 + "�..."]


def test_trim_quotes(evaluate):
    cases = {'"test"': "test", "'test'": "test", "`test`": "test", "test": "test", "": "", '"test': '"test', 'test"': 'test"', '"': '"', '""': ""}
    assert evaluate(text.trim_quotes_code(F.col("s")), cases) == list(cases.values())
    assert evaluate(text.trim_quotes_code(F.col("s")), [' "x" ']) == [' "x" ']
    assert evaluate(text.trim_quotes_env(F.col("s")), ['\t "x"  ', "　'y'"]) == ["x", "y"]


def test_first_and_last_string(evaluate):
    cases = {
        '"prefix_" + var': ("prefix_", "prefix_"),
        "'prefix_' + var": ("prefix_", "prefix_"),
        "`prefix_` + var": ("prefix_", "prefix_"),
        'var + "_suffix"': ("_suffix", "_suffix"),
        '"a" + x + \'b\'': ("a", "b"),
        "var + other": ("", ""),
        "": ("", ""),
        "\"it's\" + x": ("it's", "it's"),
    }
    assert evaluate(text.first_string(F.col("s")), cases) == [a for a, _ in cases.values()]
    assert evaluate(text.last_string(F.col("s")), cases) == [b for _, b in cases.values()]


def test_decode_base64(evaluate):
    cases = {"aGVsbG8=": "hello", "aGk=": "hi", "aGk": "aGk", "not base64": "not base64", "aGVs\nbG8=": "hello", "": ""}
    assert evaluate(text.decode_base64(F.col("s")), cases) == list(cases.values())


def test_format_location(spark):
    df = spark.createDataFrame([("a.js", 3, "x"), ("b.js", 4, "")], "f string, l int, s string")
    got = df.select(text.format_location(F.col("f"), F.col("l"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["a.js:3 (x)", "b.js:4"]


def test_detect_language(evaluate):
    cases = {
        "a.js": "javascript", "a.jsx": "javascript", "a.mjs": "javascript", "a.ts": "typescript", "a.tsx": "typescript",
        "d/a.GO": "go", "a.py": "python", "a.rs": "rust", "A.java": "java", "a.txt": "unknown", "go": "unknown",
        "a.js/b": "unknown", ".js": "javascript", "a.test.ts": "typescript", "a.": "unknown",
    }
    assert evaluate(paths.detect_language(F.col("s")), cases) == list(cases.values())


def test_detect_file_type(evaluate):
    cases = {
        ".envrc": "envrc", ".env": "env", ".env.prod": "env", ".envrc.bak": "env", "docker-compose.yml": "docker-compose",
        "docker-compose.prod.yaml": "docker-compose", "docker-compose": "env", "app-configmap.yaml": "k8s",
        "my-secret.yml": "k8s", "secrets.yaml": "k8s", "secret.sh": "shell", "configmap.json": "env", "a.service": "systemd",
        "run.sh": "shell", "run.bash": "shell", "README": "env", "d/.envrc": "envrc",
    }
    assert evaluate(paths.detect_file_type(F.col("s")), cases) == list(cases.values())


def test_pruned_dirs(evaluate):
    cases = {"node_modules/a.js": True, "x/vendor/y/a.go": True, "vendor": False, "src/a.js": False, "my_vendor/a.go": False, "build": False, "a/.git/x": True}
    assert evaluate(paths.in_pruned_dir(F.col("s")), cases) == list(cases.values())
    assert len(paths.PRUNED_DIRS) == 41


def test_ancestors(evaluate):
    assert evaluate(paths.ancestors(F.col("s")), ["a/b/c.js", "x.py"]) == [["a", "a/b", "a/b/c.js"], ["x.py"]]


def test_relativize(spark):
    rows = [("/root/src/a.js", "/root"), ("/root/a.js", "/root/"), ("/rooted/a.js", "/root")]
    df = spark.createDataFrame(rows, "p string, r string")
    got = [r[0] for r in df.select(paths.relativize(F.col("p"), F.col("r"))).collect()]
    assert got == ["src/a.js", "a.js", "a.js"]


@pytest.mark.parametrize(
    ("globs", "path", "expected"),
    [
        (["*.go"], "src/a.go", True),
        (["src/*.go"], "src/a.go", False),  # the full path starts at the root
        (["/src/*.go"], "src/a.go", True),
        (["/*.go"], "src/a.go", False),  # '*' stops at '/'
        (["a?.js"], "x/ab.js", True),
        (["[a-c].js"], "b.js", True),
        (["[^a-c].js"], "b.js", False),
        (["\\*.js"], "*.js", True),
        (["[a.js", "*.py"], "[a.js", False),  # malformed: no match
        (["a.b"], "axb", False),
    ],
)
def test_globs(evaluate, globs, path, expected):
    assert evaluate(paths.matches_globs(F.col("s"), globs, "/"), [path]) == [expected]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ab*?.", min_size=1, max_size=6), st.text("ab.", min_size=1, max_size=6))
def test_glob_regex_agrees_with_fnmatch(glob, name):
    import re

    assert bool(re.match(paths.glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob)


def test_literals_and_comments_are_passed_over_at_once():
    text = 'let x = "a"; // b\n' * 50 + "let y = process.env.KEY; /* c */ /['\"]/.test(process.env['Z'])"
    assert accesses._patterns(languages.JAVASCRIPT)["over code"].match(text).end() == text.index("process.env.KEY")
    assert [a[1] for a in accesses.accesses(text, languages.JAVASCRIPT)] == ["KEY", "'Z'"]
