import pytest
from pyspark.sql import functions as F

from keydrift.functions import accesses, languages
from keydrift.operators import files, usages


@pytest.fixture(scope="module")
def extract(source):
    def run(path, code):
        found = usages.extract_usages(files.code_files(source({path: code})))
        return [
            (r.line, r.key, "var_ref" if r.is_var_ref else "dynamic" if r.is_partial else "static")
            for r in found.orderBy("line", "key").collect()
        ]

    return run


STATIC = {
    "a.js": (
        "export function boot() {\n  if (process.env.NODE_REGION) start(process.env['QUEUE_URL']);\n  return { port: +process.env.HTTP_PORT };\n}\n",
        [(2, "NODE_REGION"), (2, "QUEUE_URL"), (3, "HTTP_PORT")],
    ),
    "a.ts": (
        'class Mailer {\n  private host = process.env.SMTP_HOST as string;\n  static from(): string { return process.env["SMTP_FROM"]!; }\n}\n',
        [(2, "SMTP_HOST"), (3, "SMTP_FROM")],
    ),
    "a.go": (
        'package cache\n\nfunc dial() (*Conn, error) {\n\tif dsn := os.Getenv("REDIS_DSN"); dsn != "" {\n\t\treturn open(dsn, os.Getenv("REDIS_TLS") == "1")\n\t}\n\treturn nil, nil\n}\n',
        [(4, "REDIS_DSN"), (5, "REDIS_TLS")],
    ),
    "a.py": (
        "import os\n\n\ndef workers():\n    count = int(os.environ[\"WORKERS\"])\n    return [os.getenv('WORKER_NAME')] * count if os.environ.get('SKIP') else []\n",
        [(5, "WORKERS"), (6, "WORKER_NAME")],
    ),
    "a.rs": (
        'fn limits() -> (String, Option<OsString>) {\n    let soft = env::var("SOFT_LIMIT").unwrap_or_default();\n    (soft, std::env::var_os("HARD_LIMIT"))\n}\n',
        [(2, "SOFT_LIMIT"), (3, "HARD_LIMIT")],
    ),
    "A.java": (
        'final class Places {\n    static Path home() {\n        return Path.of(System.getenv("DATA_HOME"), System.getenv().get("PROFILE"));\n    }\n    String d = System.getenv().getOrDefault("UNSEEN", "x");\n}\n',
        [(3, "DATA_HOME"), (3, "PROFILE")],
    ),
}


@pytest.mark.parametrize("path", STATIC)
def test_static(extract, path):
    code, expected = STATIC[path]
    assert extract(path, code) == [(line, key, "static") for line, key in expected]


DYNAMIC = {
    "a.js": (
        'for (const n of names) load(process.env["SHARD_" + n]);\nconst t = process.env[tier];\n\nuse(process.env[left + right], process.env[tenant + "_QUOTA"]);',
        [(1, "SHARD_", "dynamic"), (2, "tier", "var_ref"), (4, "_QUOTA", "dynamic"), (4, "left + right", "dynamic")],
    ),
    "a.go": (
        'for _, n := range names {\n\tload(os.Getenv(n))\n\tload(os.Getenv("SHARD_" + n), os.Getenv(tenant + "_QUOTA"))\n}',
        [(2, "n", "var_ref"), (3, '"SHARD_" + n', "dynamic"), (3, 'tenant + "_QUOTA"', "dynamic")],
    ),
    "a.py": (
        'quota = {t: os.environ[t + "_QUOTA"] for t in tenants}\nshard = os.getenv("SHARD_" + n)\nreturn os.environ[tier], os.getenv(zone)',
        [(1, 't + "_QUOTA"', "dynamic"), (2, '"SHARD_" + n', "dynamic"), (3, "tier", "var_ref"), (3, "zone", "var_ref")],
    ),
    "a.rs": (
        'names.iter().map(|n| env::var("SHARD_".to_owned() + n));\nlet z = std::env::var(zone);\nenv::var(tenant.clone() + "_QUOTA")',
        [(1, '"SHARD_".to_owned() + n', "dynamic"), (2, "zone", "var_ref"), (3, 'tenant.clone() + "_QUOTA"', "dynamic")],
    ),
    "A.java": (
        'String z = System.getenv(zone);\nreturn names.map(n -> System.getenv().get("SHARD_" + n));\nlog(System.getenv(tenant + "_QUOTA"));',
        [(1, "zone", "var_ref"), (2, '"SHARD_" + n', "dynamic"), (3, 'tenant + "_QUOTA"', "dynamic")],
    ),
}


@pytest.mark.parametrize("path", DYNAMIC)
def test_dynamic(extract, path):
    code, expected = DYNAMIC[path]
    assert extract(path, code) == expected


NOTHING = {
    "a.js": [
        "// process.env.A", "/* process.env.A\n*/", 's = "process.env.A"', "s = `process.env.A`", "foo.process.env.A",
        "myprocess.env.A", "process.env", "process.env[a ? 'b' : 'c']", "process.env[`A`]", "process.env[f(x)]",
        "process.env[true]", "process.env[this]", 'process.env[""]', "const {A} = process.env", "process.env[-a]", "`${x} {process.env.A}`",
    ],
    "a.go": ["os.Getenv(`A`)", 'os.LookupEnv("A")', 'x.os.Getenv("A")', '// os.Getenv("A")', '`os.Getenv("A")`', "os.Getenv(nil)", "os.Getenv('a')"],
    "a.py": ['# os.getenv("A")', '"""\nos.getenv("A")\n"""', 'os.getenv(a or "b")', 'os.getenv("A" "B")', "os.getenv(*a)", "os.getenv(default='x')", "os.getenv(None)", "os.getenv(a == b)", "my.os.getenv('A')"],
    "a.rs": ['env!("A")', 'foo::env::var("A")', '// env::var("A")', 'r#"env::var("A")"#', "env::var(&name)", 'env::var(format!("A"))', '/* a /* b */ env::var("A") */', 'crate::env::var("A")'],
    "A.java": ['java.lang.System.getenv("A")', "System.getenv()", '// System.getenv("A")', '"""\nSystem.getenv("A")\n"""', "System.getenv(null)"],
}


@pytest.mark.parametrize("path", NOTHING)
def test_nothing(source, path):
    tree = {(f"r{i}", path): code + "\n" for i, code in enumerate(NOTHING[path])}
    got = usages.extract_usages(files.code_files(source(tree))).select("repo_id", "key").collect()
    assert [(NOTHING[path][int(r.repo_id[1:])], r.key) for r in got] == []


def test_every_direct_argument_counts(extract):
    assert extract("a.py", 'os.getenv("PORT", "3000")') == [(1, "3000", "static"), (1, "PORT", "static")]
    assert extract("A.java", 'System.getenv("A").get("B")') == [(1, "A", "static"), (1, "B", "static")]


def test_line_of_the_key_and_its_snippet(source):
    code = "x = process\n  .env\n  .KEY; // end\n\nprocess.env[\n  // why\n  'LATE'\n];\n"
    got = usages.extract_usages(files.code_files(source({"src/a.js": code}))).orderBy("line").collect()
    assert [(r.file, r.key, r.line, r.code_snippet) for r in got] == [
        ("src/a.js", "KEY", 3, ".KEY; // end"),
        ("src/a.js", "LATE", 7, "'LATE'"),
    ]


def test_first_usage_of_a_line_wins(extract):
    assert extract("a.js", "process.env.K; process.env[K]; process.env.K\nprocess.env[K]; process.env.K") == [
        (1, "K", "static"),
        (2, "K", "var_ref"),
    ]


def test_holes_of_interpolated_strings(extract):
    js = 'x = `a ${process.env.T} it\'s ${process.env["U"]}`; y = process.env.V'
    assert [k for _, k, _ in extract("a.js", js)] == ["T", "U", "V"]
    py = "f\"{os.getenv('A')} it's {os.environ['B']}\" + os.getenv(\"C\")"
    assert [k for _, k, _ in extract("a.py", py)] == ["A", "B", "C"]


def test_more_syntax(extract):
    js = "f({...process.env.A}); process?.env?.B; process.env?.['C']; x.replace(/'/g, ''); process.env.D; process.env[g(\"]\") + 'E']"
    assert [(k, kind) for _, k, kind in extract("a.js", js)] == [
        ("A", "static"), ("B", "static"), ("C", "static"), ("D", "static"), ("]", "dynamic"),
    ]
    assert [k for _, k, _ in extract("a.go", "r := '\"'; os.Getenv(\"A\"); os.Getenv(a || b)")] == ["A", "a || b"]
    assert [k for _, k, _ in extract("a.py", 'os.environ[f"X_{a}"]')] == ['f"X_{a}"']
    assert [k for _, k, _ in extract("a.rs", "let c: &'a str = '\"'; env::var(\"A\")")] == ["A"]
    assert [k for _, k, _ in extract("A.java", 'System.getenv((String) o + "X")')] == ['(String) o + "X"']


def test_control_characters_in_the_source_do_no_harm(extract):
    assert extract("a.js", "\x01\x02\x03\x04process.env.A") == [(1, "A", "static")]


def test_whole_files_are_read(source):
    filler = "x = 'y'; // z\n" * 20_000
    got = usages.extract_usages(files.code_files(source({"a.js": filler + "process.env.LAST"}))).collect()
    assert [(r.key, r.line) for r in got] == [("LAST", 20_001)]


def test_long_literals_do_not_exhaust_the_matcher(extract):
    n = 100_000
    assert len(extract("a.py", "os.getenv(" + '"a" + ' * n + "b)")) == 1
    assert extract("a.js", '"' + "\\n" * n + '"; process.env.A') == [(1, "A", "static")]
    assert extract("a.go", "os.Getenv(" + "(a) + " * n + "b)")[0][2] == "dynamic"


def test_kinds_of_one_language(source):
    tree = files.code_files(source({"a.go": 'os.Getenv("A"); os.Getenv(b); os.Getenv(c + "d")', "b.py": "os.getenv('X')"}))
    for kind, key in (("static", "A"), ("var_ref", "b"), ("dynamic", 'c + "d"')):
        assert [r.key for r in usages.extract(tree, languages.GO, kind).collect()] == [key]
    assert {r.key for r in usages.static_keys(usages.extract_usages(tree)).collect()} == {"A", "X"}


def test_a_language_can_be_added_as_data(spark):
    from dataclasses import replace

    ruby = replace(languages.PYTHON, names=("ruby",), needles=(("ENV",),), bracketed=r"ENV~\[", template=None)
    df = spark.createDataFrame([("r", "a.rb", "ruby", "ENV['A']\n# ENV['B']")], "repo_id string, path string, language string, content string")
    assert [r.key for r in usages.extract_usages(df, (ruby,)).collect()] == ["A"]


def test_extraction_does_not_shuffle(source):
    plan = usages.extract_usages(files.code_files(source({"a.js": "process.env.A"})))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_holes_hold_any_code(extract):
    js = {
        "x = `${cond ? {a: 1} : process.env.B}`": [(1, "B")],
        "`${\n process.env.C\n}`": [(2, "C")],
        "`${y.map(z => { return process.env.D })}`": [(1, "D")],
        "`${'" + "x" * 5000 + "' + process.env.E}`": [(1, "E")],
        "`a ${`b ${process.env.F} }`} ${process.env.G}` + process.env.H": [(1, "F"), (1, "G"), (1, "H")],
        "`\\${process.env.NO} ${process.env.I}`": [(1, "I")],
        "`${'}'}` + process.env.J": [(1, "J")],
        "`${" * 200 + "process.env.DEEP" + "}`" * 200: [(1, "DEEP")],
    }
    for code, keys in js.items():
        assert [(line, k) for line, k, _ in extract("a.js", code)] == keys, code
    py = {
        "f\"{x} {{os.getenv('A')}}\"": [],
        'f"{ {1: os.environ["D"]}[1]:{os.getenv("W")}}"': ["D", "W"],
        'f"""{\nos.getenv("M")\n}""" + rf"\\{os.getenv("N")}"': ["M", "N"],
        "f'{f\"{os.getenv(key)}\"}'": ["key"],
        "'{os.getenv(1)}' + f'{{}}' + os.getenv('Q')": ["Q"],
    }
    for code, keys in py.items():
        assert [k for _, k, _ in extract("a.py", code)] == keys, code


@pytest.mark.parametrize("depth", [1, 4, 50, 200, 20_000])
def test_brackets_of_any_depth(extract, depth):
    inner, ends = "f(" * depth, ")" * depth
    assert extract("a.go", f'os.Getenv({inner}"A"{ends} + "B")') == [(1, f'{inner}"A"{ends} + "B"', "dynamic")]
    assert extract("a.go", f'{inner}os.Getenv("A"){ends}') == [(1, "A", "static")]
    assert extract("a.rs", f"let x = {'[' * depth}env::var(name){']' * depth};") == [(1, "name", "var_ref")]


def test_accesses_in_arguments_of_accesses(extract):
    assert extract("a.go", 'os.Getenv(f(os.Getenv("A")) + "B")') == [(1, "A", "static"), (1, 'f(os.Getenv("A")) + "B"', "dynamic")]
    assert extract("a.js", "process.env[process.env[x]]") == [(1, "x", "var_ref")]
    assert extract("A.java", 'System.getenv().get(System.getenv("A"))') == [(1, "A", "static")]


def test_slashes_and_elements(extract):
    cases = {
        "const a = <p>don't {process.env.A} it's</p>; process.env.B": ["A", "B"],
        "return <><b c='{' d={process.env.C}/>// no comment {`'${process.env.D}`}</>": ["C", "D"],
        "if (x) /'/.test(process.env.E)": ["E"],
        "a = (b) / c; s = 'x/y'; process.env.F": ["F"],
        "a++ / 2; process.env.G // '": ["G"],
        "function f() {}\n/'/.test(process.env.H)": ["H"],
        "x = {} / process.env.I; y = '/'": ["I"],
        "const f = <T>(x: T) => x; const s = \"don't\"; process.env.J": ["J"],
        "const f = <T extends U>(x: T) => x; process.env.K": ["K"],
        "if (a < b && c > d) process.env.L; s = '</b>'": ["L"],
        "`${/`}/.test(process.env.M)}`": ["M"],
    }
    for code, keys in cases.items():
        assert [k for _, k, _ in extract("a.tsx", code)] == keys, code


def test_comments(extract):
    # an expression's text is what stands between its first and last token
    assert extract("a.js", "process.env[/* x */ a /* c */ + b // d\n]") == [(1, "a /* c */ + b", "dynamic")]
    assert extract("a.rs", '/* a /* b /* c */ */ env::var("A") */ env::var(/* ( */ "B")') == [(1, "B", "static")]
    assert extract("a.go", "/* never closed os.Getenv(\"A\")") == []


def test_a_long_line_is_held_once(source):
    """2 MB on one line with 400 accesses: each row carries it, the file's array does not."""
    line = "".join(f'x("{"y" * 5000}", process.env.K{n}); ' for n in range(400))
    found = usages.extract_usages(files.code_files(source({"a.js": line})))
    got = found.agg(F.count_distinct("key"), F.min(F.length("code_snippet")), F.max(F.length("code_snippet"))).first()
    assert tuple(got) == (400, len(line) - 1, len(line) - 1)


def test_work_grows_with_the_text():
    """Twice the text takes at most about twice the time, whatever is nested or left open."""
    import time

    from keydrift.functions.accesses import placed

    def seconds(code, rule):
        best = []
        for _ in range(3):
            start = time.perf_counter()
            placed(code, rule, " ")
            best.append(time.perf_counter() - start)
        return min(best)

    shapes = {
        "open quotes": ('"', "process.env.A"), "open brackets": ("f(", "process.env.A"), "open comments": ("/* ", "process.env.A"),
        "closers": (")", "process.env.A"), "slashes": ("a / ", "process.env.A"), "elements": ("<a>", "process.env.A"),
        "templates": ("`${", "process.env.A"), "accesses": ("process.env[a + ", "b"), "lines": ("process.env.A;\n", ""),
    }
    for name, (piece, end) in shapes.items():
        n = 20_000 if name != "accesses" else 400
        small, large = seconds(piece * n + end, languages.JAVASCRIPT), seconds(piece * 4 * n + end, languages.JAVASCRIPT)
        # nested accesses that are operands return the text of each: that output alone is quadratic
        assert large < (24 if name == "accesses" else 9) * small + 0.05, (name, small, large)


def test_literals_and_comments_outside_are_passed_over_at_once(monkeypatch):
    """What no argument holds costs no step of the scan, whatever its number."""
    steps = []
    code = accesses._Scan.code
    monkeypatch.setattr(accesses._Scan, "code", lambda scan, pos: steps.append(pos) or code(scan, pos))
    for rule, access in ((languages.JAVASCRIPT, 'process.env["A"]'), (languages.GO, 'os.Getenv("A")'), (languages.JAVA, 'System.getenv("A")')):
        steps.clear()
        text = 'let x = "filler"; // more\n' * 500 + f"/* c */ /a'b/ \n{access}; // last"
        found = accesses.accesses(text, rule)
        assert [(expr, key) for _, expr, _, key, _ in found] == [('"A"', True)] and len(steps) < 20, rule.names
