import pytest
from pyspark.sql import functions as F

from keydrift.functions import yaml_nodes
from keydrift.functions.text import let
from keydrift.operators import definitions, yaml
from keydrift.sources.rules import RULES_FILE, exported_names, read_ignore_rules


@pytest.fixture(scope="module")
def parse(source):
    def run(path, content, extra=()):
        found = definitions.parse_definitions(definitions.select_env_files(source({path: content}), extra))
        return [(r.key, r.value) for r in found.orderBy("seq").collect()]

    return run


def test_dotenv(parse):
    content = '# comment\nAPI_KEY=abc\n\nDB_URL="postgres://x"\nEMPTY=\n  SPACED  =  \'v\'  \r\nexport A=1\nINLINE=x # y\nBROKEN\n=none\nEQ=a=b\n'
    assert parse(".env", content) == [
        ("API_KEY", "abc"), ("DB_URL", "postgres://x"), ("EMPTY", ""), ("SPACED", "v"), ("export A", "1"),
        ("INLINE", "x # y"), ("EQ", "a=b"),
    ]


@pytest.mark.parametrize("path", [".envrc", "setup.sh", "x.bash"])
def test_exports(parse, path):
    content = '#!/bin/bash\nexport A=1\n  export  B = "b c"\nLOCAL=2\n# export C=3\nexport 1D=4\nexport E=\'x\'; y\nexport F=\n'
    assert parse(path, content) == [("A", "1"), ("B", "b c"), ("E", "'x'; y"), ("F", "")]


def test_systemd(parse):
    content = '[Service]\nEnvironment=A=1\nEnvironment="B=b c"\n#Environment=C=1\nEnvironment = D = 2 \nEnvironment="E=1" "F=2"\nEnvironmentFile=/x=y\nEnvironment=G\n'
    assert parse("app.service", content) == [("A", "1"), ("B", "b c"), ("D", "2"), ("E", '1" "F=2')]


COMPOSE = """
name: shop
services:
  cart:
    restart: always
    environment: # read at start
      REGION: north   # of two
      SHARDS: "12"
      CACHE: memory://cart:0#lru
      UNSET:
      OFF: ~
      DEBUG: True
      LIMIT: 1_000
      MASK: 0x1F
      MODE: 010
      RATIO: 1.50
      SINCE: 2020-1-2
      MOTTO: 'it''s'
      BANNER: "a\\tb"
    labels:
      - "tier=front"
  mail:
    environment:
    - LANE=slow
    - "DELAY = 2"
    - BARE
    - CACHE=http://x:1/
    restart: never
  flow:
    environment: {P: 1, "R": "x, y"}
  flows:
    environment: ["K=1", L=2]
---
services: {z: {environment: {LATER: 1}}}
"""


def test_compose(parse):
    assert dict(parse("docker-compose.yml", COMPOSE)) == {
        "REGION": "north", "SHARDS": "12", "CACHE": "http://x:1/", "UNSET": "<nil>", "OFF": "<nil>", "DEBUG": "true",
        "LIMIT": "1000", "MASK": "31", "MODE": "8", "RATIO": "1.5", "SINCE": "2020-01-02 00:00:00 +0000 UTC", "MOTTO": "it's",
        "BANNER": "a\tb", "LANE": "slow", "DELAY": "2", "P": "1", "R": "x, y", "K": "1", "L": "2",
    }


def test_configmap(parse):
    content = "---\napiVersion: v1\nkind: ConfigMap\ndata:\n  A: https://x\n  N: 30\n  S: \"30\"\n  B: true\n  app.conf: |\n    a=b\n      c: d\n\n    # e\n  fold: >-\n    one\n    two\n"
    assert parse("configmap.yaml", content) == [
        ("A", "https://x"), ("S", "30"), ("app.conf", "a=b\n  c: d\n\n# e\n"), ("fold", "one two"),
    ]


def test_secret(parse):
    content = 'kind: Secret\ndata:\n  A: aGVsbG8=\n  B: aGk\n  C: "c2VjcmV0"\nstringData:\n  X: y\n'
    assert parse("my-secret.yml", content) == [("A", "hello"), ("B", "aGk"), ("C", "secret")]
    assert parse("my-secret.yml", "kind: Deployment\ndata:\n  A: x\n") == []


def test_invalid_yaml_gives_nothing(parse):
    assert parse("configmap.yml", "kind: ConfigMap\ndata:\n  A: x\n  A: y\n") == []
    assert parse("configmap.yml", "kind: ConfigMap\njust text\ndata:\n  A: x\n") == []
    assert parse("docker-compose.yml", "") == []
    # an alias without an anchor, or inside its own, a merge of what is no map, brackets left open
    for env in ("A: *ref\n      B: 1", "<<: *base\n      B: 1", "&e\n      A: *e", "<<: text\n      B: 1", "{A: 1", "A: b: c", "A: 'x' y", "A: @x"):
        assert parse("docker-compose.yml", f"services:\n  a:\n    environment:{' ' if env[0] in '&{' else chr(10) + ' ' * 6}{env}\n") == [], env


def test_anchors_aliases_and_merge_keys(parse):
    content = """
x-base: &base
  A: base
  B: base
x-more: &more {B: more, C: more}
x-all: &all
  <<: [*more, *base]
  D: all
name: &v 12
services:
  one:
    environment:
      <<: *base
      B: own
  two: &two
    environment: *all
  three:
    environment:
      E: *v
      "<<": quoted
  four:
    <<: *two
    image: x
  five:
    environment: &list
    - F=1
  six:
    environment: *list
"""
    got = parse("docker-compose.yml", content)
    assert got[:2] == [("B", "own"), ("A", "base")]
    assert sorted(got[2:6]) == [("A", "base"), ("B", "more"), ("C", "more"), ("D", "all")]
    assert got[6:8] == [("E", "12"), ("<<", "quoted")]
    assert sorted(got[8:]) == [("A", "base"), ("B", "more"), ("C", "more"), ("D", "all"), ("F", "1"), ("F", "1")]


def test_flow_collections_and_json(parse):
    want = [("G", "1"), ("H", "x, y"), ("I", "<nil>")]
    for text in (
        "services:\n  fl2: {environment: {G: 1, H: 'x, y', I}}\n",
        'services: {fl: {image: [a, {b: [c]}], environment: {"G":1,\n  "H":"x, y", # note\n  I: }}}\n',
        '{"services": {"a": {"environment": {"G": 1, "H": "x, y", "I": null}}}}',
        "services: {a: {environment: [G=1, 'H=x, y', I, {J: K=1}]}}",
    ):
        assert parse("docker-compose.yml", text) == (want if "[G=1" not in text else want[:2]), text
    assert parse("configmap.yml", '{"kind":"ConfigMap","data":{"A":"1","B":2,"C":{"D":"x"}}}') == [("A", "1")]


def test_scalars_over_lines_tags_and_explicit_keys(parse):
    content = """kind:
  ConfigMap
data:
  H: one
    two

    three # end
  ? K
  : v
  ? "L"
  P: !!str 5
  Q: !!int "6"
  R: !own text
  S: ! 7
  T: "a\\
      b
      c\\u0041"
  U: |2
     x
    y
  V: >
    f
    g

      h
    i
"""
    assert parse("configmap.yaml", content) == [
        ("H", "one two\nthree"), ("K", "v"), ("P", "5"), ("R", "text"), ("S", "7"), ("T", "ab cA"), ("U", " x\ny\n"),
        ("V", "f g\n\n  h\ni\n"),
    ]


def test_collections_as_values(parse):
    content = "x: &x {q: [1, ~]}\nservices:\n  a:\n    environment:\n      A: [1, two, [x=y]]\n      B: {z: 1, a: {k: v}}\n      C: *x\n      D: []\n  b:\n    environment:\n    - E=1\n    - [F=1]\n    - {G: H=1}\n"
    assert parse("docker-compose.yml", content) == [
        ("A", "[1 two [x=y]]"), ("B", "map[a:map[k:v] z:1]"), ("C", "map[q:[1 <nil>]]"), ("D", "[]"), ("E", "1"),
    ]


def test_keys_that_are_no_strings(parse):
    # a map with such a key is no map from names; the outermost one is read by name whatever its keys are
    env = "services:\n  a:\n    environment:\n      {}: 1\n      B: 2\n  b:\n    environment:\n      C: 3\n"
    assert parse("docker-compose.yml", env.format("12")) == [("C", "3")]
    assert parse("docker-compose.yml", env.format("true")) == [("C", "3")]
    assert parse("docker-compose.yml", env.format("'12'")) == [("12", "1"), ("B", "2"), ("C", "3")]
    assert parse("docker-compose.yml", "12: x\n" + env.format("yes")) == [("yes", "1"), ("B", "2"), ("C", "3")]
    assert parse("docker-compose.yml", env.format("[x]")) == []


def test_yaml_leaves_of_nested_lists(source):
    content = "a:\n  - name: x\n    env:\n      - k: v\n  - y\nb:\n- - 1\n  - - 2\n"
    rows = definitions.parse_block_yaml(source({"x.yml": content})).collect()
    assert [("/".join(r.yaml_path), r.value) for r in rows] == [("a/-/name", "x"), ("a/-/env/-/k", "v"), ("a/-", "y"), ("b/-/-", "1"), ("b/-/-/-", "2")]


def test_reading_grows_with_the_text():
    import time

    def seconds(text):
        start = time.perf_counter()
        found = yaml_nodes.leaves(text)
        return time.perf_counter() - start, len(found)

    shapes = {
        "lines": lambda n: "data:\n" + "".join(f"  k{i}: v\n" for i in range(n)),
        "items": lambda n: "a:\n" + "- x: 1\n  y: 2\n" * n,
        "flow": lambda n: "a: [" + "{b: c}, " * n + "]\n",
        "aliases": lambda n: "a: &a {x: 1}\nb:\n" + "- *a\n" * n + "".join(f"c{i}: 1\n" for i in range(n)),
        "continued": lambda n: "a: x\n" + "  y\n" * n,
        "comments": lambda n: "# c\n" * n + "a: 1\n",
        "block": lambda n: "a: |\n" + "  text\n" * n,
    }
    for name, shape in shapes.items():
        small, found = seconds(shape(16_000))
        large, _ = seconds(shape(64_000))
        assert found and large < 9 * small + 0.1 and large < 10, (name, small, large)
    assert yaml_nodes.leaves("a: " + "[" * 9_000 + "1" + "]" * 9_000)[0][0] == ["a"] + ["-"] * 9_000
    assert yaml_nodes.leaves("a: " + "[" * 11_000 + "1" + "]" * 11_000) == []
    # each line doubles what its alias stands for: a share of the document that is refused
    bomb = "a0: &a0 [x, x]\n" + "".join(f"a{i}: &a{i} [*a{i - 1}, *a{i - 1}]\n" for i in range(1, 40))
    assert yaml_nodes.leaves(bomb) == []


def test_whole_documents_against_a_library():
    library = pytest.importorskip("yaml")
    import random

    rng = random.Random(11)
    words = ["a b  c", "it's", 'say "x"', "a: b", "- x", "#no", "a #b", "x:", "[a", "{b", "*c", "&d", "!e", "%f", "@g", "a\\b", "é ü", "?", "-",
             "---", "...", " x", "x ", "\tx", "a\nb\n", "a\n\nb", "\n\nq", "a\n  b\nc\n", "0x1F", "|", ">", "<<", "k: [1]", "w " * 60]

    def value(depth):
        if depth == 0 or rng.random() < 0.4:
            return rng.choice(words)
        if rng.random() < 0.5:
            return [value(depth - 1) for _ in range(rng.randint(1, 4))]
        return {f"{rng.choice(words[:20])}{i}": value(depth - 1) for i in range(rng.randint(1, 4))}

    def flat(v, path=()):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from flat(x, (*path, k))
        elif isinstance(v, list):
            for x in v:
                yield from flat(x, (*path, "-"))
        else:
            yield (list(path), v)

    for _ in range(1500):
        tree = {f"r{i}": value(4) for i in range(2)}
        text = library.safe_dump(
            tree, default_flow_style=rng.choice([None, True, False]), width=rng.choice([20, 80]), indent=rng.choice([2, 4]),
            default_style=rng.choice([None, None, '"', "'", "|", ">"]), explicit_start=rng.random() < 0.2, sort_keys=False,
        )
        assert [leaf[:2] for leaf in yaml_nodes.leaves(text)] == [tuple(leaf) for leaf in flat(library.safe_load(text))], text


def test_long_line_rejects_the_whole_file(parse):
    assert parse(".env", "A=1\nB=" + "x" * 65_533) == [("A", "1"), ("B", "x" * 65_533)]
    assert parse(".env", "A=1\nB=" + "x" * 65_534) == []
    assert parse("run.sh", "export A=1\n#" + "x" * 65_535) == []
    assert parse("docker-compose.yml", "#" + "x" * 70_000 + "\nservices:\n  a:\n    environment:\n      A: 1\n") == [("A", "1")]


def test_which_files_and_in_what_order(source):
    names = [".env", ".env.local", "env.example", ".env.production", ".envrc", "run.sh", "a.service", "docker-compose.yml",
             "x-secret.yaml", "README", "sub/.env", "conf/prod.env", "settings.env", RULES_FILE]
    files = source({n: "" for n in names})

    def order(**kwargs):
        chosen = definitions.select_env_files(files, **kwargs)
        return [r.path for r in chosen.orderBy("load_tier", "load_pos", "path").collect()]

    detected = sorted([".env.production", ".envrc", "run.sh", "a.service", "docker-compose.yml", "x-secret.yaml", RULES_FILE])
    assert order() == [".env", ".env.local", "env.example", *detected]
    assert order(extra=["./conf/prod.env", "run.sh"])[3:5] == ["conf/prod.env", "run.sh"]
    assert order(extra=[".env"])[:3] == [".env.local", "env.example", ".env"]
    assert order(auto_detect=False) == [".env", ".env.local", "env.example"]


def test_last_definition_wins(source):
    tree = {
        ".env": "A=1\nB=1\nA=2\nC=1", ".env.local": "B=2", "env.example": "B=3", ".env.production": "C=9", ".envrc": "export D=1",
        ("other", ".env"): "A=other",
    }
    found = definitions.parse_definitions(definitions.select_env_files(source(tree)))
    merged = {(r.repo_id, r.key): (r.value, r.source_file) for r in definitions.merge_last_wins(found).collect()}
    assert merged == {
        ("r", "A"): ("2", ".env"), ("r", "B"): ("3", "env.example"), ("r", "C"): ("9", ".env.production"),
        ("r", "D"): ("1", ".envrc"), ("other", "A"): ("other", ".env"),
    }
    assert definitions.merge_values_only(found).columns == ["repo_id", "key", "value"]


def test_exported_names_fill_gaps_only(spark, source):
    found = definitions.parse_definitions(definitions.select_env_files(source({".env": "A=1"})))
    entries = spark.createDataFrame([("r", "A=x"), ("r", "B=s=t"), ("r", "B=again"), ("r", "NOEQ")], "repo_id string, entry string")
    names = exported_names(entries)
    assert names.columns == ["repo_id", "key"]  # values are never kept
    env = definitions.overlay_exported(found, names)
    assert {(r.key, r.value, r.source_file, r.from_file) for r in env.collect()} == {
        ("A", "1", ".env", True), ("B", "[from environment]", None, False),
    }
    assert [r.key for r in definitions.file_vars_only(env).collect()] == ["A"]


def test_ignore_rules(source):
    good = "# c\nignores:\n  missing:\n    - A\n    # - B\n    - 'C'\n  folders: [config, \"src/x\"]\nother:\n  - z\n"
    tree = {
        ("good", RULES_FILE): good, ("none", "a.js"): "", ("empty", RULES_FILE): "ignores:\n  missing:\n  folders:\n",
        ("bad", RULES_FILE): "ignores:\n  missing: A\n  folders:\n    - x\n", ("nested", "sub/" + RULES_FILE): good,
    }
    got = {(r.repo_id, r.kind, r.pattern) for r in read_ignore_rules(source(tree)).collect()}
    assert got == {("good", "missing", "A"), ("good", "missing", "C"), ("good", "folder", "config"), ("good", "folder", "src/x")}


def test_scalar_text_matches_typed_printing(spark):
    cases = {"-3": "-3", "+3": "3", "0b11": "3", "0o17": "15", "08": "8", "1e3": "1000", ".5": "0.5", "-0": "0", ".inf": "+Inf", "-.Inf": "-Inf", ".nan": "NaN", "FALSE": "false", "yes": "yes", "1.2.3": "1.2.3", "null": "<nil>", "1e40": "1e40", "0x" + "F" * 20: "0x" + "F" * 20, "9" * 30: "9" * 30}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r[0]: r[1] for r in df.select("v", yaml.scalar_text(F.col("v"), F.lit(False))).collect()}
    assert got == cases
    df = spark.createDataFrame([("kind: x",)], "content string")
    assert df.select(F.size(let(yaml.leaves(), lambda x: x))).first()[0] == 1


def test_line_formats_keep_other_separators(parse):
    assert parse(".envrc", "export A=x\u2028y\n") == [("A", "x\u2028y")]
    assert parse("app.service", "Environment=A=x\x85y\n") == [("A", "x\x85y")]
