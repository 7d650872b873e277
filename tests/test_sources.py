import os

from keydrift.plans.scan import DriftScan
from keydrift.sources import trees


def write(root, files):
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


def test_trees_with_hidden_files(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    write(one, {".env": "A=1", "_priv/__init__.py": "import os\nos.getenv('A')", "a/b/c/d/e.go": 'os.Getenv("B")', "node_modules/x.js": "process.env.N", "a/.git/x.js": "process.env.N", "note.txt": "x"})
    write(two, {"x.js": b"process.env.\xff; process.env.C", "sub/.env": "C=1"})
    roots = spark.createDataFrame([("one", one), ("two", two)], "repo_id string, root string")
    listed = trees.list_trees(roots)
    assert {(r.repo_id, r.path) for r in listed.collect()} == {
        ("one", ".env"), ("one", "_priv/__init__.py"), ("one", "a/b/c/d/e.go"), ("one", "note.txt"), ("two", "x.js"), ("two", "sub/.env"),
    }
    wanted = trees.wanted(listed)
    assert {r.path for r in wanted.collect()} == {".env", "_priv/__init__.py", "a/b/c/d/e.go", "x.js"}
    stored = str(tmp_path / "corpus")
    trees.write_corpus(trees.read_contents(wanted), stored)
    corpus = spark.read.parquet(stored)
    s = DriftScan(corpus, spark.createDataFrame([], "repo_id string, key string"))
    assert {(r.repo_id, r.key) for r in s.missing.collect()} == {("one", "B"), ("two", "C")}
    config = s.env_files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(area" in config


def test_rounds_of_listing_do_not_matter(spark, tmp_path):
    write(str(tmp_path), {"a.js": "", "d/b.js": "", "d/e/c.js": "", "d/e/f/g.js": "", "d/vendor/h.js": "", "i/j/k/l/m.js": ""})
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo_id string, root string")
    expected = ["a.js", "d/b.js", "d/e/c.js", "d/e/f/g.js", "i/j/k/l/m.js"]
    for first, most in ((1, 1), (2, 3), (1000, 1000)):
        assert sorted(r.path for r in trees.list_trees(roots, first, most).collect()) == expected


def test_chains_and_bushes_go_in_rounds(spark, tmp_path):
    chain = "/".join(["c"] * 600)
    write(str(tmp_path), {f"{chain}/end.py": "", **{f"bush/{k}/{k}.py": "" for k in range(900)}})
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo_id string, root string")
    listed = trees.list_trees(roots, 50, 400)
    assert {r.path for r in listed.collect()} == {f"{chain}/end.py", *(f"bush/{k}/{k}.py" for k in range(900))}


def test_a_task_lists_no_more_than_its_share(tmp_path):
    import pandas as pd

    for k in range(30):
        (tmp_path / str(k) / "x").mkdir(parents=True)
    batch = pd.DataFrame([("r", str(tmp_path), "", True)], columns=["repo_id", "root", "path", "is_dir"])
    found = pd.concat(trees._expand(11, frozenset())(iter([batch])))
    # the root and ten of its folders are listed: twenty of those, and ten one level below, are left
    assert found["is_dir"].sum() == 30 and len(found) == 30


def test_rules_files_that_cannot_be_read_are_told(source):
    from keydrift.sources.rules import RULES_FILE, rules_problems

    tree = {
        ("good", RULES_FILE): "ignores:\n  missing: [A]\n", ("empty", RULES_FILE): "# nothing\n---\n", ("none", "a.js"): "",
        ("nulls", RULES_FILE): "ignores:\n  missing:\n  folders: ~\n", ("text", RULES_FILE): "ignores:\n  missing: A\n",
        ("bad", RULES_FILE): "ignores:\n  missing: [A\n",
    }
    got = {(r.repo_id, r.reason) for r in rules_problems(source(tree)).collect()}
    assert got == {("text", "a list is expected below 'ignores'"), ("bad", "no valid YAML")}


def test_one_bad_root_or_folder_fails_nothing_else(spark, tmp_path):
    good = tmp_path / "good"
    (good / "a" / "b" / "c" / "d").mkdir(parents=True)
    (good / "a" / "b" / "c" / "d" / "deep.py").write_text("os.getenv('DEEP')")
    (good / "gone.js").symlink_to(tmp_path / "nowhere")
    roots = spark.createDataFrame([("good", str(good)), ("missing", str(tmp_path / "missing"))], "repo_id string, root string")
    listed = trees.list_trees(roots)
    assert {(r.repo_id, r.path) for r in listed.collect()} == {("good", "a/b/c/d/deep.py"), ("good", "gone.js")}
    assert [r.path for r in trees.read_contents(listed).collect()] == ["a/b/c/d/deep.py"]
    found = {(r.repo_id, r.path, r.reason) for r in trees.problems(roots, listed).collect()}
    assert found == {("missing", "", "No such file or directory"), ("good", "gone.js", "No such file or directory")}


def test_a_stored_corpus_is_pruned_by_language(spark, source, tmp_path):
    from keydrift.functions import languages
    from keydrift.operators import files, usages

    path = str(tmp_path / "corpus")
    trees.write_corpus(source({"a.go": 'os.Getenv("A")', "b.py": "os.getenv('B')", ".env": "A=1"}), path)
    found = usages.extract(files.code_files(spark.read.parquet(path)), languages.GO, "static")
    assert [r.key for r in found.collect()] == ["A"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "language" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_staging_needs_a_shared_folder_off_local_masters():
    from types import SimpleNamespace

    import pytest

    from keydrift.plans import staging

    def session(master, folder=None):
        nothing = SimpleNamespace(get=lambda *_: None)
        context = SimpleNamespace(master=master, getConf=lambda: nothing, getCheckpointDir=lambda: folder)
        return SimpleNamespace(conf=nothing, sparkContext=context)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_dir(session("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_dir(session("local-cluster[2,1,1024]"))
    assert staging.staging_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
