from collections import defaultdict

import numpy as np
import pytest

from keydrift.llm import mixing, tables


def test_targets_stop_at_twice_the_size():
    sizes = [10, 1000, 1000, 0]
    t = mixing.targets(sizes)
    assert t[0] == 20 and t[3] == 0 and sum(t) == pytest.approx(1.5 * sum(sizes))
    assert all(x <= 2 * s for x, s in zip(t, sizes, strict=True))
    assert mixing.targets([]) == [] and mixing.targets([0]) == [0.0]
    # nothing is above: shares go by weight 5, 2, 1
    assert mixing.targets([800, 800, 800]) == pytest.approx([1600, 1333.333333, 666.666667])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations_are_bijections(n):
    at = np.arange(n)
    one, two = (mixing.permuted(at, np.full(n, n), np.full(n, k)) for k in (1, 2))
    assert sorted(one) == sorted(two) == list(range(n))
    assert n < 64 or (one != two).any()


def _documents(spark):
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(k * 37 % 700)), f"s{k % 4}", "en", k, "x", 1.5) for k in range(60)]
    rows += [(100, None, None, None, None, "y", 1.0), (101, "a b  c", None, None, 6, "y", 1.0), (7, "a b", "s9", "en", 3, "", 0.0)]
    rows += [(200, "same text here", "s1", "en", 14, "", 0.0)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, tie string, start double")


def test_mix(spark):
    docs = _documents(spark)
    placed, taken = mixing.mixed(docs)
    words = defaultdict(int)
    for r in taken.collect():
        assert 0 < r["words"] <= mixing.BLOCK and 0 <= r["out_shard"] < mixing.OUTPUT_SHARDS
        words[r["sid"], r["start"]] += r["words"]
    by_source = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in placed.collect():
        got = words.get((r["sid"], r["start"]), 0) if r["size"] else 0
        assert got <= 2 * r["size"]
        entry = by_source[r["source"]]
        entry[0], entry[1], entry[2], entry[3] = entry[0] + r["size"], entry[1] + got, r["target"], r["source_size"]
    names = sorted((s for s in by_source if s is not None)) + [None]
    want = mixing.targets([by_source[s][0] for s in names])
    for s, t in zip(names, want, strict=True):
        size, got, target, source_size = by_source[s]
        assert source_size == size and target == pytest.approx(t) and got == round(t)


def test_no_setting_changes_the_mix(spark):
    docs, found = _documents(spark), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (4, 7, 23):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        placed, taken = mixing.mixed(docs.repartition(n))
        words = taken.join(placed.select("sid", "start", "doc_id", "size").where("size > 0"), ["sid", "start"])
        found.append(sorted(map(repr, words.select("doc_id", "word", "words", "pass", "slot", "out_shard").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_every_word_against_the_plan(spark):
    """Word by word: blocks of the packed sources, permuted pass by pass, shards by the drawn ends."""
    docs = _documents(spark)
    placed, taken = mixing.mixed(docs)
    rows = [r for r in placed.collect() if r["size"]]
    sizes = {r["sid"]: r["source_size"] for r in rows}
    at = defaultdict(dict)
    for r in rows:
        for k in range(r["size"]):
            assert r["start"] + k not in at[r["sid"]]
            at[r["sid"]][r["start"] + k] = (r["start"], k)
    assert all(sorted(at[s]) == list(range(sizes[s])) for s in sizes)
    plan = {r["sid"]: r for r in mixing.source_plan(spark, placed.select("source", "size")).collect()}
    slots = defaultdict(dict)
    for r in mixing.slots(mixing.source_plan(spark, placed.select("source", "size"))).collect():
        slots[r["sid"], r["pass"]][r["slot"]] = r
    want = defaultdict(int)
    for (sid, _), of_pass in slots.items():
        blocks = plan[sid]["blocks"]
        chosen = [of_pass[k]["block"] for k in sorted(of_pass)]
        # a pass uses no block twice, and its short last block, if at all, last
        assert len(set(chosen)) == len(chosen) <= blocks and (blocks - 1 not in chosen[:-1] or len(chosen) < blocks)
        for k in sorted(of_pass):
            r = of_pass[k]
            assert r["out_shard"] == sum(e <= r["slot"] for e in plan[sid]["ends"])
            for word in range(r["block"] * mixing.BLOCK, min(r["block"] * mixing.BLOCK + r["take"], sizes[sid])):
                start, inside = at[sid][word]
                want[sid, start, inside, r["pass"], r["out_shard"]] += 1
    got = defaultdict(int)
    for r in taken.collect():
        for k in range(r["words"]):
            got[r["sid"], r["start"], r["word"] + k, r["pass"], r["out_shard"]] += 1
    assert got == want and set(got.values()) == {1}


def test_the_draw_decides_what_a_shard_gets(spark, tmp_path, monkeypatch):
    _documents(spark).write.parquet(str(tmp_path / "documents.parquet"))

    def by_shard():
        rows = mixing.query(spark, str(tmp_path)).collect()
        assert all(sum(r["shard_words"]) == r["taken"] and len(r["shard_words"]) == mixing.OUTPUT_SHARDS for r in rows)
        return sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows), [sum(r["shard_words"][k] for r in rows) for k in range(8)]

    rows, shards = by_shard()
    monkeypatch.setattr(mixing, "SEED", 7)
    other = by_shard()[1]
    assert min(shards) > 0 and shards != other and sum(shards) == sum(other)


def test_texts(spark):
    docs = _documents(spark)
    out = mixing.mixed_texts(docs).collect()
    assert out and set(out[0].asDict()) == set(docs.columns)
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    placed, taken = mixing.mixed(docs)
    assert sum(len(r["text"].split()) for r in out) == sum(r["words"] for r in taken.collect())
    whole = sum((r["doc_id"], r["text"]) in texts for r in out)
    assert whole > len(out) / 2 and all(r["n_chars"] == len(r["text"]) for r in out)
    parts = {r["doc_id"]: set(r["text"].split()) for r in docs.where("text is not null and doc_id < 60").collect()}
    assert all(set(r["text"].split()) <= parts[r["doc_id"]] for r in out if r["doc_id"] < 60 and r["doc_id"] != 7)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mixed_texts(docs).collect()))


def test_no_rows(spark):
    assert mixing.mixed_texts(_documents(spark).limit(0)).count() == 0
    assert mixing.mixed_texts(_documents(spark).where("text is null")).count() == 0


def test_words_are_counted_as_split(spark):
    texts = [None, "", " ", "a", " a", "a ", "a\tb\n", " ", "a b c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = [r["n"] for r in df.select("k", tables.n_words(df.text).alias("n")).orderBy("k").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 1, 2]
