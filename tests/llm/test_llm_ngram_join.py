"""The Jaccard join against all pairs by brute force, and the pipeline's stages."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keydrift.llm import ngram_join, shingles, tables

WORDS = [f"w{k}" for k in range(3000)]


def _set(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _brute(rows):
    sets = [(i, _set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having, shared = defaultdict(list), Counter()
    for k, (_, s) in enumerate(sets):
        for x in s:
            having[x].append(k)
    for members in having.values():
        shared.update((a, b) for j, b in enumerate(members) for a in members[:j])
    for (a, b), both in shared.items():
        if 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = root(sets[a][0]), root(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def _changed(rnd, words, times):
    w = list(words)
    for _ in range(times):
        at = rnd.randrange(len(w))
        w[at : at + rnd.randrange(2)] = [rnd.choice(WORDS)] * rnd.randrange(2)
        w = w or ["x"]
    return " ".join(w)


def _linked(spark, rows):
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, id string, n int")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs).collect()}


def test_sizes_and_near_copies(spark):
    rnd, texts = random.Random(5), [None, "", " \n", "a", "A", "a b c", "a b c d e", "a b c d e f"]
    for n in (5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 120, 300):
        for _ in range(4):
            base = [rnd.choice(WORDS) for _ in range(n)]
            texts += [_changed(rnd, base, rnd.randrange(0, max(2, n // 12))) for _ in range(7)]
    texts += [" ".join(f"t{k}" for k in range(n)) for n in (30_000, 26_000, 20_000)]
    rows = list(enumerate(texts))
    assert _linked(spark, rows) == _brute(rows)


@pytest.mark.parametrize("sent", [500_000, -1])
def test_hot_groups(spark, monkeypatch, sent):
    """A passage that makes up half of many unlike texts, a large group of near copies, and many exact copies; groups cut
    into small blocks, with and without identifiers sent to the tasks."""
    monkeypatch.setattr(ngram_join, "GROUP", 40)
    monkeypatch.setattr(ngram_join, "LARGE", 500_000 if sent < 0 else 30)
    monkeypatch.setattr(ngram_join, "SENT", sent)
    rnd = random.Random(6)
    passage, copied = ([rnd.choice(WORDS) for _ in range(n)] for n in (60, 80))
    texts = [" ".join(passage[: rnd.randrange(30, 60)] + [rnd.choice(WORDS) for _ in range(rnd.randrange(10, 60))]) for _ in range(200)]
    texts += [_changed(rnd, copied, rnd.randrange(0, 8)) for _ in range(150)] + ["Many copies of this text here"] * 200
    rows = list(enumerate(texts))
    assert _linked(spark, rows) == _brute(rows)


def test_no_rows_nulls_and_shared_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "x y z"), (3, "q r s t u v"), (4, "q r s t u v")], "doc_id long, text string")
    got = Counter((r[0], r[2]) for r in ngram_join.linked(docs).collect())
    assert got[None, None] == 2 and got[4, 3] == 1 and got[3, 3] == 2
    assert ngram_join.linked(docs.limit(0)).count() == 0
    kept = ngram_join.representatives(docs.selectExpr("*", "'r' as row", "1 as rank"))
    assert sorted(kept.toPandas()["text"]) == ["a b c d e f", "q r s t u v", "x y z"] and kept.columns == ["doc_id", "text", "row", "rank"]
    assert ngram_join.representatives(docs.limit(0)).count() == 0


def test_one_text_of_each_component_stays(spark):
    """Rows that share a doc_id are judged each by its own text."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (9, c), (9, d), (9, d), (None, d), (None, d + " more"), (None, None), (5, ""), (5, ""), (None, "e f g"), (-7, "h i j k l m n"), (-7, "h i j k l m n"), (8, "h i j k l m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(repr, ((r[0], r[1]) for r in ngram_join.representatives(docs).collect())))
    assert kept == sorted(map(repr, [(3, a), (5, b), (9, c), (9, d), (None, None), (5, ""), (5, ""), (None, "e f g"), (-7, "h i j k l m n")]))


def test_postings_of_two_members_need_no_cell(spark, monkeypatch):
    rnd = random.Random(8)
    rows, unsettled, met = [], ngram_join._unsettled, []
    for k in range(20):
        shared = [f"s{k}x{i}" for i in range(60)]
        rows += [(2 * k + j, " ".join(shared + [f"o{rnd.random()}" for _ in range(60)])) for j in (0, 1)]
    monkeypatch.setattr(ngram_join, "_unsettled", lambda nodes, rows, forest: met.append(rows.count()) or unsettled(nodes, rows, forest))
    assert _linked(spark, rows) == _brute(rows)
    assert met == [0, 0]


def test_a_passage_that_many_share_is_not_looked_up(spark):
    """A hot passage in half of 2,000 unlike texts, and near copies among them."""
    rnd = random.Random(12)
    passage = [rnd.choice(WORDS) for _ in range(12)]
    texts = []
    for k in range(2000):
        own = [rnd.choice(WORDS) for _ in range(rnd.randrange(90, 130))]
        texts.append(" ".join((passage if k % 2 else []) + own))
        if k % 50 == 0:
            texts.append(_changed(rnd, texts[-1].split(), 2))
    rows = list(enumerate(texts))
    assert _linked(spark, rows) == _brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("name"), "text")
    profile = docs.selectExpr("name as doc_id", "text", "0L as key").mapInArrow(ngram_join._profiles, "doc_id long, key long, node long, n long, less0 long, less1 long, odd binary")
    index = docs.mapInArrow(ngram_join._indexed(profile.agg({"n": "max"}).first()[0], 8), "bucket long, sigs binary, ids binary")
    groups = index.groupBy("bucket").applyInArrow(ngram_join._grouped, "sig long, side int, id long, first long, g long")
    looks = ngram_join._allocated(groups, profile.withColumnRenamed("doc_id", "id"))
    long = groups.where("g > 100").select("sig").distinct()
    counts = {r["looks"]: r["count"] for r in looks.join(long, "sig").groupBy("looks").count().collect()}
    # long postings are given up by most of their members
    assert counts.get(False, 0) > 4 * counts.get(True, 0)



def test_every_link_shares_a_signature():
    """The pigeonhole, on sets of small sizes whose segments are often empty."""
    rnd = np.random.default_rng(8)
    schemes = ngram_join.Schemes(400)
    for n in [4, 5, 6, 7, 9, 11, 14, 18, 25, 40, 90, 200]:
        for _ in range(60):
            both = rnd.integers(0, 2**63, n, dtype=np.uint64)
            more = [rnd.integers(0, 2**63, k, dtype=np.uint64) for k in rnd.integers(0, n // 4 + 1, 2)]
            a, b = (np.unique(np.concatenate([both, m])) for m in more)
            if len(a) == len(b) == n or 100 * n < 75 * (len(a) + len(b) - n):
                continue
            sigs = [set(ngram_join.signatures(x, np.array([len(x)]), schemes)[0].tolist()) for x in (a, b)]
            assert sigs[0] & sigs[1], (n, len(a), len(b))


def test_sketches_never_exceed_the_difference():
    rnd = np.random.default_rng(9)
    for n in (1, 3, 64, 65, 300):
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rnd.integers(0, 2**63, n, dtype=np.uint64)]))
        x, y = (np.frombuffer(ngram_join.odd_sketch(s), np.uint64) for s in (a, b))
        size = min(len(x), len(y))
        distance = int(np.bitwise_count(ngram_join.folded(x, size) ^ ngram_join.folded(y, size)).sum())
        assert distance <= len(np.setxor1d(a, b))


def test_shingles_match_plain_python():
    texts = ["", None, "a", "A b", "a b c d e", " a  b\tc d\ne f A b c d e f", " ", "é É z q r s t é É z q r s t u", "a b c d e", " x"]
    found = []
    for _, _, data, offsets in shingles.slices(pa.array(texts)):
        h, n = shingles.shingle_sets(data, offsets)
        found += [set(x.tolist()) for x in np.split(h, np.cumsum(n)[:-1])]
    for x, s in zip(found, texts, strict=True):
        for y, t in zip(found, texts, strict=True):
            assert len(x & y) == len(_set(s) & _set(t))


def test_packing_is_lossless():
    rnd = np.random.default_rng(10)
    sigs, ids = rnd.integers(0, 2**63, 5000, dtype=np.uint64), rnd.integers(-(2**62), 2**62, 5000)
    rows = ngram_join._packed(sigs, ids, 7)
    parts = [ngram_join._unpacked(s.as_py(), i.as_py()) for s, i in zip(rows.column("sigs"), rows.column("ids"), strict=True)]
    got = Counter(zip(np.concatenate([s for s, _ in parts]).tolist(), np.concatenate([i for _, i in parts]).tolist(), strict=True))
    assert got == Counter(zip((sigs & np.uint64(2**48 - 1)).tolist(), ids.tolist(), strict=True))


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = tables.table(spark, sf, "documents")
    columns, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = tables.stored(stage(spark, docs, sf))
        if k < 4:
            assert out.columns == columns
        if k < 3:
            assert out.exceptAll(docs).count() == 0 and 0 < out.count() < docs.count()
        before, docs = docs, out
    assert docs.count() == before.count()
    for shard in {r["shard"] for r in docs.select("shard").distinct().collect()}:
        slots = sorted(r["slot"] for r in docs.where(docs.shard == shard).collect())
        assert slots == list(range(len(slots)))
    ran = corpus_pipeline.run(spark, sf)
    assert ran.exceptAll(docs).count() == docs.exceptAll(ran).count() == 0


def test_pipeline_stages_on_no_rows_and_odd_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = tables.table(spark, sf, "documents").limit(30).selectExpr(
        "*", "1 as kept", "'a' as row", "2 as tie", "'s' as spans", "0 as shard", "1L as size", "'i' as id", "'k' as key", "9 as rank"
    )
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.format("noop").mode("overwrite").save()
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_indexing_holds_little_beside_its_batch():
    """What a task holds while it indexes is bounded by its blocks, not by a bucket's signatures nor by copies of the batch."""
    rng = np.random.default_rng(3)
    text = pa.array([" ".join(map(str, rng.integers(0, 1 << 40, 150))) for _ in range(8000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), text], ["name", "text"])
    index = ngram_join._indexed(200, 64)
    list(index(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    held = pa.total_allocated_bytes()
    signatures, most = 0, 0
    for block in index(iter([batch])):
        signatures += sum(len(s) // 6 for s in block.column("sigs").to_pylist())
        most = max(most, pa.total_allocated_bytes() - held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert signatures > 900_000, signatures
    assert (peak < 50e6, most < 10e6) == (True, True), (peak, most)


def test_slices_of_any_string_column():
    texts = ["a b", None, "", "é " * 300_000, "c"]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["x", *texts], kind).slice(1)
        for c in (column, pa.chunked_array([column.slice(0, 2), column.slice(2)])):
            parts = [bytes(data[o[k] : o[k + 1]]).decode() for _, _, data, o in shingles.slices(c) for k in range(len(o) - 1)]
            assert parts == [t or "" for t in texts]
    assert not list(shingles.slices(pa.array([], pa.string())))
