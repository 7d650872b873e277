import itertools
import random
import zlib

from pyspark.sql import functions as F

from keydrift.llm import sharding


def test_flow_moves_the_fewest_bytes():
    rnd = random.Random(1)
    for _ in range(30):
        n = rnd.randrange(1, 4)
        supply = [rnd.randrange(0, 5) for _ in range(n)]
        capacity = [rnd.randrange(0, 5) for _ in range(n)]
        if sum(capacity) < sum(supply):
            capacity[0] += sum(supply) - sum(capacity)
        flow = sharding.minimum_cost_flow(supply, capacity)
        for s in range(n):
            assert sum(f for (a, _), f in flow.items() if a == s) == supply[s]
            assert sum(f for (_, t), f in flow.items() if t == s) <= capacity[s]
        moved = sum(f for (s, t), f in flow.items() if s != t)
        units = [s for s in range(n) for _ in range(supply[s])]
        best = min(
            sum(s != t for s, t in zip(units, to, strict=True))
            for to in itertools.product(range(n), repeat=len(units))
            if all(to.count(t) <= capacity[t] for t in range(n))
        ) if len(units) <= 7 else max(0, sum(max(0, supply[s] - capacity[s]) for s in range(n)))
        assert moved == best


def test_flow_prefers_cheap_ways():
    flow = sharding.minimum_cost_flow([10, 0, 0], [2, 8, 8], cost=lambda s, t: abs(s - t))
    assert flow == {(0, 0): 2, (0, 1): 8}


def test_documents(spark):
    rnd = random.Random(2)
    rows = [(k, "x" * rnd.randrange(0, 300), f"s{rnd.randrange(3)}", "old") for k in range(3000)]
    rows += [(5, None, None, None), (5, None, None, None), (None, "é", "s1", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    out = sharding.documents_resharded(sharding.sized(docs, "shard")).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    for k in range(sharding.SHARDS):
        mine = [r for r in out if r["shard"] == k]
        assert abs(sum(r["size"] for r in mine) - total / 8) < 400
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[None]["text_crc32"] == zlib.crc32("é".encode()) and by_id[None]["size"] == 3
    assert [r["size"] for r in out if r["doc_id"] == 5].count(1) == 2
    old = [sum(r["size"] for r in out if r["old_shard"] == k) for k in range(8)]
    moved = sum(r["size"] for r in out if r["old_shard"] != r["shard"])
    assert moved <= sum(max(0, x - total // 8) for x in old) + 8
    again = sharding.documents_resharded(sharding.sized(docs, "shard")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.documents_resharded(sharding.sized(docs)).count() == 0


def test_rewrites_only_what_changes(spark, tmp_path):
    rows = spark.range(90).select(F.col("id"), (F.col("id") % 3).cast("int").alias("old_shard"))
    for k in range(3):
        rows.where(F.col("old_shard") == k).drop("old_shard").write.parquet(str(tmp_path / f"old{k}"))
    # shard 0 loses rows to shard 1; shard 2 is not touched
    shard = F.when((F.col("old_shard") == 0) & (F.col("id") < 30), F.lit(1)).otherwise(F.col("old_shard"))
    assigned = rows.withColumn("shard", shard).withColumn("slot", F.lit(0))
    old = {k: str(tmp_path / f"old{k}") for k in range(3)}
    folders = sharding.rewrite(spark, old, assigned, str(tmp_path / "new"))
    assert folders[2] == [old[2]] and folders[1][0] == old[1] and old[0] not in folders[0]
    want = {k: sorted(r["id"] for r in assigned.where(F.col("shard") == k).collect()) for k in range(3)}
    for k, paths in folders.items():
        assert sorted(r["id"] for p in paths for r in spark.read.parquet(p).select("id").collect()) == want[k]
