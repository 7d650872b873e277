"""Resharding by minimum-cost flow: from the sizes of the old shards and the new capacities, the block transfers that
move the fewest bytes, and the rewriting of the files they touch.

A shard's rows are dealt into ``BLOCKS`` blocks by a hash of the key; only block sizes reach the driver (shards x blocks
numbers, whatever the number of rows). Flow between shards is solved exactly; then each transfer is filled with whole
blocks, the largest that still fits first, so a new shard misses its capacity by less than its smallest movable block.

Defined cases: a null text has size 1 and CRC 0; null keys share a block; repeated rows get slots of their own, in any
order, since they are equal; an empty table gives an empty table; extra columns are kept by ``reshard``,
but for columns named as those it adds.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keydrift.llm import tables

SHARDS = 8
BLOCKS = 512
ADDED = ("old_shard", "shard", "slot")


def minimum_cost_flow(supply: list[int], capacity: list[int], cost=lambda s, t: int(s != t)) -> dict[tuple[int, int], int]:
    """Flow from old shard s to new shard t that places all supply at the least cost; ``cost`` is that of one byte.

    Successive shortest paths with potentials on the bipartite graph. The capacities must hold the supply.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold the old ones' bytes")
    n, m = len(supply), len(capacity)
    start, end = n + m, n + m + 1
    graph: dict[int, dict[int, int]] = defaultdict(dict)
    price: dict[tuple[int, int], int] = {}

    def edge(u: int, v: int, room: int, c: int) -> None:
        graph[u][v], graph[v][u] = room, graph[v].get(u, 0)
        price[u, v], price[v, u] = c, -c

    for s, x in enumerate(supply):
        edge(start, s, x, 0)
        for t in range(m):
            edge(s, n + t, x, cost(s, t))
    for t, x in enumerate(capacity):
        edge(n + t, end, x, 0)
    potential = dict.fromkeys(range(n + m + 2), 0)
    left = sum(supply)
    while left:
        far, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, u = heappop(heap)
            if d > far[u]:
                continue
            for v, room in graph[u].items():
                new = d + price[u, v] + potential[u] - potential[v]
                if room > 0 and new < far.get(v, new + 1):
                    far[v], via[v] = new, u
                    heappush(heap, (new, v))
        for v, d in far.items():
            potential[v] += d
        path, v = [], end
        while v != start:
            path.append((via[v], v))
            v = via[v]
        push = min(left, *(graph[u][v] for u, v in path))
        for u, v in path:
            graph[u][v] -= push
            graph[v][u] += push
        left -= push
    return {(s, t): f for s in range(n) for t in range(m) if (f := graph[n + t][s]) > 0}


def transfers(blocks: list[tuple[int, int, int]], capacity: list[int], cost=lambda s, t: int(s != t)) -> dict[tuple[int, int], int]:
    """The new shard of each (old shard, block), given (old shard, block, bytes)."""
    n = max([len(capacity), *(s + 1 for s, _, _ in blocks)])
    supply = [0] * n
    own = defaultdict(list)
    for s, b, size in blocks:
        supply[s] += size
        own[s].append((size, b))
    flow = minimum_cost_flow(supply, capacity, cost)
    placed = {}
    left = {}
    for s, mine in own.items():
        mine.sort(reverse=True)
        home = s if (s, s) in flow else max((f, t) for (a, t), f in flow.items() if a == s)[1]
        for t in sorted(t for a, t in flow if a == s and t != home):
            left[t] = flow[s, t]
            rest = []
            for size, b in mine:
                if size <= left[t]:
                    placed[s, b], left[t] = t, left[t] - size
                else:
                    rest.append((size, b))
            mine = rest
        placed |= {(s, b): home for _, b in mine}
    return placed


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (t < total % shards) for t in range(shards)]


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")


def reshard(rows: DataFrame, old_shard: Column, size: Column, key: Column, tie: list[Column], capacity=None) -> DataFrame:
    """The rows with ``shard`` and ``slot``. ``capacity``: bytes of each new shard; equal ones if none. ``tie``: what
    orders rows of a block, beside the key."""
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in ADDED]
    work = tables.stored(
        rows.select(
            F.struct(*columns).alias("row"), old_shard.cast("int").alias("old"), size.cast("long").alias("size"),
            _block(key).alias("block"), F.struct(key, *tie).alias("tie"),
        )
    )
    plan = transfer_plan(work, capacity)
    at = F.row_number().over(Window.partitionBy("old", "block").orderBy("tie")).cast("long")
    return (
        work.withColumn("at", at)
        .join(F.broadcast(plan), ["old", "block"])
        .select("row.*", F.col("old").alias("old_shard"), "shard", (F.col("first") + F.col("at") - 1).alias("slot"))
    )


def transfer_plan(work: DataFrame, capacity: list[int] | None = None) -> DataFrame:
    """old, block, shard and the block's first slot, from rows with old, block and size."""
    # shards x BLOCKS rows at most, whatever the table's size
    sums = work.groupBy("old", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sums.sort(key=lambda r: (r["old"], r["block"]))
    capacity = capacity or equal_capacities(sum(r["size"] for r in sums), SHARDS)
    to = transfers([(r["old"], r["block"], r["size"]) for r in sums], capacity)
    first, filled = [], [0] * len(capacity)
    for r in sums:
        t = to[r["old"], r["block"]]
        first.append((r["old"], r["block"], t, filled[t]))
        filled[t] += r["n"]
    return work.sparkSession.createDataFrame(first, "old int, block int, shard int, first long")


def rewrite(spark: SparkSession, old: dict[int, str], assigned: DataFrame, target: str) -> dict[int, list[str]]:
    """Writes what changes: ``old`` has each old shard's folder, ``assigned`` the rows with ``old_shard`` and ``shard``.

    Folders of shards that lose no row stay as they are and are only added to; shards that lose rows are written anew
    under ``target``. Returns the folders that make up each new shard.
    """
    pairs = [tuple(r) for r in assigned.select("old_shard", "shard").distinct().collect()]  # shards x shards at most
    losing = {s for s, t in pairs if s != t}
    change = assigned.where((F.col("old_shard") != F.col("shard")) | F.col("old_shard").isin(sorted(losing)))
    # no shuffle of the texts: every task writes its part of each shard it has rows of
    change.drop("old_shard", "slot").write.partitionBy("shard").parquet(target)
    written = {t for s, t in pairs if s != t or s in losing}
    return {
        t: ([old[t]] if t in old and t not in losing else []) + [f"{target}/shard={t}"] * (t in written)
        for t in sorted(set(old) - losing | written)
    }


def _old_shard(source: Column) -> Column:
    """A layout that keeps each source in one shard."""
    return F.pmod(tables.crc(source), F.lit(SHARDS)).cast("int")


def documents_resharded(docs: DataFrame) -> DataFrame:
    """The documents' shards, from a layout that keeps each source in one shard to one of equal bytes."""
    return reshard(
        docs,
        old_shard=_old_shard(F.col("source")),
        size=F.col("size"),
        key=F.col("doc_id"),
        tie=[F.col("text_crc32"), F.col("size")],
    )


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size and text_crc32, without the text."""
    return docs.select(
        "doc_id", "source", *more,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        tables.crc(F.col("text")).alias("text_crc32"),
    )


def layout_rewritten(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents, texts included, read from the new layout's files, with ``old_shard`` and ``shard``; and the plan.

    The old layout is written first, each source in one shard. The plan follows from its block sizes; a row's shard
    follows from its old shard and block, so texts meet the plan by a broadcast and are not shuffled.
    """
    spark, layout = docs.sparkSession, tables.shared_folder(docs.sparkSession)
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
    rows.withColumn("old_shard", _old_shard(F.col("source"))).write.partitionBy("old_shard").parquet(layout)
    written = spark.read.schema(rows.withColumn("old_shard", F.lit(0)).schema).parquet(layout)
    sizes = sized(written, "old_shard").select(F.col("old_shard").alias("old"), "size", _block(F.col("doc_id")).alias("block"))
    plan = transfer_plan(sizes)
    same = (F.col("r.old_shard") == F.col("p.old")) & (_block(F.col("r.doc_id")) == F.col("p.block"))
    assigned = written.alias("r").join(F.broadcast(plan.alias("p")), same).select("r.*", "p.shard")
    old = {r["old"]: f"{layout}/old_shard={r['old']}" for r in plan.select("old").distinct().collect()}
    new = spark.createDataFrame([], rows.schema).withColumn("shard", F.lit(0))
    for shard, folders in rewrite(spark, old, assigned, tables.shared_folder(spark)).items():
        new = new.unionByName(spark.read.schema(rows.schema).parquet(*folders).withColumn("shard", F.lit(shard)))
    return new.withColumn("old_shard", _old_shard(F.col("source"))), plan


def documents_rewritten(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, ``more``, size, text_crc32, old_shard, shard and slot of every row in the new layout's files."""
    new, plan = layout_rewritten(docs)
    rows = sized(new, *more, "old_shard", "shard").withColumn("block", _block(F.col("doc_id")))
    at = F.row_number().over(Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")).cast("long")
    first = F.broadcast(plan.select(F.col("old").alias("old_shard"), "block", "first"))
    kept = [c for c in rows.columns if c not in (*ADDED, "block")]
    rows = rows.withColumn("at", at).join(first, ["old_shard", "block"])
    return rows.select(*kept, "old_shard", "shard", (F.col("first") + F.col("at") - 1).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents_rewritten(tables.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
