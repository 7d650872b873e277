"""Mixing sources to target weights: words are packed into fixed-length blocks per source, source counts are drawn per
output shard, slots are mapped to blocks by pseudorandom permutations, and blocks are joined by index.

Targets are met exactly to the word: every pass over a source uses all its blocks, the last one only as many as are
needed, the final block of it in part. The multinomial draw of each source is over the output shards, so it has the
drawn counts' law for every shard while a source's total stays what its target asks for; ``query`` returns how many words of
a document each output shard got. The mix is a function of the rows alone: the number of hash buckets that documents are
packed by follows from their count, not from the session's settings.

Defined cases: a null text has no words and is never taken; a null source is a source of its own, the last; an empty
table gives an empty table; repeated rows are packed one after the other as rows of their own; further columns, whatever
their names, are not read. Only one row per source reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from keydrift.llm import tables

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 256
OUTPUT_SHARDS = 8
SEED = 20240613
#: Rows of a packing bucket, and the least number of buckets.
PACK_ROWS, PACK_BUCKETS = 100_000, 256


def targets(sizes: list[int], share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> list[float]:
    """Words of each source, sources in order: shares by weight, none above ``most`` times its size."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weight[k] for k in open_)
        full = [k for k in sorted(open_) if unit * weight[k] > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = unit * weight[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.remove(k)
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of range(n) at each index: four Feistel rounds over the next even power of two, walked along
    its cycle until inside. Two arrays of one (n, key) never collide."""
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(4):
            f = (right + k + np.uint64(r * 0x9E3779B97F4A7C15 & 2**64 - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        v = left << h | right
        out[todo] = v
        todo = todo[v >= n[todo]]
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def _permute(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), n.to_numpy(), key.to_numpy()))


def packed(sizes: DataFrame) -> DataFrame:
    """Rows (source, size, tie...) with ``start``: the words of the same source before them, by two levels of sums."""
    buckets = max(PACK_BUCKETS, -(-sizes.count() // PACK_ROWS))
    rows = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(buckets)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket"))
    return rows.alias("r").join(sums.alias("s"), same).select("r.*", (F.col("base") + F.col("inside")).alias("start"))


def source_plan(spark: SparkSession, sizes: DataFrame, block: int = BLOCK, shards: int = OUTPUT_SHARDS) -> DataFrame:
    """A row for each source: size, target, blocks, slots, the words of the last pass, drawn shard counts."""
    totals = [(r["source"], r["size"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    totals.sort(key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    rng, rows = np.random.default_rng(SEED), []
    for sid, ((source, size), target) in enumerate(zip(totals, targets([n for _, n in totals]), strict=True)):
        whole, rest = divmod(round(target), size) if size else (0, 0)
        blocks = -(-size // block)
        slots = whole * blocks + -(-rest // block)
        ends = np.cumsum(rng.multinomial(slots, [1 / shards] * shards)).tolist()
        rows.append((source, sid, size, target, blocks, whole, rest, slots, ends))
    return spark.createDataFrame(
        rows, "source string, sid int, source_size long, target double, blocks long, whole long, rest long, slots long, ends array<long>"
    )


def slots(plan: DataFrame, block: int = BLOCK, chunk: int = 10_000) -> DataFrame:
    """A row for each slot of the mix: the block of the source that fills it, the words taken and the output shard.

    All full blocks of a source are permuted anew in each pass; its last, shorter block closes the pass, so the words
    before a slot follow from its place. Slots are made in chunks, spread before they are expanded.
    """
    parts = plan.where("slots > 0").withColumn("from", F.explode(F.expr(f"sequence(0L, slots - 1, {chunk}L)")))
    rows = parts.repartition("sid", "from").withColumn("slot", F.explode(F.expr(f"sequence(from, least(from + {chunk}L, slots) - 1)")))
    rows = rows.withColumn("pass", F.expr("slot div blocks")).withColumn("j", F.expr("slot % blocks"))
    full = F.col("blocks") - 1
    key = F.xxhash64(F.lit(SEED), "sid", "pass")
    rows = rows.withColumn("moved", _permute(F.least("j", F.greatest(full - 1, F.lit(0))), F.greatest(full, F.lit(1)), key))
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    left = F.when(F.col("pass") < F.col("whole"), length).otherwise(F.col("rest") - F.col("j") * block)
    shard = F.size(F.filter("ends", lambda e: e <= F.col("slot")))
    return rows.withColumn("block", F.when(F.col("j") == full, full).otherwise(F.col("moved"))).select(
        "sid", "block", "pass", "slot", shard.alias("out_shard"), F.greatest(F.least(length, left), F.lit(0)).alias("take")
    )


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each stretch of a document in a block: its place in the block and in the document."""
    cut = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}L, (start + size - 1) div {block}L)")))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select(
        "sid", "start", "block", (lo - F.col("block") * block).alias("lo"), (hi - F.col("block") * block).alias("hi"),
        (lo - F.col("start")).alias("word"),
    )


def mixed(docs: DataFrame, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The packed documents (doc_id, source, size, start, source_size, target, ...) and the taken stretches
    (sid, start of the document, word, words, pass, slot, out_shard)."""
    spark = docs.sparkSession
    sizes = tables.stored(docs.select("doc_id", "source", tables.n_words(F.col("text")).alias("size"), tables.crc(F.col("text")).alias("tie"), *more))
    plan = source_plan(spark, sizes)
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    placed = packed(sizes).alias("d").join(plan.alias("p"), same).select("d.*", "sid", "source_size", "target")
    placed = tables.stored(placed.drop("bucket", "inside"))
    # the planner takes the slots for as few as the sources they are expanded from: both sides must be shuffled
    taken = pieces(placed).join(slots(plan).hint("merge"), ["sid", "block"]).select(
        "sid", "start", "word", (F.least("hi", "take") - F.col("lo")).alias("words"), "pass", "slot", "out_shard"
    )
    return placed, taken.where("words > 0")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with the documents' columns. A
    text taken whole stays as it is; otherwise its taken words, joined by one space. n_chars follows the text."""
    placed, taken = mixed(docs)
    spans = taken.groupBy("sid", "start", "pass").agg(
        F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("word", "words"))).alias("spans")
    )
    # rows that agree in (doc_id, tie) are told apart by their rank on either side
    keyed = ("doc_id", "tie")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    texts = docs.where(tables.n_words(F.col("text")) > 0).select(row, "doc_id", tables.crc(F.col("text")).alias("tie"))
    texts = texts.withColumn("rank", F.row_number().over(Window.partitionBy(*keyed).orderBy("row.source")))
    ranks = placed.where("size > 0").withColumn("rank", F.row_number().over(Window.partitionBy(*keyed).orderBy("source", "start")))
    rows = ranks.join(spans, ["sid", "start"]).select(*keyed, "size", "pass", "words", "spans", "rank")
    w = tables.words(F.col("t.row.text"))
    cut = lambda s, all_: F.slice(all_, s["word"].cast("int") + 1, s["words"].cast("int"))
    part = F.transform(F.array(w), lambda all_: F.array_join(F.flatten(F.transform("spans", lambda s: cut(s, all_))), " "))[0]
    text = F.when(F.col("words") == F.col("size"), F.col("t.row.text")).otherwise(part)
    same = F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.tie") == F.col("r.tie"))
    same &= F.col("t.rank") == F.col("r.rank")
    joined = texts.alias("t").join(rows.alias("r"), same).select("row", text.alias("text"))
    value = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return joined.select(*(value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, taken = mixed(tables.table(spark, sf_dir, "documents"))
    by_shard = [F.coalesce(F.sum(F.when(F.col("out_shard") == k, F.col("words"))), F.lit(0)) for k in range(OUTPUT_SHARDS)]
    sums = taken.groupBy("sid", "start").agg(F.sum("words").alias("taken"), F.array(*by_shard).alias("shard_words"))
    key = F.when(F.col("size") > 0, F.col("start"))
    rows = placed.withColumn("_start", key).alias("d")
    same = (F.col("d.sid") == F.col("s.sid")) & (F.col("d._start") == F.col("s.start"))
    return rows.join(sums.alias("s"), same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("shard_words", F.array_repeat(F.lit(0).cast("long"), OUTPUT_SHARDS)).alias("shard_words"),
    )
