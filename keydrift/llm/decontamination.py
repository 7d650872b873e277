"""Benchmark decontamination with DataFrame functions only: a hash set of the benchmark's normalised n-grams is sent with
the plan, every document's token windows are tested against it, survivors carry their text and are verified by an exact
join, and hit words give spans or documents to remove.

The set is a bit table of at least 256 bits for each window, which goes to every task. It is cut by hash into tables of
about ``TABLE_WINDOWS`` windows, each of them sent with one scan of the documents; only survivors are ever spelt out.

Words fold only A-Z, in the scan as in the verified text.

Defined cases: null or wordless texts have no words and no hits; an item of fewer words than a window is one window, an
item without words none; rows of one doc_id are judged each on its own text; equal rows get equal results; an empty
benchmark hits nothing; other columns of any name are kept by ``without_documents`` and ``without_spans``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import tables

WINDOW = 10
TABLE_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, before folding.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN = "array<struct<at:int,len:int,win:string>>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _window_hash(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.slice(w, at + 1, n))


def _window_text(raw: Column, at: Column, n: Column | int) -> Column:
    return _folded(F.array_join(F.slice(raw, at + 1, n), " "))


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct (len, win, item_id, h): the windows of every item."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = items.select("item_id", _words(text).alias("raw"), _words(_folded(text)).alias("w")).where(F.size("raw") > 0)
    k = F.least(F.size("raw"), F.lit(n))
    rows = words.withColumn("len", k).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("raw") - F.col("len"))))
    h = F.xxhash64(F.slice("w", F.col("at") + 1, F.col("len")))
    return rows.select("len", _window_text(F.col("raw"), F.col("at"), F.col("len")).alias("win"), "item_id", h.alias("h")).distinct()


def _bit_table(windows: DataFrame) -> tuple[Column, int]:
    """The table as a constant, and its words."""
    hashes = [r["h"] for r in windows.select("h").distinct().collect()]  # about TABLE_WINDOWS numbers
    size = 1 << max(6, (4 * len(hashes)).bit_length())
    table = [0] * size
    for h in hashes:
        table[(h >> 6) % size] |= 1 << (h & 63)
    signed = ",".join(str(x - (1 << 64) if x >> 63 else x) for x in table)
    return F.from_json(F.lit(f"[{signed}]"), "array<bigint>"), size


def candidates(docs: DataFrame, windows: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, spans): a row for each document, with the windows that pass the bit table and their text."""
    lengths = [r["len"] for r in windows.select("len").distinct().collect()]  # n at most
    table, size = _bit_table(windows)
    text = F.coalesce(F.col("text"), F.lit(""))
    work = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("key"), _words(_folded(text)).alias("w"))

    def tested(k: int) -> Column:
        def hit(i: Column) -> Column:
            return _let(_window_hash(F.col("w"), i, k), lambda h: F.getbit(
                F.get(table, F.pmod(F.shiftright(h, 6), F.lit(size)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1)

        at = F.filter(F.sequence(F.lit(0), F.size("w") - k), hit)
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(k).alias("len")))

    parts = [F.when(F.size("w") >= k, tested(k)).otherwise(F.array().cast("array<struct<at:int,len:int>>")) for k in lengths]
    found = reduce(F.concat, parts) if parts else F.array().cast("array<struct<at:int,len:int>>")
    texts = _let(_words(F.col("text")), lambda raw: F.transform(
        F.col("found"), lambda s: F.struct(s["at"].alias("at"), s["len"].alias("len"), _window_text(raw, s["at"], s["len"]).alias("win"))
    ))
    work = work.select("doc_id", "key", "text", F.size("w").cast("long").alias("n_words"), found.alias("found"))
    return work.select("doc_id", "key", "n_words", F.when(F.size("found") > 0, texts).otherwise(F.array().cast(SPAN)).alias("spans"))


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted (at, len) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        new = F.greatest(F.lit(0), end - F.greatest(a["end"], s["at"])).cast("long")
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + new).alias("n"))

    return F.aggregate(spans, start, step, lambda a: a["n"])


def hits(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, key, n_words, spans (at, len), n_hit, items (as sorted strings)."""
    windows = tables.stored(item_windows(items, n))
    parts = max(1, -(-windows.select("h").distinct().count() // TABLE_WINDOWS))
    of_part = F.pmod(F.xxhash64("h"), F.lit(parts))
    scans = [tables.stored(candidates(docs, windows.where(of_part == k), n)) for k in range(parts)]
    found = scans[0]
    each = reduce(DataFrame.union, (s.where(F.size("spans") > 0).select("doc_id", "key", F.inline("spans")) for s in scans))
    sure = each.join(windows.select("win", "item_id"), "win").groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.struct("at", "len"))).alias("hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key") == F.col("s.key"))
    rows = found.drop("spans").alias("d").join(sure.alias("s"), same, "left")
    hit = F.coalesce("hit", F.array().cast("array<struct<at:int,len:int>>"))
    return rows.select(
        "d.doc_id", "d.key", "n_words", hit.alias("spans"), _covered(hit).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _hit_documents(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    return hits(docs, items, n).where("n_hit > 0").select("doc_id", "key", "spans").distinct()


def _matched(docs: DataFrame, hit: DataFrame, how: str) -> DataFrame:
    same = F.col("t.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64("t.text") == F.col("h.key"))
    return docs.alias("t").join(hit.alias("h"), same, how)


def without_documents(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return _matched(docs, _hit_documents(docs, items, n), "left_anti")


def without_spans(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """All documents, hit words cut from their texts; what stands between words stays."""
    raw, gaps = _words(F.col("t.text")), F.split("t.text", WORD, -1)
    cut = _let(raw, lambda w: _let(gaps, lambda g: F.array_join(F.flatten(F.transform(g, lambda x, i: F.array(x, F.when(
        F.exists("h.spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["len"])), F.lit("")
    ).otherwise(F.coalesce(F.get(w, i), F.lit("")))))), "")))
    text = F.when(F.size("h.spans") > 0, cut).otherwise(F.col("t.text"))
    out = _matched(docs, _hit_documents(docs, items, n), "left")
    return out.select(*(text.alias("text") if c == "text" else F.col(f"t.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, tables.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hit AS (SELECT r, i, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.t = win.t),
words AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + k)) AS x FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
