"""Token counts through a digest cache.

A text's digest covers its content with runs of white space made one space, which the tokenizer drops; the version's
digest covers the vocabulary file. Texts join the stored counts by both digests; only distinct misses are encoded, and
their counts are appended. A miss is encoded word by word: the tokenizer splits at white space and no step of it looks
across, so a text's count is the sum over its words, and a task encodes each distinct word once.

That holds for word-level ``tokenizers`` files whose pre-tokenizer drops white space; ``whole_texts=True`` encodes and
digests texts as they are, for any other file; the version says which way a count was made. Documents of one content are
cut into parts where they are more than a quarter of a task's even share.

Defined cases: a null text is empty and has no bytes and tokens; equal texts share one cache row; repeated rows are
counted each; an empty table gives an empty table; further columns are not read. Nothing is cut, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import tables
from keydrift.operators.skew import hot_groups, spread_join

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 500_000
CACHE = "digest binary, version string, n_tokens long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


class _Words(dict):
    """Tokens of each word (as UTF-8), encoded when first met."""

    def __init__(self, tokenizer):
        super().__init__()
        self.encode = tokenizer.encode

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = len(self.encode(word.decode(), add_special_tokens=False).ids)
        return n


def counter(name: str, version: str, whole_texts: bool = False):
    """A function over Arrow batches of (digest, text) to cache rows."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        # the vocabulary is installed with Python on every machine; only its name travels
        tokenizer = Tokenizer.from_file(vocabulary_path(name))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        words = _Words(tokenizer)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            if whole_texts:
                n = [len(tokenizer.encode(t.as_py().decode(), add_special_tokens=False).ids) for t in texts]
            else:
                n = [sum(map(words.__getitem__, t.as_py().split())) for t in texts]
            rows = [batch.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["digest", "version", "n_tokens"])

    return encoded


def digest_of(text: Column, whole_texts: bool) -> Column:
    """The digest of a text's content: white space is folded only where no token crosses or depends on it."""
    content = text if whole_texts else F.regexp_replace(text, f"{tables.SPACE}+", " ")
    return F.unhex(F.sha2(content.cast("binary"), 256))


def version(name: str, whole_texts: bool) -> str:
    """The vocabulary's digest and how texts are read with it: counts of one way never answer for the other."""
    return version_of(vocabulary_path(name)) + (":whole" if whole_texts else "")


def keyed(docs: DataFrame, more: tuple[str, ...] = (), whole_texts: bool = False) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", *more, F.octet_length(text).cast("long").alias("n_bytes"), digest_of(text, whole_texts).alias("digest"))


def append_misses(docs: DataFrame, cache_path: str, name: str = VOCABULARY, whole_texts: bool = False) -> None:
    """Encodes each distinct content that the cache has no count for, and appends the counts."""
    spark, of = docs.sparkSession, version(name, whole_texts)
    docs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = _read(spark, cache_path).where(F.col("version") == of).select("digest")
    texts = docs.select(digest_of(F.col("text"), whole_texts).alias("digest"), "text")
    misses = texts.join(known, "digest", "left_anti").dropDuplicates(["digest"])
    misses.mapInArrow(counter(name, of, whole_texts), CACHE).write.mode("append").parquet(cache_path)


def _read(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache, or no rows where none is written yet."""
    jvm, path = spark.sparkContext._jvm, cache_path
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def counted(docs: DataFrame, cache_path: str, name: str = VOCABULARY, whole_texts: bool = False) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, counts read from the cache after it was brought up to date."""
    append_misses(docs, cache_path, name, whole_texts)
    # two writers may have appended one digest at a time; a count is the same in both
    cache = _read(docs.sparkSession, cache_path).where(F.col("version") == version(name, whole_texts))
    cache = cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = tables.stored(keyed(docs, whole_texts=whole_texts))
    # a content that many documents have is cut into parts of a quarter of a task's even share
    n = tables.stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = (n.agg(F.sum("n")).first()[0] or 0) // (4 * tasks) + 1
    met = spread_join(rows, cache, ["digest"], "inner", ["doc_id"], hot_groups(n, ["digest"], hot_rows=share))
    return met.select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = counted(docs, f"{tables.shared_folder(spark)}/token-cache")
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
