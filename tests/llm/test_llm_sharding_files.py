"""The registered resharding writes the old layout and rewrites its files; texts come back from them."""

import random

import corpus_pipeline
from keydrift.llm import sharding


def _docs(spark, n=2000):
    rnd = random.Random(4)
    rows = [(k, "x" * rnd.randrange(0, 300), f"s{rnd.randrange(3)}", "en", 1) for k in range(n)] if n else []
    rows += [(5, None, None, None, None)] * 2 + [(None, "é", "s1", "", 1)] if n else []
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")


def test_rows_come_from_rewritten_files(spark):
    docs = _docs(spark)
    new, _ = sharding.layout_rewritten(docs)
    files = new.inputFiles()
    assert any("/shard=" in f for f in files) and sorted(map(repr, new.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    columns = ["doc_id", "source", "size", "text_crc32", "old_shard", "shard", "slot"]
    want = sharding.documents_resharded(sharding.sized(docs)).select(columns).collect()
    got = sharding.documents_rewritten(docs).select(columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_pipeline_stage_keeps_texts(spark):
    docs = _docs(spark)
    out = corpus_pipeline.resharded(spark, docs, "")
    assert sorted(map(repr, out.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert corpus_pipeline.resharded(spark, _docs(spark, 0), "").count() == 0
