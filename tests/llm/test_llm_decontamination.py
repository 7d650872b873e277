import duckdb

from keydrift.llm import decontamination

ITEM = "One two three four five six seven eight nine ten eleven twelve."
DOCS = [
    (1, None), (2, ""), (3, "nothing of it here at all"), (4, "pre " + ITEM.upper() + " post"), (5, "one-two three; four five six seven eight nine TEN x"),
    (6, "é café short phrase Émile"), (6, "é café short phrase émile"), (7, "one two three four five six seven eight nine"), (8, ITEM + "\n" + ITEM),
    (9, "Short Phrase"), (9, "Short Phrase"), (None, ITEM), (11, "x " * 3000 + ITEM + " y" * 3000),
    (12, "one two three four five six seven eight nine ΟΔΟΣ.x"), (13, "one two three four five six seven eight nine οδοσ"),
]
ITEMS = [(13, "ONE two three four five six seven eight nine ΟΔΟΣ"), (10, ITEM), (2, "short phrase Émile"), (3, None), (4, "?!"), (5, "short phrase"), (5, "short phrase"), (12, "kelvin K word")]


def _tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_hits_match_the_oracle(spark, tmp_path):
    docs, items = _tables(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    result = con.execute(decontamination.SQL)
    columns = [d[0] for d in result.description]
    got = decontamination.query(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, result.fetchall()))
    assert {r["doc_id"] for r in got if r["contaminated"]} == {4, 5, 6, 8, 9, 11, 12, None}


def test_many_small_tables_find_the_same(spark, monkeypatch):
    docs, items = _tables(spark)
    want = sorted(map(repr, decontamination.hits(docs, items).collect()))
    monkeypatch.setattr(decontamination, "TABLE_WINDOWS", 2)
    assert sorted(map(repr, decontamination.hits(docs, items).collect())) == want


def test_removal(spark):
    docs, items = _tables(spark)
    docs = docs.selectExpr("*", "'x' as key", "1 as n_hit", "2 as spans")
    left = decontamination.without_documents(docs, items).collect()
    assert sorted(r["doc_id"] for r in left) == [1, 2, 3, 7, 13] and left[0].asDict().keys() == set(docs.columns)
    cut = {(r["doc_id"], r["text"]) for r in decontamination.without_spans(docs, items).collect()}
    assert (4, "pre " + " " * 11 + ". post") in cut and (3, DOCS[2][1]) in cut and (1, None) in cut and len(cut) == len(set(DOCS))


def test_no_rows(spark):
    docs, items = _tables(spark)
    assert decontamination.hits(docs.limit(0), items).count() == 0
    assert decontamination.hits(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.without_documents(docs, items.limit(0)).count() == len(DOCS)
