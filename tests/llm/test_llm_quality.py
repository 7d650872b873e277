import duckdb
import pytest

from keydrift.llm import quality

CLEAN = " ".join(f"the word{k} and thing{k * 7 % 31} of place{k * 5 % 37}" for k in range(20))
TEXTS = [
    None, "", " \t\n", "few words only", CLEAN, CLEAN + "\n" + CLEAN, "the same three " * 40, ("# " + CLEAN).replace(" ", " ### "),
    CLEAN.upper(), "\n".join(["the line of text"] * 30), CLEAN + "\n\n" + "x" * 5000, "é ü ß " * 30,
]


def test_counts_match_the_oracle(spark):
    rows = [(k % 9, t) for k, t in enumerate(TEXTS)] + [(4, CLEAN)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    result = con.execute(quality.SQL)
    columns = [d[0] for d in result.description]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, result.fetchall()))


def test_repeats_by_hand(spark):
    def repeats(text):
        return quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_repeat_words"]

    assert repeats("a b c d e f") == 0
    assert repeats("a b c x a b c") == 6
    assert repeats("a a a a") == 4
    assert repeats("a b a b a b") == 6
    assert repeats("a b") == 0


def test_verdicts(spark):
    docs = spark.createDataFrame([(1, CLEAN), (2, CLEAN.upper()), (3, None), (4, CLEAN.replace("the", "##"))], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, CLEAN, 5, "k", "w")], "doc_id long, text string, n_words int, kept string, row string")
    assert quality.accepted(docs).collect() == docs.collect()
    assert quality.judge(docs).first()["n_words"] == 120
    assert quality.accepted(docs.limit(0)).count() == 0


def test_a_rule_is_a_row_of_the_table(spark):
    docs = spark.createDataFrame([(1, CLEAN)], "doc_id long, text string")
    assert quality.accepted(docs, (quality.Rule("short", "n_words", most=10),)).count() == 0
    with pytest.raises(KeyError):
        quality.failed((quality.Rule("none", "no such measure", least=1),))
