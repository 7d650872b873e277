import re

import duckdb

from keydrift.corpus import queries

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle_that_runs():
    con = duckdb.connect()
    for table in ("orders", "customer", "documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert set(queries.ORACLE) == set(queries.QUERIES)
    for name, sql in queries.ORACLE.items():
        assert con.execute(f"SELECT count(*) FROM ({sql}) q").fetchall()[0][0] > 0, name


def test_queries_match_their_oracle(spark):
    """A few cheap ones; ``check.py`` runs them all."""
    con = duckdb.connect()
    for table in ("orders", "customer", "documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name in ("parse_definitions", "extract_usages", "missing", "unused"):
        df = queries.QUERIES[name](spark, SF)
        result = con.execute(queries.ORACLE[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted(map(str, result.fetchall()))
        assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want, name


def test_no_query_limits_its_tables():
    for name, sql in queries.ORACLE.items():
        assert not re.search(r"\bLIMIT\b|\bSAMPLE\b", sql, re.I), name
