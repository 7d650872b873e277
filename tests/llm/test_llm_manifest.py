import zlib
from hashlib import sha256

import duckdb
import pytest

from keydrift.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def plain(rows):
    """The contract, row by row."""

    def h(parts):
        return sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
        return h(fields)

    def lower(row):
        text = row[4]
        return (*row[:4], None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, i, node, proof):
        for level in levels[:-1]:
            first = i - i % 8
            left, right = level[first:i], level[i + 1 : first + 8]
            proof += left + right
            node = h([*left, node, *right])
            i //= 8
        return node, proof

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node, proof = climb(trees[g], i, leaf(lower(r) if chosen else r), [])
            node, proof = climb(top, k, node, proof)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(map(repr, out))


def rows_of(n, langs):
    return [(k * 7 % 1013 - 5, f"s{k % 3}", langs[k % len(langs)], k, f"Text Ä {k}" if k % 4 else "lower only") for k in range(n)]


CASES = {
    "one": [(3, "s", "en", 1, "A")],
    "odd": [(1, None, None, None, None), (1, None, None, None, None), (None, "s", "", 0, ""), (None, "s", "", 0, "B"), (2, "s", "é", 1, "x" * 300_000 + "Y")],
    "runs": rows_of(65, ["en"]),
    "pieces": rows_of(700, ["en", "en", "de", None]),
    "languages": rows_of(90, [f"l{k}" for k in range(20)]),
}


@pytest.mark.parametrize("case", CASES)
def test_every_row_against_the_contract(spark, case):
    rows = CASES[case]
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA))
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows)


def test_pieces_of_other_heights_give_the_same_tree(spark, monkeypatch):
    rows = CASES["pieces"]
    monkeypatch.setattr(manifest.cuts, "__defaults__", (1,))
    monkeypatch.setattr(manifest, "PART_ROWS", 40)
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows)


def test_sql_says_the_same():
    rows = CASES["pieces"] + CASES["odd"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(map(repr, con.execute(manifest.SQL).fetchall())) == plain(rows)


def test_no_rows_and_clashing_columns(spark):
    rows = [(*r, 1, b"x", "y", 2) for r in rows_of(20, ["en", "de"])]
    docs = spark.createDataFrame(rows, SCHEMA + ", idx long, leaf binary, grp string, n int")
    assert sorted(repr(tuple(r)) for r in manifest.manifest(docs).collect()) == plain([r[:5] for r in rows])
    assert manifest.manifest(docs.limit(0)).collect() == []


def test_layout_is_recursive():
    # three levels: the root alone, then each subtree of two levels in one stretch
    root, middle, leaves = manifest.places(3)
    assert root.tolist() == [0] and middle.tolist() == [1 + 9 * k for k in range(8)]
    assert leaves[:9].tolist() == [2, 3, 4, 5, 6, 7, 8, 9, 11]
    for levels in range(1, 6):
        all_places = sorted(int(p) for level in manifest.places(levels) for p in level)
        assert all_places == list(range(manifest.n_nodes(levels)))
    assert manifest.cuts(10) == [3, 2, 3, 2] and sum(manifest.cuts(14)) == 14
