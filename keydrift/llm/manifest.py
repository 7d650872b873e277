"""Merkle manifest of a dataset: one hash tree for each language, a tree over their roots, and every row's proof.

Nodes have up to ``FANOUT`` children. A tree is cut into aligned subtrees by halving its height again and again until a
piece has at most ``BLOCK_HEIGHT`` levels of edges (the van Emde Boas recursion). A piece is one row of a table; inside
it the recursion goes on as an address rule: ``places`` says where in the row's array a node of some level stands, and both
construction and the retrieval of siblings read and write through it. The roots of one table's pieces are the leaves of the
next table's, so each table is built by one grouping of at most ``FANOUT ** BLOCK_HEIGHT`` rows a group, whatever a
language's size. Proofs come down the same way: the siblings above a piece are found once for all rows below it.

Texts are hashed where they are read and never shuffled; rows are numbered within their language by a range partitioning
whose parts are counted, so that a language may hold any share of all rows.

Defined cases: null columns are leaves' ``-``; a null doc_id comes first in its language and is never tampered with; a null
lang is a language of its own, the first; rows of one doc_id are ordered by leaf, and equal rows are leaves each; a lone
leaf is its subroot, a lone language's subroot is the root; a proof without siblings is the hash of nothing; an empty table
gives no rows; further columns, whatever their names, are not read. Texts may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keydrift.llm import tables

FANOUT = 8
#: Levels of edges of the tallest subtree kept in one row: 512 leaves, 585 nodes, 19 KB.
BLOCK_HEIGHT = 3
#: Rows of one part of the range partitioning.
PART_ROWS = 200_000
FIELDS = "doc_id source lang n_chars text".split()
ABOVE = "array<struct<left:string,right:string>>"


# ---------------------------------------------------------------- addresses


def cuts(height: int, tallest: int = BLOCK_HEIGHT) -> list[int]:
    """The heights of the pieces of a tree, the lowest first: halved until none is taller than ``tallest``."""
    if height <= tallest:
        return [height]
    low = (height + 1) // 2
    return cuts(low, tallest) + cuts(height - low, tallest)


def n_nodes(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


@lru_cache(maxsize=64)
def places(levels: int) -> list[np.ndarray]:
    """For each level, the root's first, where its nodes stand in the layout: the upper half of the levels as one tree,
    then each tree that hangs below it, all of them laid out by the same rule."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    upper = levels // 2
    top, low = places(upper), places(levels - upper)
    starts = n_nodes(upper) + n_nodes(levels - upper) * np.arange(FANOUT**upper)
    return [*top, *((starts[:, None] + level[None, :]).ravel() for level in low)]


def height_of(n: int) -> int:
    """Levels of edges of a tree with n leaves."""
    height = 0
    while FANOUT**height < n:
        height += 1
    return height


def digest(parts: list[bytes]) -> bytes:
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def laid_out(leaves: list[bytes], height: int) -> list[bytes | None]:
    """A subtree's nodes by their places; leaves missing at its end are None, and so is what has none below."""
    at = places(height + 1)
    nodes: list[bytes | None] = [None] * n_nodes(height + 1)
    for place, leaf in zip(at[height], leaves, strict=False):
        nodes[place] = leaf
    n = len(leaves)
    for level in range(height - 1, -1, -1):
        n = -(-n // FANOUT)
        for i in range(n):
            below = [nodes[p] for p in at[level + 1][FANOUT * i : FANOUT * (i + 1)]]
            nodes[at[level][i]] = digest([b for b in below if b is not None])
    return nodes


def siblings(nodes: list[bytes | None], height: int, leaf: int) -> list[dict[str, str]]:
    """What stands left and right of a leaf and of each node above it, the lowest level first."""
    at, found = places(height + 1), []
    for level in range(height, 0, -1):
        first = leaf - leaf % FANOUT
        run = [nodes[p] for p in at[level][first : first + FANOUT]]
        k = leaf - first
        found.append({
            "left": "".join(b.hex() for b in run[:k]),
            "right": "".join(b.hex() for b in run[k + 1 :] if b is not None),
        })
        leaf //= FANOUT
    return found


def folded(leaf: bytes, above: list[dict[str, str]]) -> bytes:
    """The root that a leaf gives with its siblings."""
    node = leaf
    for level in above:
        node = sha256((level["left"] + node.hex() + level["right"]).encode()).digest()
    return node


# ---------------------------------------------------------------- leaves and their numbers


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(source: dict[str, Column]) -> Column:
    """The hash of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(_field(source[c]) for c in FIELDS)).cast("binary"), 256))


def group_of(lang: Column) -> Column:
    """A key that tells null from every name and sorts it first, names by their bytes."""
    return F.coalesce(F.concat(F.lit("1"), lang.cast("string")), F.lit("0"))


def hashed(docs: DataFrame) -> DataFrame:
    """grp, doc_id, leaf and, for the rows to tamper with, the leaf of the text in lower case."""
    columns = {c: F.col(f"`{c}`") for c in FIELDS}
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = leaf_of(columns | {"text": F.translate(columns["text"], upper, lower)})
    chosen = F.crc32(columns["doc_id"].cast("string").cast("binary")) % 3 == 0
    return docs.select(
        group_of(columns["lang"]).alias("grp"), columns["doc_id"].alias("doc_id"), leaf_of(columns).alias("leaf"),
        F.when(chosen, tampered).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``idx``, their gapless number from 0 in their ``grp``, and ``n``, the rows of that group.

    Parts of a range partitioning are written with their numbers; the rows of a group in the parts before one are a
    running sum over one row per part and group. Among rows equal in ``order`` any order gives the same tree; a running
    id lets the partitioning cut between them.
    """
    parts = tables.cut_buckets(rows, PART_ROWS)
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, "grp", *order, "_tie")
    cut = tables.stored(spread.withColumn("part", F.spark_partition_id()))
    of_group = Window.partitionBy("grp")
    counts = (
        cut.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(of_group.orderBy("part")) - F.col("_n"))
        .withColumn("n", F.sum("_n").over(of_group)).drop("_n")
    )
    within = Window.partitionBy("grp", "part").orderBy(*order, "_tie")
    placed = cut.withColumn("_row", F.row_number().over(within))
    # merged on the window's own keys: no further shuffle of the rows
    joined = placed.join(counts.hint("merge"), ["grp", "part"])
    return joined.withColumn("idx", F.col("_before") + F.col("_row") - 1).drop("_before", "_row", "part", "_tie")


# ---------------------------------------------------------------- trees

_SIBLINGS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _pieces(rows: DataFrame, height: int, members: list[str]) -> DataFrame:
    """grp, piece, height, n, members, nodes: one row for each subtree of ``height`` above the given leaves
    (grp, idx, n, leaf); a group whose tree ends below that height has a smaller subtree."""
    width = FANOUT**height
    kept = F.struct("idx", "leaf", *members)
    grouped = rows.groupBy("grp", F.expr(f"idx div {width}").alias("piece")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(kept)).alias("members"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights, nodes = [], []
            for n, found in zip(batch.column("n").to_pylist(), batch.column("members"), strict=True):
                own = min(height, height_of(n))
                heights.append(own)
                nodes.append(laid_out(found.values.field("leaf").to_pylist(), own))
            columns = [*batch.columns, pa.array(heights, pa.int32()), pa.array(nodes, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "height", "nodes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema)
    return grouped.mapInArrow(build, f"{schema}, height int, nodes array<binary>")


def planted(rows: DataFrame, members: list[str]) -> list[DataFrame]:
    """The written tables of all groups' trees, the lowest pieces first; ``rows`` as ``numbered`` gives them, with
    ``leaf``. The last table has one piece for each group, whose first node is the group's root."""
    largest = rows.agg(F.max("n")).first()[0] or 0
    found = []
    for height in cuts(height_of(largest)):
        found.append(tables.stored(_pieces(rows, height, members)))
        width = FANOUT**height
        # the root stands first in every layout
        rows = found[-1].select("grp", F.col("piece").alias("idx"), F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("nodes")[0].alias("leaf"))
        members = []
    return found


def roots(trees: list[DataFrame]) -> DataFrame:
    """grp and root of each group."""
    return trees[-1].select("grp", F.col("nodes")[0].alias("leaf"))


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grp, piece, root, above = [], [], [], []
        for r in batch.to_pylist():
            for k, m in enumerate(r["members"]):
                grp.append(r["grp"])
                piece.append(m["idx"])
                root.append(r["subroot"])
                above.append(siblings(r["nodes"], r["height"], k) + r["above"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(grp, pa.string()), pa.array(piece, pa.int64()), pa.array(root, pa.binary()), pa.array(above, _SIBLINGS)],
            ["grp", "piece", "subroot", "above"],
        )


def above_pieces(trees: list[DataFrame], above_roots: DataFrame) -> DataFrame:
    """grp, piece, subroot, above: the siblings above each lowest piece up to the root of all; ``above_roots`` has
    (grp, subroot, above) of each group."""
    found = above_roots.withColumn("piece", F.lit(0).cast("long"))
    for table in reversed(trees[1:]):
        met = table.join(found, ["grp", "piece"])
        found = met.mapInArrow(_handed_down, f"grp string, piece long, subroot binary, above {ABOVE}")
    return found


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pa.concat_arrays([m.values.field("doc_id") for m in batch.column("members")]) if len(batch) else batch.column("members").values.field("doc_id")
        leaf, subroot, proof, root = [], [], [], []
        for r in batch.select(["members", "nodes", "height", "subroot", "above"]).to_pylist():
            for k, m in enumerate(r["members"]):
                above = siblings(r["nodes"], r["height"], k) + r["above"]
                leaf.append(m["leaf"].hex())
                subroot.append(r["subroot"].hex())
                proof.append(sha256("".join(a["left"] + a["right"] for a in above).encode()).hexdigest())
                root.append(folded(m["tampered"] or m["leaf"], above).hex())
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.string()) for x in (leaf, subroot, proof, root))], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = numbered(tables.stored(hashed(docs)), ["doc_id", "leaf"])
    trees = planted(rows, ["doc_id", "tampered"])
    # the languages' roots, by name, are the leaves of one more tree
    named = roots(trees).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "leaf")
    top = planted(numbered(named, ["name"]), ["name"])
    last = roots(top).first()
    root = F.lit(last["leaf"].hex() if last else None).cast("string")
    nothing = docs.sparkSession.range(1).select(F.lit("").alias("grp"), F.lit(None).cast("binary").alias("subroot"), F.array().cast(ABOVE).alias("above"))
    lowest = top[0].join(above_pieces(top, nothing).drop("subroot"), ["grp", "piece"])

    def named_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(m["name"], m["leaf"], siblings(r["nodes"], r["height"], k) + r["above"]) for r in batch.to_pylist() for k, m in enumerate(r["members"])]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.binary(), _SIBLINGS))]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "subroot", "above"])

    above_roots = lowest.mapInArrow(named_paths, f"grp string, subroot binary, above {ABOVE}")
    met = trees[0].join(above_pieces(trees, above_roots), ["grp", "piece"])
    proved = met.mapInArrow(_proved, f"doc_id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proved.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(tables.table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- SQL

SQL_LEVELS = 9  # of each of the two trees: 8 ** 9 rows of a language


def _sql_tree(name: str, leaves: str, levels: int = SQL_LEVELS) -> str:
    """CTEs: ``{name}0`` (g, i, n, h) from ``leaves`` (g, i, h), and each level above; a group stops at one node."""
    found = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(levels):
        found.append(f"""{name}{k + 1} AS (
  SELECT g, i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
         (max(n) + 7) // 8 AS n
  FROM {name}{k} GROUP BY g, i // 8)""")
    return ",\n".join(found)


def _sql_climb(name: str, start: str, tree: str, levels: int = SQL_LEVELS) -> str:
    """CTEs that carry (r, g, i, proof, fold) of ``start`` from a tree's leaves to its roots."""
    found, before = [], start
    for k in range(levels):
        found.append(f"""{name}{k + 1} AS (
  SELECT c.r, c.g, c.i // 8 AS i,
         proof || CASE WHEN s.n = 1 THEN '' ELSE left(run, 64 * (c.i % 8)) || substr(run, 64 * (c.i % 8) + 65) END AS proof,
         CASE WHEN s.n = 1 THEN fold ELSE sha256(left(run, 64 * (c.i % 8)) || fold || substr(run, 64 * (c.i % 8) + 65)) END AS fold
  FROM {before} c JOIN (SELECT g, i // 8 AS p, max(n) AS n, string_agg(h, '' ORDER BY i) AS run FROM {tree}{k} GROUP BY g, i // 8) s
    ON s.g = c.g AND s.p = c.i // 8)""")
        before = f"{name}{k + 1}"
    return ",\n".join(found)


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC32 bit by bit: a byte is mixed in, then eight steps of the shift register follow.
_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END))"""

SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS g,
         sha256({" || ".join(_sql_field(c) for c in FIELDS)}) AS leaf,
         sha256({" || ".join(_sql_field(_LOWER if c == "text" else c) for c in FIELDS)}) AS lower_leaf,
         doc_id IS NOT NULL AND {_CRC} % 3 = 0 AS chosen
  FROM documents
), leaves AS (
  SELECT r, g, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
),
{_sql_tree("a", "leaves")},
subroots AS (SELECT g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i, '' AS g FROM a{SQL_LEVELS}),
{_sql_tree("b", "subroots")},
c0 AS (SELECT r, l.g, l.i, '' AS proof, CASE WHEN chosen THEN lower_leaf ELSE leaf END AS fold FROM leaves l JOIN d USING (r)),
{_sql_climb("c", "c0", "a")},
e0 AS (SELECT c.r, s.g, s.i, c.proof, c.fold FROM c{SQL_LEVELS} c JOIN subroots s ON s.name = c.g),
{_sql_climb("e", "e0", "b")}
SELECT d.doc_id, d.leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root, e.fold = t.h AS verified
FROM e{SQL_LEVELS} e JOIN d USING (r) JOIN subroots s ON s.name = d.g CROSS JOIN b{SQL_LEVELS} t
"""
