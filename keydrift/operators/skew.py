"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a group from which it is cut into parts. The option changes the plan only, never the result.
HOT_ROWS = 1_000_000


def hot_groups(counts: DataFrame, keys: Sequence[str], n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every group of more than ``hot_rows`` rows and the number of parts it is split into.

    ``counts`` has one row per group. There is at most one such group for every
    ``hot_rows`` rows counted, twelve bytes each, which bounds what is broadcast:
    a million entries for 10^12 rows. Groups are named by a hash: a collision
    only splits a group that did not need it.
    """
    parts = F.ceil(F.max(n) / hot_rows).cast("int")
    heavy = counts.filter(F.col(n) > hot_rows).groupBy(F.xxhash64(*keys).alias("_group"))
    return heavy.agg(parts.alias("_parts"))


def spread_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str | Column],
    hot: DataFrame,
) -> DataFrame:
    """Join ``many`` with ``one`` (unique on ``on``), hot groups cut into parts.

    Rows of a hot group go to parts by the hash of ``spread_by``; the matching
    row of ``one`` is copied to every part. No row is dropped or repeated.
    """
    hot = F.broadcast(hot)

    def with_parts(df: DataFrame) -> DataFrame:
        tagged = df.withColumn("_group", F.xxhash64(*on)).join(hot, "_group", "left").drop("_group")
        return tagged.withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    left = with_parts(many).withColumn("_part", F.pmod(F.xxhash64(*spread_by), F.col("_parts")).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    right = with_parts(one).withColumn("_part", copies)
    return left.drop("_parts").join(right.drop("_parts"), [*on, "_part"], how).drop("_part")
