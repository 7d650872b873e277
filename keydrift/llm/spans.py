"""Places of regular expression matches, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def empty(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches as (start, end, value), in code points, end exclusive.

    Splitting gives what stands between them, so places are running sums of lengths. They are summed in blocks, which
    keeps the work near linear in the number of matches of a text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    step = "struct<gap:int,len:int,value:string>"
    steps = F.zip_with(found, F.slice(between, F.lit(1), F.greatest(F.size(found), F.lit(0))), lambda m, g: F.struct(
        F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("value"))).cast(f"array<{step}>")

    def inner(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), (start + s["len"]).alias("end"), s["value"].alias("value"))
        return F.struct((start + s["len"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["at"].alias("at"), empty().alias("out")), inner)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def placed(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda k: F.slice(s, k * BLOCK + 1, BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        return F.aggregate(blocks, start, outer, lambda a: F.flatten(a["out"]))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(steps, placed)).otherwise(empty())


def tagged(spans: Column, kind: str, order: int) -> Column:
    """(start, ord, kind, end, value): sorts by place, then by the kind's order."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
