"""YAML as array expressions: content -> array of (yaml_path, value, quoted, named, ...) leaves, and what a scalar's text means.

A stack of open collections, anchors and aliases is no regular language and no fold of small state; one Arrow function
reads a text's nodes in one pass (``functions.yaml_nodes``). Only YAML files reach it: it gets null for all others, and a
file's text never leaves its task. Types of scalars are expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from keydrift.functions import yaml_nodes as nodes

ITEM = nodes.ITEM
_LEAVES = ArrayType(
    StructType(
        [
            StructField("yaml_path", ArrayType(StringType())),
            StructField("value", StringType()),
            StructField("quoted", BooleanType()),
            StructField("named", BooleanType()),
            StructField("collection", BooleanType()),
        ]
    )
)
_NAMES = ("yaml_path", "value", "quoted", "named", "collection")
_KINDS = (pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
_ARROW = pa.list_(pa.struct(list(zip(_NAMES, _KINDS, strict=True))))


def leaves(content: Column | None = None, whole: int | None = None) -> Column:
    """All leaves of a text (column ``content``) in document order; none when it is null or not valid YAML. With ``whole``,
    a collection at a path of that length is one leaf."""

    def read(contents: pa.Array) -> pa.Array:
        found = (nodes.leaves(text, whole) if text else [] for text in contents.to_pylist())
        return pa.array([[dict(zip(_NAMES, leaf, strict=True)) for leaf in leaves] for leaves in found], _ARROW)

    return F.arrow_udf(read, _LEAVES)(F.col("content") if content is None else content)


# ------------------------------------------------------------- plain scalars

_NULL, _BOOL, _INT, _RADIX = (f"^{x}$" for x in (nodes.NULL, nodes.BOOL, nodes.INT, nodes.RADIX))
_FLOAT, _SPECIAL, _DATE, _TIME = (f"^{x}$" for x in (nodes.FLOAT, nodes.SPECIAL, nodes.DATE, nodes.TIME))


def is_string(value: Column, quoted: Column) -> Column:
    """Whether a scalar is a string: quoted, or plain and of no other type."""
    typed = value.rlike("|".join((_NULL, _BOOL, _INT, _RADIX, _FLOAT, _SPECIAL, _DATE, _TIME)))
    return quoted | ~typed


def scalar_text(value: Column, quoted: Column) -> Column:
    """Any scalar as text, the way its typed value prints."""
    digits = F.replace(value, F.lit("_"), F.lit(""))
    sign = F.when(value.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.lower(F.regexp_replace(digits, r"^[-+]?0", ""))
    radix = (
        F.when(body.startswith("x"), F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10))
        .when(body.startswith("b"), F.conv(F.substring(body, F.lit(2), F.length(body)), 2, 10))
        .otherwise(F.conv(F.regexp_replace(body, "^o", ""), 8, 10))
    )
    number = F.regexp_replace(value, r"^\+", "").try_cast("double")
    decimal = F.regexp_replace(F.regexp_replace(number.try_cast("decimal(38,17)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    special = (
        F.when(F.lower(value).contains("nan"), F.lit("NaN")).when(value.startswith("-"), F.lit("-Inf")).otherwise(F.lit("+Inf"))
    )
    return (
        F.when(quoted, value)
        .when(value.rlike(_NULL), F.lit("<nil>"))
        .when(value.rlike(_BOOL), F.lower(value))
        .when(value.rlike(_INT), F.regexp_replace(digits, r"^\+|^-(?=0$)", ""))
        .when(value.rlike(_RADIX), F.concat(sign, radix))
        .when(value.rlike(_FLOAT), F.coalesce(decimal, value))
        .when(value.rlike(_SPECIAL), special)
        .when(
            value.rlike(_DATE),
            F.concat_ws(
                "-",
                F.regexp_extract(value, _DATE, 1),
                F.lpad(F.regexp_extract(value, _DATE, 2), 2, "0"),
                F.concat(F.lpad(F.regexp_extract(value, _DATE, 3), 2, "0"), F.lit(" 00:00:00 +0000 UTC")),
            ),
        )
        .otherwise(value)
    )
