"""Stored payloads as variants: typed fields out of JSON whose shape has changed over the years.

A field may be missing, hold text where a number is expected (amounts as people write them), or one object in place of a
list. What can't be read as the type asked for is null; a payload that is no JSON object has null fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType

from .. import schema as S
from .text import parse_money


def field(payload: Column, path: str, kind: DataType) -> Column:
    """The value at a path of a variant as `kind`: amounts from text too, lists also from a lone element."""
    got = lambda k: F.try_variant_get(payload, path, k)
    if isinstance(kind, DoubleType):
        text = got("string")
        # a number in text that isn't a plain one is an amount with a currency, or nothing
        return F.coalesce(got("double"), F.when(text.rlike(r"^\s*\d") & ~text.rlike(r"[{}\[\]]"), parse_money(text)))
    if isinstance(kind, ArrayType):
        return F.coalesce(got(kind.simpleString()), F.array_compact(F.array(got(kind.elementType.simpleString()))))
    return got(kind.simpleString())


def notices(stored: DataFrame, column: str = "payload") -> DataFrame:
    """Typed notices of stored payloads, with the columns source and source_id that name them."""
    fields = [f for f in S.struct(S.NOTICE).fields if f.name not in ("source", "source_id")]
    parsed = stored.select("source", "source_id", F.try_parse_json(column).alias("_v"))
    read = {f.name: field(F.col("_v"), f"$.{f.name}", f.dataType) for f in fields}
    return parsed.select("source", "source_id", *[F.when(F.size(c) > 0, c).alias(n) if n == "documents" else c.alias(n) for n, c in read.items()])
