"""What single notices and properties say, as expressions and windows: keys, versions, sources, type and place of an estate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import fixed as X
from ..functions.regions import district_region, town_region
from ..functions.text import norm_key

#: Columns that are no part of a notice's content.
NOT_CONTENT = ("fetched_at", "versioned_at", "first_seen")


def group_key() -> Column:
    """Key of the auction that a notice names: its case, or itself; for executions also the first property's unit and folios."""
    case = F.coalesce(F.nullif("case_key", F.lit("")), F.concat_ws("|", "source", "source_id"))
    first = F.try_element_at(F.coalesce("properties", F.array()), F.lit(1))
    folios = F.array_join(F.array_sort(F.coalesce(first["lv"], F.array())), ",")
    return F.when(F.col("kind") == "exekucna", F.concat_ws("|", case, norm_key(first["ku"]), folios)).otherwise(case)


def compatible(a: str, n: str) -> Column:
    """Whether sides `a` and `n` can be one auction: not with two times on one day under two numbers."""
    at = lambda side: F.coalesce(F.col(f"{side}.auction_at"), F.lit(""))
    number = lambda side: norm_key(F.col(f"{side}.auction_number"))
    at_odds = lambda x, y: (x != "") & (y != "") & (x != y)
    same_day = (F.substring(at(a), 1, 10) != "") & (F.substring(at(a), 1, 10) == F.substring(at(n), 1, 10))
    return ~(same_day & at_odds(F.substring(at(a), 12, 5), F.substring(at(n), 12, 5)) & at_odds(number(a), number(n)))


def content_hash(notices: DataFrame) -> Column:
    """24 hex digits over a notice's content, its columns in order of their names."""
    own = sorted(c for c in notices.columns if c not in NOT_CONTENT and not c.startswith("_"))
    return F.substring(F.sha2(F.to_json(F.struct(*own)), 256), 1, 24)


def versions(notices: DataFrame, *order: Column) -> DataFrame:
    """`notices` with `content_hash` and `result`: new, changed or the same as the version before it in `order`."""
    line = Window.partitionBy("source", "source_id").orderBy(*order)
    hashed = notices.withColumn("content_hash", content_hash(notices)).withColumn("_before", F.lag("content_hash").over(line))
    result = F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col("content_hash"), "same").otherwise("changed")
    return hashed.withColumn("result", result).drop("_before")


def sources(notices: DataFrame, key: str = "group_key") -> DataFrame:
    """(key, source, label, url, notice_type, published_at): what an auction was told by, each label and address once, by its first notice."""
    at = F.struct(F.coalesce("published_at", F.lit("")).alias("day"), (F.col("source") != "ov").alias("later"), F.col("source_id").cast("string").alias("id"))
    entry = F.struct("source", "notice_type", "published_at")
    first = notices.groupBy(key, F.col("source_label").alias("label"), F.col("source_url").alias("url")).agg(F.min_by(entry, at).alias("e"))
    return first.select(key, "e.source", "label", "url", "e.notice_type", "e.published_at")


def main_type(types: Column) -> Column:
    """The first type of the order of priority that occurs."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, X.TYPE_PRIORITY)), lambda t: F.array_contains(types, t)), F.lit(1))


def place(properties: Column) -> Column:
    """(property_type, kraj, okres, obec, ku) of an estate: the first property that has a town or unit says where it is; null without properties."""
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    p = F.coalesce(F.try_element_at(F.filter(properties, lambda x: named(x["obec"]) | named(x["ku"])), F.lit(1)), F.try_element_at(properties, F.lit(1)))
    kraj = F.coalesce(F.nullif(p["kraj"], F.lit("")), district_region(p["okres"]), town_region(p["obec"]))
    kinds = F.coalesce(F.filter(F.transform(properties, lambda x: x["type"]), lambda t: named(t)), F.array())
    found = F.struct(main_type(kinds).alias("property_type"), kraj.alias("kraj"), p["okres"].alias("okres"), p["obec"].alias("obec"), p["ku"].alias("ku"))
    return F.when(F.size(properties) > 0, found)
