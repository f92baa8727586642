"""Regions and districts as map literals and as a dimension table."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed as X
from .text import fold_case, lookup

DISTRICTS = {name: region for region, names in X.REGIONS.items() for name in names}
ROMAN = {"1": "i", "2": "ii", "3": "iii", "4": "iv", "5": "v"}


def plain_key(name: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    return " ".join(bare.replace("-", " ").replace("okres ", "").replace("okolie", " okolie").split())


BY_KEY = {plain_key(name): name for name in DISTRICTS}


def district(name: str | None) -> str | None:
    """Official district name of any spelling; null where it is ambiguous or unknown."""
    key = plain_key(name or "")
    town, _, number = key.rpartition(" ")
    return BY_KEY.get(key) or (BY_KEY.get(f"{town} {ROMAN[number]}") if number in ROMAN and " " not in town else None)


def region_of_district(name: str | None) -> str | None:
    return DISTRICTS.get(district(name))


def region_of_town(name: str | None) -> str | None:
    """Region of a town that shares its name with a district, or of the two cities with several districts."""
    key = plain_key(name or "")
    if key.startswith("bratislava"):
        return "Bratislavský kraj"
    if key.startswith("kosice") and "okolie" not in key:
        return "Košický kraj"
    return region_of_district(name)


def district_key(c: Column) -> Column:
    bare = F.replace(F.replace(F.replace(fold_case(c), F.lit("-"), F.lit(" ")), F.lit("okres "), F.lit("")), F.lit("okolie"), F.lit(" okolie"))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def normalize_district(c: Column) -> Column:
    key = district_key(c)
    numbered = F.when(key.rlike(r"^\S+ [1-5]$"), F.concat(F.substring_index(key, " ", 1), F.lit(" "), lookup(ROMAN, F.substring_index(key, " ", -1))))
    return F.coalesce(lookup(BY_KEY, key), lookup(BY_KEY, numbered))


def district_region(c: Column) -> Column:
    return lookup(DISTRICTS, normalize_district(c))


def town_region(c: Column) -> Column:
    key = district_key(c)
    return F.when(key.startswith("bratislava"), "Bratislavský kraj").when(key.startswith("kosice") & ~F.contains(key, F.lit("okolie")), "Košický kraj").otherwise(district_region(c))


def code_region(c: Column) -> Column:
    """Region of a municipality code, by its first five characters."""
    return lookup(X.NUTS3, F.substring(c, 1, 5))


def districts(spark: SparkSession) -> DataFrame:
    """Dimension okres, okres_key, kraj; 79 rows, so it may always be broadcast."""
    return spark.createDataFrame([(n, plain_key(n), r) for n, r in DISTRICTS.items()], "okres string, okres_key string, kraj string")
