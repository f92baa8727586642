"""The library's scalar functions under SQL names, for `spark.sql` and notebooks.

All are SQL functions, which the optimizer sees through: short ones are written here, the others take the text of the
Column functions' expressions, so that a query by name plans like one in Python, without UDFs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from .. import fixed as X
from . import regions, text

#: name: (parameters, result type, SQL)
PLAIN = {
    "public_id": ("group_key STRING", "STRING", "substring(sha1(group_key), 1, 10)"),
    "whole_euros": ("amount DOUBLE", "BIGINT", "CAST(bround(amount) AS BIGINT)"),
    "discount": ("price DOUBLE, value DOUBLE", "DOUBLE", "CASE WHEN price <> 0 AND value > price THEN 1 - price / value ELSE 0.0D END"),
    "company_id": ("written STRING", "STRING", r"CASE WHEN regexp_like(regexp_replace(written, '(?U)\\s', ''), '^\\d{6,8}$') THEN regexp_replace(written, '(?U)\\s', '') END"),
    "effective_status": ("status STRING, auction_at STRING, today DATE", "STRING", "CASE WHEN coalesce(status, 'pripravovana') IN ('pripravovana', 'odrocena') AND try_to_date(substring(auction_at, 1, 10), 'yyyy-MM-dd') < today THEN 'prebehla' ELSE coalesce(status, 'pripravovana') END"),
}
#: name: (expression over one text, result type)
WRITTEN: dict[str, tuple[Callable[[Column], Column], str]] = {
    "norm_key": (text.norm_key, "STRING"), "parse_money": (text.parse_money, "DOUBLE"), "parse_time": (text.parse_time, "STRING"), "parse_round": (text.parse_round, "INT"),
    "parse_date": (lambda c: text.parse_date(c).cast("string"), "STRING"), "property_type": (text.property_type, "STRING"), "redact_personal": (text.redact, "STRING"),
    "html_to_text": (text.html_to_text, "STRING"), "valid_place": (text.valid_place, "BOOLEAN"), "normalize_district": (regions.normalize_district, "STRING"), "town_region": (regions.town_region, "STRING"),
}


def body(spark: SparkSession, f: Callable[[Column], Column]) -> str:
    """The SQL of an expression over a column `written`; one with lambdas has no text that can be read back."""
    frame = spark.range(1).select(F.lit("").alias("written")).select(f(F.col("written")).alias("r"))
    return frame._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; gives their names."""
    told = dict(PLAIN) | {name: ("written STRING", result, body(spark, f)) for name, (f, result) in WRITTEN.items()}
    skipped = ", ".join(f"'{w}'" for w in X.EXECUTOR_WORDS)
    told["executor_key"] = ("written STRING", "STRING", f"array_join(array_sort(filter(split({told['norm_key'][2]}, ' '), w -> w <> '' AND w NOT IN ({skipped}))), ' ')")
    for name, (parameters, result, sql) in told.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {sql}")
    return list(told)
