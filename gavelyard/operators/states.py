"""The state of auctions after all their notices, as aggregates that can be merged.

Where it is known which auction a notice is of, a state in order of publication needs no walk through the notices:

- A status is set by the last notice that closes or postpones the auction, whatever was before it; an announcement after
  that one opens it again, if it is not closed for good. So two positions and a value say it all, and partial results
  of any two stretches of notices merge.
- A field has the value of the last notice that may overwrite it, else the first value that any notice gave. A notice
  may overwrite if no better source has told of the auction before.

Only two things depend on what was before a notice: the best source so far, and the day of auction that a postponement
changes. Both are prefix scans in two levels: first what each day's notices contribute, then the scan over days, then the
scan within a day. So no task needs all notices of an auction, however many it has.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import fixed as X
from ..functions.text import lookup

#: Fields that a notice of the type leaves alone once the auction has a value.
_LEFT_ALONE = ("title", "description", "min_bid", "appraised_value", "round")
_FINAL = tuple(X.STATUS_BY_NOTICE)
_REOPENED = ("pripravovana", "prebehla", "zmarena")


def _has(df: DataFrame, field: str) -> Column:
    c = F.col(field)
    return c.isNotNull() & (c != "") if dict(df.dtypes)[field] == "string" else c.isNotNull()


def _overwrites(df: DataFrame, field: str) -> Column:
    """The notice gives a value that it may put in the place of another."""
    kind = F.coalesce("notice_type", F.lit(""))
    kept = kind.isin(*_FINAL) & F.lit(field in (*_LEFT_ALONE, "auction_at")) | (kind == "dodatok") & F.lit(field in _LEFT_ALONE)
    may = F.col("_leads") & ~kept
    if field in ("sold", "highest_bid"):  # a result is always taken
        counts = F.col(field) != 0 if field == "highest_bid" else F.lit(True)
        may = may | (kind == "vysledok") & counts
    return _has(df, field) & may


def _scan(rows: DataFrame, key: str, per_day: dict[str, Column], over_days: dict[str, Column]) -> DataFrame:
    """`rows` with the columns `over_days`: scans over what the earlier days of a key contributed (`per_day`)."""
    days = rows.groupBy(key, "_day").agg(*[c.alias(n) for n, c in per_day.items()])
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    scanned = days.select(key, "_day", *[c.over(before).alias(n) for n, c in over_days.items()])
    return rows.join(scanned, [key, "_day"])


def states(notices: DataFrame, key: str = "group_key") -> DataFrame:
    """(key, status, last_notice_at, the merged fields that `notices` has): every auction after all its notices.

    Order is that of publication: by day, the gazette before other sources, by id as text, then versions as they came. Null
    and empty values are missing; rows without a key are left out; an empty table gives no rows.
    """
    fields = [f for f in X.MERGED if f in notices.columns]
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in notices.columns else F.lit("")
    rank = F.coalesce(lookup(X.SOURCE_RANK, F.col("source")), F.lit(0))
    at = F.struct(text("published_at").alias("day"), (F.col("source") != "ov").alias("later"), F.col("source_id").cast("string").alias("id"), text("versioned_at").alias("version"), text("first_seen").alias("seen"))
    own = notices.where(F.col(key).isNotNull()).select(key, "notice_type", "published_at", *fields, text("published_at").alias("_day"), rank.alias("_rank"), at.alias("_at"))
    within = Window.partitionBy(key, "_day").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)

    ranked = _scan(own, key, {"_best": F.max("_rank")}, {"_best": F.max("_best")})
    best = F.greatest("_best", F.max("_rank").over(within))
    told = ranked.withColumn("_leads", F.col("_rank") >= F.coalesce(best, F.lit(0))).drop("_best")

    day_set = F.lit(None).cast("string")
    if "auction_at" in fields:
        told = told.withColumns({"_sets": F.when(_overwrites(told, "auction_at"), F.col("auction_at")), "_gives": F.when(_has(told, "auction_at"), F.col("auction_at"))})
        dated = _scan(
            told, key, {"_last": F.max_by("_sets", F.when(F.col("_sets").isNotNull(), F.col("_at"))), "_first": F.min_by("_gives", F.when(F.col("_gives").isNotNull(), F.col("_at")))},
            {"_last": F.last("_last", ignorenulls=True), "_first": F.first("_first", ignorenulls=True)},
        )
        before = F.coalesce(F.last("_sets", ignorenulls=True).over(within), F.col("_last"), F.col("_first"), F.first("_gives", ignorenulls=True).over(within))
        told = dated.withColumn("_before", before)
        day_set = F.when((F.col("notice_type") == "dodatok") & F.col("_gives").isNotNull() & (F.col("_before") != F.col("_gives")), "odrocena")

    moved = told.withColumns({"_set": F.coalesce(lookup(X.STATUS_BY_NOTICE, F.col("notice_type")), day_set), "_opens": F.col("notice_type").isin("oznamenie", "opakovana")})
    when = lambda test: F.when(test, F.col("_at"))
    status = [F.max_by("_set", when(F.col("_set").isNotNull())).alias("_set"), F.max(when(F.col("_set").isNotNull())).alias("_set_at"), F.max(when(F.col("_opens"))).alias("_open_at")]
    values = [a for f in fields for a in (F.max_by(f, when(_overwrites(moved, f))).alias(f"_new_{f}"), F.min_by(f, when(_has(moved, f))).alias(f"_old_{f}"))]
    done = moved.groupBy(key).agg(*status, F.max(F.nullif("published_at", F.lit(""))).alias("last_notice_at"), *values)
    again = (F.col("_open_at") > F.col("_set_at")) & F.col("_set").isin(*_REOPENED)
    final = F.when(F.col("_set").isNull() | F.coalesce(again, F.lit(False)), "pripravovana").otherwise(F.col("_set"))
    # a known value can't be overwritten by a missing one, nor be known before the first that was given
    return done.select(key, final.alias("status"), "last_notice_at", *[F.coalesce(f"_new_{f}", f"_old_{f}").alias(f) for f in fields])


# -- versions ----------------------------------------------------------------------------------------------------
def written(c: Column, kind: str) -> Column:
    """A value as the change history writes it: whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")) if kind in ("double", "float") else c.cast("string")


def changes(before: DataFrame, after: DataFrame, key: str = "group_key", fields: tuple[str, ...] = X.TRACKED) -> DataFrame:
    """(key, change, field, old_value, new_value): what differs between two versions of a table.

    `created` and `vanished` rows name no field. Amounts differ if they are further apart than the tolerance; a null and
    a value differ. Keys must be unique in each version; rows without a key are left out.
    """
    kinds = dict(after.dtypes)
    fields = tuple(f for f in fields if f in kinds and f in before.columns)
    side = lambda df, name: df.where(F.col(key).isNotNull()).select(key, F.struct(F.lit(True).alias("_there"), *fields).alias(name))
    both = side(before, "a").join(side(after, "b"), key, "full_outer")

    def differs(f: str) -> Column:
        a, b = F.col(f"a.{f}"), F.col(f"b.{f}")
        close = F.abs(a - b) <= X.MONEY_TOLERANCE if kinds[f] in ("double", "float", "int", "bigint") or kinds[f].startswith("decimal") else a == b
        return ~F.coalesce(close, a.isNull() & b.isNull())

    row = lambda change, f, a, b: F.struct(F.lit(change).alias("change"), F.lit(f).cast("string").alias("field"), a.alias("old_value"), b.alias("new_value"))
    none = F.lit(None).cast("string")
    moved = [F.when(differs(f), row("changed", f, written(F.col(f"a.{f}"), kinds[f]), written(F.col(f"b.{f}"), kinds[f]))) for f in fields]
    found = F.when(F.col("a").isNull(), F.array(row("created", None, none, none))).when(F.col("b").isNull(), F.array(row("vanished", None, none, none))).otherwise(F.array_compact(F.array(*moved)))
    return both.select(key, F.explode(found).alias("c")).select(key, "c.*")
