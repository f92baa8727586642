"""Matching notices to auctions as joins: the same auction told by another source, and the next round of an estate.

Both rules ask for one auctioneer, which is no equality: two company numbers decide, else names, where one may contain the
other. So auctioneers are matched first, as a small table of distinct ones, and notices then meet auctions by equal
keys alone: (auctioneer, kind, day) for another source, (auctioneer, kind, folio, period) for another round. Conditions
that are left are expressions; no Python, no nested loop. Rows of one day and estate are reduced to the one that can
win before they meet, so a notice never meets more rows of an estate than there are days in its window.

Notices have source, source_id, kind, auctioneer_name, auctioneer_ico, auction_at, venue, properties; auctions have
group_key, kind, the same auctioneer, auction_at, venue, obec, ku, sources, properties and `place`, their order of creation.
A null or empty date is unknown, missing properties are none; notices without an auctioneer match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import fixed as X
from ..functions.text import executor_key, norm_key
from .resolve import contained_names, cut

#: Days of one period: a round and the next are in one, or in neighbouring ones.
PERIOD = X.ROUND_GAP_DAYS[1]
_ID = ["source", "source_id"]
_WHO = ["auctioneer_ico", "auctioneer_name", "executor"]


def day(at: Column) -> Column:
    return F.substring(F.coalesce(at, F.lit("")), 1, 10)


def clock(at: Column) -> Column:
    return F.substring(F.coalesce(at, F.lit("")), 12, 5)


def folios(properties: Column) -> Column:
    """Distinct `unit|folio` keys of an estate."""
    unit = lambda p: norm_key(F.coalesce(F.nullif(p["ku"], F.lit("")), p["obec"]))
    each = F.transform(F.coalesce(properties, F.array()), lambda p: F.transform(F.coalesce(p["lv"], F.array()), lambda lv: F.concat(unit(p), F.lit("|"), lv)))
    return F.array_distinct(F.filter(F.flatten(each), lambda k: k.isNotNull()))


def place_words(*names: Column) -> Column:
    """Distinct words of over three letters in names of places."""
    words = F.split(F.concat_ws(" ", *[norm_key(n) for n in names]), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))


# -- auctioneers -------------------------------------------------------------------------------------------------
def _who(df: DataFrame) -> DataFrame:
    """With one key for all rows of an auctioneer, told apart by number, name and whether it is an executor's office."""
    executor = F.coalesce(F.col("kind") == "exekucna", F.lit(False))
    return df.withColumn("who", F.to_json(F.struct("auctioneer_ico", "auctioneer_name", executor.alias("executor")))).withColumn("executor", executor)


def same_auctioneer(a: str, n: str) -> Column:
    """Whether auction side `a` and notice side `n` name one auctioneer: by numbers, else by an executor's words or by names."""
    c = lambda side, name: F.col(f"{side}.{name}")
    known = lambda side: F.coalesce(c(side, "auctioneer_ico"), F.lit("")) != ""
    left, right = norm_key(c(a, "auctioneer_name")), norm_key(c(n, "auctioneer_name"))
    contains = lambda x, y: (F.length(x) > 6) & F.contains(y, x)
    named = (left != "") & (right != "") & ((left == right) | contains(left, right) | contains(right, left))
    by_name = F.when(c(a, "executor") | c(n, "executor"), executor_key(c(a, "auctioneer_name")) == executor_key(c(n, "auctioneer_name"))).otherwise(named)
    told = c(a, "auctioneer_name").isNotNull() & (known(n) | (right != ""))
    return F.when(known(a) & known(n), c(a, "auctioneer_ico") == c(n, "auctioneer_ico")).otherwise(told & by_name)


def agreeing(auctions: DataFrame, notices: DataFrame) -> DataFrame:
    """(who, their): the distinct auctioneers of notices (`who`) with those of auctions that agree with them (`their`).

    Numbers meet numbers; names are looked at only where a side has no number, so one name under many numbers makes no pairs.
    """
    bare = F.coalesce("auctioneer_ico", F.lit("")) == ""
    theirs, ours = (cut(df.select("who", *_WHO).distinct().withColumns({"bare": bare, "name": norm_key(F.col("auctioneer_name"))})) for df in (auctions, notices))
    theirs = theirs.withColumnRenamed("who", "their")
    numbered = theirs.where(~F.col("bare")).select("their", "auctioneer_ico").join(ours.where(~F.col("bare")).select("who", "auctioneer_ico"), "auctioneer_ico").select("their", "who")

    def keyed(df: DataFrame) -> DataFrame:
        named = F.when(F.col("name") != "", F.concat(F.lit("m|"), "name"))
        executor = F.when(F.col("auctioneer_name").isNotNull(), F.concat(F.lit("x|"), executor_key(F.col("auctioneer_name"))))
        return df.withColumn("k", F.explode(F.array_compact(F.array(named, executor))))

    inside = cut(contained_names(theirs.select("name").union(ours.select("name")).distinct()))
    pairs = numbered
    for left, right in ((theirs.where("bare"), ours), (theirs.where("not bare"), ours.where("bare"))):
        met = keyed(left).select("their", "k").join(keyed(right).select("who", "k"), "k").select("their", "who")
        for short, long in (("a", "b"), ("b", "a")):  # either name may be the longer one
            met = met.union(inside.join(left.select("their", F.col("name").alias(short)), short).join(right.select("who", F.col("name").alias(long)), long).select("their", "who"))
        pairs = pairs.union(met)
    sided = pairs.distinct().join(theirs.alias("a"), "their").join(ours.alias("n"), "who")
    return sided.where(same_auctioneer("a", "n")).select("who", "their")


def _sides(notices: DataFrame, auctions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notices with the auctioneers (`their`) that agree with their own, and auctions with theirs."""
    told, held = _who(notices), _who(auctions)
    return told.join(cut(agreeing(held, told)), "who"), held.withColumnRenamed("who", "their")


# -- another source ----------------------------------------------------------------------------------------------
def told_elsewhere(notices: DataFrame, auctions: DataFrame) -> DataFrame:
    """(source, source_id, group_key): the one auction of the day that a notice's source has not told of yet.

    Of several that fit, those of the same time of day stay if there are any, then those that share most words of their
    places; a notice for which that leaves two has no match.
    """
    told, held = _sides(notices, auctions)
    own = F.coalesce("properties", F.array())
    places = F.array_join(F.transform(own, lambda p: F.concat_ws(" ", p["obec"], p["ku"])), " ")
    kind = F.when(F.col("source") == "ncrd", "dobrovolna").otherwise(F.coalesce(F.nullif("kind", F.lit("")), F.lit("dobrovolna")))
    n = told.select(*_ID, "their", kind.alias("kind"), day(F.col("auction_at")).alias("day"), clock(F.col("auction_at")).alias("clock"), folios(own).alias("estate"), place_words(F.col("venue"), places).alias("words")).where("day != ''")
    a = held.select("their", "kind", day(F.col("auction_at")).alias("day"), "group_key", clock(F.col("auction_at")).alias("their_clock"), folios(F.col("properties")).alias("their_estate"), place_words(F.col("venue"), F.col("obec"), F.col("ku")).alias("their_words"), F.transform("sources", lambda s: s["source"]).alias("told_by"))
    fit = n.join(a, ["their", "kind", "day"]).where(
        ~F.coalesce(F.array_contains("told_by", F.col("source")), F.lit(False)) & ((F.size("estate") == 0) | (F.size("their_estate") == 0) | F.arrays_overlap("estate", "their_estate"))
    )
    liked = fit.select(*_ID, "group_key", ((F.col("clock") != "") & (F.col("clock") == F.col("their_clock"))).cast("int").alias("timely"), F.size(F.array_intersect("words", "their_words")).alias("shared")).distinct()
    each = Window.partitionBy(*_ID)
    for liking in ("timely", "shared"):
        liked = liked.withColumn("best", F.max(liking).over(each)).where(F.col(liking) == F.col("best"))
    return liked.withColumn("n", F.count(F.lit(1)).over(each)).where("n = 1").select(*_ID, "group_key")


# -- another round -----------------------------------------------------------------------------------------------
def other_round(notices: DataFrame, auctions: DataFrame) -> DataFrame:
    """(source, source_id, group_key): of the auctions of a shared folio some weeks before or after, the latest.

    An unknown day is no obstacle. Days are counted in periods as long as the widest gap, so an auction of a known day
    is within reach only in the notice's own period or the ones beside it.
    """
    low, high = X.ROUND_GAP_DAYS
    told, held = _sides(notices, auctions)
    days = F.unix_date(F.try_to_date(day(F.col("auction_at")), "yyyy-MM-dd"))
    period, undated_period = F.floor(F.col("days") / PERIOD), F.lit(-(1 << 40))
    n = told.where("kind != ''").select(*_ID, "their", "kind", days.alias("days"), F.explode(folios(F.col("properties"))).alias("folio"))
    a = held.select("their", "kind", days.alias("days"), F.explode(folios(F.col("properties"))).alias("folio"), F.struct(F.coalesce("auction_at", F.lit("")).alias("at"), (-F.col("place")).alias("place"), "group_key").alias("auction"))
    # of one day and folio only the latest auction can win
    a = a.groupBy("their", "kind", "folio", "days").agg(F.max("auction").alias("auction")).select("their", "kind", "folio", F.col("days").alias("their_days"), "auction", F.coalesce(period, undated_period).alias("period"))
    any_day = a.groupBy("their", "kind", "folio").agg(F.max("auction").alias("auction"))
    where = F.when(F.col("days").isNotNull(), F.array(period - 1, period, period + 1, undated_period))
    near = n.withColumn("period", F.explode(where)).join(a, ["their", "kind", "folio", "period"])
    gap = F.abs(F.col("days") - F.col("their_days"))
    near = near.where(F.col("their_days").isNull() | gap.between(low, high)).select(*_ID, "auction")
    undated = n.where("days is null").join(any_day, ["their", "kind", "folio"]).select(*_ID, "auction")
    return near.union(undated).groupBy(*_ID).agg(F.max("auction").alias("auction")).select(*_ID, "auction.group_key")
