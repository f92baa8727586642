"""Which notices may meet in one auction: blocks of notices that share, directly or through others, a matching key.

Every way to match needs an equal case key, or auctioneers that agree by company number, by name, by executor
name in any word order, or by one name containing the other. Blocks are the connected components of notices over
these keys; they are supersets of auctions, and the exact rules run inside a block.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import executor_key, norm_key
from ..sources.scratch import drop, keep


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder; in a temporary one only on a local master where none is set."""
    context, named = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="gavelyard-"))
    return df.checkpoint()


def components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): smallest node reachable. Labels spread over edges and are then followed once, so rounds are few."""
    spark = edges.sparkSession
    both, ends = keep(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels, path = keep(nodes.select("node").distinct().withColumn("component", F.col("node")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("least")).withColumnRenamed("a", "node")
        spread = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("before"))
        # follow the label of the label
        onward = labels.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        jumped, now = keep(spread.join(onward, "component", "left").select("node", F.least("component", F.coalesce("onward", "component")).alias("component"), "before"), "labels")
        drop(spark, path)
        labels, path = jumped.select("node", "component"), now
        if jumped.where("component != before").isEmpty():
            drop(spark, ends)
            return labels
    raise RuntimeError("components did not settle")


def contained_names(names: DataFrame, least: int = 7) -> DataFrame:
    """(a, b): names of `least` characters or more where b contains a.

    b then has every run of `least` characters of a, so the two meet at a's rarest run; runs that many names
    share are looked at only by names that have nothing rarer.
    """
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - least + 1), lambda i: F.substring(F.col("name"), i, F.lit(least))))
    grams = names.where(F.length("name") >= least).select("name", F.explode(runs).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(counts, "gram").groupBy("name").agg(F.min(F.struct("n", "gram")).alias("r")).select(F.col("name").alias("a"), F.col("r.gram").alias("gram"))
    met = rarest.join(grams.withColumnRenamed("name", "b"), "gram")
    return met.where((F.col("a") != F.col("b")) & F.contains("b", "a")).select("a", "b").distinct()


def meeting(fresh: DataFrame, known: DataFrame, least: int = 7) -> DataFrame:
    """(block) of the `known` notices that share a key with a fresh one, or whose auctioneer's name contains or is in a fresh one's.

    A superset of what the exact rules tie; names are compared as distinct names, through the first characters of the
    shorter one, which the longer one must have somewhere.
    """
    def keyed(df: DataFrame) -> DataFrame:
        name, executor = norm_key(F.col("auctioneer_name")), executor_key(F.col("auctioneer_name"))
        key = lambda kind, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{kind}|"), c))
        executor = F.when(F.col("auctioneer_name").isNotNull(), F.concat(F.lit("x|"), executor))
        keys = F.array_compact(F.array(key("c", F.col("case_key")), key("n", F.col("auctioneer_ico")), key("m", name), executor))
        return df.withColumn("k", F.explode(keys))

    stored = keyed(known).select("block", "k").distinct()
    wanted = keyed(fresh).select("k").distinct()
    direct = stored.join(wanted, "k", "left_semi").select("block")
    names = lambda df: df.where("k like 'm|%'").select(F.substring("k", 3, 1 << 20).alias("name")).where(F.length("name") >= least).distinct()
    grams = lambda df: df.select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - least + 1), lambda i: F.substring(F.col("name"), i, F.lit(least))))).alias("gram"))
    starts = lambda df: df.select("name", F.substring("name", 1, least).alias("gram"))
    old, new = names(stored), names(wanted)
    inside = starts(old).alias("a").join(grams(new).alias("b"), "gram").where(F.contains("b.name", "a.name")).select("a.name")
    around = grams(old).alias("b").join(starts(new).alias("a"), "gram").where(F.contains("b.name", "a.name")).select("b.name")
    tied = inside.union(around).distinct().select(F.concat(F.lit("m|"), "name").alias("k"))
    return direct.union(stored.join(tied, "k", "left_semi").select("block"))


def _key(kind: str, c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.xxhash64(F.concat(F.lit(f"{kind}|"), c)))


def _own() -> Column:
    return F.xxhash64(F.concat_ws("|", F.lit("i"), "source", "source_id"))


def _first_key() -> Column:
    """What a notice stands for while blocks are found: its company number, else its case, else itself."""
    return F.coalesce(_key("n", F.col("auctioneer_ico")), _key("c", F.col("case_key")), _own())


def _name_keys(notices: DataFrame) -> DataFrame | None:
    """(auctioneer_name, by_name, by_executor): the keys of names as written; None where every name has a company number.

    Two company numbers are compared with each other and not the names, so a name ties notices only where one of
    them has no number. Names of which one contains the other are one key.
    """
    bare = F.col("auctioneer_ico").isNull()
    if notices.where(bare & F.col("auctioneer_name").isNotNull()).isEmpty():
        return None
    written = notices.where("auctioneer_name is not null").groupBy("auctioneer_name").agg(F.bool_or(bare).alias("bare"))
    name = norm_key(F.col("auctioneer_name"))
    names, _ = keep(written.select("auctioneer_name", "bare", F.when(name != "", name).alias("name"), executor_key(F.col("auctioneer_name")).alias("executor")), "names")
    used = names.where("name is not null").groupBy("name").agg(F.bool_or("bare").alias("bare"))
    pairs = contained_names(used.select("name")).join(used.select(F.col("name").alias("a"), F.col("bare").alias("bare_a")), "a").join(used.select(F.col("name").alias("b"), F.col("bare").alias("bare_b")), "b").where("bare_a or bare_b")
    pairs, _ = keep(pairs.select(_key("m", F.col("a")).alias("a"), _key("m", F.col("b")).alias("b")), "pairs")
    nodes = used.where("bare").select(_key("m", F.col("name")).alias("node")).union(pairs.select("a")).union(pairs.select("b"))
    tying = components(pairs, nodes).withColumnRenamed("component", "by_name")
    # an executor's empty name equals another empty one, so it is a key too
    executors = names.where("bare").select("executor", F.xxhash64(F.concat(F.lit("x|"), "executor")).alias("by_executor")).distinct()
    return names.join(tying, _key("m", F.col("name")) == F.col("node"), "left").join(executors, "executor", "left").select("auctioneer_name", "by_name", "by_executor").where("by_name is not null or by_executor is not null")


def with_blocks(notices: DataFrame) -> DataFrame:
    """`notices` with their `block`.

    Most keys belong to notices of one first key alone and tie nothing; they are told by the least and the largest first
    key, and only those that tie two become edges. So rows meet once as pairs of numbers, whatever their texts' size.
    """
    narrow = notices.select("source", "source_id", "case_key", "auctioneer_ico", "auctioneer_name")
    names = _name_keys(narrow)
    keys = [_own(), _key("c", F.col("case_key"))]
    if names is not None:
        narrow, keys = narrow.join(names, "auctioneer_name", "left"), [*keys, F.col("by_name"), F.col("by_executor")]
    # a company number is the first key of all that have it, so it ties nothing else
    each = narrow.select(_first_key().alias("first"), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    ends = each.groupBy("key").agg(F.min("first").alias("least"), F.max("first").alias("most"))
    shared, _ = keep(ends.where("least != most").select("key", "least"), "shared")
    if shared.isEmpty():
        return notices.withColumn("block", _first_key())
    edges, _ = keep(each.join(shared, "key").where("first != least").select(F.col("first").alias("a"), F.col("least").alias("b")).distinct(), "ties")
    found = components(edges, edges.select(F.col("a").alias("node")).union(edges.select("b")))
    marked = notices.withColumn("_first", _first_key()).join(found.withColumnRenamed("node", "_first"), "_first", "left")
    return marked.withColumn("block", F.coalesce("component", "_first")).drop("_first", "component")


def blocks(notices: DataFrame) -> DataFrame:
    """(source, source_id, block) for each notice."""
    return with_blocks(notices).select("source", "source_id", "block").distinct()
