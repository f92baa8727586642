"""Meeting in groups of any size: small groups whole, large ones in blocks of bounded size, without rows for pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import keep

#: Roles of dealt rows: a member that is compared with all of its group, a copy of a member that others pass, one that passes.
WHOLE, HELD, PASSING = 0, 1, 2
_SALTS = 16


def dealt(entries: DataFrame, key: list[str], item: str, block: int) -> DataFrame:
    """`entries` with their `salt`, dealt by (key, salt) and sorted by role and item: each (key, salt) is one meeting.

    `entries` have the columns `key`, `item` and `role`: members are WHOLE, rows that only look for members PASSING.
    A group of up to `block` rows is one meeting. In a larger one members are HELD in blocks of about `block`, and all
    rows pass every block, divided into lanes that each have a copy of the block: no meeting has many more than two blocks' rows.
    """
    sizes = entries.groupBy(*key).agg(F.sum((F.col("role") == WHOLE).cast("long")).alias("members"), F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    large = keep(sizes.where("members > 0").select(*key, *[F.ceil(F.col(c) / block).cast("int").alias(to) for c, to in (("members", "blocks"), ("size", "lanes"))]), "large-groups")
    if large.isEmpty():
        rows = entries.withColumn("salt", F.lit(0))
    else:
        of = lambda seed, n: F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(n) if isinstance(n, int) else n).cast("int")
        # a large key's rows are spread over several tasks of this join
        spread = large.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        named = keep(entries.withColumn("_spread", of(0, _SALTS)).join(spread, [*key, "_spread"], "left").drop("_spread"), "grouped")
        lane, block_no = F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        salt = (F.col("_block") * F.col("lanes") + F.col("_lane")).cast("int")
        held = named.where(F.col("blocks").isNotNull() & (F.col("role") == WHOLE)).withColumn("_block", of(1, F.col("blocks"))).withColumn("_lane", lane)
        passing = named.where("blocks is not null").withColumn("_lane", of(2, F.col("lanes"))).withColumn("_block", block_no)
        rows = named.where("blocks is null").select(*entries.columns, F.lit(0).alias("salt"))
        for more, role in ((held, HELD), (passing, PASSING)):
            rows = rows.union(more.withColumn("role", F.lit(role)).select(*entries.columns, salt.alias("salt")))
    # a number of its own, as Spark would deal few bytes to few tasks, whatever the work on them
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *key, "salt").sortWithinPartitions(*key, "salt", "role", item)
