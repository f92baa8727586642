"""Incremental ingest: a stream of filings kept in two tables, of which only touched blocks are merged again.

A store keeps every version of every notice with the time it was first seen, and the auctions made of them, both in
buckets of blocks. A micro-batch finds the stored blocks that share a key with its notices, merges these anew with
them, and writes the buckets these blocks are in under its own number; a pointer says for each bucket which number
holds. Replaying a batch writes the same again, so at-least-once input is enough. Late notices need no watermark: a
merge is ordered by publication, so an old notice fills gaps and overwrites nothing; times of first sight come from
the store, so a block that is merged anew doesn't make its auctions new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.window import Window

from .. import schema as S
from ..operators import resolve
from ..plans import rebuild
from ..sources import read

BUCKETS = 64
_TABLES = {"notices": f"{S.NOTICE}, group_key string, block long", "auctions": f"{S.AUCTION}, block long"}


def _current(spark: SparkSession, store: str) -> dict[int, int] | None:
    """The number that holds for each bucket; at most BUCKETS rows."""
    try:
        rows = spark.read.schema("bucket int, number long").json(f"{store}/current").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return {r["bucket"]: r["number"] for r in rows}


def _read(spark: SparkSession, store: str, name: str, holds: dict[int, int]) -> DataFrame:
    paths = [f"{store}/{name}/{number}/bucket={bucket}" for bucket, number in sorted(holds.items())]
    return spark.read.schema(_TABLES[name]).parquet(*paths) if paths else spark.createDataFrame([], _TABLES[name])


def tables(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame] | None:
    """(notices, auctions) as they stand; notices with all their versions."""
    holds = _current(spark, store)
    if holds is None:
        return None
    return tuple(_read(spark, store, name, {b: n for b, n in holds.items() if b >= 0}) for name in _TABLES)


def _bucket(block) -> F.Column:
    return F.pmod(block, F.lit(BUCKETS)).cast("int")


def _new_versions(batch: DataFrame, known: DataFrame, now: str | None, counted: Observation | None = None) -> DataFrame:
    """The notices of a batch that say something else than the version before them, oldest first; without `now` they keep their own time."""
    own = [c for c in batch.columns if c not in ("versioned_at", "first_seen")]
    digest = F.sha2(F.to_json(F.struct(*own)), 256)
    fresh = batch.withColumns({"first_seen": F.lit(now) if now else F.col("first_seen"), "_digest": digest, "_old": F.lit(False)})
    stored = known.select(*batch.columns).withColumns({"_digest": digest, "_old": F.lit(True)})
    both = stored.unionByName(fresh.select(*stored.columns))
    line = Window.partitionBy("source", "source_id").orderBy(F.col("_old").desc(), F.coalesce("versioned_at", F.lit("")), "_digest")
    told = both.withColumn("_before", F.lag("_digest").over(line)).where("not _old and (_before is null or _before != _digest)")
    told = told.observe(counted, F.count_if(F.col("_before").isNull()).alias("new"), F.count_if(F.col("_before").isNotNull()).alias("changed")) if counted else told
    return told.drop("_digest", "_old", "_before")


def apply(batch: DataFrame, number: int, store: str, now: str) -> dict[str, int]:
    """Take one batch of notices into the store as `number`; how many notices and auctions were new, counted in passing."""
    spark = batch.sparkSession
    holds = _current(spark, store)
    if holds is not None and holds.get(-1, -1) >= number:
        return {}  # replayed
    holds = holds or {}
    good = batch.where("_error is null").drop("_error") if "_error" in batch.columns else batch
    good = good.select(*[F.col(c) if c in good.columns else F.lit(None).cast(t).alias(c) for c, t in ((f.name, f.dataType) for f in S.struct(S.NOTICE))])
    buckets = {b: n for b, n in holds.items() if b >= 0}
    known = _read(spark, store, "notices", buckets)
    same_ids = known.join(good.select("source", "source_id").distinct(), ["source", "source_id"], "left_semi")
    versions, told = Observation(), Observation()
    fresh = resolve.cut(_new_versions(good, same_ids, now, versions))
    # stored blocks that a new notice, or an older version of it, may meet
    touched = resolve.cut(resolve.meeting(fresh, known).union(same_ids.select("block")).distinct())
    again = resolve.cut(known.join(touched, "block", "left_semi").drop("group_key", "block").unionByName(fresh))
    if again.isEmpty():
        _commit(spark, store, {**holds, -1: number})
        return versions.get
    blocks = resolve.cut(resolve.blocks(again.select("source", "source_id", "case_key", "auctioneer_ico", "auctioneer_name")))
    auctions, assigned = rebuild.fold(again, now, blocks)
    # what was located stays so
    before = resolve.cut(_read(spark, store, "auctions", buckets).join(touched, "block", "left_semi"))
    auctions = rebuild.carried_over(auctions, before)
    where = assigned.select("source", "source_id", "group_key", "block").distinct()
    notices = again.join(where, ["source", "source_id"])
    moved = touched.select("block").union(blocks.select("block")).select(_bucket(F.col("block")).alias("b")).distinct()
    changed = sorted(r["b"] for r in moved.collect())  # at most BUCKETS
    written = {}
    for name, made in (("auctions", auctions), ("notices", notices)):
        calm = _read(spark, store, name, {b: n for b, n in buckets.items() if b in changed}).join(touched, "block", "left_anti")
        made = made.observe(told, F.count(F.lit(1)).alias("n")) if name == "auctions" else made
        whole = made.select(*[f.name for f in S.struct(_TABLES[name])]).unionByName(calm)
        whole.withColumn("bucket", _bucket(F.col("block"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{name}/{number}")
        written[name] = {r["bucket"] for r in whole.select(_bucket(F.col("block")).alias("bucket")).distinct().collect()}
    kept = {b: n for b, n in buckets.items() if b not in changed}
    _commit(spark, store, {**kept, **dict.fromkeys(written["notices"], number), -1: number})
    return versions.get | {"new_auctions": told.get["n"] - before.count()}


def replace(spark: SparkSession, store: str, notices: DataFrame, auctions: DataFrame, only: list[int] | None = None) -> None:
    """Put `notices` (with group_key and block) and `auctions` in the place of the store's, of all its buckets or of `only` some.

    New buckets are written first, then the pointer moves, so readers see the old tables or the new ones.
    """
    holds = _current(spark, store) or {}
    number = holds.get(-1, -1) + 1
    for name, df in (("notices", notices), ("auctions", auctions)):
        rows = df.select(*[f.name for f in S.struct(_TABLES[name])]).withColumn("bucket", _bucket(F.col("block")))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{name}/{number}")
    written = {r["bucket"] for r in auctions.select(_bucket(F.col("block")).alias("bucket")).distinct().collect()}  # at most BUCKETS
    kept = {b: n for b, n in holds.items() if only is not None and b >= 0 and b not in only}
    _commit(spark, store, {**kept, **dict.fromkeys(written, number), -1: number})


def _commit(spark: SparkSession, store: str, holds: dict[int, int]) -> None:
    """Bucket -1 has the number of the last batch."""
    spark.createDataFrame(sorted(holds.items()), "bucket int, number long").coalesce(1).write.mode("overwrite").json(f"{store}/current")


def tidy(spark: SparkSession, store: str) -> list[str]:
    """Delete what no bucket points to any more; readers of older pointers must be done. Gives the deleted folders."""
    holds, gone = _current(spark, store) or {}, []
    for name in _TABLES:
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
        files = top.getFileSystem(spark._jsc.hadoopConfiguration())
        for number in files.listStatus(top) if files.exists(top) else ():
            for part in files.listStatus(number.getPath()):
                found = part.getPath().getName()
                if found.startswith("bucket=") and holds.get(int(found[7:])) != int(number.getPath().getName()):
                    files.delete(part.getPath(), True)
                    gone.append(f"{name}/{number.getPath().getName()}/{found}")
    return gone


class Counts(StreamingQueryListener):
    """What each batch of a stream counted in passing: rows of (batch, metric name, counts)."""

    def __init__(self) -> None:
        self.seen: list[tuple[int, str, dict[str, int]]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            self.seen.append((event.progress.batchId, name, row.asDict()))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def run(spark: SparkSession, landing: str, store: str, checkpoint: str, now: str) -> None:
    """Take in everything that has landed and stop. Filings and errors are observed as `filings`, for a listener such as `Counts`."""
    stream = read.notices(read.landing_stream(spark, landing))
    stream = stream.observe("filings", F.count(F.lit(1)).alias("filings"), F.count_if(F.col("_error").isNotNull()).alias("errors"))
    query = stream.writeStream.foreachBatch(lambda batch, k: apply(resolve.cut(batch), k, store, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type and tumbling window; rows later than the watermark are dropped by the stream."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
