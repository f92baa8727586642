"""The batch plan: notices to auctions with history, located and ready to serve."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions.text import norm_key
from ..operators import geo, resolve, serve
from ..operators.merge import Ledger
from ..sources import read
from ..sources.scratch import keep


def fold_order(n: dict) -> tuple:
    """Publication order; of one day the gazette first, then by id as text, then versions as they came."""
    return n.get("published_at") or "", n["source"] != "ov", str(n["source_id"]), n.get("versioned_at") or "", n.get("first_seen") or ""


def fold_order_columns() -> list[Column]:
    """The same order of notices for whole tables."""
    return [F.coalesce("published_at", F.lit("")).asc(), (F.col("source") != "ov").asc(), F.col("source_id").asc()]


def in_order(notices: DataFrame) -> DataFrame:
    """All notices with their place in the order of a rebuild."""
    return serve.placed(notices, *fold_order_columns())


def _merged(now: str, kinds: tuple[str, ...], block: int, bodies: list[str]) -> Iterator[tuple[int, str, str]]:
    """(block, kind, JSON) of the auctions and assignments of one block's notices, as far as asked for."""
    ledger = Ledger(now)
    results = []
    for n in sorted(map(json.loads, bodies), key=fold_order):
        result = ledger.ingest(n)
        known = ledger.notices[n["source"], n["source_id"]]
        row = {"source": n["source"], "source_id": n["source_id"], "result": result, "content_hash": known["content_hash"], "group_key": known["group_key"], "first_seen": known["first_seen"]}
        results.append(row | {"case_key": n.get("case_key")})
    for kind, rows in (("auction", ledger.auctions.values()), ("notice", results)):
        for row in rows if kind in kinds else ():
            yield block, kind, json.dumps(row, ensure_ascii=False)


def _fold(now: str, kinds: tuple[str, ...]):
    """Rows (block, body) come sorted by block; each block is merged as soon as the next one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, x) for batch in batches for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        merged = (row for block, own in groupby(rows, key=itemgetter(0)) for row in _merged(now, kinds, block, [x for _, x in own]))
        while some := list(islice(merged, 2000)):
            yield pa.record_batch([pa.array(c) for c in zip(*some, strict=True)], ["block", "kind", "body"])

    return run


def _out(notices: DataFrame, now: str, *kinds: str, blocks: DataFrame | None = None) -> DataFrame:
    """(block, kind, body) of the merge, made when it is read: one keyed shuffle by block, then the exact ordered merge."""
    body = F.to_json(F.struct(*[c for c in notices.columns if not c.startswith("_")]))
    tied = resolve.with_blocks(notices) if blocks is None else notices.join(blocks, ["source", "source_id"])
    dealt = tied.select("block", body.alias("body")).repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(_fold(now, kinds), "block long, kind string, body string")


def merged(notices: DataFrame, now: str, blocks: DataFrame | None = None) -> DataFrame:
    """(block, auction, notice): a row for each auction and each assignment of all notices, the other column null.

    A block holds all notices of one auctioneer and those tied to them; a very large one is one task, whose rows are
    indexed by day and folio, so its time grows with its notices and not with their square.
    """
    typed = lambda kind, ddl: F.when(F.col("kind") == kind, F.from_json("body", S.struct(ddl))).alias(kind)
    return _out(notices, now, "auction", "notice", blocks=blocks).select("block", typed("auction", S.AUCTION), typed("notice", S.ASSIGNMENT))


def fold(notices: DataFrame, now: str, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(auctions, assignments) of all notices, merged once and kept for any number of readers. Both have `block`."""
    out, _ = keep(merged(notices, now, blocks), "merged")
    read = lambda kind: out.where(f"{kind} is not null").select(f"{kind}.*", "block")
    return read("auction"), read("notice")


def auctions_of(notices: DataFrame, now: str) -> DataFrame:
    """The auctions of `fold` alone, for one reader: nothing is kept on disk."""
    return _out(notices, now, "auction").select("block", F.from_json("body", S.struct(S.AUCTION)).alias("r")).select("r.*", "block")


def assignments_of(notices: DataFrame, now: str) -> DataFrame:
    """The assignments of `fold` alone, for one reader: nothing is kept on disk."""
    return _out(notices, now, "notice").select("block", F.from_json("body", S.struct(S.ASSIGNMENT)).alias("r")).select("r.*", "block")


def both_of(notices: DataFrame, now: str, fields: str) -> DataFrame:
    """(block, kind, `fields`) of auctions and assignments from one merge, for one reader; what a kind lacks is null."""
    return _out(notices, now, "auction", "notice").select("block", "kind", F.from_json("body", S.struct(fields)).alias("r")).select("block", "kind", "r.*")


def latest_notices(*parts: DataFrame) -> DataFrame:
    """Notices of several origins, one per (source, source_id): the later part wins."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if "first_seen" in out.columns:  # a later part doesn't make a notice new
        out = out.withColumn("first_seen", F.min("first_seen").over(Window.partitionBy("source", "source_id")))
    return serve.newest_by_key(out, ["source", "source_id"], F.col("_part").desc()).drop("_part")


def with_places(auctions: DataFrame, units: DataFrame, parcels: DataFrame, normalize_register: bool = False, redo: bool = False) -> DataFrame:
    """Auctions whose properties have points, and with the point of the first property that has one.

    Properties located before keep their point, unless `redo` asks for all of them again.
    """
    each = auctions.select("group_key", F.posexplode("properties").alias("idx", "p"))
    open_ = each if redo else each.where("p.lat is null")
    asked = open_.select(F.concat_ws("\u0001", "group_key", "idx").alias("pid"), "p.ku", "p.obec", "p.parcels")
    found = geo.locate(asked, units, parcels, normalize_register).where("lat is not null")
    point = F.struct(F.substring_index("pid", "\u0001", -1).cast("int").alias("idx"), "lat", "lng", F.col("precision").alias("geo_source"))
    points = found.groupBy(F.substring_index("pid", "\u0001", 1).alias("group_key")).agg(F.collect_list(point).alias("_points"))

    def placed(p: Column, i: Column) -> Column:
        new = F.try_element_at(F.filter("_points", lambda x: x["idx"] == i), F.lit(1))
        take = lambda c: F.when(new.isNotNull(), new[c]).otherwise(p[c])
        return p.withField("lat", take("lat")).withField("lng", take("lng")).withField("geo_source", take("geo_source"))

    joined = auctions.join(points, "group_key", "left").withColumn("properties", F.transform("properties", placed))
    return rolled_up(joined).drop("_points")


def _place_key(p: Column) -> Column:
    """What a property is known by from one merge to the next: its unit or town, and its folios."""
    return F.concat(norm_key(F.coalesce(F.nullif(p["ku"], F.lit("")), p["obec"])), F.lit("|"), F.array_join(F.array_sort(F.coalesce(p["lv"], F.array())), ","))


def carried_over(auctions: DataFrame, before: DataFrame) -> DataFrame:
    """`auctions`, merged anew, with the points that properties of the same auction, place and folios had `before`."""
    known = before.select("group_key", F.transform(F.filter("properties", lambda p: p["lat"].isNotNull()), lambda p: F.struct(_place_key(p).alias("key"), p["lat"].alias("lat"), p["lng"].alias("lng"), p["geo_source"].alias("geo_source"))).alias("_known"))
    known = known.where(F.size("_known") > 0)

    def placed(p: Column) -> Column:
        old = F.try_element_at(F.filter("_known", lambda k: k["key"] == _place_key(p)), F.lit(-1))
        take = lambda c: F.when(p["lat"].isNull() & old.isNotNull(), old[c]).otherwise(p[c])
        return p.withField("geo_source", take("geo_source")).withField("lng", take("lng")).withField("lat", take("lat"))

    joined = auctions.join(known, "group_key", "left").withColumn("properties", F.transform("properties", placed))
    return rolled_up(joined).drop("_known")


def rolled_up(auctions: DataFrame) -> DataFrame:
    """Auctions with the point of the first property that has one."""
    first = F.try_element_at(F.filter("properties", lambda p: p["lat"].isNotNull()), F.lit(1))
    return auctions.withColumns({"lat": F.coalesce(first["lat"], "lat"), "lng": F.coalesce(first["lng"], "lng"), "geo_precision": F.coalesce(first["geo_source"], "geo_precision")})


def case_counts(notices: DataFrame) -> DataFrame:
    """(group_key, source, cases): by the rules an auction has one case of the register at most."""
    # dealt by auction, rows need no second exchange for the distinct cases
    dealt = notices.select("group_key", "source", "case_key").repartition("group_key")
    return dealt.groupBy("group_key", "source").agg(F.count_distinct("case_key").alias("cases"))


def read_again(raw: DataFrame, stored: DataFrame, now: str) -> DataFrame:
    """The stored filings parsed anew, as further versions of their notices."""
    again = read.notices(raw.where("source = 'ov'")).where("_error is null").drop("_error")
    first = stored.groupBy("source", "source_id").agg(F.min(F.coalesce("published_at", F.lit(""))).alias("_day"), F.min("first_seen").alias("_seen"))
    again = again.join(first, ["source", "source_id"], "left")
    # a version sorts behind its first one, on whose day it is placed
    return again.withColumns({"published_at": F.coalesce(F.nullif("_day", F.lit("")), "published_at"), "first_seen": F.coalesce("_seen", F.lit(now)), "versioned_at": F.lit(now)}).drop("_day", "_seen")


def reparse(raw: DataFrame, stored: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(auctions, assignments) after reading all stored filings again with the present parser.

    Stored notices go first, then their filings as further versions in the order of their ids: a changed one keeps its
    auction and first day of publication, and its properties replace the old ones even where they say less.
    """
    versions, _ = keep(stored.unionByName(read_again(raw, stored, now), allowMissingColumns=True), "versions")
    return fold(versions, now)


def write_export(auctions: DataFrame, notices: DataFrame, out: str, version: str, today: str) -> None:
    """List, details, map features and counts as JSON under `out/version`, then a pointer to it.

    Readers follow the pointer, so they never see half an export; details are rows of one table, not a file each.
    """
    day = F.to_date(F.lit(today))
    items = serve.list_items(auctions, day)
    told = notices
    for name, df in (
        ("auctions", items.orderBy(F.col("d").desc_nulls_last(), "id")), ("details", serve.details(auctions, told, day)),
        ("features", serve.features(items)), ("meta", serve.stats(auctions, told, day)),
    ):
        df.write.mode("overwrite").json(f"{out}/{version}/{name}")
    point_to(auctions.sparkSession, out, version)


def point_to(spark: SparkSession, out: str, version: str) -> None:
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{out}/current")


def rebuild(raw_notices: DataFrame, stored_notices: DataFrame | None, now: str) -> dict[str, DataFrame]:
    """All auctions anew from parsed filings and, for notices without a filing, their stored form."""
    good = raw_notices.where("_error is null").drop("_error") if "_error" in raw_notices.columns else raw_notices
    notices = latest_notices(stored_notices, good) if stored_notices is not None else good
    notices = resolve.cut(notices)
    auctions, assignments = fold(notices, now)
    return {"notices": notices.join(assignments.select("source", "source_id", "group_key"), ["source", "source_id"], "left"), "auctions": auctions, "assignments": assignments}


def history(auctions: DataFrame) -> DataFrame:
    return auctions.select("group_key", F.posexplode("history").alias("seq", "h")).select("group_key", "seq", "h.*")


def properties(auctions: DataFrame) -> DataFrame:
    return auctions.select("group_key", F.posexplode("properties").alias("idx", "p")).select("group_key", "idx", "p.*")


def missing_raw(notices: DataFrame, raw: DataFrame) -> DataFrame:
    """Notices whose filing isn't stored, to be fetched again."""
    return notices.where("source = 'ov'").join(raw.where("source = 'ov'").select("source_id"), "source_id", "left_anti").select("source_id")


def daily(steps: dict[str, object]) -> tuple[dict[str, object], int]:
    """Run steps one by one; a failed one doesn't stop the rest, and only if all fail is the exit code 1."""
    results: dict[str, object] = {}
    for name, step in steps.items():
        try:
            results[name] = step()
        except Exception as e:  # noqa: BLE001  one step must not stop the others
            results[name] = {"error": str(e)}
    failed = [r for r in results.values() if isinstance(r, dict) and "error" in r]
    return results, int(bool(results) and len(failed) == len(results))


def read_export(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the export that the pointer names, in the schema it was written with."""
    version = spark.read.schema("version string").json(f"{out}/current").first()["version"]
    return spark.read.json(f"{out}/{version}/{name}")


def run_counts(assignments: DataFrame) -> DataFrame:
    """Counters of a run: how many notices were new, changed or the same."""
    return assignments.groupBy("result").agg(F.count(F.lit(1)).alias("n"))
