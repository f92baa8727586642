"""Jobs over a store of tables: ingest, register, reparse, rebuild, geocode, export, alerts, counts, sync, and their command line.

A store is a folder: the incremental tables of `streaming.ingest`, and append-only tables `raw`, `runs`, `state`,
`searches` and `sent`, whose newest row per key holds. Times are parameters, so a job can be repeated.

    python -m gavelyard.plans.jobs STORE VERB [options]
"""

from __future__ import annotations

import argparse
import contextlib
import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .. import schema as S
from ..operators import serve
from ..sources import read
from ..streaming import ingest
from . import rebuild

SCHEMAS = {"raw": S.RAW_ITEM, "runs": S.RUN, "state": S.STATE, "searches": S.SEARCH, "sent": S.SENT}
#: Days that the first run looks back.
FIRST_DAYS = 120


def table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """An append-only table of the store, empty before its first row."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{store}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def append(rows: DataFrame, store: str, name: str) -> None:
    rows.select(*[f.name for f in S.struct(SCHEMAS[name]).fields]).write.mode("append").parquet(f"{store}/{name}")


# -- state, cursor and runs --------------------------------------------------------------------------------------
def states(spark: SparkSession, store: str) -> DataFrame:
    """(key, value, at): the newest value of each key."""
    return serve.newest_by_key(table(spark, store, "state"), ["key"], F.col("at").desc(), F.col("value").desc())


def set_state(spark: SparkSession, store: str, key: str, value: str, at: str) -> None:
    append(spark.createDataFrame([(key, value, at)], S.STATE), store, "state")


def cursor(spark: SparkSession, store: str, now: str, since: str | None = None, days: int = FIRST_DAYS) -> str:
    """From when on filings are taken: as asked, else where the last run ended, else some days back; a day is its first second."""
    row = None if since else states(spark, store).where("key = 'ov:since'").first()
    found = since or (row["value"] if row else (datetime.fromisoformat(now) - timedelta(days=days)).strftime("%Y-%m-%d"))
    return f"{found}T00:00:00Z" if len(found) == 10 else found


def last_change(items: DataFrame, before: str) -> str:
    """Where the next run goes on: the latest change among the items."""
    row = items.agg(F.max(F.coalesce("updated_at", "created_at")).alias("t")).first()
    return max(row["t"] or before, before)


def log_run(spark: SparkSession, store: str, source: str, started: str, finished: str, counts: dict[str, int], message: str | None = None) -> None:
    row = (f"{source}-{started}", source, started, finished, *(counts.get(k, 0) for k in ("fetched", "new", "changed", "new_auctions", "errors")), message)
    append(spark.createDataFrame([row], S.RUN), store, "runs")


# -- saved searches and alerts -----------------------------------------------------------------------------------
def add_search(spark: SparkSession, store: str, email: str, filters: dict, now: str, name: str | None = None) -> str:
    """Store a search; only auctions first seen after `now` will alert."""
    f = {"kraj": "", "okres": "", "types": [], "kinds": [], "minPrice": None, "maxPrice": None, "round": "", "q": ""} | filters
    search = f"{email}-{now}"
    number = lambda k: None if f[k] is None else float(f[k])
    row = (search, email, name, f["kraj"], f["okres"], list(f["types"]), list(f["kinds"]), number("minPrice"), number("maxPrice"), f["round"], f["q"], True, now)
    append(spark.createDataFrame([row], S.SEARCH), store, "searches")
    set_state(spark, store, f"search:{search}", now, now)
    return search


def searches(spark: SparkSession, store: str) -> DataFrame:
    """Stored searches with the time of their last notice."""
    last = states(spark, store).where("key like 'search:%'").select(F.substring("key", 8, 1 << 20).alias("search_id"), F.col("value").alias("last_notified_at"))
    return table(spark, store, "searches").join(last, "search_id", "left")


def notify(spark: SparkSession, store: str, auctions: DataFrame, now: str, today: str, site: str, outbox: str | None = None) -> DataFrame:
    """Messages for new matches, one per search, written to `outbox`; what was told is noted, and the searches' time moves on.

    A search without a hit keeps its time, so nothing that is first seen meanwhile is passed over.
    """
    kept = searches(spark, store)
    hits = rebuild.resolve.cut(serve.alerts(auctions, kept, table(spark, store, "sent"), F.to_date(F.lit(today))))
    messages = rebuild.resolve.cut(serve.render_alerts(hits, auctions, kept, site))
    if outbox:
        messages.withColumn("created_at", F.lit(now)).write.mode("append").json(outbox)
    append(hits.withColumn("created_at", F.lit(now)), store, "sent")
    append(hits.select(F.concat(F.lit("search:"), "search_id").alias("key")).distinct().withColumns({"value": F.lit(now), "at": F.lit(now)}), store, "state")
    return messages


# -- sync --------------------------------------------------------------------------------------------------------
def sync_tables(spark: SparkSession, store: str, notices: DataFrame, auctions: DataFrame) -> dict[str, DataFrame]:
    """The five tables as a database keeps them: nested values as JSON text, points as well-known text."""
    flat = lambda df: df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    point = F.when(F.col("lat").isNotNull(), F.format_string("POINT(%s %s)", F.col("lng"), F.col("lat")))
    latest = serve.newest_by_key(notices, ["source", "source_id"], F.col("first_seen").desc(), F.coalesce("versioned_at", F.lit("")).desc())
    payload = F.to_json(F.struct(*[c for c in latest.columns if c not in ("group_key", "block")]))
    columns = ["source", "source_id", "kind", "notice_type", "source_url", "source_label", "published_at", "auction_at", "first_seen", "group_key"]
    return {
        "auctions": flat(auctions.withColumn("point", point).drop("properties", "history", "lat", "lng", "block")),
        "notices": latest.select(*columns, payload.alias("payload")),
        "properties": flat(rebuild.properties(auctions).withColumn("point", point).drop("lat", "lng")),
        "auction_history": rebuild.history(auctions), "scrape_runs": table(spark, store, "runs"),
    }


#: Tables in an order in which each refers only to ones before it, with their keys.
KEYS = {"auctions": ("group_key",), "notices": ("source", "source_id"), "properties": ("group_key", "idx"), "auction_history": ("group_key", "seq"), "scrape_runs": ("run",)}
#: Characters of a text that is part of a key.
KEY_LENGTH = 700


def _merge_sql(name: str, columns: list[str], key: tuple[str, ...]) -> str:
    q = lambda c: f'"{c}"'
    on = " AND ".join(f"t.{q(c)} = s.{q(c)}" for c in key)
    rest = [c for c in columns if c not in key]
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
    return f"MERGE INTO {name} t USING {name}_staging s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, columns))}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})"


def sync(tables: dict[str, DataFrame], url: str, properties: dict[str, str] | None = None, connections: int = 8) -> dict[str, int]:
    """Bring a database up to date over JDBC: rows are updated or added by key, and rows that are only there stay.

    Every table is loaded beside the real one, by a few connections whatever the partitions. When all are loaded, the
    database merges them in one transaction, tables that others refer to first. A run that fails at any point leaves
    the real tables as they were, and the next one starts over.
    """
    properties = properties or {}
    out: dict[str, int] = {}
    for name, df in tables.items():
        kinds = dict(df.dtypes)
        texts = ", ".join(f"{c} VARCHAR({KEY_LENGTH})" for c in KEYS[name] if kinds[c] == "string")
        counted = Observation()
        # made by all tasks first: only the loading is limited to a few
        rows = rebuild.resolve.cut(df.observe(counted, F.count(F.lit(1)).alias("n"))).coalesce(connections)
        write = lambda frame, to, mode: frame.write.options(**{"createTableColumnTypes": texts} if texts else {}).jdbc(url, to, mode, properties)  # noqa: B023, E731
        write(rows, f"{name}_staging", "overwrite")
        write(df.limit(0), name, "append")  # makes the table where there is none
        out[name] = counted.get["n"]
    spark = next(iter(tables.values())).sparkSession
    with _connected(spark, url, properties) as connection:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            for name in (n for n in KEYS if n in tables):
                statement.executeUpdate(_merge_sql(name, tables[name].columns, KEYS[name]))
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        for name in tables:
            statement.executeUpdate(f"DROP TABLE {name}_staging")
        connection.commit()
    return out


@contextlib.contextmanager
def _connected(spark: SparkSession, url: str, properties: dict[str, str]):
    """A connection of the driver's own to a database."""
    jvm = spark._jvm
    if "driver" in properties:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        yield connection
    finally:
        connection.close()


# -- verbs -------------------------------------------------------------------------------------------------------
def take_filings(spark: SparkSession, store: str, landing: str | None, now: str, since: str | None = None, pages: str | None = None) -> dict[str, int]:
    """Filings that changed since the cursor, from a landing zone or a feed's `pages`: kept raw, parsed, and merged into the store; the run is logged."""
    start = cursor(spark, store, now, since)
    seen = Observation()
    items = read.feed_items(spark, pages, start) if pages else read.landing(spark, landing, start)
    items = rebuild.resolve.cut(items.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.coalesce("updated_at", "created_at")).alias("at")))
    wanted = items.where(read.is_auction(F.col("file_name")) & (F.col("content") != ""))
    append(wanted.select(*[f.name for f in S.struct(S.RAW_ITEM).fields]), store, "raw")
    return _take(spark, store, "ov", read.notices(items), seen.get["n"], now, max(seen.get["at"] or start, start))


def take_register(spark: SparkSession, store: str, pages: str, now: str) -> dict[str, int]:
    """Register pages (act_id, row, detail, text) that the store has not: parsed and merged; the run is logged."""
    held = ingest.tables(spark, store)
    known = held[0].where("source = 'ncrd'").select(F.col("source_id").alias("act_id")) if held else None
    seen = Observation()
    found = spark.read.schema("act_id string, row string, detail string, text string").json(pages)
    found = rebuild.resolve.cut(found.observe(seen, F.count(F.lit(1)).alias("n")))
    return _take(spark, store, "ncrd", read.register_notices(found, known), seen.get["n"], now)


def _take(spark: SparkSession, store: str, source: str, notices: DataFrame, fetched: int, now: str, cursor_: str | None = None) -> dict[str, int]:
    seen = Observation()
    notices = rebuild.resolve.cut(notices.observe(seen, F.count_if(F.col("_error").isNotNull()).alias("errors")))
    number = ((ingest._current(spark, store) or {}).get(-1, -1)) + 1
    counts = {"fetched": fetched, "errors": 0, "new": 0, "changed": 0, "new_auctions": 0} | seen.get | ingest.apply(notices, number, store, now)
    if cursor_:
        set_state(spark, store, "ov:since", cursor_, now)
    log_run(spark, store, source, now, now, counts)
    return counts


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gavelyard")
    p.add_argument("store")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("ov", "ncrd", "geocode", "export", "notify", "stats", "daily", "pgsync", "reparse", "rebuild", "search-add"):
        v = verbs.add_parser(verb)
        for option in ("--landing", "--feed", "--pages", "--since", "--units", "--parcels", "--out", "--site", "--url", "--email", "--filters", "--name", "--now"):
            v.add_argument(option)
        v.add_argument("--redo", action="store_true")
        v.add_argument("--normalize-register", action="store_true")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("gavelyard").getOrCreate()
    now = a.now or datetime.now(timezone.utc).isoformat(timespec="seconds")
    result, code = run_verb(spark, a, now)
    print(json.dumps(result, ensure_ascii=False, default=str))
    return code


def run_verb(spark: SparkSession, a: argparse.Namespace, now: str) -> tuple[object, int]:
    """(result, exit code) of one verb."""
    day = F.to_date(F.lit(now[:10]))

    def held() -> tuple[DataFrame, DataFrame]:
        got = ingest.tables(spark, a.store)
        if got is None:
            raise ValueError("the store is empty")
        notices, auctions = got
        if a.units and a.parcels:
            auctions = rebuild.with_places(auctions, read.cadastral_units(spark, a.units), read.parcel_points(spark, a.parcels), a.normalize_register, a.redo)
        return serve.newest_by_key(notices, ["source", "source_id"], F.col("first_seen").desc(), F.coalesce("versioned_at", F.lit("")).desc()), auctions

    def geocode():
        """Points are stored, so later verbs need no look-up tables; buckets without a new point stay as they are."""
        got = ingest.tables(spark, a.store)
        if got is None:
            raise ValueError("the store is empty")
        notices, auctions = got
        if a.units and a.parcels:
            located = rebuild.resolve.cut(rebuild.with_places(auctions, read.cadastral_units(spark, a.units), read.parcel_points(spark, a.parcels), a.normalize_register, a.redo))
            moved = located.alias("n").join(auctions.alias("o"), "group_key").where("not n.properties <=> o.properties").select(ingest._bucket(F.col("n.block")).alias("b")).distinct()
            buckets = [r["b"] for r in moved.collect()]  # at most BUCKETS
            if buckets:
                of = lambda df: df.where(ingest._bucket(F.col("block")).isin(buckets))
                ingest.replace(spark, a.store, of(notices), of(located), buckets)
            auctions = located
        by = auctions.groupBy(F.coalesce("geo_precision", F.lit("-")).alias("p")).count()
        return {r["p"]: r["count"] for r in by.collect()}

    def export():
        notices, auctions = held()
        rebuild.write_export(auctions, notices, a.out or f"{a.store}/export", now.replace(":", ""), now[:10])
        return {"auctions": auctions.count()}

    def alerts():
        return {"emails": notify(spark, a.store, held()[1], now, now[:10], a.site or "", f"{a.store}/outbox").count()}

    def stats():
        notices, auctions = held()
        return {f"{r['measure']} {r['key']}".strip(): r["n"] for r in serve.stats(auctions, notices, day).collect()}

    def again(kind):
        """The store's tables anew: from all versions and their filings read again, or from the latest of each notice alone."""
        notices, auctions = ingest.tables(spark, a.store) or held()
        stored = notices.drop("group_key", "block")
        raw = read.raw_versions(table(spark, a.store, "raw"))
        if kind == "reparse":
            more = rebuild.resolve.cut(rebuild.read_again(raw, stored, now).select(*stored.columns))
            made, assigned = rebuild.fold(rebuild.resolve.cut(stored.unionByName(more)), now)
            kept = stored.unionByName(ingest._new_versions(more, stored, None))
        else:
            done = rebuild.rebuild(read.notices(raw), serve.newest_by_key(stored, ["source", "source_id"], F.col("first_seen").desc(), F.coalesce("versioned_at", F.lit("")).desc()), now)
            made, assigned, kept = done["auctions"], done["assignments"], done["notices"].select(*stored.columns)
        where = assigned.select("source", "source_id", "group_key", "block").distinct()
        made = rebuild.resolve.cut(rebuild.carried_over(made, auctions))
        ingest.replace(spark, a.store, rebuild.resolve.cut(kept.join(where, ["source", "source_id"])), made)
        return {r["result"]: r["n"] for r in rebuild.run_counts(assigned).collect()}

    steps = {
        "ov": lambda: take_filings(spark, a.store, a.landing, now, a.since, a.feed), "ncrd": lambda: take_register(spark, a.store, a.pages, now), "geocode": geocode, "export": export, "notify": alerts,
        "pgsync": lambda: sync(sync_tables(spark, a.store, *held()), a.url) if a.url else {"skipped": True},
    }
    if a.verb == "daily":
        return rebuild.daily(steps)
    verbs = steps | {"stats": stats, "reparse": lambda: again("reparse"), "rebuild": lambda: again("rebuild"), "search-add": lambda: add_search(spark, a.store, a.email, json.loads(a.filters or "{}"), now, a.name)}
    return verbs[a.verb](), 0


if __name__ == "__main__":
    raise SystemExit(main())
