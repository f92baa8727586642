"""Queries over matching as joins, states as aggregates, versions, feeds, stored payloads and the map's zooms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import Window

from . import fixed as X
from .functions import payload
from .operators import geo, match, notices, serve, states
from .queries import ITEMS_SQL, items, query, t
from .sources import read
from .sources.scratch import folder

PROPERTY = "array<struct<obec:string,ku:string,lv:array<string>>>"


def _estate(*folios) -> Column:
    return F.array(F.struct(F.lit(None).cast("string").alias("obec"), F.lit("Dolná Ves").alias("ku"), F.array(*folios).alias("lv"))).cast(PROPERTY)


# -- next rounds -------------------------------------------------------------------------------------------------
_ROUND_SQL = """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_custkey % 3 AS estate, o_orderkey % 4 = 0 AS told, CASE (o_orderkey // 4) % 5 WHEN 0 THEN 13 WHEN 1 THEN 14 WHEN 2 THEN 366 WHEN 3 THEN 367 ELSE NULL END AS gap, (o_orderkey // 20) % 4 = 3 AS alone FROM orders"""


@query(f"""WITH o AS ({_ROUND_SQL}), n AS (SELECT *, day + gap AS at FROM o WHERE told AND NOT alone),
  m AS (SELECT n.o_orderkey, a.o_orderkey AS theirs, row_number() OVER (PARTITION BY n.o_orderkey ORDER BY a.day DESC, a.o_orderkey) AS k FROM n JOIN o a ON a.o_custkey = n.o_custkey AND (n.gap IS NULL OR abs(date_diff('day', a.day, n.at)) BETWEEN 14 AND 366))
  SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CAST(theirs AS VARCHAR) AS group_key FROM m WHERE k = 1""")
def match_next_round(spark, sf_dir):
    """Every fourth order told as a next round 13, 14, 366 or 367 days later, or on an unknown day, with the latest of its customer's auctions within reach.

    Every customer's auctions share a folio, and some notices name another one that nobody has. Half of the customers are
    known by number, the others by names of which the notice's is longer.
    """
    o, key = t(spark, sf_dir, "orders"), F.col("o_orderkey")
    numbered = F.col("o_custkey") % 2 == 0
    name = F.concat(F.lit("Kladivko "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    ico = F.when(numbered, F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    day, own = F.to_date("o_orderdate"), F.concat(F.lit("LV"), "o_custkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    auctions = o.select(
        key.cast("string").alias("group_key"), F.lit("dobrovolna").alias("kind"), name.alias("auctioneer_name"), ico.alias("auctioneer_ico"), day.cast("string").alias("auction_at"), _estate(own, F.lit("1")).alias("properties"), place.alias("place"),
    )
    gap = F.element_at(F.array(*map(F.lit, (13, 14, 366, 367, None))), (F.floor(key / 4) % 5 + 1).cast("int"))
    alone = F.floor(key / 20) % 4 == 3
    notices = o.where(key % 4 == 0).select(
        F.lit("ov").alias("source"), key.cast("string").alias("source_id"), F.lit("dobrovolna").alias("kind"), F.when(numbered, F.lit("Iné meno")).otherwise(F.concat(name, F.lit(" Holding, s.r.o."))).alias("auctioneer_name"), ico.alias("auctioneer_ico"),
        F.concat(F.date_add(day, gap).cast("string"), F.lit("T10:00:00")).alias("auction_at"), _estate(F.when(alone, F.lit("none")).otherwise(own)).alias("properties"),
    )
    return match.other_round(notices, auctions).select("source_id", "group_key")


# -- another source ----------------------------------------------------------------------------------------------
_WORDS = ("Zelená", "Modrá", "Dlhá", "Krátka", "Hradná", "Mlynská")
_SAME_DAY_SQL = f"""SELECT o_orderkey, o_custkey, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 < 3 THEN '09:00' ELSE '10:30' END AS clock,
  o_orderkey % 3 AS lv, [w FOR w, i IN {list(_WORDS)} IF (o_orderkey // 8 + 7 * i) % 3 <> 0] AS words, o_orderkey % 2 = 1 AS told FROM orders"""


@query(f"""WITH o AS ({_SAME_DAY_SQL}), m AS (SELECT n.o_orderkey, a.o_orderkey AS theirs, CAST(n.clock <> '' AND n.clock = a.clock AS INT) AS timely, len(list_intersect(n.words, a.words)) AS shared
  FROM o n JOIN o a ON n.told AND NOT a.told AND a.o_custkey = n.o_custkey AND a.day = n.day AND (n.lv = 0 OR a.lv = 0 OR n.lv = a.lv)),
  b AS (SELECT * FROM m QUALIFY timely = max(timely) OVER (PARTITION BY o_orderkey)), c AS (SELECT * FROM b QUALIFY shared = max(shared) OVER (PARTITION BY o_orderkey)), d AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY o_orderkey) = 1)
  SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CAST(theirs AS VARCHAR) AS group_key FROM d""")
def match_other_source(spark, sf_dir):
    """Odd orders as register entries, matched with the even ones of their customer and day: by time, then by words of places, then by being the only one left."""
    o, key = t(spark, sf_dir, "orders"), F.col("o_orderkey")
    clock = F.when(key % 5 == 0, "").when(key % 5 < 3, "T09:00:00").otherwise("T10:30:00")
    at = F.concat(F.date_format(F.trunc(F.to_date("o_orderdate"), "year"), "yyyy-MM-dd"), clock)
    words = F.array_join(F.array_compact(F.array(*[F.when((F.floor(key / 8) + 7 * (i + 1)) % 3 != 0, w) for i, w in enumerate(_WORDS)])), ", ")
    estate = F.when(key % 3 != 0, _estate((key % 3).cast("string"))).otherwise(F.array().cast(PROPERTY))
    both = o.select(
        key.alias("key"), key.cast("string").alias("source_id"), key.cast("string").alias("group_key"), F.lit("dobrovolna").alias("kind"), F.lit("Príklep").alias("auctioneer_name"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("auctioneer_ico"),
        at.alias("auction_at"), words.alias("venue"), estate.alias("properties"), F.lit(None).cast("string").alias("obec"), F.lit(None).cast("string").alias("ku"), F.array(F.struct(F.lit("ov").alias("source"))).alias("sources"),
    )
    return match.told_elsewhere(both.where("key % 2 = 1").withColumn("source", F.lit("ncrd")), both.where("key % 2 = 0")).select("source_id", "group_key")


# -- versions ----------------------------------------------------------------------------------------------------
@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderkey % 10 AS m FROM orders)
  SELECT CAST(k AS VARCHAR) AS group_key, CASE WHEN m = 0 THEN 'created' ELSE 'vanished' END AS change, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM o WHERE m IN (0, 1)
  UNION ALL SELECT CAST(k AS VARCHAR), 'changed', 'min_bid', CAST(CAST(floor(p) AS BIGINT) AS VARCHAR), CAST(CAST(floor(p) + 1 AS BIGINT) AS VARCHAR) FROM o WHERE m IN (3, 4)
  UNION ALL SELECT CAST(k AS VARCHAR), 'changed', 'status', 'pripravovana', 'odrocena' FROM o WHERE m IN (4, 5) UNION ALL SELECT CAST(k AS VARCHAR), 'changed', 'round', NULL, '2' FROM o WHERE m = 6""")
def version_changes(spark, sf_dir):
    """Two versions of the auctions: some are new, some gone, some have another price, status or round; a price that is off by less than the tolerance is the same."""
    o, m = t(spark, sf_dir, "orders"), F.col("o_orderkey") % 10
    price = F.floor("o_totalprice").cast("double")
    base = o.select(F.col("o_orderkey").cast("string").alias("group_key"), m.alias("m"), price.alias("min_bid"), F.lit("pripravovana").alias("status"), F.lit(None).cast("int").alias("round"))
    after = base.where("m != 1").withColumns({"min_bid": F.when(F.col("m").isin(3, 4), F.col("min_bid") + 1).when(F.col("m") == 7, F.col("min_bid") + 0.004).otherwise(F.col("min_bid")), "status": F.when(F.col("m").isin(4, 5), "odrocena").otherwise("pripravovana"), "round": F.when(F.col("m") == 6, 2)})
    return states.changes(base.where("m != 0"), after)


# -- feeds and payloads ------------------------------------------------------------------------------------------
@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS changed_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS content FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01'")
def feed_since(spark, sf_dir):
    """The orders as a feed of pages, read back from a day on."""
    o, path = t(spark, sf_dir, "orders"), folder(spark, "feed")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00Z'")
    page = F.lpad((F.col("o_orderkey") % 48).cast("string"), 4, "0")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("content"), F.when(F.col("o_orderkey") % 2 == 0, at).alias("updated_at"), F.when(F.col("o_orderkey") % 2 == 1, at).alias("created_at"), page.alias("page"))
    rows.repartition("page").write.partitionBy("page").json(path)
    got = read.feed_items(spark, path, "1995-03-01")
    return got.select(F.col("source_id").cast("long").alias("id"), F.coalesce("updated_at", "created_at").alias("changed_at"), "content")


@query("""SELECT CAST(event_id AS VARCHAR) AS source_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN CAST(k AS DOUBLE) WHEN event_id % 7 = 3 THEN CAST(k * 1000 AS DOUBLE) + 0.5 END AS min_bid, CASE WHEN event_id % 7 IN (0, 4) THEN CAST(k AS INT) END AS round,
  CASE WHEN event_id % 7 = 1 THEN 'Ves' WHEN event_id % 7 = 2 THEN event_type END AS obec, CAST(CASE WHEN event_id % 7 IN (1, 2) THEN 1 WHEN event_id % 7 = 4 THEN 2 ELSE 0 END AS INT) AS n_properties FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)""")
def stored_payloads(spark, sf_dir):
    """Notices stored as JSON of changing shape: numbers, numbers and amounts in text, one property or a list, missing paths, broken JSON."""
    e = t(spark, sf_dir, "events")
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    bodies = (
        F.concat(F.lit('{"min_bid": '), k, F.lit(', "round": "'), k, F.lit('"}')),
        F.concat(F.lit('{"min_bid": "'), k, F.lit('", "properties": {"obec": "Ves"}, "round": {"no": 1}}')),
        F.concat(F.lit('{"min_bid": '), k, F.lit('.0, "properties": [{"obec": "'), kind, F.lit('", "lv": ["1"]}], "extra": {"a": [1]}}')),
        F.concat(F.lit('{"min_bid": "'), k, F.lit(' 000,50 EUR"}')),
        F.concat(F.lit('{"round": '), k, F.lit(', "min_bid": {"value": 3}, "properties": [{"ku": "A"}, {"ku": "B"}]}')),
        F.concat(F.lit('{"min_bid": '), k), F.lit("[1, 2]"),
    )
    stored = e.select(F.lit("ov").alias("source"), F.col("event_id").cast("string").alias("source_id"), F.element_at(F.array(*bodies), (F.col("event_id") % 7 + 1).cast("int")).alias("payload"))
    first = F.try_element_at("properties", F.lit(1))
    return payload.notices(stored).select("source_id", "min_bid", "round", first["obec"].alias("obec"), F.coalesce(F.size("properties"), F.lit(0)).alias("n_properties"))


# -- the map -----------------------------------------------------------------------------------------------------
@query(f"""SELECT CAST(z AS INT) AS zoom, CAST(floor((lng + 180) / 360 * 256 * power(2, z) / 45) AS BIGINT) AS cell_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * power(2, z) / 45) AS BIGINT) AS cell_y, count(*) AS n, round(avg(lat) + 0.000000033, 6) AS lat, round(avg(lng) + 0.000000033, 6) AS lng,
  CASE WHEN count(*) < 10 THEN 0 WHEN count(*) < 50 THEN 1 WHEN count(*) < 200 THEN 2 ELSE 3 END AS size FROM ({ITEMS_SQL}), range(0, {X.CLUSTER_MOST_ZOOM + 1}) r(z) WHERE lat IS NOT NULL GROUP BY 1, 2, 3""")
def zoom_pyramid(spark, sf_dir):
    """Clusters of the map at every zoom, in one query; means are moved off the halves that rounding would decide by the order of summing."""
    return geo.pyramid(items(spark, sf_dir)).withColumns({c: F.round(F.col(c) + 0.000000033, 6) for c in ("lat", "lng")})


# -- small things that had no row of their own -------------------------------------------------------------------
@query(f"SELECT id, lat BETWEEN 47.7 AND 49.65 AND lng BETWEEN 17.0 - 0.2 AND 22.6 AS inside FROM ({ITEMS_SQL}) WHERE lat IS NOT NULL")
def in_country(spark, sf_dir):
    """Which points lie in the country's box."""
    return items(spark, sf_dir).where("lat is not null").select("id", geo.in_country(F.col("lat"), F.col("lng")).alias("inside"))


@query("SELECT l_orderkey, CASE WHEN sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END) = 0 THEN NULL ELSE CAST(sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS DOUBLE) END AS land_area FROM lineitem GROUP BY l_orderkey")
def land_areas(spark, sf_dir):
    """Orders as auctions, lines as properties of one parcel; every third has no area."""
    area = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("long").cast("double"))
    parcel = F.array(F.struct(area.alias("area_m2")))
    each = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(parcel.alias("parcels"))).alias("properties"))
    return each.select("l_orderkey", serve.land_area(F.col("properties")).alias("land_area"))


# -- notices -----------------------------------------------------------------------------------------------------
@query("""SELECT event_id, CASE WHEN b IS NULL THEN 'new' WHEN b = c THEN 'same' ELSE 'changed' END AS result FROM (SELECT event_id, c, lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT *, event_type || ' ' || CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR) AS c FROM events))""")
def notice_versions(spark, sf_dir):
    """Every event as a version of its user's notice: what it says anew."""
    e = t(spark, sf_dir, "events")
    rows = e.select(F.lit("ov").alias("source"), F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("notice_type"), F.floor(F.col("value") / 40).alias("min_bid"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("versioned_at"), F.col("event_id").alias("_id"))
    return notices.versions(rows, F.col("versioned_at"), F.col("_id")).select(F.col("_id").alias("event_id"), "result")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'ov|' || CAST(o_orderkey AS VARCHAR) ELSE 'c' || CAST(o_custkey AS VARCHAR) END || CASE WHEN o_orderkey % 3 <> 0 THEN '' WHEN o_orderkey % 6 = 0 THEN '||' ELSE '|dolna ves|' || CASE WHEN o_orderkey % 9 = 0 THEN '10,7' ELSE '8' END END AS group_key FROM orders""")
def group_keys(spark, sf_dir):
    """Keys of auctions, for executions with unit and folios."""
    o, key = t(spark, sf_dir, "orders"), F.col("o_orderkey")
    estate = F.when(key % 6 != 0, F.when(key % 9 == 0, _estate(F.lit("7"), F.lit("10"))).otherwise(_estate(F.lit("8"))))
    rows = o.select("o_orderkey", F.lit("ov").alias("source"), key.cast("string").alias("source_id"), F.when(key % 3 == 0, "exekucna").otherwise("danova").alias("kind"), F.when(key % 4 != 0, F.concat(F.lit("c"), "o_custkey")).alias("case_key"), estate.alias("properties"))
    return rows.select("o_orderkey", notices.group_key().alias("group_key"))


@query("""SELECT l_orderkey, label, arg_min(l_returnflag, (day, part, line)) AS notice_type, min(day) AS published_at FROM (SELECT l_orderkey, 'L' || CAST(l_suppkey % 4 AS VARCHAR) AS label, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(l_partkey AS VARCHAR) AS part, l_linenumber AS line FROM (SELECT DISTINCT ON (l_orderkey, l_shipdate, l_partkey) * FROM lineitem ORDER BY l_orderkey, l_shipdate, l_partkey, l_linenumber)) GROUP BY l_orderkey, label""")
def told_by(spark, sf_dir):
    """Orders as auctions, lines as their notices: each label once, by the first notice."""
    li = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_shipdate", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_suppkey", "l_returnflag")).alias("x")).select("*", "x.*")
    rows = li.select("l_orderkey", F.lit("ov").alias("source"), F.col("l_partkey").cast("string").alias("source_id"), F.concat(F.lit("L"), F.col("l_suppkey") % 4).alias("source_label"), F.lit("u").alias("source_url"), F.col("l_returnflag").alias("notice_type"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("published_at"))
    return notices.sources(rows, "l_orderkey").select("l_orderkey", "label", "notice_type", "published_at")


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'byt' WHEN bool_or(l_returnflag = 'N') THEN 'dom' ELSE 'garaz' END AS main_type, arg_min(CAST(l_partkey AS VARCHAR), l_linenumber) FILTER (WHERE l_linestatus = 'O') AS obec, 'Nitriansky kraj' AS kraj
  FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY l_orderkey""")
def estate_places(spark, sf_dir):
    """Orders as estates of their lines: main type, town of the first line that has one, region of its district."""
    li = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    kind = F.when(F.col("l_returnflag") == "A", "byt").when(F.col("l_returnflag") == "N", "dom").otherwise("garaz")
    none = F.lit(None).cast("string")
    one = F.struct(kind.alias("type"), none.alias("kraj"), F.lit("Nitra").alias("okres"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).alias("obec"), none.alias("ku"))
    estates = li.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", one.alias("p")))), lambda x: x["p"]).alias("properties"))
    p = notices.place(F.col("properties"))
    return estates.select("l_orderkey", p["property_type"].alias("main_type"), p["obec"].alias("obec"), p["kraj"].alias("kraj"))
