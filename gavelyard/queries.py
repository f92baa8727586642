"""Queries over the driver's tables, one or more per operator, and their DuckDB SQL.

A query maps a driver table to the shape that an operator works on (orders as auctions, events as notices, ...)
and applies the operator to all rows. `ORACLES` has the same result in SQL where SQL expresses it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import fixed as X
from .functions import regions, text
from .operators import geo, resolve, serve
from .plans import rebuild
from .sources import read
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt to enough tasks for work that takes far longer than reading: a small file would be one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def _q(s: str) -> str:
    return s.replace("'", "''")


def _case(values: dict, key: str, otherwise: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{_q(str(k))}' THEN '{_q(str(v))}'" for k, v in values.items()) + f" ELSE {otherwise} END"


#: Orders joined to customers as compact list items; used by several queries.
ITEMS_SQL = """
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'dobrovolna' WHEN 'O' THEN 'exekucna' ELSE 'danova' END AS k,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'odrocena' WHEN o_orderpriority LIKE '5%' THEN 'zrusena' ELSE 'pripravovana' END AS s,
         CASE o_orderkey % 7 WHEN 0 THEN 'byt' WHEN 1 THEN 'dom' WHEN 2 THEN 'pozemok' WHEN 3 THEN 'garaz' WHEN 4 THEN 'nebytovy' WHEN 5 THEN 'rekreacny' ELSE 'ine' END AS t,
         c_name AS ti, c_mktsegment AS kr, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS ok, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
         CAST(o_orderkey % 4 AS INTEGER) AS r, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(round_even(o_totalprice, 0) AS BIGINT) END AS mb,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(round_even(c_acctbal * 60, 0) AS BIGINT) END AS av,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 47.7 + (c_custkey % 195) / 100.0 END AS lat, 16.8 + (o_orderkey % 580) / 100.0 AS lng, strftime(o_orderdate, '%Y-%m') AS fs
  FROM orders JOIN customer ON o_custkey = c_custkey"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    key, kinds = F.col("o_orderkey"), ("byt", "dom", "pozemok", "garaz", "nebytovy", "rekreacny", "ine")
    unless = lambda n, x: F.when(key % n != 0, x)
    kind = F.when(F.col("o_orderstatus") == "F", "dobrovolna").when(F.col("o_orderstatus") == "O", "exekucna").otherwise("danova")
    status = F.when(F.col("o_orderpriority").startswith("1"), "odrocena").when(F.col("o_orderpriority").startswith("5"), "zrusena").otherwise("pripravovana")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        key.cast("string").alias("id"), kind.alias("k"), status.alias("s"), F.element_at(F.array(*map(F.lit, kinds)), (key % 7 + 1).cast("int")).alias("t"),
        F.col("c_name").alias("ti"), F.col("c_mktsegment").alias("kr"), F.concat(F.lit("NATION_"), "c_nationkey").alias("ok"), F.lit(None).cast("string").alias("ob"), F.lit(None).cast("string").alias("au"),
        unless(11, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"), (key % 4).cast("int").alias("r"), unless(5, text.whole(F.col("o_totalprice"))).alias("mb"),
        unless(6, text.whole(F.col("c_acctbal") * 60)).alias("av"), unless(13, 47.7 + (F.col("c_custkey") % 195) / 100.0).alias("lat"), (16.8 + (key % 580) / 100.0).alias("lng"),
        F.date_format("o_orderdate", "yyyy-MM").alias("fs"),
    )


# -- scalar functions --------------------------------------------------------------------------------------------
_LEGAL = _q(X.LEGAL_FORM)


@query(f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(strip_accents(lower('DRAŽBY ' || p_name || ' ' || p_brand || ', s. r. o.')), '{_LEGAL}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM part""")
def norm_key_names(spark, sf_dir):
    """Company names with accents, capitals, signs and a legal form."""
    return t(spark, sf_dir, "part").select("p_partkey", text.norm_key(F.concat(F.lit("DRAŽBY "), "p_name", F.lit(" "), "p_brand", F.lit(", s. r. o."))).alias("name_key"))


@query(f"""SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, trim(regexp_replace(replace(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'zzqzz'), '{_LEGAL}', ' ', 'g'), 'zzqzz', ' '),
  '[^a-z0-9]+', ' ', 'g')) AS x FROM documents)""")
def norm_key_texts(spark, sf_dir):
    """norm_key over whole texts."""
    x = text.norm_key(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


def _html_sql() -> str:
    c = "html"
    for _ in range(3):
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
            c = f"replace({c}, '{name}', '{char if name != '&nbsp;' else ' '}')"
    c = rf"regexp_replace({c}, '(?i)</?(p|div|li|ul|ol|br|tr|h\d|table)\b[^>]*>', chr(10), 'g')"
    c = f"replace(replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), chr(160), ' '), chr(8203), '')"
    c = rf"regexp_replace({c}, '[ \t\r\f\v]+', ' ', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, ' *\n *', chr(10), 'g'), '\n\n+', chr(10), 'g')"
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, {_html_sql()} AS x FROM pages)")
def html_to_text_pages(spark, sf_dir):
    x = text.html_to_text(F.col("html"))
    return t(spark, sf_dir, "pages").select("page_id", x.alias("x")).select("page_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS dots, CAST(floor(o_totalprice) AS DOUBLE) AS dashes, round(o_totalprice, 2) AS bare, round(o_totalprice, 2) AS labelled FROM orders")
def parse_money_text(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(14,2)")
    dots = F.concat(F.translate(F.format_number(price, 2), ",.", ".,"), F.lit(" EUR"))
    dashes = F.concat(F.translate(F.format_number(F.floor(price), 0), ",", "."), F.lit(",- EUR"))
    labelled = F.concat(F.lit("Zábezpeka je 0 EUR. Najnižšie podanie: "), dots, F.lit(", minimálne prihodenie 200 EUR"))
    return o.select("o_orderkey", text.parse_money(dots).alias("dots"), text.parse_money(dashes).alias("dashes"), text.parse_money(price.cast("string")).alias("bare"), text.find_money_after(labelled, "vyvolávacia cena", "zábezpeka je", "najnižšie podanie", window=30).alias("labelled"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dots, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS named, CAST(NULL AS VARCHAR) AS bad, strftime(o_orderdate, '%Y-%m-%d') || 'T09:30:00' AS moment FROM orders")
def parse_date_text(spark, sf_dir):
    o, d = t(spark, sf_dir, "orders"), F.col("o_orderdate")
    genitive = {m: n for n, m in X.MONTHS.items() if n.endswith("a")}
    named = F.concat(F.lit("dňa "), F.date_format(d, "d"), F.lit(". "), text.lookup(genitive, F.month(d)), F.lit(" "), F.date_format(d, "yyyy"))
    moment = F.concat(F.date_format(d, "d.M.yyyy"), F.lit(" 9:30:00"))
    return o.select("o_orderkey", text.parse_date(F.date_format(d, "d. M. yyyy")).cast("string").alias("dots"), text.parse_date(named).cast("string").alias("named"), text.parse_date(F.concat(F.lit("31. 2. "), F.date_format(d, "yyyy"))).cast("string").alias("bad"), text.parse_datetime(moment).alias("moment"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lpad(CAST(CAST(l_quantity AS INTEGER) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_linenumber * 7 AS VARCHAR), 2, '0') AS clock,
  CASE WHEN CAST(l_quantity AS INTEGER) < 24 THEN lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') || ':00' END AS hour, l_linenumber AS numbered, CAST(l_linenumber + 1 AS INTEGER) AS again FROM lineitem""")
def parse_time_round_text(spark, sf_dir):
    li, h = t(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("int")
    clock = F.concat(F.lit("o "), h % 24, F.lit(" . "), F.lpad((F.col("l_linenumber") * 7).cast("string"), 2, "0"), F.lit(" hod"))
    numbered = F.concat(F.col("l_linenumber"), F.lit(". kolo"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.parse_time(clock).alias("clock"), text.parse_time(F.concat(h, F.lit(" hod"))).alias("hour"), text.parse_round(numbered).alias("numbered"), text.parse_round(F.concat(numbered, F.lit(" opakovanej dražby"))).alias("again"))


_PHRASES = {"Byt č. 5 na 2. poschodí": "byt", "Rodinný dom s dvorom": "dom", "Záhradná chata": "rekreacny", "Skladová hala": "nebytovy", "Garáž v radovej zástavbe": "garaz", "Obytná budova": "dom", "Stavba na pozemku": "nebytovy", "Orná pôda": "pozemok", "Osobné auto": "ine"}


@query("SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_PHRASES.values())) + " END AS kind FROM part")
def classify_cascade(spark, sf_dir):
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", text.property_type(F.concat("p_name", F.lit(": "), phrase)).alias("kind"))


@query(f"SELECT doc_id, md5(text || '; {X.REDACTED} (nar. {X.REDACTED}), r. č. {X.REDACTED}; bytom {X.REDACTED}') AS digest FROM documents")
def redact_numbers_documents(spark, sf_dir):
    """Whole texts that end in a person's name, birth date, number and address."""
    c = F.concat("text", F.lit("; Ján Vzor (nar. 1. 2. 1970), r. č. 700102/1234; bytom Dlhá "), "doc_id")
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(c)).alias("digest"))


@query(f"SELECT c_custkey, 'povinný: {X.REDACTED}, bytom {X.REDACTED}' AS shown FROM customer")
def redact_people(spark, sf_dir):
    c = F.concat(F.lit("povinný: Ján Vzor, bytom Dlhá "), "c_custkey", F.lit(", 949 01 Nitra"))
    return t(spark, sf_dir, "customer").select("c_custkey", text.redact(c).alias("shown"))


@query("SELECT o_orderkey, substr(sha1('ov|' || CAST(o_orderkey AS VARCHAR)), 1, 10) AS public_id FROM orders")
def public_ids(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", text.public_id(F.concat(F.lit("ov|"), "o_orderkey")).alias("public_id"))


@query("""SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS whole, replace(format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)), ',', ' ') || ' €' AS written,
  CASE WHEN o_orderkey % 10 = 1 THEN 'dražba' WHEN o_orderkey % 10 BETWEEN 2 AND 4 THEN 'dražby' ELSE 'dražieb' END AS counted FROM orders""")
def money_labels(spark, sf_dir):
    p = F.col("o_totalprice")
    return t(spark, sf_dir, "orders").select("o_orderkey", text.whole(p).alias("whole"), text.money_text(p, " ").alias("written"), text.plural(F.col("o_orderkey") % 10, "dražba", "dražby", "dražieb").alias("counted"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Žilinský kraj' WHEN 1 THEN 'Bratislavský kraj' WHEN 2 THEN NULL ELSE 'Košický kraj' END AS kraj, CASE n_nationkey % 4 WHEN 0 THEN 'Dolný Kubín' WHEN 1 THEN 'Bratislava II' WHEN 3 THEN 'Košice - okolie' END AS okres, 'Trnavský kraj' AS coded FROM nation")
def region_lookup(spark, sf_dir):
    spelled = F.element_at(F.array(*map(F.lit, ("Okres DOLNY KUBIN", "Bratislava 2", "Atlantída", "kosice-okolie"))), F.col("n_nationkey") % 4 + 1)
    return t(spark, sf_dir, "nation").select("n_nationkey", regions.district_region(spelled).alias("kraj"), regions.normalize_district(spelled).alias("okres"), regions.code_region(F.lit("SK021B500123")).alias("coded"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || CAST(event_id AS VARCHAR) || ',\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS again FROM events")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return t(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("again"))


# -- sources and sinks -------------------------------------------------------------------------------------------
@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def upsert_latest(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return serve.newest_by_key(e, ["user_id", "event_type"], F.col("event_id").desc()).select("user_id", "event_type", "event_id", "value")


@query("SELECT page_id FROM pages WHERE (page_id % 3 = 0 OR page_id % 3 = 1)")
def filing_filter(spark, sf_dir):
    names = F.element_at(F.array(F.lit("X1-OV_DRAZBA_OZNAMENIE_DOBROVOLNA-v-2.xml"), F.lit("X2-UPVS_Drazobna_vyhlaska-v-1.XML"), F.lit("X3-OV_INE-v-1.xml")), (F.col("page_id") % 3 + 1).cast("int"))
    return t(spark, sf_dir, "pages").where(read.is_auction(names)).select("page_id")


@query()
def parse_filings(spark, sf_dir):
    """Every order written as a filing, parsed back by the XML reader."""
    o = spread(t(spark, sf_dir, "orders"), "o_orderkey")
    esc = lambda c: c.cast("string")
    body = F.concat(
        F.lit("<Drazba><Cislo>"), "o_orderkey", F.lit("</Cislo><Drazobnik><ObchodneMenoNazov>Kladivko "), "o_custkey", F.lit(" s.r.o.</ObchodneMenoNazov><Ico>"),
        F.lpad(esc(F.col("o_custkey")), 8, "1"), F.lit("</Ico></Drazobnik><KonanieDatum>"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("</KonanieDatum><KonanieCas>10:00</KonanieCas><Predmet>byt, okres Nitra, k. ú. Nitra, LV "),
        F.col("o_orderkey") % 50, F.lit("</Predmet><NajnizsiePodanie>"), esc(F.col("o_totalprice").cast("decimal(14,2)")), F.lit("</NajnizsiePodanie></Drazba>"),
    )
    raw = o.select(F.lit("ov").alias("source"), esc(F.col("o_orderkey")).alias("source_id"), F.concat(F.lit("X"), "o_orderkey", F.lit("-OV_DRAZBA_OZNAMENIE_DOBROVOLNA-v-1.xml")).alias("file_name"), body.alias("content"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.lit(None).cast("string").alias("updated_at"), F.lit(None).cast("struct<year:int,number:int,published_at:string>").alias("bulletin_issue"))
    n = read.notices(raw)
    return n.select("source_id", "kind", "auction_at", "auctioneer_ico", "min_bid", F.col("properties")[0]["lv"][0].alias("lv"), F.col("properties")[0]["kraj"].alias("kraj"))


ORACLES["parse_filings"] = """SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'dobrovolna' AS kind, strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00' AS auction_at, lpad(CAST(o_custkey AS VARCHAR), 8, '1') AS auctioneer_ico,
  round(o_totalprice, 2) AS min_bid, CAST(o_orderkey % 50 AS VARCHAR) AS lv, 'Nitriansky kraj' AS kraj FROM orders"""


@query("SELECT event_type AS source, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events")
def raw_replay(spark, sf_dir):
    """Stored items in the numeric order of their ids, source by source."""
    raw = t(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("source_id"))
    out = None
    for source in ("view", "signup", "purchase", "error", "click"):
        one = read.raw_in_order(raw, source).select("source", F.col("source_id").cast("long").alias("event_id"), "place")
        out = one if out is None else out.union(one)
    return out


# -- filters and sorts -------------------------------------------------------------------------------------------
def _ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n in order, with their place: a top-k, then a window over n rows."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


_TODAY = "1999-06-15"


@query(f"""SELECT id, row_number() OVER (ORDER BY coalesce(mb, av) ASC NULLS LAST, d DESC NULLS LAST, id ASC) AS place FROM ({ITEMS_SQL})
  WHERE k IN ('dobrovolna', 'exekucna') AND t IN ('byt', 'dom', 'pozemok') AND coalesce(mb, av) BETWEEN 1000 AND 300000 AND s IN ('pripravovana', 'odrocena') AND (d IS NULL OR d >= '{_TODAY}')
  AND (CASE WHEN r IS NULL THEN 1 ELSE r END) >= 2 AND contains(lower(ti), 'customer') AND contains(lower(ti || ' ' || ok || ' ' || kr), 'nation_1')
  ORDER BY place LIMIT 60""")
def list_filter_sort(spark, sf_dir):
    f = serve.Filters(q="  CUSTOMER nátion_1 ", types=("byt", "dom", "pozemok"), kinds=("dobrovolna", "exekucna"), minPrice=1000, maxPrice=300000, round="2+", sort="price_asc")
    found = items(spark, sf_dir).where(serve.list_predicate(f, F.to_date(F.lit(_TODAY))))
    return _ranked(found, serve.list_order(f), X.PAGE_ROWS).select("id", "place")


_LIST_SQL = ORACLES["list_filter_sort"].rsplit("ORDER BY place", 1)[0]


@query(_LIST_SQL)
def list_filter_places(spark, sf_dir):
    """All rows of the filtered list, with their place."""
    f = serve.Filters(q="  CUSTOMER nátion_1 ", types=("byt", "dom", "pozemok"), kinds=("dobrovolna", "exekucna"), minPrice=1000, maxPrice=300000, round="2+", sort="price_asc")
    found = items(spark, sf_dir).where(serve.list_predicate(f, F.to_date(F.lit(_TODAY))))
    return serve.placed(found, *serve.list_order(f)).select("id", "place")


def _sort_query(sort: str, when: str, key: str) -> None:
    active = f"s IN ('pripravovana', 'odrocena') AND (d IS NULL OR d >= '{_TODAY}')"
    where = {"upcoming": active, "past": f"NOT ({active})", "all": "true"}[when]
    tail = "id ASC" if sort == "new" else "d DESC NULLS LAST, id ASC"
    name = f"sort_{sort}_{when}"

    def run(spark, sf_dir):
        f = serve.Filters(sort=sort, when=when)
        found = items(spark, sf_dir).where(serve.list_predicate(f, F.to_date(F.lit(_TODAY))))
        return _ranked(found, serve.list_order(f), X.PAGE_ROWS).select("id", "place")

    def places(spark, sf_dir):
        f = serve.Filters(sort=sort, when=when)
        found = items(spark, sf_dir).where(serve.list_predicate(f, F.to_date(F.lit(_TODAY))))
        return serve.placed(found, *serve.list_order(f)).select("id", "place")

    run.__name__, places.__name__ = name, f"{name}_places"
    query(f"SELECT id, row_number() OVER (ORDER BY {key}, {tail}) AS place FROM ({ITEMS_SQL}) WHERE {where} ORDER BY place LIMIT 60")(run)
    query(f"SELECT id, row_number() OVER (ORDER BY {key}, {tail}) AS place FROM ({ITEMS_SQL}) WHERE {where}")(places)


_sort_query("date", "upcoming", "d ASC NULLS LAST")
_sort_query("date", "past", "d DESC NULLS LAST")
_sort_query("price_asc", "all", "coalesce(mb, av) ASC NULLS LAST")
_sort_query("price_desc", "all", "coalesce(mb, av) DESC NULLS LAST")
_sort_query("new", "all", "fs DESC")
_sort_query("discount", "all", "CASE WHEN mb <> 0 AND av > mb THEN 1 - CAST(mb AS DOUBLE) / av ELSE 0 END DESC")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice < 100000 AND l_extendedprice <> 0 AND CAST(floor((1 - l_extendedprice / 100000) * 100 + 0.5) AS BIGINT) >= 5
  THEN CAST(floor((1 - l_extendedprice / 100000) * 100 + 0.5) AS BIGINT) END AS percent FROM lineitem""")
def discount_badge(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.discount_percent(F.col("l_extendedprice"), F.lit(100000.0)).alias("percent"))


@query(f"SELECT id, lat, lng FROM ({ITEMS_SQL}) WHERE lng BETWEEN 17 AND 19.5 AND lat BETWEEN 48 AND 49.1")
def bbox_filter(spark, sf_dir):
    f = serve.Filters(when="all", in_view=True)
    return items(spark, sf_dir).where(serve.list_predicate(f, F.to_date(F.lit(_TODAY)), (17, 48, 19.5, 49.1))).select("id", "lat", "lng")


@query(f"SELECT id, CASE WHEN s IN ('pripravovana', 'odrocena') AND d < '{_TODAY}' THEN 'prebehla' ELSE s END AS status, s IN ('pripravovana', 'odrocena') AND (d IS NULL OR d >= '{_TODAY}') AS active FROM ({ITEMS_SQL})")
def effective_statuses(spark, sf_dir):
    today = F.to_date(F.lit(_TODAY))
    return items(spark, sf_dir).select("id", serve.effective_status(F.col("s"), F.col("d"), today).alias("status"), serve.is_active(F.col("s"), F.col("d"), today).alias("active"))


@query("SELECT doc_id, lower(trim(lang)) AS lang, length(text) <= 45 AND NOT contains(text, ':') AND NOT regexp_matches(text, '[0-9]{3,}') AND NOT regexp_matches(text, '(?i)" + X.PLACE_FORBIDDEN + "') AND trim(text) <> '' AS valid FROM documents")
def place_guard(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("lang")).alias("lang"), text.valid_place(F.col("text")).alias("valid"))


# -- joins -------------------------------------------------------------------------------------------------------
@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_id FROM orders WHERE o_orderkey % 4 = 0")
def anti_known(spark, sf_dir):
    """Notices whose filing isn't stored."""
    ids = t(spark, sf_dir, "orders").select(F.lit("ov").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"))
    return rebuild.missing_raw(ids, ids.where("CAST(source_id AS BIGINT) % 4 <> 0"))


_SEARCHES = [(1, "HOUSEHOLD", None, ["byt", "dom"], None, 20000.0, 200000.0, "", "customer"), (2, None, "NATION_3", None, ["exekucna"], None, None, "2+", ""), (3, "", "", [], [], None, 50000.0, "1", "#000000")]


@query(f"""WITH s(search_id, kraj, okres, types, kinds, lo, hi, round, q) AS (VALUES (1, 'HOUSEHOLD', NULL, ['byt', 'dom'], NULL, 20000.0, 200000.0, '', 'customer'), (2, NULL, 'NATION_3', NULL, ['exekucna'], NULL, NULL, '2+', ''), (3, NULL, NULL, NULL, NULL, NULL, 50000.0, '1', '#000000'))
  SELECT s.search_id, id AS group_key FROM s JOIN ({ITEMS_SQL}) i ON (s.kraj IS NULL OR i.kr = s.kraj) AND (s.okres IS NULL OR i.ok = s.okres) AND (s.types IS NULL OR list_contains(s.types, i.t)) AND (s.kinds IS NULL OR list_contains(s.kinds, i.k))
  AND (s.lo IS NULL OR coalesce(mb, av) >= s.lo) AND (s.hi IS NULL OR coalesce(mb, av) <= s.hi) AND (s.round <> '1' OR (CASE WHEN r = 0 THEN 1 ELSE r END) = 1) AND (s.round <> '2+' OR (CASE WHEN r = 0 THEN 1 ELSE r END) >= 2)
  AND contains(lower(ti), s.q) AND i.s IN ('pripravovana', 'odrocena') AND NOT coalesce(d < '{_TODAY}', false) AND fs > '1997-01' AND CAST(id AS BIGINT) % 9 <> 0""")
def saved_search_match(spark, sf_dir):
    a = items(spark, sf_dir).select(F.col("id").alias("group_key"), F.col("kr").alias("kraj"), F.col("ok").alias("okres"), F.lit("").alias("obec"), F.lit("").alias("ku"), F.col("t").alias("property_type"), F.col("k").alias("kind"), F.col("mb").alias("min_bid"), F.col("av").alias("appraised_value"), F.col("r").alias("round"), F.col("s").alias("status"), F.col("d").alias("auction_at"), F.col("ti").alias("title"), F.lit(None).cast("string").alias("auctioneer_name"), F.col("fs").alias("first_seen"))
    s = spark.createDataFrame([(*x, True, "1997-01", "1996-01") for x in _SEARCHES], "search_id int, kraj string, okres string, types array<string>, kinds array<string>, min_price double, max_price double, round string, q string, active boolean, last_notified_at string, created_at string")
    sent = a.where(F.col("group_key").cast("long") % 9 == 0).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("search_id"), "group_key")
    return serve.alerts(a, s, sent, F.to_date(F.lit(_TODAY)))


@query("""SELECT DISTINCT a.p AS a, b.p AS b FROM (SELECT DISTINCT p_name AS p FROM part) a, (SELECT DISTINCT p_name || ' ' || lower(p_brand) AS p FROM part) b WHERE length(a.p) >= 7 AND contains(b.p, a.p) AND a.p <> b.p""")
def near_duplicate_keys(spark, sf_dir):
    """Names that another name contains, through the first characters of the shorter one."""
    p = t(spark, sf_dir, "part")
    long = p.select(F.concat("p_name", F.lit(" "), F.lower("p_brand")).alias("name")).distinct()
    short = p.select(F.col("p_name").alias("name")).distinct()
    own = short.withColumn("own", F.lit(True)).select(F.col("name").alias("a"), "own")
    others = long.select(F.col("name").alias("b"))
    found = resolve.contained_names(long.union(short).distinct())
    return found.join(own, "a").join(others, "b").select("a", "b")


# -- counts and facets -------------------------------------------------------------------------------------------
@query(f"SELECT DISTINCT kr AS value FROM ({ITEMS_SQL})")
def facet_regions(spark, sf_dir):
    return serve.facets(items(spark, sf_dir))


@query(f"SELECT DISTINCT ok AS value FROM ({ITEMS_SQL}) WHERE kr = 'MACHINERY'")
def facet_dependent(spark, sf_dir):
    return serve.facets(items(spark, sf_dir), "MACHINERY")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS place FROM events ORDER BY event_id DESC LIMIT 10")
def last_runs_topk(spark, sf_dir):
    return _ranked(t(spark, sf_dir, "events").select("event_id"), [F.col("event_id").desc()], 10)


@query("""SELECT origin, id, published_at FROM (SELECT 'ov' AS origin, CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS published_at FROM orders
  UNION ALL SELECT 'ncrd', CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m-%d') FROM events) ORDER BY published_at, origin <> 'ov', id LIMIT 100""")
def rebuild_union_order(spark, sf_dir):
    """The first hundred notices of a rebuild."""
    return rebuild_union_places(spark, sf_dir).where("place <= 100").drop("place")


@query("""SELECT origin, id, published_at, row_number() OVER (ORDER BY coalesce(published_at, ''), origin <> 'ov', id) AS place FROM (SELECT 'ov' AS origin, CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS published_at FROM orders
  UNION ALL SELECT 'ncrd', CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m-%d') FROM events)""")
def rebuild_union_places(spark, sf_dir):
    """The whole order of a rebuild: every notice with its place; those without a day come first."""
    o = t(spark, sf_dir, "orders").select(F.lit("ov").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"))
    e = t(spark, sf_dir, "events").select(F.lit("ncrd").alias("source"), F.col("event_id").cast("string").alias("source_id"), F.date_format("ts", "yyyy-MM-dd").alias("published_at"))
    return rebuild.in_order(o.unionByName(e)).withColumnsRenamed({"source": "origin", "source_id": "id"})


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return ingest.event_windows(t(spark, sf_dir, "events")).withColumn("total", F.round("total", 2))


# -- components -------------------------------------------------------------------------------------------------
@query("SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer")
def component_resolution(spark, sf_dir):
    """Customers joined through shared keys, by label spreading over a graph of customers and keys."""
    c = t(spark, sf_dir, "customer").select("c_custkey", (-1 - F.pmod(F.xxhash64("c_nationkey", "c_mktsegment"), F.lit(2**60))).alias("key"))
    found = resolve.components(c.select(F.col("c_custkey").alias("a"), F.col("key").alias("b")), c.select(F.col("c_custkey").alias("node")).union(c.select("key")))
    named = found.where("node >= 0").groupBy("component").agg(F.min("node").alias("least"))
    return found.where("node >= 0").join(named, "component").select("node", F.col("least").alias("component"))


# -- geometry ----------------------------------------------------------------------------------------------------
def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's numbers two by two as integer points, closed."""
    k = F.floor(F.size("embedding") / 2).cast("int")
    number = lambda i: F.round(F.element_at("embedding", i).cast("double") * 1000, 0)
    points = F.transform(F.sequence(F.lit(0), k), lambda i: F.array(number(2 * (i % k) + 1), number(2 * (i % k) + 2)))
    return t(spark, sf_dir, "embeddings").select("vec_id", points.alias("ring"))


_RING_SQL = """SELECT vec_id, k + 1 AS m, [round(CAST(embedding[1 + (2 * i) % (2 * k)] AS DOUBLE) * 1000, 0) FOR i IN range(0, k + 1)] AS xs, [round(CAST(embedding[2 + (2 * i) % (2 * k)] AS DOUBLE) * 1000, 0) FOR i IN range(0, k + 1)] AS ys
  FROM (SELECT vec_id, embedding, len(embedding) // 2 AS k FROM embeddings)"""


@query(f"""SELECT vec_id, CASE WHEN a <> 0 THEN round(cx / (3 * a), 6) END AS lng, CASE WHEN a <> 0 THEN round(cy / (3 * a), 6) END AS lat FROM (SELECT vec_id, list_sum([xs[k] * ys[k + 1] - xs[k + 1] * ys[k] FOR k IN range(1, m)]) AS a,
  list_sum([(xs[k] + xs[k + 1]) * (xs[k] * ys[k + 1] - xs[k + 1] * ys[k]) FOR k IN range(1, m)]) AS cx, list_sum([(ys[k] + ys[k + 1]) * (xs[k] * ys[k + 1] - xs[k + 1] * ys[k]) FOR k IN range(1, m)]) AS cy FROM ({_RING_SQL}))""")
def ring_centroid(spark, sf_dir):
    c = rings(spark, sf_dir).select("vec_id", geo.centroid(F.array(F.array("ring"))).alias("c"))
    return c.select("vec_id", F.round("c.lng", 6).alias("lng"), F.round("c.lat", 6).alias("lat"))


@query(f"SELECT vec_id, list_min(xs) AS west, list_min(ys) AS south, list_max(xs) AS east, list_max(ys) AS north FROM ({_RING_SQL})")
def ring_bounds(spark, sf_dir):
    return rings(spark, sf_dir).select("vec_id", geo.bounds(F.col("ring")).alias("b")).select("vec_id", "b.*")


@query(f"""SELECT vec_id, len(kept) + 1 AS n, CAST(list_sum([p.x FOR p IN kept]) + xs[m] AS DOUBLE) AS x_sum FROM (SELECT vec_id, xs, m, list_reduce([[{{'x': xs[k], 'y': ys[k]}}] FOR k IN range(2, m)],
  lambda out, p: CASE WHEN abs(p[1].x - out[-1].x) > 40 OR abs(p[1].y - out[-1].y) > 40 THEN list_concat(out, p) ELSE out END, [{{'x': xs[1], 'y': ys[1]}}]) AS kept FROM ({_RING_SQL}))""")
def ring_simplify(spark, sf_dir):
    r = rings(spark, sf_dir).select("vec_id", geo.simplify_ring(F.col("ring"), 40).alias("r"))
    return r.select("vec_id", F.size("r").cast("long").alias("n"), F.aggregate("r", F.lit(0.0), lambda s, p: s + p[0]).alias("x_sum"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) ELSE CAST(n_regionkey AS DOUBLE) END AS lat,
  CASE WHEN s_suppkey % 3 = 0 THEN 'parcela' WHEN n_nationkey % 2 = 0 THEN 'ku' ELSE 'obec' END AS precision FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def geo_cascade(spark, sf_dir):
    """Suppliers located by parcel, by unit, or by the unit named like the municipality."""
    s, n = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "nation")
    units = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("K"), "n_nationkey").alias("code"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lng"))
    # odd nations are units without a centre, inside a municipality named by region
    units = units.union(n.where("n_nationkey % 2 = 1").select(F.concat(F.lit("K"), "n_nationkey"), "n_name", F.lit(None).cast("double"), F.lit(None).cast("double")))
    units = units.union(t(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey"), F.concat(F.lit("Obec "), "r_regionkey"), F.col("r_regionkey").cast("double"), F.lit(0.0)))
    with_nation = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    parcels = with_nation.where("s_suppkey % 3 = 0").select(F.concat(F.lit("K"), "n_nationkey", F.lit("_"), "s_suppkey", F.lit(".C")).alias("ref"), F.col("s_acctbal").alias("lat"), F.lit(0.0).alias("lng"), F.lit(None).cast("array<array<array<array<double>>>>").alias("geom"))
    asked = with_nation.select(F.col("s_suppkey").alias("pid"), F.col("n_name").alias("ku"), F.concat(F.lit("Obec "), "n_regionkey").alias("obec"), F.array(F.struct(F.lit("E").alias("register"), F.lit("9").alias("number")), F.struct(F.lit(None).cast("string").alias("register"), F.concat(F.lit(" "), F.col("s_suppkey")).alias("number"))).alias("parcels"))
    return geo.locate(asked, units, parcels).select(F.col("pid").alias("s_suppkey"), "lat", "precision")


@query(f"""SELECT CAST(floor((lng + 180) / 360 * 256 * 256 / 45) AS BIGINT) AS cell_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * 256 / 45) AS BIGINT) AS cell_y, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng,
  CASE WHEN count(*) < 10 THEN 0 WHEN count(*) < 50 THEN 1 WHEN count(*) < 200 THEN 2 ELSE 3 END AS size FROM ({ITEMS_SQL}) WHERE lat IS NOT NULL GROUP BY 1, 2""")
def grid_clusters(spark, sf_dir):
    c = geo.clusters(items(spark, sf_dir), zoom=8)
    return c.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query(f"SELECT id, CASE WHEN s IN ('prebehla', 'zrusena', 'zmarena') THEN 1 ELSE 0 END AS past, lng FROM ({ITEMS_SQL}) WHERE lat IS NOT NULL")
def map_features(spark, sf_dir):
    f = serve.features(items(spark, sf_dir).withColumn("gp", F.lit("ku")))
    read_back = F.from_json("feature", "geometry struct<coordinates:array<double>>, properties struct<past:int>")
    return f.select("id", read_back["properties"]["past"].alias("past"), read_back["geometry"]["coordinates"][0].alias("lng"))


from . import linkage, stories  # noqa: E402, F401  their queries register themselves
