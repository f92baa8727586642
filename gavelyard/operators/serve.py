"""Serving: filters, sorts, facets, counts, exports and alerts over the auctions table."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import fixed as X
from ..functions.text import day_text, discount, fold_case, lookup, money_short, money_text, plural, public_id, redact, short_title, value_text, whole
from .geo import bounds


_NAMES = {"date_from": "from", "date_to": "to"}


# -- filters -----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Filters:
    q: str = ""
    kraj: str = ""
    okres: str = ""
    types: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    minPrice: float | None = None
    maxPrice: float | None = None
    when: str = "upcoming"  # upcoming | past | all
    round: str = ""  # "" | "1" | "2+"
    date_from: str = ""
    date_to: str = ""
    sort: str = "date"  # date | price_asc | price_desc | discount | new
    in_view: bool = False

    def to_query(self) -> str:
        """The query string of a link; defaults and the map view are left out."""
        pairs = []
        for f in fields(self):
            key, value = X.FILTER_KEYS.get(_NAMES.get(f.name, f.name)), getattr(self, f.name)
            if key and value != f.default:
                pairs.append((key, ",".join(value) if isinstance(value, tuple) else f"{value:g}" if isinstance(value, float) else value))
        return urlencode(pairs)

    @classmethod
    def from_query(cls, query: str) -> Filters:
        given, values = dict(parse_qsl(query)), {}
        for f in fields(cls):
            text = given.get(X.FILTER_KEYS.get(_NAMES.get(f.name, f.name)) or "")
            if not text:
                continue
            if isinstance(f.default, tuple):
                values[f.name] = tuple(filter(None, text.split(",")))
            elif f.name in ("minPrice", "maxPrice"):
                try:
                    values[f.name] = float(text)
                except ValueError:
                    continue
            else:
                values[f.name] = text
        return cls(**values)

    def active(self) -> int:
        """How many filters are set; the two prices count once, and so do the two dates."""
        single = (self.q, self.kraj, self.okres, self.types, self.kinds, self.when != "upcoming", self.round)
        return sum(map(bool, single)) + (self.minPrice is not None or self.maxPrice is not None) + bool(self.date_from or self.date_to)


def effective_status(status: Column, auction_at: Column, today: Column) -> Column:
    """A coming auction whose day has passed is over; a bad date changes nothing."""
    known = F.coalesce(status, F.lit("pripravovana"))
    passed = F.try_to_date(F.substring(auction_at, 1, 10), "yyyy-MM-dd") < today
    return F.when(known.isin(*X.ACTIVE_STATUSES) & passed, "prebehla").otherwise(known)


def is_active(status: Column, auction_at: Column, today: Column) -> Column:
    """For list items: an active status, and no date or one from today on."""
    day = F.substring(F.coalesce(auction_at, F.lit("")), 1, 10)
    return F.coalesce(status.isin(*X.ACTIVE_STATUSES), F.lit(False)) & ((day == "") | (day >= today.cast("string")))


def _all_words(query: Column, names: list[Column]) -> Column:
    hay = fold_case(F.concat_ws(" ", *[F.nullif(n, F.lit("")) for n in names]))
    words = F.filter(F.split(F.trim(F.regexp_replace(fold_case(query), r"(?U)\s+", " ")), " "), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(hay, w))


def list_predicate(f: Filters, today: Column, box: tuple[float, float, float, float] | None = None) -> Column:
    """Filters on list items (short column names); a null price or date fails where a bound is set."""
    price, day = F.coalesce("mb", "av"), F.substring(F.coalesce("d", F.lit("")), 1, 10)
    active = is_active(F.col("s"), F.col("d"), today)
    tests = [
        f.kraj and F.col("kr") == f.kraj, f.okres and F.col("ok") == f.okres, f.types and F.col("t").isin(*f.types), f.kinds and F.col("k").isin(*f.kinds),
        f.minPrice is not None and price >= f.minPrice, f.maxPrice is not None and price <= f.maxPrice,
        active if f.when == "upcoming" else ~active if f.when == "past" else None,
        f.date_from and (day != "") & (day >= f.date_from), f.date_to and (day != "") & (day <= f.date_to),
        f.round == "1" and F.coalesce("r", F.lit(1)) == 1, f.round == "2+" and F.coalesce("r", F.lit(1)) >= 2,
        f.q.strip() and _all_words(F.lit(f.q), [F.col(c) for c in ("ti", "ob", "ok", "kr", "au")]),
    ]
    if f.in_view and box:
        west, south, east, north = box
        tests.append(F.col("lng").between(west, east) & F.col("lat").between(south, north))
    out = F.lit(True)
    for t in tests:
        if isinstance(t, Column):
            out = out & F.coalesce(t, F.lit(False))
    return out


def list_order(f: Filters) -> list[Column]:
    """Sort keys; ties keep the export order (latest auction first, then id)."""
    price = F.coalesce("mb", "av")
    first = {
        "date": F.nullif("d", F.lit("")).desc_nulls_last() if f.when == "past" else F.nullif("d", F.lit("")).asc_nulls_last(),
        "price_asc": price.asc_nulls_last(), "price_desc": price.desc_nulls_last(), "discount": F.coalesce(discount(F.col("mb"), F.col("av")), F.lit(0.0)).desc(),
        "new": F.col("fs").desc(),
    }[f.sort]
    return [first, F.col("id").asc()] if f.sort == "new" else [first, F.col("d").desc_nulls_last(), F.col("id").asc()]


def search(items: DataFrame, f: Filters, today: Column, box: tuple | None = None, page: int | None = None, page_rows: int = X.PAGE_ROWS) -> DataFrame:
    """The filtered list in order; a page is a top-k of all pages up to it, so no full sort is needed."""
    found = items.where(list_predicate(f, today, box)).orderBy(*list_order(f))
    return found if page is None else found.offset(page * page_rows).limit(page_rows)


def alert_predicate(a: str, f: str, today: Column) -> Column:
    """Does auction `a` match the stored filters in columns of `f`? Full prices, its own haystack, active ones only."""
    c, g = lambda n: F.col(f"{a}.{n}"), lambda n: F.col(f"{f}.{n}")
    price, turn = F.coalesce(c("min_bid"), c("appraised_value")), F.coalesce(F.nullif(c("round"), F.lit(0)), F.lit(1))
    free = lambda column, test: F.coalesce(column, F.lit("")).isin("") | F.coalesce(test, F.lit(False))
    any_of = lambda column, value: F.coalesce(F.size(column) <= 0, F.lit(True)) | F.coalesce(F.array_contains(column, value), F.lit(False))
    return (
        free(g("kraj"), c("kraj") == g("kraj")) & free(g("okres"), c("okres") == g("okres"))
        & any_of(g("types"), F.coalesce(F.nullif(c("property_type"), F.lit("")), F.lit("ine"))) & any_of(g("kinds"), c("kind"))
        & (g("min_price").isNull() | F.coalesce(price >= g("min_price"), F.lit(False))) & (g("max_price").isNull() | F.coalesce(price <= g("max_price"), F.lit(False)))
        & F.when(g("round") == "1", turn == 1).when(g("round") == "2+", turn >= 2).otherwise(F.lit(True))
        & _all_words(g("q"), [c(n) for n in ("title", "obec", "ku", "okres", "kraj", "auctioneer_name")])
        & effective_status(c("status"), c("auction_at"), today).isin(*X.ACTIVE_STATUSES)
    )


#: What searches are found by: (field of a search, is it a list?, column of an auction).
_INDEXED = (("kraj", False, "kraj"), ("okres", False, "okres"), ("types", True, "property_type"), ("kinds", True, "kind"))
_ANY = "*"
#: Tasks among which the auctions of a search without any of these fields are divided.
_WILD_PARTS = 16


def _search_keys(searches: DataFrame) -> DataFrame:
    """`searches` once per key that an auction it may match must have: one value, or any, for every indexed field."""
    wanted = lambda c, many: F.transform(F.col(c), lambda v: F.concat(F.lit("="), v)) if many else F.array(F.concat(F.lit("="), F.nullif(c, F.lit(""))))
    given = lambda c, many: F.coalesce(F.size(c) > 0, F.lit(False)) if many else F.coalesce(F.col(c), F.lit("")) != ""
    keyed = searches
    for c, many, _ in _INDEXED:
        values = F.when(given(c, many), F.array_compact(F.array_distinct(wanted(c, many)))).otherwise(F.array(F.lit(_ANY)))
        keyed = keyed.withColumn(f"_{c}", F.explode(values))
    return keyed.withColumn("_key", F.concat_ws("\u0001", *[f"_{c}" for c, _, _ in _INDEXED])).drop(*[f"_{c}" for c, _, _ in _INDEXED])


def alerts(auctions: DataFrame, searches: DataFrame, sent: DataFrame, today: Column) -> DataFrame:
    """(search_id, group_key): matches first seen after a search's last notice and not yet sent for it.

    Searches are indexed by region, district, type and kind, each a value or any: an auction has one key for each choice of
    fields that some search makes (16 choices at most), so it meets only searches that share a key, by an equi-join. Searches
    without any of these fields have one key in common; their auctions are divided among several tasks.
    """
    live = _search_keys(searches.where("active"))
    own = {c: F.concat(F.lit("="), F.coalesce(F.nullif(col, F.lit("")), F.lit("ine")) if c == "types" else F.col(col)) for c, _, col in _INDEXED}
    uses = F.transform(F.split("_key", "\u0001"), lambda part: part != _ANY)
    shapes = [r["u"] for r in live.select(uses.alias("u")).distinct().collect()]  # at most 2 ** len(_INDEXED)
    if not shapes:
        return auctions.join(searches, F.lit(False)).select("search_id", "group_key")
    wild = "\u0001".join([_ANY] * len(_INDEXED))
    keys = F.array(*[F.concat_ws("\u0001", *[F.coalesce(own[c], F.lit("!")) if used else F.lit(_ANY) for used, (c, _, _) in zip(shape, _INDEXED, strict=True)]) for shape in shapes])
    part = F.when(F.col("_key") == wild, F.pmod(F.xxhash64("group_key"), F.lit(_WILD_PARTS))).otherwise(F.lit(0))
    active = auctions.where(effective_status(F.col("status"), F.col("auction_at"), today).isin(*X.ACTIVE_STATUSES))
    asked = active.withColumn("_key", F.explode(keys)).withColumn("_part", part)
    parts = F.when(F.col("_key") == wild, F.sequence(F.lit(0), F.lit(_WILD_PARTS - 1))).otherwise(F.array(F.lit(0)))
    offered = live.withColumn("_part", F.explode(parts)).withColumn("_part", F.col("_part").cast("long"))
    test = (F.col("a.first_seen") > F.coalesce(F.col("f.last_notified_at"), F.col("f.created_at"))) & alert_predicate("a", "f", today)
    hit = asked.alias("a").join(offered.alias("f"), ["_key", "_part"]).where(test).select("f.search_id", "a.group_key")
    return hit.join(sent.select("search_id", "group_key"), ["search_id", "group_key"], "left_anti")


def render_alerts(hits: DataFrame, auctions: DataFrame, searches: DataFrame, site: str) -> DataFrame:
    """One message per search: search_id, email, subject, text, html. Delivery is left to the caller."""
    rows = hits.join(auctions, "group_key").join(searches.select("search_id", "email", F.col("name").alias("search_name")), "search_id")
    place = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("obec", "ku", "okres")], F.lit(""))
    title = F.concat(F.coalesce(lookup(X.TYPE_LABELS, F.coalesce("property_type", F.lit("ine"))), F.lit("")), F.lit(", "), place)
    url = F.concat(F.lit(f"{site}/#id="), public_id(F.col("group_key")))
    day, price = F.substring(F.coalesce("auction_at", F.lit("")), 1, 10), money_text(F.col("min_bid"), " ")
    kind = F.coalesce(lookup(X.KIND_LABELS, F.col("kind")), F.lit(""))
    safe = F.replace(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("- "), F.concat_ws(" | ", title, kind, day, price), F.lit("\n  "), url)
    cells = F.concat(F.lit("<tr><td><a href='"), url, F.lit("'>"), safe, F.lit("</a></td><td>"), day, F.lit("</td><td>"), price, F.lit("</td></tr>"))
    items = rows.select("search_id", "email", "search_name", F.struct("auction_at", "group_key", line.alias("line"), cells.alias("cells")).alias("i"))
    whole_ = items.groupBy("search_id", "email", "search_name").agg(F.sort_array(F.collect_list("i")).alias("i"), F.count(F.lit(1)).alias("n"))
    name = F.coalesce("search_name", F.lit("Vaše hľadanie"))
    subject = F.concat(F.col("n"), F.when(F.col("n") == 1, " nová dražba").otherwise(" nové dražby"), F.lit(" – "), name)
    text = F.concat(name, F.lit("\n\n"), F.array_join(F.transform("i", lambda x: x["line"]), "\n"))
    html = F.concat(F.lit("<h2>"), name, F.lit("</h2><table>"), F.array_join(F.transform("i", lambda x: x["cells"]), ""), F.lit("</table>"))
    return whole_.select("search_id", "email", "n", subject.alias("subject"), text.alias("text"), html.alias("html"))


# -- export ------------------------------------------------------------------------------------------------------
def first_area(properties: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(properties, lambda p: p["area_m2"]), lambda v: v != 0), F.lit(1))


def land_area(properties: Column) -> Column:
    """Total area of all parcels; null for none."""
    areas = F.flatten(F.transform(properties, lambda p: F.transform(F.coalesce(p["parcels"], F.array()), lambda x: F.coalesce(x["area_m2"], F.lit(0.0)))))
    return F.nullif(F.aggregate(areas, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def list_items(auctions: DataFrame, today: Column) -> DataFrame:
    """The compact list that clients filter."""
    place = F.coalesce(F.nullif("obec", F.lit("")), F.col("ku"))
    title = short_title(F.col("property_type"), F.coalesce(F.nullif("obec", F.lit("")), F.nullif("ku", F.lit("")), F.col("okres")), first_area(F.col("properties")))
    return auctions.select(
        public_id(F.col("group_key")).alias("id"), F.col("kind").alias("k"), effective_status(F.col("status"), F.col("auction_at"), today).alias("s"),
        F.coalesce(F.nullif("property_type", F.lit("")), F.lit("ine")).alias("t"), title.alias("ti"), F.col("kraj").alias("kr"), F.col("okres").alias("ok"),
        place.alias("ob"), F.col("auction_at").alias("d"), F.col("round").alias("r"), whole(F.col("min_bid")).alias("mb"), whole(F.col("appraised_value")).alias("av"),
        whole(F.col("highest_bid")).alias("hb"), F.bround("lat", 6).alias("lat"), F.bround("lng", 6).alias("lng"), F.col("geo_precision").alias("gp"),
        F.col("auctioneer_name").alias("au"), F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["source"]))).alias("src"),
        F.substring("first_seen", 1, 10).alias("fs"), first_area(F.col("properties")).alias("ar"), whole(land_area(F.col("properties"))).alias("la"),
    )


def details(auctions: DataFrame, notices: DataFrame, today: Column) -> DataFrame:
    """One row per auction with its nested properties, history and notices; personal data hidden."""
    told = F.struct("published_at", "source", "source_id", F.col("source_url").alias("url"), F.col("source_label").alias("label"), F.col("notice_type").alias("type"), F.coalesce(lookup(X.NOTICE_LABELS, F.col("notice_type")), "notice_type").alias("type_label"), "auction_at", "documents")
    nested = notices.groupBy("group_key").agg(F.sort_array(F.collect_list(told)).alias("notices"))
    status = effective_status(F.col("status"), F.col("auction_at"), today)
    shown = auctions.join(nested, "group_key", "left").withColumns({"status": status, **{c: redact(F.col(c)) for c in ("description", "title", "reason", "inspection", "proposer")}})
    shown = shown.withColumns({
        "status_label": F.coalesce(lookup(X.STATUS_LABELS, F.col("status")), "status"), "kind_label": F.coalesce(lookup(X.KIND_LABELS, F.col("kind")), "kind"),
        "property_type_label": lookup(X.TYPE_LABELS, F.coalesce(F.nullif("property_type", F.lit("")), F.lit("ine"))), "id": public_id(F.col("group_key")),
    })
    return shown.drop("group_key", "last_notice_at", "last_seen")


def features(items: DataFrame) -> DataFrame:
    """Map points as GeoJSON text."""
    properties = F.struct(F.col("id").alias("pid"), "t", money_short(F.coalesce("mb", "av")).alias("price"), F.col("s").isin("prebehla", "zrusena", "zmarena").cast("int").alias("past"), F.coalesce((F.col("gp") != "parcela").cast("int"), F.lit(1)).alias("approx"))
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    return items.where("lat is not null and lng is not null").select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))).alias("feature"))


# -- what a page shows -------------------------------------------------------------------------------------------
def card_title(items: str = "") -> Column:
    """Title of a list card; an unknown thing without a place is named by its auctioneer."""
    c = lambda n: F.col(f"{items}{n}")
    unknown = (c("t") == "ine") & (F.coalesce(c("ob"), F.lit("")) == "")
    return F.when(unknown, F.concat(F.lit("Dražba – "), F.coalesce(F.nullif(c("au"), F.lit("")), F.lit("bez údajov o predmete")))).otherwise(c("ti"))


def history_value(field: Column, value: Column) -> Column:
    """How a field's old or new value is shown."""
    return (
        F.when(value.isNull(), "—").when(field.isin("min_bid", "appraised_value", "deposit", "highest_bid"), money_text(value.try_cast("double")))
        .when(field == "auction_at", day_text(value)).when(field == "status", F.coalesce(lookup(X.STATUS_LABELS, value), value))
        .when(field == "round", F.concat(value, F.lit(". kolo"))).otherwise(value)
    )


def field_label(field: Column) -> Column:
    return F.coalesce(lookup(X.FIELD_LABELS, field), field)


def short_type(kind: Column) -> Column:
    return F.coalesce(lookup(X.SHORT_TYPE_LABELS, kind), kind)


def parcels_text(parcels: Column, most: int = X.SHOWN_PARCELS) -> Column:
    """The first parcels in words, and how many more there are; null for none."""
    one = lambda p: F.concat(F.when(p["register"] != "", F.concat(p["register"], F.lit(" "))).otherwise(""), p["number"], F.when(p["area_m2"] != 0, F.concat(F.lit(" ("), value_text(p["area_m2"]), F.lit(" m²)"))).otherwise(""))
    more = F.when(F.size(parcels) > most, F.concat(F.lit(" a ďalších "), F.size(parcels) - most)).otherwise("")
    return F.when(F.size(parcels) > 0, F.concat(F.array_join(F.transform(F.slice(parcels, 1, most), one), ", "), more))


def reason_text(reason: Column, status: Column, most: int = X.SHOWN_REASON) -> Column:
    """The reason of a cancelled, failed or void auction, cut to a length."""
    return F.when(status.isin("zrusena", "zmarena", "neplatna") & (reason != ""), F.substring(reason, 1, most))


def all_documents(notices: Column) -> Column:
    return F.flatten(F.transform(notices, lambda n: F.coalesce(n["documents"], F.array())))


def camera(properties: Column, polygons: Column) -> Column:
    """struct(west, south, east, north, lng, lat, zoom): the box of all outlines (`polygons`, rings of points), else the first point and a zoom for it."""
    box = bounds(F.flatten(F.flatten(F.coalesce(polygons, F.array()))))
    first = F.try_element_at(F.filter(properties, lambda p: p["lat"].isNotNull()), F.lit(1))
    boxed = box["west"].isNotNull()
    zoom = F.when(~boxed & first.isNotNull(), F.when(first["geo_source"] == "ku", X.ZOOM_UNIT).otherwise(X.ZOOM_OTHER))
    return F.struct(*[box[c].alias(c) for c in ("west", "south", "east", "north")], F.when(~boxed, first["lng"]).alias("lng"), F.when(~boxed, first["lat"]).alias("lat"), zoom.alias("zoom"))


def header(items: DataFrame, today: Column, f: Filters) -> DataFrame:
    """One row: how many items a filter finds (any view), in words, and how many of them the map can't show."""
    found = items.where(list_predicate(replace(f, in_view=False), today)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lat").isNull()).alias("hidden"))
    return found.withColumn("text", F.concat("n", F.lit(" "), plural(F.col("n"), "dražba", "dražby", "dražieb")))


# -- facets and counts -------------------------------------------------------------------------------------------
def facets(items: DataFrame, kraj: str | None = None) -> DataFrame:
    """Regions, or the districts of one, in Slovak order."""
    column, rows = ("ok", items.where(F.col("kr") == kraj)) if kraj else ("kr", items)
    return rows.select(F.col(column).alias("value")).where("value != ''").distinct().orderBy(F.collate("value", "sk"))


def stats(auctions: DataFrame, notices: DataFrame, today: Column) -> DataFrame:
    """(measure, key, n): every count of the report. "upcoming" is given by date and by effective status."""
    by = lambda name, column: auctions.groupBy(F.coalesce(column, F.lit("-")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "key", "n")
    has = lambda s: F.exists("sources", lambda x: x["source"] == s)
    counts = {
        "auctions": F.count(F.lit(1)), "with_coords": F.count("lat"), "upcoming_by_date": F.count_if(F.col("auction_at") >= today.cast("string")),
        "upcoming_by_status": F.count_if(effective_status(F.col("status"), F.col("auction_at"), today).isin(*X.ACTIVE_STATUSES)),
        "multi_source": F.count_if(has("ov") & has("ncrd")), "history_rows": F.coalesce(F.sum(F.size("history")), F.lit(0)),
    }
    one = auctions.agg(*[c.cast("long").alias(k) for k, c in counts.items()])
    single = one.select(F.explode(F.create_map(*[x for k in counts for x in (F.lit(k), F.col(k))])).alias("measure", "n")).select("measure", F.lit("").alias("key"), "n")
    of_source = notices.groupBy("source").agg(F.count(F.lit(1)).alias("notices"), F.count_distinct("group_key").alias("auctions"))
    told = of_source.selectExpr("stack(2, 'notices_by_source', notices, 'auctions_by_source', auctions) as (measure, n)", "source as key").select("measure", "key", "n")
    out = single.union(told)
    for name, column in (("by_kind", F.col("kind")), ("by_status", F.col("status")), ("geo_precision", F.col("geo_precision"))):
        out = out.union(by(name, column))
    return out


def latest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Every row with its `place` in a total order: rows are dealt by range, and those of earlier ranges are counted."""
    at = F.monotonically_increasing_id()
    # kept, so that both uses see the same ranges
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(2**33 - 1)}).persist()
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).select(*rows.columns, "place")


def newest_by_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order (upsert semantics without a MERGE)."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
