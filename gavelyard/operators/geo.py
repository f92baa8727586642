"""Geometry on nested arrays, and the cascade that locates a property through lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import fixed as X
from ..functions.text import norm_key


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees, a degree of longitude counted at this country's latitude."""
    return F.hypot(lat1 - lat2, (lng1 - lng2) * X.LONGITUDE_WEIGHT)


def in_country(lat: Column, lng: Column) -> Column:
    west, south, east, north = X.COUNTRY_BOX
    return lng.between(west, east) & lat.between(south, north)


def _moments(ring: Column) -> Column:
    """(doubled area, x moment, y moment) of a ring of [x, y] points, by the shoelace sums."""
    n = F.size(ring)
    ends = F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cross = lambda e: e["p"][0] * e["q"][1] - e["q"][0] * e["p"][1]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(ends, zero, lambda s, e: F.struct((s["a"] + cross(e)).alias("a"), (s["x"] + (e["p"][0] + e["q"][0]) * cross(e)).alias("x"), (s["y"] + (e["p"][1] + e["q"][1]) * cross(e)).alias("y")))


def centroid(polygons: Column) -> Column:
    """struct(lng, lat): centre of the outer ring of the largest polygon; null where no polygon has an area."""
    sums = F.filter(F.transform(polygons, lambda rings: _moments(F.try_element_at(rings, F.lit(1)))), lambda m: m["a"] != 0)
    # of equal areas the first polygon wins
    placed = F.transform(sums, lambda m, i: F.struct(F.abs(m["a"]).alias("size"), (-i).alias("i"), (m["x"] / (3 * m["a"])).alias("lng"), (m["y"] / (3 * m["a"])).alias("lat")))
    best = F.array_max(placed)
    return F.when(best.isNotNull(), F.struct(best["lng"].alias("lng"), best["lat"].alias("lat")))


def simplify_ring(ring: Column, tolerance: float = X.SIMPLIFY_TOLERANCE) -> Column:
    """Points nearer than `tolerance` to the last kept one are left out, both ends stay; six decimals."""
    n = F.size(ring)
    far = lambda p, q: (F.abs(p[0] - q[0]) > tolerance) | (F.abs(p[1] - q[1]) > tolerance)
    inner = F.slice(ring, F.lit(2), F.greatest(n - 2, F.lit(0)))
    kept = F.aggregate(inner, F.slice(ring, 1, 1), lambda out, p: F.when(far(p, F.element_at(out, -1)), F.concat(out, F.array(p))).otherwise(out))
    return F.transform(F.concat(kept, F.slice(ring, F.greatest(n, F.lit(1)), F.lit(1))), lambda p: F.transform(p, lambda v: F.bround(v, 6)))


def bounds(points: Column) -> Column:
    """struct(west, south, east, north) of an array of [x, y] points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def city_part(name: Column) -> Column:
    """A cadastral or municipal name without the prefix of the two big cities."""
    return F.trim(F.regexp_replace(name, X.CITY_PREFIX, ""))


def parcel_numbers(parcels: Column, normalize_register: bool = False) -> Column:
    """The distinct well-formed numbers of register C (null counts as C), at most six, in order.

    `normalize_register` also accepts the long and quoted spellings of that register.
    """
    register = lambda p: F.upper(F.coalesce(F.nullif(p["register"], F.lit("")), F.lit("C")))
    own = (lambda p: F.regexp_replace(F.regexp_replace(register(p), "PARCELA|REGISTRA|KN|[^A-Z]", ""), "^$", "C")) if normalize_register else register
    numbers = F.transform(F.filter(parcels, lambda p: own(p) == "C"), lambda p: F.regexp_replace(F.coalesce(p["number"], F.lit("")), r"(?U)\s", ""))
    return F.slice(F.array_distinct(F.filter(numbers, lambda s: s.rlike(f"^{X.PARCEL_NUMBER}$"))), 1, X.MOST_PARCELS)


def locate(properties: DataFrame, units: DataFrame, parcels: DataFrame, normalize_register: bool = False) -> DataFrame:
    """Each property (`pid`, ku, obec, parcels) with lat, lng, geom, precision.

    Tried in order: its parcels in one of the two nearest cadastral units of its name, the centre of the nearest
    unit, the centre of a unit named like the municipality. `units` (code, label, lat, lng) and `parcels`
    (ref, lat, lng, geom array of polygons) are lookup tables; a parcel row without lat is known not to exist.
    Ties and order among units of one name follow `code`.
    """
    named = units.select(norm_key(F.col("label")).alias("key"), "code", F.col("lat").alias("ulat"), F.col("lng").alias("ulng"))
    name = city_part(F.coalesce(F.nullif("ku", F.lit("")), F.col("obec")))
    base = properties.select("pid", "ku", "obec", name.alias("name"), parcel_numbers(F.col("parcels"), normalize_register).alias("numbers"))
    base = base.withColumns({"key": norm_key(F.col("name")), "town_key": norm_key(F.col("obec")), "part_key": norm_key(city_part(F.col("obec")))})
    # first unit with a centre for each name: the reference point of a municipality
    centres = named.where("ulat is not null").groupBy("key").agg(F.min_by(F.struct("ulat", "ulng"), "code").alias("c"))
    towns = centres.select(F.col("key").alias("town_key"), F.col("c.ulat").alias("tlat"), F.col("c.ulng").alias("tlng"))
    parts = centres.select(F.col("key").alias("part_key"), F.col("c.ulat").alias("plat"), F.col("c.ulng").alias("plng"))
    # units are ranked once for each name and municipality that occur together, not for each property
    found = base.where("key != ''").select("key", "town_key").distinct().join(named, "key").join(towns, "town_key", "left")
    away = F.when(F.col("town_key").isin("") | (F.col("town_key") == F.col("key")) | F.col("tlat").isNull(), F.lit(0.0)).otherwise(
        F.when(F.col("ulat").isNull(), F.lit(1e9)).otherwise(distance(F.col("ulat"), F.col("ulng"), F.col("tlat"), F.col("tlng")))
    )
    rank = F.row_number().over(Window.partitionBy("key", "town_key").orderBy(away, "code"))
    nearest = found.withColumn("rank", rank).where("rank <= 2").select("key", "town_key", "rank", "code", "ulat", "ulng")
    near = base.join(nearest, ["key", "town_key"])
    asked = near.select("pid", "rank", "code", F.posexplode("numbers").alias("nth", "number")).withColumn("ref", F.concat("code", F.lit("_"), "number", F.lit(".C")))
    hits = asked.join(parcels.where("lat is not null").select("ref", F.col("lat").alias("hlat"), F.col("lng").alias("hlng"), F.col("geom").alias("hgeom")), "ref")
    per_unit = hits.groupBy("pid", "rank").agg(F.sort_array(F.collect_list(F.struct("nth", "hlat", "hlng", "hgeom"))).alias("h"))
    best = per_unit.groupBy("pid").agg(F.min_by("h", "rank").alias("h"))
    by_parcel = best.select("pid", F.struct(F.col("h")[0]["hlat"].alias("lat"), F.col("h")[0]["hlng"].alias("lng"), F.flatten(F.filter(F.transform("h", lambda x: x["hgeom"]), lambda g: g.isNotNull())).alias("geom")).alias("parcel"))
    by_unit = near.where("rank = 1 and ulat is not null").select("pid", F.struct(F.col("ulat").alias("lat"), F.col("ulng").alias("lng")).alias("unit"))
    out = base.join(by_parcel, "pid", "left").join(by_unit, "pid", "left").join(parts, "part_key", "left")
    town = F.when((F.col("obec") != "") & (F.col("part_key") != norm_key(F.col("ku"))) & F.col("plat").isNotNull(), F.struct(F.col("plat").alias("lat"), F.col("plng").alias("lng")))
    point = F.coalesce(F.struct("parcel.lat", "parcel.lng"), F.lit(None))
    point = F.when(F.col("parcel").isNotNull(), point).otherwise(F.coalesce(F.col("unit"), town))
    precision = F.when(F.col("parcel").isNotNull(), "parcela").when(F.col("unit").isNotNull(), "ku").when(town.isNotNull(), "obec")
    return out.select("pid", point["lat"].alias("lat"), point["lng"].alias("lng"), F.col("parcel.geom").alias("geom"), precision.alias("precision"))


def clusters(points: DataFrame, zoom: int, radius: int = X.CLUSTER_RADIUS) -> DataFrame:
    """Points counted by cells of `radius` pixels of the Web Mercator map at a zoom: cell_x, cell_y, n, lat, lng, size.

    A deterministic grid in place of greedy clustering; beyond the highest clustered zoom each point stands alone.
    """
    world = 256 * 2**zoom
    x = (F.col("lng") + 180) / 360 * world
    y = (1 - F.log(F.tan(F.radians("lat")) + 1 / F.cos(F.radians("lat"))) / F.pi()) / 2 * world
    cell = radius if zoom <= X.CLUSTER_MOST_ZOOM else 1e-6
    cells = points.where("lat is not null and lng is not null").groupBy(F.floor(x / cell).alias("cell_x"), F.floor(y / cell).alias("cell_y"))
    size = F.when(F.col("n") < X.CLUSTER_SIZES[0], 0).when(F.col("n") < X.CLUSTER_SIZES[1], 1).when(F.col("n") < X.CLUSTER_SIZES[2], 2).otherwise(3)
    return cells.agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng")).withColumn("size", size)


def pyramid(points: DataFrame, zooms: range = range(X.CLUSTER_MOST_ZOOM + 1), radius: int = X.CLUSTER_RADIUS) -> DataFrame:
    """The cells of `clusters` at all zooms: zoom, cell_x, cell_y, n, lat, lng, size.

    A cell of one zoom is four of the next, so points are read and counted once, in the cells of the last zoom; those of all
    coarser zooms are sums of these. Points without a place are left out; positions are means over a cell's points.
    """
    last = max(zooms)
    world = 256 * 2**last
    x = (F.col("lng") + 180) / 360 * world
    y = (1 - F.log(F.tan(F.radians("lat")) + 1 / F.cos(F.radians("lat"))) / F.pi()) / 2 * world
    finest = points.where("lat is not null and lng is not null").groupBy(F.floor(x / radius).alias("x"), F.floor(y / radius).alias("y"))
    finest = finest.agg(F.count(F.lit(1)).alias("k"), F.sum("lat").alias("lats"), F.sum("lng").alias("lngs"))
    each = finest.withColumn("zoom", F.explode(F.array(*map(F.lit, sorted(zooms)))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), last - F.col("zoom")))
    cells = each.groupBy("zoom", up("x").alias("cell_x"), up("y").alias("cell_y")).agg(F.sum("k").alias("n"), (F.sum("lats") / F.sum("k")).alias("lat"), (F.sum("lngs") / F.sum("k")).alias("lng"))
    few, some, many = X.CLUSTER_SIZES
    return cells.withColumn("size", F.when(F.col("n") < few, 0).when(F.col("n") < some, 1).when(F.col("n") < many, 2).otherwise(3))
