"""Column functions against the plain-Python parsers of the same name."""

import random

from pyspark.sql import functions as F

from gavelyard.functions import regions, text
from gavelyard.operators import geo, merge
from gavelyard.sources import parse

SAMPLES = [
    "78.200", "78.200,- EUR (slovom)", "3.310,00 EUR", "27090.23", "12 500 €", "1 234,5 eur", "cena 5/2020 je 40 €", "", "nič", "dňa 13. októbra 2026 o 9:05 hod", "13. 10. 2026", "2026-02-30",
    "31.02.2026", "prvá opakovaná dražba", "opakovaná", "Druhé kolo", "3. kolo", "kolo tretie", "byt č. 5", "rodinný dom so súpisným číslom 5", "chata", "administratívna budova", "garáž", "obytná budova",
    "orná pôda", "Kladivko, s. r. o.", "DRAŽBY Žilina a.s.", "Súdny exekútor JUDr. Vzor Peter", "Mgr. Peter Vzor, PhD.", "Ľubľana ŁÓDŹ é", "vlastník: Ján Vymyslený, bytom Dlhá 5, 949 01 Nitra",
    "Eva Vzorová r. Nová (nar. 1.2.1970), r. č. 700102/1234", "11 hod", "24:10", "okres Nitra",
]


def table(spark):
    rng = random.Random(5)
    mixed = ["".join(rng.sample(s, len(s))) for s in SAMPLES for _ in range(5)]
    return [s for s in SAMPLES + mixed], spark.createDataFrame([(s,) for s in SAMPLES + mixed], "s string")


def test_columns_equal_python(spark):
    samples, df = table(spark)
    s = F.col("s")
    got = df.select(
        text.parse_money(s).alias("money"), text.parse_date(s).cast("string").alias("day"), text.parse_time(s).alias("time"), text.parse_round(s).alias("round"), text.property_type(s).alias("kind"),
        text.norm_key(s).alias("key"), text.executor_key(s).alias("executor"), text.squash(s).alias("squash"), text.redact(s).alias("redact"), text.valid_place(s).alias("place"),
        regions.normalize_district(s).alias("district"), regions.town_region(s).alias("region"), text.find_money_after(s, "cena", "je", window=20).alias("after"),
    ).collect()
    for x, r in zip(samples, got, strict=True):
        want = (parse.money(x), str(parse.day(x)) if parse.day(x) else None, parse.time_of_day(x), parse.round_number(x), parse.property_type(x), merge.norm_key(x), merge.executor_key(x), parse.squash(x))
        assert (r.money, r.day, r.time, r["round"], r.kind, r.key, r.executor, r.squash) == want, x
        assert (r.place, r.district, r.region, r.after) == (parse.valid_place(x), regions.district(x), regions.region_of_town(x), parse.money_after(x, "cena", "je", window=20)), x
        if "́" not in x:
            assert (r.redact or "") == (parse.redact(x) or ""), x


def test_labels(spark):
    row = spark.range(1).select(
        text.area_text(F.lit(78.30)).alias("a"), text.area_text(F.lit(120.0)).alias("b"), text.short_title(F.lit("byt"), F.lit("Nitra"), F.lit(65.5)).alias("c"), text.short_title(F.lit(None), F.lit(None), F.lit(None)).alias("d"),
        text.money_text(F.lit(1234567.0), " ").alias("e"), text.money_short(F.lit(1250000.0)).alias("f"), text.money_short(F.lit(45600.0)).alias("g"), text.discount_percent(F.lit(90.0), F.lit(100.0)).alias("h"),
        text.days_text(F.to_date(F.lit("2026-01-05")), F.to_date(F.lit("2026-01-02"))).alias("i"), text.day_text(F.lit("2026-01-05T09:30:00")).alias("j"), text.public_id(F.lit("ov|1")).alias("k"),
    ).first()
    assert tuple(row)[:10] == ("78,3", "120", "Byt, Nitra, 65,5 m²", "Iné", "1 234 567 €", "1,25 mil. €", "46 tis. €", 10, "o 3 dni", "5. 1. 2026 o 09:30") and len(row.k) == 10


def test_geometry(spark):
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    line = [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([([[square]],), ([[line], [square]],), ([[line]],), ([],)], "p array<array<array<array<double>>>>")
    assert [r.c and (r.c.lng, r.c.lat) for r in df.select(geo.centroid(F.col("p")).alias("c")).collect()] == [(1.0, 1.0), (1.0, 1.0), None, None]
    ring = spark.createDataFrame([([[0.0, 0.0], [0.000001, 0.0], [1.1234567, 0.0], [1.0, 1.0], [0.0, 0.0]],)], "r array<array<double>>")
    assert ring.select(geo.simplify_ring(F.col("r")).alias("r")).first().r == [[0.0, 0.0], [1.123457, 0.0], [1.0, 1.0], [0.0, 0.0]]


def test_locate(spark):
    units = spark.createDataFrame([("1", "Nová Ves", 48.0, 18.0), ("2", "Nová Ves", 49.0, 20.0), ("3", "Levoča", 49.02, 20.6)], "code string, label string, lat double, lng double")
    square = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]
    parcels = spark.createDataFrame([("2_5/1.C", 49.001, 20.001, square), ("2_6.C", 49.002, 20.002, square), ("2_7.C", None, None, None)], "ref string, lat double, lng double, geom array<array<array<array<double>>>>")
    own = "array<struct<register:string,number:string>>"
    rows = [
        ("both", "Nová Ves", "Levoča", [("C", "5 / 1"), (None, "6"), ("E", "7")]), ("missing", "Nová Ves", "Levoča", [("C", "7")]), ("quoted", "Nová Ves", "Levoča", [('"C"', "6")]),
        ("town", "Neznáme", "Levoča", []), ("none", "Neznáme", None, []),
    ]
    df = spark.createDataFrame(rows, f"pid string, ku string, obec string, parcels {own}")
    got = {r.pid: (r.precision, r.lat, r.geom and len(r.geom)) for r in geo.locate(df, units, parcels).collect()}
    assert got == {"both": ("parcela", 49.001, 2), "missing": ("ku", 49.0, None), "quoted": ("ku", 49.0, None), "town": ("obec", 49.02, None), "none": (None, None, None)}
    assert {r.pid: r.precision for r in geo.locate(df, units, parcels, normalize_register=True).collect()}["quoted"] == "parcela"


def test_sql_names_plan_without_python(spark):
    from gavelyard.functions import sql
    from gavelyard.operators import merge

    names = sql.register(spark)
    written = ["JUDr. Vzor Peter", "Vzor JUDr. Peter, PhD.", "", None, "Žiar nad Hronom, s. r. o.", "<p>1 200,- EUR o 9.30 hod</p>", "vlastník Ján Novák, nar. 1.1.1970"]
    df = spark.createDataFrame([(w,) for w in written], "written string").repartition(1)
    calls = df.selectExpr("written", *[f"{n}(written) as {n}" for n in (*sql.WRITTEN, "executor_key")])
    assert set(sql.WRITTEN) <= set(names) and not any(x in calls._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow"))
    same = df.select("written", *[f(df.written).alias(n) for n, (f, _) in sql.WRITTEN.items()])
    rows, direct = ({r.written: r.asDict() for r in x.collect()} for x in (calls, same))
    for w in written:
        assert {n: rows[w][n] for n in sql.WRITTEN} == {n: direct[w][n] for n in sql.WRITTEN} and rows[w]["executor_key"] == merge.executor_key(w)
