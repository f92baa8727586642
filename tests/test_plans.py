import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gavelyard import schema as S
from gavelyard.functions import sql
from gavelyard.operators import resolve, serve
from gavelyard.plans import jobs, rebuild
from gavelyard.sources import read
from gavelyard.streaming import ingest

from .test_merge import bailiff, notice, register

NOW = "2031-05-01T00:00:00+00:00"


def frame(spark, *notices):
    return spark.read.schema(S.struct(S.NOTICE)).json(spark.sparkContext.parallelize([json.dumps(n, ensure_ascii=False) for n in notices]))


def some():
    second = notice("g-2", published_at="2031-03-25", notice_type="opakovana", auction_number="N15", case_key="dd|60606060|n15", auction_at="2031-05-20T13:15:00", round=2, min_bid=36000.0)
    other = register(auctioneer_name="Príklep Stred", auctioneer_ico=None)
    return [notice(), second, other, bailiff("e-1", "JUDr. Hronský Karol", "ex|k|1"), notice("g-9", case_key="dd|80808080|1", auctioneer_ico="80808080", auctioneer_name="Iná dražobná")]


def test_blocks_and_fold(spark):
    df = frame(spark, *some())
    blocks = {(r.source, r.source_id): r.block for r in resolve.blocks(df).collect()}
    assert len(set(blocks.values())) == 3 and blocks["ov", "g-1"] == blocks["ov", "g-2"] == blocks["ncrd", "r-1"]
    auctions, assigned = rebuild.fold(df, NOW)
    rows = {r.group_key: r for r in auctions.collect()}
    assert len(rows) == 3 and {r.result for r in assigned.collect()} == {"new"}
    merged = rows["dd|60606060|n14"]
    assert merged["round"] == 2 and {s.source for s in merged.sources} == {"ov", "ncrd"} and "min_bid" in {h.field for h in merged.history}
    # order of rows doesn't matter
    again, _ = rebuild.fold(df.orderBy(F.desc("source_id")).repartition(3), NOW)
    assert sorted(map(str, again.collect())) == sorted(map(str, auctions.collect()))


def test_export_and_stats(spark, tmp_path):
    auctions, assigned = rebuild.fold(frame(spark, *some()), NOW)
    told = frame(spark, *some()).join(assigned.select("source", "source_id", "group_key"), ["source", "source_id"])
    today = F.to_date(F.lit("2031-03-01"))
    items = serve.list_items(auctions, today)
    assert {r.s for r in items.collect()} == {"pripravovana"} and items.where("ti like 'Byt, Veľké Brezno%'").count() == 3
    counts = {(r.measure, r.key): r.n for r in serve.stats(auctions, told, today).collect()}
    assert counts["auctions", ""] == 3 and counts["multi_source", ""] == 1 and counts["notices_by_source", "ov"] == 4 and counts["by_kind", "exekucna"] == 1
    out = str(tmp_path / "out")
    rebuild.write_export(auctions, told, out, "v1", "2031-03-01")
    assert rebuild.read_export(spark, out, "details").count() == 3 and {r.id for r in rebuild.read_export(spark, out, "auctions").collect()} == {r.id for r in items.collect()}


def test_searches_are_told_once(spark, tmp_path):
    store = str(tmp_path / "store")
    auctions, _ = rebuild.fold(frame(spark, *some()), NOW)
    jobs.add_search(spark, store, "x@example.org", {"types": ["byt"], "kinds": ["exekucna"], "maxPrice": 200000, "round": "1", "q": "veľke"}, "2031-01-01")
    jobs.add_search(spark, store, "late@example.org", {}, "2031-09-01")  # stored after everything was seen
    (mail,) = jobs.notify(spark, store, auctions, NOW, "2031-03-01", "https://example.org", str(tmp_path / "outbox")).collect()
    assert mail.subject == "1 nová dražba – Vaše hľadanie" and "Byt, Veľké Brezno | Exekučná | 2031-03-20 | 48 000 €" in mail.text
    assert jobs.notify(spark, store, auctions, NOW, "2031-03-01", "https://example.org").count() == 0
    assert {r.search_id.split("-")[0]: r.last_notified_at for r in jobs.searches(spark, store).collect()} == {"x@example.org": NOW, "late@example.org": "2031-09-01"}
    assert spark.read.json(str(tmp_path / "outbox")).count() == 1


def test_filters_codec():
    f = serve.Filters(q="dom a", types=("byt", "dom"), minPrice=1000.0, when="all", date_from="2031-01-01", sort="new")
    assert serve.Filters.from_query(f.to_query()) == f and f.active() == 5
    assert serve.Filters.from_query("od=x&kraj=Nitriansky+kraj") == serve.Filters(kraj="Nitriansky kraj")


def test_daily():
    def broken():
        raise ValueError("down")

    results, code = rebuild.daily({"a": broken, "b": lambda: 1})
    assert code == 0 and results == {"a": {"error": "down"}, "b": 1} and rebuild.daily({"a": broken})[1] == 1


# -- streaming ---------------------------------------------------------------------------------------------------
def story(n, rng):
    """Notices of a few auctioneers whose names and numbers tie some of them together, some with later versions."""
    out = []
    for k in range(n):
        who = rng.choice([("60606060", "Príklep Stred a.s."), (None, "Príklep Stred"), ("70707070", "Dražby Hron"), (None, "Dražby Hron a partneri"), ("80808080", "Iná")])
        day = f"2031-0{rng.randint(1, 4)}-1{rng.randint(0, 9)}"
        base = {"auctioneer_ico": who[0], "auctioneer_name": who[1], "case_key": f"dd|{who[0] or who[1]}|{rng.randint(1, 3)}", "auction_number": f"N{k}", "auction_at": f"2031-0{rng.randint(5, 9)}-2{rng.randint(0, 9)}T10:00:00", "published_at": day}
        one = notice(f"g{k}", versioned_at=f"{day}T00:00:00Z", notice_type=rng.choice(["oznamenie", "opakovana", "upustenie", "vysledok", "dodatok"]), **base)
        out.append(one)
        if rng.random() < 0.3:
            out.append(one | {"min_bid": 11.0 + k, "versioned_at": f"{day}T09:00:00Z"})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_the_stream_gives_the_ordered_merge(spark, tmp_path, seed):
    rng = random.Random(seed)
    told = story(14, rng)
    rng.shuffle(told)
    # versions of a notice arrive in their order
    place = {n["source_id"]: k for k, n in enumerate(told)}
    told = sorted(told, key=lambda n: (place[n["source_id"]], n["versioned_at"]))
    cuts = sorted(rng.sample(range(1, len(told)), 2))
    parts, store = [told[: cuts[0]], told[cuts[0] : cuts[1]], told[cuts[1] :]], str(tmp_path / "store")
    seen, known = {}, []
    for k, part in enumerate(parts):
        now = f"2031-06-0{k + 1}"
        ingest.apply(frame(spark, *part), k, store, now)
        known += [n | {"first_seen": now} for n in part]
        notices, auctions = ingest.tables(spark, store)
        want, _ = rebuild.fold(frame(spark, *known), now)
        shape = lambda df: sorted(str((r.group_key, r.status, r.min_bid, r.auction_at, r.first_seen, r.updated_at, len(r.sources), r.history, r.properties)) for r in df.collect())
        assert shape(auctions) == shape(want) and notices.count() == len(known)
        for r in auctions.collect():
            assert seen.setdefault(r.group_key, r.first_seen) >= r.first_seen
    ingest.apply(frame(spark, *parts[-1]), len(parts) - 1, store, "2031-07-01")  # replayed
    ingest.apply(frame(spark, *parts[0]), 9, store, "2031-07-01")  # arrives again: nothing new in it
    assert shape(ingest.tables(spark, store)[1]) == shape(auctions)
    gone = ingest.tidy(spark, store)
    assert gone and shape(ingest.tables(spark, store)[1]) == shape(want)


def test_a_new_first_seen_alerts_nobody_twice(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.apply(frame(spark, notice()), 0, store, "2031-02-04")
    jobs.add_search(spark, store, "x@example.org", {}, "2031-01-01")
    tell = lambda now: jobs.notify(spark, store, ingest.tables(spark, store)[1], now, "2031-03-01", "u").count()
    assert tell("2031-02-05") == 1
    ingest.apply(frame(spark, notice("g-2", notice_type="dodatok", published_at="2031-02-09", min_bid=1.0, auction_at="2031-04-01T10:00:00")), 1, store, "2031-02-10")
    (a,) = ingest.tables(spark, store)[1].collect()
    assert (a.first_seen, a.status) == ("2031-02-04", "odrocena") and tell("2031-02-11") == 0


def test_searches_meet_auctions_by_keys(spark):
    """Every choice of fields, against the predicate on all pairs; and a plan without a nested loop."""
    rng = random.Random(9)
    pick = lambda *values: rng.choice(values)
    auctions = [(f"a{k}", pick("K1", "K2", None), pick("O1", "O2", None), "x", "x", pick("byt", "dom", "", None), pick("dobrovolna", "exekucna"), pick(None, 10.0, 90.0), None, pick(None, 1, 2), pick("pripravovana", "zrusena"), pick(None, "2031-06-01", "2030-01-01"), pick("Byt v meste", "Dom"), None, "2031-01-05") for k in range(120)]
    searches = [(f"s{k}", "e", "n", pick("", "K1", None), pick("", "O1", None), pick([], ["byt"], ["byt", "dom", "byt"], ["ine"], None), pick([], ["exekucna"], None), pick(None, 20.0), None, pick("", "1", "2+"), pick("", "byt mest"), pick(True, True, False), "2031-01-01", pick(None, "2031-01-06")) for k in range(90)]
    a = spark.createDataFrame(auctions, "group_key string, kraj string, okres string, obec string, ku string, property_type string, kind string, min_bid double, appraised_value double, round int, status string, auction_at string, title string, auctioneer_name string, first_seen string")
    f = spark.createDataFrame(searches, S.SEARCH + ", last_notified_at string")
    sent, today = spark.createDataFrame([("s1", "a1")], "search_id string, group_key string"), F.to_date(F.lit("2031-01-10"))
    hits = serve.alerts(a, f, sent, today)
    got = sorted(map(tuple, hits.collect()))
    test = serve.alert_predicate("a", "f", today) & (F.col("a.first_seen") > F.coalesce("f.last_notified_at", "f.created_at"))
    every = a.alias("a").crossJoin(f.where("active").alias("f")).where(test).select("search_id", "group_key").join(sent, ["search_id", "group_key"], "left_anti")
    assert got == sorted(map(tuple, every.collect())) and len(got) > 100
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()
    assert serve.alerts(a, f.limit(0), sent, today).count() == 0


TABLE = "<Drazba><Cislo>{n}</Cislo><Drazobnik><ObchodneMenoNazov>Príklep Stred a.s.</ObchodneMenoNazov><Ico>60606060</Ico></Drazobnik><KonanieDatum>20.03.2031</KonanieDatum><KonanieCas>{h}:00</KonanieCas><Predmet>byt č. 3, okres Brezno, k. ú. Hronec, LV {n}</Predmet><NajnizsiePodanie>{p}</NajnizsiePodanie></Drazba>"


def filing(k, n, price, form="OV_DRAZBA_OZNAMENIE_DOBROVOLNA", updated=None):
    return {"id": k, "file_name": f"X{k}-{form}-v-1.xml", "content": TABLE.format(n=n, h=9 + n, p=price), "created_at": f"2031-02-0{k}T00:00:00Z", "updated_at": updated, "bulletin_issue": None}


def land(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(x) for x in items))


def test_stream_of_filings(spark, tmp_path):
    landing, store, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    land(landing, "1.json", filing(1, 1, 1000), filing(1, 1, 1100, updated="2031-02-02T00:00:00Z"), filing(2, 2, 2000), {**filing(3, 3, 1), "file_name": "X-OV_INE-v-1.xml"})
    ingest.run(spark, str(landing), store, check, "2031-02-10")
    assert {r.min_bid for r in ingest.tables(spark, store)[1].collect()} == {1100.0, 2000.0}  # the newest version of a batch
    land(landing, "2.json", filing(4, 1, 1500, "OV_DRAZBA_OZNAMENIE_DOBROVOLNA_UPUSTENIE"))
    ingest.run(spark, str(landing), store, check, "2031-02-11")
    ingest.run(spark, str(landing), store, check, "2031-02-12")
    notices, auctions = ingest.tables(spark, store)
    assert {(r.status, r.min_bid, r.first_seen) for r in auctions.collect()} == {("zrusena", 1100.0, "2031-02-10"), ("pripravovana", 2000.0, "2031-02-10")} and notices.count() == 4


# -- jobs --------------------------------------------------------------------------------------------------------
def verb(spark, store, *words, now="2031-02-10T00:00:00+00:00"):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = jobs.main([store, *words, "--now", now])
    return json.loads(out.getvalue()), code


def test_command_line(spark, tmp_path):
    landing, store = tmp_path / "in", str(tmp_path / "store")
    land(landing, "1.json", filing(1, 1, 1000), filing(2, 2, 2000), {**filing(3, 3, 1), "file_name": "X3-OV_DRAZBA-v-1.xml", "content": "<Drazba>"})
    counts, code = verb(spark, store, "ov", "--landing", str(landing), "--since", "2031-01-01")
    assert code == 0 and (counts["fetched"], counts["new"], counts["new_auctions"]) == (3, 2, 2)
    land(landing, "2.json", filing(4, 1, 1500, "OV_DRAZBA_OZNAMENIE_DOBROVOLNA_UPUSTENIE"))
    counts, _ = verb(spark, store, "ov", "--landing", str(landing), now="2031-02-11T00:00:00+00:00")  # from the cursor on
    assert (counts["fetched"], counts["new"], counts["changed"]) == (2, 1, 0)
    (tmp_path / "units.json").write_text(json.dumps({"77": ["Hronec", 48.79, 19.58]}))
    square = {"type": "Polygon", "coordinates": [[[19.5, 48.7], [19.6, 48.7], [19.6, 48.8], [19.5, 48.7]]]}
    (tmp_path / "parcels.json").write_text(json.dumps({"77_1.C": [48.7, 19.5, square], "77_2.C": [None, None, None]}))
    assert {r.ref: (r.lat, r.geom and len(r.geom)) for r in read.parcel_points(spark, str(tmp_path / "parcels.json")).collect()} == {"77_1.C": (48.7, 1), "77_2.C": (None, None)}
    places = ("--units", str(tmp_path / "units.json"), "--parcels", str(tmp_path / "parcels.json"))
    assert verb(spark, store, "geocode", *places)[0] == {"ku": 2}
    assert verb(spark, store, "export", "--out", str(tmp_path / "out"), *places)[0] == {"auctions": 2}
    assert {r.gp for r in rebuild.read_export(spark, str(tmp_path / "out"), "auctions").collect()} == {"ku"}
    stats, _ = verb(spark, store, "stats")
    assert stats["auctions"] == 2 and stats["by_status zrusena"] == 1
    verb(spark, store, "search-add", "--email", "x@example.org", "--filters", json.dumps({"kinds": ["dobrovolna"]}), now="2031-01-01T00:00:00+00:00")
    assert verb(spark, store, "notify")[0] == {"emails": 1} and verb(spark, store, "notify")[0] == {"emails": 0}
    assert verb(spark, store, "reparse")[0] == {"new": 3, "same": 3} and verb(spark, store, "rebuild")[0] == {"new": 3}
    assert verb(spark, store, "pgsync")[0] == {"skipped": True}
    results, code = verb(spark, store, "daily")
    assert code == 0 and "error" in results["ov"] and results["export"] == {"auctions": 2}
    assert jobs.table(spark, store, "runs").where("source = 'ov'").count() == 2


def test_reading_again_reaches_the_export(spark, tmp_path):
    """A stored filing that now reads differently changes the store, its export, and keeps what was located."""
    landing, store = tmp_path / "in", str(tmp_path / "store")
    land(landing, "1.json", filing(1, 1, 1000), filing(2, 2, 2000))
    verb(spark, store, "ov", "--landing", str(landing), "--since", "2031-01-01")
    (tmp_path / "units.json").write_text(json.dumps({"77": ["Hronec", 48.79, 19.58]}))
    (tmp_path / "parcels.json").write_text("{}")
    places = ("--units", str(tmp_path / "units.json"), "--parcels", str(tmp_path / "parcels.json"))
    exported = lambda: {(r.mb, r.gp) for r in rebuild.read_export(spark, str(tmp_path / "out"), "auctions").collect()}
    assert verb(spark, store, "geocode", *places)[0] == {"ku": 2}
    verb(spark, store, "export", "--out", str(tmp_path / "out"))  # without look-up tables
    assert exported() == {(1000, "ku"), (2000, "ku")}
    raw = jobs.table(spark, store, "raw").where("source_id = '1'")  # as if the parser read another amount now
    jobs.append(raw.withColumns({"content": F.replace("content", F.lit(">1000<"), F.lit(">1500<")), "updated_at": F.lit("2031-02-05T00:00:00Z")}), store, "raw")
    assert verb(spark, store, "reparse")[0] == {"new": 2, "same": 1, "changed": 1}
    verb(spark, store, "export", "--out", str(tmp_path / "out"), now="2031-02-11T00:00:00+00:00")
    assert exported() == {(1500, "ku"), (2000, "ku")}
    assert ingest.tables(spark, store)[0].count() == 3  # a second version of the first notice
    assert verb(spark, store, "rebuild")[0] == {"new": 2} and ingest.tables(spark, store)[0].count() == 2
    verb(spark, store, "export", "--out", str(tmp_path / "out"), now="2031-02-12T00:00:00+00:00")
    assert exported() == {(1500, "ku"), (2000, "ku")}
    # a further notice merges the block anew: it stays located
    land(landing, "2.json", filing(4, 1, 1700, "OV_DRAZBA_OZNAMENIE_DOBROVOLNA_OPAKOVANA"))
    counts, _ = verb(spark, store, "ov", "--landing", str(landing), now="2031-02-13T00:00:00+00:00")
    assert (counts["new"], counts["changed"], counts["new_auctions"]) == (1, 0, 0)
    assert {r.geo_precision for r in ingest.tables(spark, store)[1].collect()} == {"ku"}


def test_sync_to_a_database(spark, tmp_path):
    store, url, driver = str(tmp_path / "store"), f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    ingest.apply(frame(spark, *some()), 0, store, "2031-02-04")
    jobs.log_run(spark, store, "ov", "a", "b", {"fetched": 5})
    made = jobs.sync_tables(spark, store, *ingest.tables(spark, store))
    assert list(made) == list(jobs.KEYS)
    try:
        spark._jvm.java.lang.Class.forName(driver["driver"])
    except Exception:  # noqa: BLE001
        pytest.skip("no database driver here")
    there = lambda name: spark.read.jdbc(url, name, properties=driver)
    statuses = lambda: sorted((r.group_key == "own", r.status) for r in there("auctions").select("group_key", "status").collect())
    counts = jobs.sync(made, url, driver)
    assert counts == jobs.sync(made, url, driver) and counts["auctions"] == 3 and counts["notices"] == 5
    assert {n: there(n).count() for n in made} == counts
    # a row that only the database knows, and a change that is to be undone by the next run
    with jobs._connected(spark, url, driver) as c:
        c.createStatement().executeUpdate('INSERT INTO auctions ("group_key", "status") VALUES (\'own\', \'zrusena\')')
        c.createStatement().executeUpdate('UPDATE auctions SET "status" = \'neplatna\' WHERE "group_key" <> \'own\'')
    broken = made | {"properties": made["properties"].withColumn("idx", F.raise_error(F.lit("lost")).cast("int"))}
    with pytest.raises(Exception, match="lost"):  # half-way: nothing of it is seen
        jobs.sync(broken, url, driver)
    twice = made | {"scrape_runs": made["scrape_runs"].union(made["scrape_runs"])}
    assert statuses() == [(False, "neplatna")] * 3 + [(True, "zrusena")]
    with pytest.raises(Exception):  # noqa: B017  the last of the merges fails: the first ones are undone
        jobs.sync(twice | {"auction_history": made["auction_history"].withColumn("field", F.lit(None).cast("string")).withColumnRenamed("field", "no_such_column")}, url, driver)
    assert statuses() == [(False, "neplatna")] * 3 + [(True, "zrusena")]
    assert jobs.sync(made, url, driver) == counts
    assert len(statuses()) == 4 and statuses()[-1] == (True, "zrusena") and "neplatna" not in {s for _, s in statuses()}


def test_a_stream_counts_in_passing(spark, tmp_path):
    listener = ingest.Counts()
    spark.streams.addListener(listener)
    try:
        land(tmp_path / "in", "1.json", filing(1, 1, 1000), filing(2, 2, 2000), {**filing(3, 3, 1), "file_name": "X3-OV_INE-v-1.xml"})
        ingest.run(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check"), "2031-02-10")
        for _ in range(100):
            if listener.seen:
                break
            time.sleep(0.1)
        assert [(name, c) for _, name, c in listener.seen if c["filings"]] == [("filings", {"filings": 2, "errors": 0})]
    finally:
        spark.streams.removeListener(listener)


def test_documents_that_cannot_be_read_are_empty(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"no pdf")
    assert [r.text for r in read.documents_text(spark, str(tmp_path)).collect()] == [""]


def test_functions_by_name_in_sql(spark):
    names = sql.register(spark)
    assert len(names) == len(set(names)) >= 15
    got = spark.sql("SELECT norm_key('Žiar, s.r.o.') a, parse_money('1 200,- EUR') b, parse_date('3. mája 2031') c, public_id('x') d, whole_euros(2.5D) e, company_id('11 112 222') f, effective_status('pripravovana', '2030-01-01', DATE'2031-01-01') g, normalize_district('kosice-okolie') h").first()
    assert tuple(got) == ("ziar", 1200.0, "2031-05-03", "11f6ad8ec5", 2, "11112222", "prebehla", "Košice - okolie")
