"""Queries give all rows and look at whole values."""

import datetime
import hashlib

import __spark_entry__ as entry


def test_norm_key_of_whole_texts(spark, tmp_path):
    head = "x" * 90
    spark.createDataFrame([(1, f"{head} Žltý Dom, s.r.o."), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.digest) for r in entry.queries()["norm_key_texts"](spark, str(tmp_path)).collect()}
    want = {1: f"{head} zlty dom", 2: ""}
    assert got == {d: (len(k), hashlib.md5(k.encode()).hexdigest()) for d, k in want.items()}


def test_every_notice_has_its_place(spark, tmp_path):
    days = [None, datetime.datetime(2026, 1, 2), datetime.datetime(2026, 1, 1)]
    orders, events = [(k, days[k % 3]) for k in range(90)], [(k, days[k % 2]) for k in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.origin, r.id): r.place for r in entry.queries()["rebuild_union_places"](spark, str(tmp_path)).collect()}
    rows = [(d.isoformat() if d else "", source != "ov", str(k), source) for source, told in (("ov", orders), ("ncrd", events)) for k, d in told]
    assert got == {(source, k): n for n, (_, _, k, source) in enumerate(sorted(rows), 1)}


def test_sorts_and_filter_go_past_the_first_page(spark):
    known, data = entry.queries(), "/root/testdata/sf0.001"
    for name in ("sort_date_upcoming", "sort_date_past", "sort_price_asc_all", "sort_price_desc_all", "sort_new_all", "sort_discount_all"):
        page = {r.place: r.id for r in known[name](spark, data).collect()}
        every = {r.place: r.id for r in known[f"{name}_places"](spark, data).collect()}
        assert sorted(every) == list(range(1, len(every) + 1)) and len(set(every.values())) == len(every) > len(page) == 60, name
        assert page.items() <= every.items(), name
    assert known["list_filter_sort"](spark, data).count() <= known["list_filter_places"](spark, data).count()
