"""Matching as joins, states as aggregates and versions compared, against the ordered merge on random stories."""

import json
import random

from gavelyard import fixed as X, schema as S
from gavelyard.operators import match, merge, notices as N, states
from gavelyard.operators.merge import Ledger, differs, same_auctioneer, written
from gavelyard.plans.rebuild import fold_order

NOW = "2031-05-01T00:00:00+00:00"
AUCTION = f"group_key string, kind string, auctioneer_name string, auctioneer_ico string, auction_at string, venue string, obec string, ku string, sources array<{S.SOURCE}>, properties array<{S.PROPERTY}>, place int"


def frame(spark, rows, ddl):
    kinds = S.struct(ddl)

    def fill(row, kind):
        return tuple(None if row.get(f.name) is None else [fill(x, f.dataType.elementType) for x in row[f.name]] if hasattr(f.dataType, "elementType") and hasattr(f.dataType.elementType, "fields") else row[f.name] for f in kind.fields)

    return spark.createDataFrame([fill(r, kinds) for r in rows], kinds)


def world(rng, k):
    """Auctions of a few related auctioneers of their own, and notices about them. (Empty executors' names agree everywhere, so auctions have none.)"""
    numbers = [f"{k:04d}{n:04d}" for n in range(2)]
    names = [f"Domino{k:05d} Holding s.r.o.", f"DOMINO{k:05d} Holding", f"Spolok Domino{k:05d} Holding", f"Vzor{k:05d} Peter", f"JUDr. Peter Vzor{k:05d}", "", None]

    def estate():
        return [{"obec": rng.choice(["Nitra", None]), "ku": rng.choice(["Dolná Ves", "Dolná Ves", "Horná Ves", ""]), "lv": rng.sample(["7", "8", "9"], rng.choice([0, 1, 2, 2]))} for _ in range(rng.choice([0, 1, 1, 2]))]

    def who(known=names):
        return {"auctioneer_name": rng.choice(known), "auctioneer_ico": rng.choice([numbers[0], numbers[0], *numbers, None, ""]), "kind": rng.choice(["dobrovolna", "dobrovolna", "dobrovolna", "exekucna", None])}

    def at(days):
        return rng.choice(["2031-03-20", "2031-03-20T09:00:00", "2031-03-20T10:30:00"]) if days else rng.choice(["2031-03-06", "2031-03-07T09:00:00", "2030-03-19", "2030-03-18T08:00:00", "2032-03-20", "2032-03-21", "2029-01-01", "1969-12-30", None, ""])

    auctions = []
    for n in range(rng.randint(1, 5)):
        a = {"group_key": f"{k}-{n}", "auction_at": at(rng.random() < 0.6), "venue": rng.choice(["Kultúrny dom Brezno", "Hotel Tatra", None]), "obec": rng.choice(["Nitra", "Brezno", None]), "ku": rng.choice(["Dolná Ves", None])}
        a |= who([n for n in names if n != ""]) | {"sources": [{"source": s} for s in rng.sample(["ov", "ncrd"], rng.randint(1, 2))], "properties": estate(), "place": n, "auction_number": None}
        auctions.append(a)
    told = [{"source": rng.choice(["ov", "ncrd"]), "source_id": f"{k}-{n}", "auction_at": at(rng.random() < 0.5), "venue": rng.choice(["Hotel Tatra, Nitra", "Brezno", None]), "properties": estate(), **who()} for n in range(3)]
    return auctions, told


def test_joins_equal_the_ordered_rules(spark):
    rng = random.Random(12)
    auctions, notices, elsewhere, rounds = [], [], {}, {}
    for k in range(900):
        own, told = world(rng, k)
        auctions += own
        notices += told
        for n in told:
            meet = [a for a in own if same_auctioneer(a, n)] if n["auctioneer_ico"] or match_name(n) else []
            elsewhere[n["source_id"]] = Ledger(NOW)._other_source(n, meet)
            rounds[n["source_id"]] = Ledger(NOW)._other_round(n, meet)
    a, n = frame(spark, auctions, AUCTION).repartition(4), frame(spark, notices, S.NOTICE).repartition(3)
    for find, want in ((match.told_elsewhere, elsewhere), (match.other_round, rounds)):
        want = {k: v for k, v in want.items() if v}
        assert len(want) > 30
        rows = find(n, a).collect()
        assert {r.source_id: r.group_key for r in rows} == want and len(rows) == len(want)
        assert find(n.limit(0), a).count() == 0 and find(n, a.limit(0)).count() == 0


def match_name(n):
    from gavelyard.operators.merge import norm_key

    return norm_key(n["auctioneer_name"])


def test_joins_use_neither_python_nor_a_nested_loop(spark):
    import contextlib
    import io

    a, n = frame(spark, [], AUCTION), frame(spark, [], S.NOTICE)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for find in (match.told_elsewhere, match.other_round):
            with contextlib.redirect_stdout(io.StringIO()) as out:
                find(n, a).explain("simple")
            assert not any(x in out.getvalue() for x in ("NestedLoop", "Cartesian", "Python", "Arrow"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def story(rng, k):
    """Notices of one auction, all under one case without a time of day, so all are one auction."""
    out = []
    for n in range(rng.randint(1, 12)):
        out.append({
            "source": rng.choice(["ov", "ov", "ncrd", "iny"]), "source_id": f"{k}-{n}", "source_label": f"l{n}", "kind": "dobrovolna", "notice_type": rng.choice([*X.NOTICE_TYPES, "dodatok"]), "case_key": f"dd|{k}", "published_at": rng.choice([None, "2031-01-02", "2031-01-03", "2031-02-01"]),
            "auctioneer_name": f"Firma {k}", "auction_at": rng.choice([None, "", "2031-04-01", "2031-04-02", "2031-04-03"]), "min_bid": rng.choice([None, 0.0, 10.0, 20.0]), "highest_bid": rng.choice([None, 0.0, 99.0]), "sold": rng.choice([None, True, False]),
            "title": rng.choice([None, "", "a", "b"]), "venue": rng.choice([None, "x", "y"]), "round": rng.choice([None, 1, 2]), "deposit": rng.choice([None, 5.0]), "auctioneer_ico": None, "auction_number": None,
        })
    return out


def test_states_equal_the_ordered_merge(spark):
    rng = random.Random(5)
    notices, want = [], {}
    for k in range(900):
        own = story(rng, k)
        ledger = Ledger(NOW)
        for n in sorted(own, key=fold_order):
            ledger.ingest(dict(n))
        (a,) = ledger.auctions.values()
        notices += own
        want[a["group_key"]] = a
    df = frame(spark, notices, S.NOTICE).withColumnRenamed("case_key", "group_key").repartition(5)
    got = {r.group_key: r for r in states.states(df).collect()}
    assert got.keys() == want.keys()
    seen = set()
    for key, a in want.items():
        assert {f: got[key][f] for f in ("status", "last_notice_at", *X.MERGED)} == {f: a.get(f) for f in ("status", "last_notice_at", *X.MERGED)}, key
        seen.add(a["status"])
    assert seen == set(X.STATUSES)
    assert states.states(df.limit(0)).count() == 0 and states.states(df.withColumn("group_key", df.group_key.substr(1, 0)).limit(9)).count() == 1


def test_versions(spark):
    rng = random.Random(3)
    value = lambda: {"min_bid": rng.choice([None, 10.0, 10.004, 10.5, 2.5e7]), "status": rng.choice([None, "zrusena", "odrocena"]), "round": rng.choice([None, 1, 2])}
    before, after = ({f"k{n}": value() for n in range(400) if rng.random() < 0.8} for _ in range(2))
    ddl = "group_key string, min_bid double, status string, round int, extra string"
    got = sorted(map(tuple, states.changes(*(frame(spark, [{"group_key": k, **v} for k, v in rows.items()] + [{"status": "x"}], ddl) for rows in (before, after))).collect()), key=str)
    want = [(k, "created" if k not in before else "vanished", None, None, None) for k in before.keys() ^ after.keys()]
    want += [(k, "changed", f, written(before[k][f]), written(v)) for k in before.keys() & after.keys() for f, v in after[k].items() if differs(before[k][f], v)]
    assert got == sorted(want, key=str) and {r[1] for r in got} == {"created", "vanished", "changed"}


def test_expressions_equal_the_merge(spark):
    """Keys, compatibility, types, places and versions, row by row against the functions of the ordered merge."""
    rng = random.Random(8)
    rows = []
    for k in range(300):
        estate = [{"type": rng.choice([None, "", *X.TYPE_PRIORITY]), "kraj": rng.choice([None, None, "Nitriansky kraj"]), "okres": rng.choice([None, "Nitra", "Košice - okolie", "x"]), "obec": rng.choice([None, "", "Nitra", "Brezno"]), "ku": rng.choice([None, "", "Dolná Ves"]), "lv": rng.choice([None, [], ["9", "10"], ["7"]])} for _ in range(rng.randint(0, 3))]
        rows.append({
            "source": rng.choice(["ov", "ncrd"]), "source_id": str(k % 90), "kind": rng.choice(["exekucna", "dobrovolna", None]), "case_key": rng.choice([None, "", "c|1"]), "auction_at": rng.choice([None, "2031-03-20", "2031-03-20T09:00:00", "2031-03-20T10:00:00", "2031-03-21T09:00:00"]),
            "auction_number": rng.choice([None, "N 1", "n1", "2"]), "properties": estate, "min_bid": rng.choice([None, 1.0]), "versioned_at": f"{k:03d}",
        })
    df = frame(spark, rows, S.NOTICE)
    got = {r.versioned_at: r for r in df.select("versioned_at", N.group_key().alias("key"), N.place(df.properties).alias("p")).collect()}
    pairs = df.where("cast(versioned_at as int) < 60").select("versioned_at", "auction_at", "auction_number")
    fit = {(r.a, r.n): r.ok for r in pairs.alias("a").crossJoin(pairs.alias("n")).select("a.versioned_at", "n.versioned_at", N.compatible("a", "n").alias("ok")).toDF("a", "n", "ok").collect()}
    for r in rows:
        now = got[r["versioned_at"]]
        assert now.key == merge.group_key(r)
        auction = {"properties": r["properties"], "kraj": None}
        Ledger(NOW)._locate(auction)
        assert now.p is None if not r["properties"] else tuple(now.p) == tuple(auction.get(c) for c in ("property_type", "kraj", "okres", "obec", "ku")), r
    for a in rows[:60]:
        for n in rows[:60]:
            assert fit[a["versioned_at"], n["versioned_at"]] == merge.compatible(a, n)
    seen, told = {}, {r.versioned_at: r.result for r in N.versions(df, df.versioned_at).collect()}
    for r in rows:
        name, digest = (r["source"], r["source_id"]), merge.content_hash({**r, "properties": json.dumps(r["properties"])})
        assert told[r["versioned_at"]] == ("new" if name not in seen else "same" if seen[name] == digest else "changed")
        seen[name] = digest
