"""The merge, by properties of generated sequences of notices and by rules stated here."""

import copy
import random

import pytest
from hypothesis import given, settings, strategies as st

from gavelyard import fixed as X
from gavelyard.operators.merge import Ledger, compatible, executor_key, norm_key, same_auctioneer
from gavelyard.plans.rebuild import fold_order

NOW = "2031-05-01T00:00:00+00:00"


def flat(folio="812", unit="Veľké Brezno", **kw):
    return {"type": "byt", "obec": unit, "ku": unit, "okres": "Brezno", "kraj": None, "lv": [folio], "parcels": []} | kw


def notice(source_id="g-1", **kw):
    base = {
        "source": "ov", "source_id": source_id, "source_label": f"label {source_id}", "source_url": "w", "published_at": "2031-02-03", "kind": "dobrovolna", "notice_type": "oznamenie", "auction_number": "N14", "case_key": "dd|60606060|n14",
        "auctioneer_name": "Príklep Stred a.s.", "auctioneer_ico": "60606060", "auction_at": "2031-03-20T13:15:00", "venue": "Kultúrny dom, Brezno", "round": 1, "min_bid": 48000.0, "properties": [flat()],
    }
    return base | kw


def register(source_id="r-1", **kw):
    blank = {"auction_number": None, "venue": None, "round": None, "min_bid": None, "properties": []}
    return notice(source_id, **(blank | {"source": "ncrd", "case_key": f"ncrd|{source_id}", "published_at": "2031-02-06"} | kw))


def bailiff(source_id, name, case, **kw):
    return notice(source_id, **({"kind": "exekucna", "auctioneer_ico": None, "auctioneer_name": name, "case_key": case, "auction_number": case} | kw))


def merge(*notices):
    ledger = Ledger(NOW)
    results = [ledger.ingest(copy.deepcopy(n)) for n in notices]
    return ledger, results


def auctions(*notices):
    return list(merge(*notices)[0].auctions.values())


# -- generated stories -------------------------------------------------------------------------------------------
@st.composite
def stories(draw):
    """Notices of a few cases of one auctioneer, in order of publication."""
    out = []
    for k in range(draw(st.integers(1, 9))):
        case, kind = draw(st.sampled_from("abc")), draw(st.sampled_from(X.NOTICE_TYPES))
        month = draw(st.integers(1, 9))
        at = draw(st.sampled_from([None, f"2031-0{month}-11", f"2031-0{month}-11T08:30:00", f"2031-0{month}-11T14:00:00"]))
        out.append(notice(
            f"g{k}", notice_type=kind, case_key=f"dd|60606060|{case}", auction_number=case, published_at=f"2031-01-{draw(st.integers(1, 28)):02d}", auction_at=at, source=draw(st.sampled_from(["ov", "ov", "ncrd"])),
            min_bid=draw(st.sampled_from([None, 10.0, 20.0])), highest_bid=draw(st.sampled_from([None, 99.0])), sold=draw(st.sampled_from([None, True, False])), properties=draw(st.sampled_from([[], [flat(case)], [flat(case), flat("9" + case)]])),
        ))
    return sorted(out, key=fold_order)


@settings(max_examples=150, deadline=None)
@given(stories())
def test_taking_in_again_changes_nothing(story):
    ledger, results = merge(*story)
    before = copy.deepcopy(ledger.auctions)
    assert set(results) == {"new"}
    assert [ledger.ingest(copy.deepcopy(n)) for n in story] == ["same"] * len(story)
    assert ledger.auctions == before


@settings(max_examples=150, deadline=None)
@given(stories(), st.randoms(use_true_random=False))
def test_the_order_of_arrival_is_no_matter(story, rng):
    shuffled = story[:]
    rng.shuffle(shuffled)
    assert auctions(*sorted(shuffled, key=fold_order)) == auctions(*story)


@settings(max_examples=150, deadline=None)
@given(stories())
def test_every_notice_is_in_one_auction(story):
    ledger, _ = merge(*story)
    told = [(s["source"], s["label"]) for a in ledger.auctions.values() for s in a["sources"]]
    assert sorted(told) == sorted((n["source"], n["source_label"]) for n in story)
    assert all(ledger.notices[n["source"], n["source_id"]]["group_key"] in ledger.auctions for n in story)
    for a in ledger.auctions.values():
        assert a["last_notice_at"] == max(s["published_at"] for s in a["sources"]) and a["status"] in X.STATUSES


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(X.NOTICE_TYPES), st.integers(0, 3), st.sampled_from([None, 5.0, 6.0])), min_size=1, max_size=8))
def test_status_and_price_follow_their_tables(steps):
    """One auction's notices, each newer than those before: the state by look-up tables written down here."""
    closes = {"upustenie": "zrusena", "zmarenie": "zmarena", "neplatnost": "neplatna", "vysledok": "prebehla"}
    revives = {"pripravovana", "prebehla", "zmarena"}
    status, price, at = "pripravovana", None, None
    notices = []
    for k, (kind, day, bid) in enumerate(steps):
        own = f"2031-03-2{day}" if day else None
        notices.append(notice(f"g{k}", notice_type=kind, published_at=f"2031-01-{k + 1:02d}", auction_at=own, min_bid=bid, venue=None, round=None))
        if kind in closes:
            status = closes[kind]
        elif kind in ("oznamenie", "opakovana"):
            status = "pripravovana" if status in revives else status
        elif kind == "dodatok" and own and at and own != at:
            status = "odrocena"
        if bid is not None and (price is None or kind not in (*closes, "dodatok")):
            price = bid
        if own and (at is None or kind not in closes):
            at = own
    (a,) = auctions(*notices)
    assert (a["status"], a["min_bid"], a["auction_at"]) == (status, price, at)
    # the history leads from the first known values to the last ones
    for field, last in (("min_bid", price), ("auction_at", at)):
        moves = [(h["old_value"], h["new_value"]) for h in a["history"] if h["field"] == field]
        assert all(x[1] == y[0] for x, y in zip(moves, moves[1:], strict=False))
        assert not moves or moves[-1][1] == (f"{last:g}" if isinstance(last, float) else last)


def test_older_and_lesser_notices_only_fill_gaps():
    rng = random.Random(8)
    for _ in range(60):
        first = notice(min_bid=None if rng.random() < 0.5 else 7.0, venue=None if rng.random() < 0.5 else "Sála", proposer=None)
        late = rng.choice([notice("g-2", published_at="2030-12-01", min_bid=9.0, venue="Inde", proposer="P"), register("r-2", published_at="2031-02-20", min_bid=9.0, venue="Inde", proposer="P", case_key="ncrd|x")])
        (a,) = auctions(first, late)
        assert (a["min_bid"], a["venue"], a["proposer"]) == (first["min_bid"] or 9.0, first["venue"] or "Inde", "P") and not a["history"]


def test_a_block_that_is_merged_anew_keeps_its_times():
    early, late = notice(first_seen="2031-02-04"), notice("g-2", notice_type="upustenie", published_at="2031-02-09", first_seen="2031-02-10", min_bid=None)
    (a,) = auctions(early, late)
    assert (a["first_seen"], a["updated_at"], a["last_seen"]) == ("2031-02-04", "2031-02-10", NOW)
    (a,) = auctions(late | {"published_at": "2031-01-01"}, early)
    assert a["first_seen"] == "2031-02-04"


# -- which auction -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("days", "folio", "one"), [(13, "812", False), (14, "812", True), (200, "812", True), (366, "812", True), (367, "812", False), (60, "813", False)])
def test_another_round_is_some_weeks_away_and_of_the_same_folio(days, folio, one):
    from datetime import date, timedelta

    day = date(2031, 3, 20) + timedelta(days)
    assert len(auctions(notice(), notice("g-2", auction_number="N15", case_key="dd|60606060|n15", published_at="2031-03-25", auction_at=f"{day}T13:15:00", properties=[flat(folio)]))) == (1 if one else 2)


@pytest.mark.parametrize(("change", "one"), [
    ({}, True), ({"auctioneer_ico": None, "auctioneer_name": "PRIKLEP STRED"}, True), ({"auctioneer_ico": "70707070"}, False), ({"auction_at": "2031-03-20"}, True), ({"auction_at": "2031-03-21"}, False),
    ({"properties": [flat("1")]}, False), ({"properties": [flat("812"), flat("1")]}, True), ({"auctioneer_ico": None, "auctioneer_name": None}, False),
])
def test_another_source_tells_of_the_same_day(change, one):
    assert len(auctions(notice(), register(**change))) == (1 if one else 2)


def test_of_several_that_fit_time_and_then_place_decide():
    morning = notice("g-2", auction_number="N15", case_key="dd|60606060|n15", auction_at="2031-03-20T09:00:00", properties=[flat("900", "Stará Lehota")], venue="Mestský úrad, Lehota")
    both = (notice(properties=[flat("812", "Hronec")]), morning)
    home = lambda n: merge(*both, n)[0].notices["ncrd", "r-1"]["group_key"]
    assert home(register(auction_at="2031-03-20T09:00:00")) == "dd|60606060|n15"
    assert home(register(auction_at="2031-03-20", venue="Kultúrny dom v obci Hronec")) == "dd|60606060|n14"
    assert home(register(auction_at="2031-03-20")) == "ncrd|r-1"  # nothing decides: an auction of its own
    # a source tells of an auction under one case only
    two = auctions(*both, register(auction_at="2031-03-20T09:00:00"), register("r-2", auction_at="2031-03-20T09:00:00", case_key="ncrd|r-2"))
    assert [[s["source"] for s in a["sources"]].count("ncrd") for a in two] == [1, 1]


def test_two_times_under_two_numbers_are_two_auctions():
    for a, b, same in (("T09:00:00", "T09:45:00", False), ("", "T09:45:00", True), ("T09:00:00", "T09:00:00", True)):
        one, two = notice(auction_at=f"2031-03-20{a}"), notice("g-2", auction_number="N15", auction_at=f"2031-03-20{b}")
        assert compatible(one, two) is same and len(auctions(one, two)) == (1 if same else 2)
    assert compatible(notice(), notice(auction_at="2031-03-20T18:00:00")) and compatible(notice(), notice(auction_number="N15", auction_at="2031-03-21T18:00:00"))


def test_bailiffs_go_by_their_names_in_any_order_and_by_folio():
    first = bailiff("e1", "JUDr. Hronský Karol", "ex|k|77EX1")
    assert len(auctions(first, bailiff("e2", "Mgr. Karol Hronský", "ex|k|77EX1", auction_at="2031-05-20T10:00:00"))) == 1
    assert len(auctions(*(bailiff(f"e{k}", "JUDr. Hronský Karol", "ex|k|77EX1", properties=[flat(str(k))]) for k in range(4)))) == 4
    assert not same_auctioneer(first, bailiff("e3", "JUDr. Hronská Karola", "x"))


@pytest.mark.parametrize(("a", "b", "same"), [("Dražby Hron s.r.o.", "DRAZBY HRON, s. r. o.", True), ("Dražby Hron", "Dražby Hron a partneri", True), ("Hron", "Hron a partneri", False), ("Dražby Hron", "Dražby Váh", False), (None, "Hron", False), ("", "", False)])
def test_names(a, b, same):
    plain = {"auctioneer_ico": None, "kind": "dobrovolna"}
    assert same_auctioneer(plain | {"auctioneer_name": a}, plain | {"auctioneer_name": b}) is same
    assert norm_key("Žiar, spol. s r.o.") == norm_key("ZIAR") and executor_key("Súdny exekútor Mgr. Karol Hronský, PhD.") == "hronsky karol"


# -- properties --------------------------------------------------------------------------------------------------
def test_corrections_replace_properties_and_poorer_notices_do_not():
    poor = [{"type": "byt", "obec": "Brezno", "ku": None, "okres": None, "kraj": None, "lv": [], "parcels": []}]
    (a,) = auctions(notice(), notice(properties=poor))
    assert a["properties"] == poor and merge(notice(), notice(properties=poor))[1] == ["new", "changed"]
    (a,) = auctions(notice(), notice("g-2", properties=poor, published_at="2031-02-20"))
    assert a["properties"] == [flat()] and a["kraj"] == "Banskobystrický kraj"


def test_points_are_kept_with_place_and_folio():
    here = {"lat": 48.8, "lng": 19.6, "geo_source": "parcela"}
    (a,) = auctions(notice(properties=[flat("1"), flat("2") | here]), notice("g-2", published_at="2031-02-20", properties=[flat("2"), flat("3"), flat("4")]))
    assert [p.get("lat") for p in a["properties"]] == [48.8, None, None] and (a["lat"], a["geo_precision"]) == (48.8, "parcela")
