"""The ordered merge of notices into auctions: a plain-Python kernel for one block of related notices.

A `Ledger` holds the auctions of a block. `ingest` takes one notice at a time and answers "new", "changed" or
"same"; `plans.rebuild` feeds it the notices of a block in order and runs one ledger per block.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass, field
from datetime import date
from functools import lru_cache

from .. import fixed as X
from ..functions.regions import region_of_district, region_of_town

#: Fields that a notice of the type leaves alone once the auction has a value.
_PARTIAL = frozenset({"title", "description", "min_bid", "appraised_value", "round"})
_KEEPS = {t: _PARTIAL | {"auction_at"} for t in X.STATUS_BY_NOTICE} | {"dodatok": _PARTIAL}
_OPEN = (None, *X.ACTIVE_STATUSES)
_REVIVED = (None, "pripravovana", "prebehla", "zmarena")
_LEGAL = re.compile(X.LEGAL_FORM)


@lru_cache(100_000)
def norm_key(text: str | None) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", _LEGAL.sub(" ", bare)).strip()


def executor_key(text: str | None) -> str:
    return " ".join(sorted(w for w in norm_key(text).split() if w not in X.EXECUTOR_WORDS))


def content_hash(notice: dict) -> str:
    """24 hex digits over the sorted content, without the times of fetching, of the version and of the first sight."""
    bare = {k: v for k, v in notice.items() if k not in ("fetched_at", "versioned_at", "first_seen")}
    return hashlib.sha256(json.dumps(bare, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:24]


def written(value) -> str | None:
    """A value as the change history writes it."""
    if isinstance(value, float) and value == int(value):
        value = int(value)
    return None if value is None else str(value)


def differs(a, b) -> bool:
    if isinstance(a, int | float) and isinstance(b, int | float):
        return abs(a - b) > X.MONEY_TOLERANCE
    return written(a) != written(b)


def group_key(notice: dict) -> str:
    """Key of the auction that a notice names: its case, and for executions the first property's unit and folios."""
    key = notice.get("case_key") or f"{notice['source']}|{notice['source_id']}"
    if notice.get("kind") == "exekucna":
        first = next(iter(notice.get("properties") or ()), {})
        key = "|".join((key, norm_key(first.get("ku")), ",".join(sorted(first.get("lv") or ()))))
    return key


def folios(properties: list[dict]) -> set[tuple[str, str]]:
    return {(norm_key(p.get("ku") or p.get("obec")), str(lv)) for p in properties for lv in p.get("lv") or ()}


def place_words(*names: str | None) -> set[str]:
    return {w for name in names for w in norm_key(name).split() if len(w) > 3}


def richness(properties: list[dict]) -> int:
    return sum(bool(p.get(k)) for p in properties for k in ("obec", "ku", "okres", "kraj")) + sum(len(p.get(k) or ()) for p in properties for k in ("lv", "parcels"))


def located_as_before(old: list[dict], new: list[dict]) -> list[dict]:
    """The new properties, with the points of old ones of the same place and folios."""
    key = lambda p: (norm_key(p.get("ku") or p.get("obec")), tuple(sorted(p.get("lv") or ())))
    points = {key(p): {k: p.get(k) for k in ("lat", "lng", "geo_source")} for p in old if p.get("lat") is not None}
    return [dict(p) | points.get(key(p), {}) for p in new]


def at_odds(a: str | None, b: str | None) -> bool:
    """Both known, and different."""
    return bool(a and b and a != b)


@dataclass(frozen=True)
class Facts:
    """What matching looks at, of a notice or of an auction as it stands."""

    day: str
    time: str
    kind: str
    number: str
    estate: frozenset[tuple[str, str]]
    words: frozenset[str]

    @classmethod
    def of(cls, x: dict, kind: str | None = None, *places: str | None) -> Facts:
        at, properties = x.get("auction_at") or "", x.get("properties") or []
        return cls(at[:10], at[11:16], kind or x.get("kind") or "", norm_key(x.get("auction_number")), frozenset(folios(properties)), frozenset(place_words(x.get("venue"), *places)))


def compatible(auction: dict, notice: dict) -> bool:
    """Whether both can be one auction: not with two times on one day under two numbers."""
    a, b = Facts.of(auction), Facts.of(notice)
    return not (a.day and a.day == b.day and at_odds(a.time, b.time) and at_odds(a.number, b.number))


def names_agree(a: str | None, b: str | None, executors: bool) -> bool:
    """Executors by their words in any order; companies by equal names, or by a longer name that contains the other."""
    if executors:
        return executor_key(a) == executor_key(b)
    short, long = sorted((norm_key(a), norm_key(b)), key=len)
    return bool(short) and (short == long or len(short) > 6 and short in long)


def same_auctioneer(auction: dict, notice: dict) -> bool:
    """Two company numbers decide; where one is missing, the names do."""
    numbers = [x.get("auctioneer_ico") for x in (auction, notice)]
    if all(numbers):
        return numbers[0] == numbers[1]
    if auction.get("auctioneer_name") is None or not (numbers[1] or norm_key(notice.get("auctioneer_name"))):
        return False
    return names_agree(auction["auctioneer_name"], notice.get("auctioneer_name"), "exekucna" in (auction.get("kind"), notice.get("kind")))


def _weeks_away(a: Facts, n: Facts) -> bool:
    """Unknown days are no obstacle."""
    if not (a.day and n.day):
        return True
    low, high = X.ROUND_GAP_DAYS
    return low <= abs((date.fromisoformat(a.day) - date.fromisoformat(n.day)).days) <= high


#: An auction that another source told of: what must hold for (auction, notice), and what narrows several that fit.
OTHER_SOURCE = (
    (lambda a, n: bool(n.day) and a.day == n.day, lambda a, n: a.kind == n.kind, lambda a, n: not (a.estate and n.estate and a.estate.isdisjoint(n.estate))),
    (lambda a, n: bool(n.time) and a.time == n.time, lambda a, n: len(a.words & n.words)),
)
#: An earlier or later round of the same estate.
OTHER_ROUND = (lambda a, n: a.kind == n.kind, _weeks_away, lambda a, n: not a.estate.isdisjoint(n.estate))


def main_type(types: list[str]) -> str | None:
    return next((t for t in X.TYPE_PRIORITY if t in types), None)


@dataclass
class Ledger:
    """Auctions and notices of one block; `now` stands for the time of the run.

    A notice that was taken in before brings its `first_seen`; an auction has the earliest of its notices', and counts as
    updated when the latest notice that moved something was first seen. So a block that is merged anew keeps its times.
    """

    now: str
    auctions: dict[str, dict] = field(default_factory=dict)  # by group key, in order of creation
    aliases: dict[str, str] = field(default_factory=dict)
    notices: dict[tuple[str, str], dict] = field(default_factory=dict)
    index: dict[tuple, set[str]] = field(default_factory=dict)  # a day, or a folio of an estate: group keys
    spots: dict[str, list[tuple]] = field(default_factory=dict)  # by group key, where it is in the index

    # -- one notice ------------------------------------------------------------------------------------------
    def ingest(self, notice: dict) -> str:
        digest = content_hash(notice)
        name = notice["source"], notice["source_id"]
        known, seen = self.notices.get(name), notice.get("first_seen") or self.now
        if known and known["content_hash"] == digest:
            known["last_seen"] = self.auctions[known["group_key"]]["last_seen"] = self.now
            return "same"
        if known:
            home = known["group_key"]
            created = False
        else:
            home, created = self._home(notice, seen)
        auction = self.auctions[home]
        key = group_key(notice)
        if not created and key != home:
            self.aliases[key] = home
        self._apply(auction, notice, created, known is not None, seen)
        self._enter(auction)
        # a changed notice keeps the publication facts of its first version
        facts = known or {"published_at": notice.get("published_at"), "first_seen": seen, "case_key": None}
        self.notices[name] = facts | {"content_hash": digest, "group_key": home, "last_seen": self.now, "case_key": notice.get("case_key"), "source": notice["source"]}
        return "changed" if known else "new"

    def _home(self, notice: dict, seen: str) -> tuple[str, bool]:
        """Group key of the notice's auction, and whether it was created for it."""
        key = group_key(notice)
        auction = self.auctions.get(key)
        if auction is not None:
            if compatible(auction, notice):
                return key, False
            key = f"{key}|{norm_key(notice.get('auction_number'))}|{(notice.get('auction_at') or '')[11:16]}"
            if key in self.auctions:
                return key, False
        else:
            found = self.aliases.get(key) or self._match(notice)
            if found:
                return found, False
        self.auctions[key] = {
            **dict.fromkeys((*X.MERGED, "property_type", "kraj", "okres", "obec", "ku", "lat", "lng", "geo_precision", "last_notice_at")),
            "group_key": key, "status": "pripravovana", "kind": notice.get("kind") or "dobrovolna", "sources": [], "properties": [], "history": [],
            "first_seen": seen, "last_seen": self.now, "updated_at": seen, "place": len(self.auctions),
        }
        return key, True

    # -- matching --------------------------------------------------------------------------------------------
    def _enter(self, auction: dict) -> None:
        """Put an auction into the index under its day and its folios."""
        key, facts = auction["group_key"], Facts.of(auction)
        for spot in self.spots.get(key, ()):
            self.index[spot].discard(key)
        self.spots[key] = [("day", facts.day)] * bool(facts.day) + [("folio", f) for f in facts.estate]
        for spot in self.spots[key]:
            self.index.setdefault(spot, set()).add(key)

    def _match(self, notice: dict) -> str | None:
        """An auction must share the day or a folio; only such are looked at, in order of creation."""
        if not (notice.get("auctioneer_ico") or norm_key(notice.get("auctioneer_name"))):
            return None
        n = Facts.of(notice)
        near = set().union(*(self.index.get(spot, ()) for spot in (("day", n.day), *(("folio", f) for f in n.estate))))
        own = [a for a in sorted((self.auctions[key] for key in near), key=lambda a: a["place"]) if same_auctioneer(a, notice)]
        return self._other_source(notice, own) or self._other_round(notice, own)

    def _other_source(self, notice: dict, candidates: list[dict]) -> str | None:
        """The one auction of that day that this source has not told of yet."""
        must, narrow = OTHER_SOURCE
        own = notice.get("properties") or []
        n = Facts.of(notice, "dobrovolna" if notice["source"] == "ncrd" else notice.get("kind") or "dobrovolna", *(p.get(k) for p in own for k in ("obec", "ku")))
        fit = [(Facts.of(a, None, a["obec"], a["ku"]), a) for a in candidates if all(s["source"] != notice["source"] for s in a["sources"])]
        fit = [(f, a) for f, a in fit if all(test(f, n) for test in must)]
        for liking in narrow:
            best = max((liking(f, n) for f, _ in fit), default=0)
            fit = [(f, a) for f, a in fit if liking(f, n) == best]
        return fit[0][1]["group_key"] if len(fit) == 1 else None

    def _other_round(self, notice: dict, candidates: list[dict]) -> str | None:
        """Of the rounds that fit, the latest auction."""
        n = Facts.of(notice)
        fit = [a for a in candidates if all(test(Facts.of(a), n) for test in OTHER_ROUND)] if n.estate and n.kind else []
        return max(fit, key=lambda a: a["auction_at"] or "")["group_key"] if fit else None

    # -- merging ---------------------------------------------------------------------------------------------
    def _apply(self, auction: dict, notice: dict, created: bool, forced: bool, seen: str) -> None:
        update = self._update(auction, notice, created)
        told = {s["source"] for s in auction["sources"]}
        moved = [f for f in X.TRACKED if f in update and differs(auction[f], update[f])]
        for f in moved:
            old, new = auction[f], update[f]
            respelled = f == "venue" and norm_key(old) == norm_key(new)
            result_of_closed = f == "status" and new == "prebehla" and old in ("zrusena", "zmarena", "neplatna")
            if old is not None and not created and (f == "status" or notice["source"] in told) and not respelled and not result_of_closed:
                auction["history"].append({
                    "changed_at": notice.get("published_at") or self.now, "field": f, "old_value": written(old), "new_value": written(new),
                    "source": notice["source"], "source_id": notice["source_id"],
                })
        auction.update(update)
        auction["last_seen"], auction["first_seen"] = self.now, min(auction["first_seen"], seen)
        if moved or created:
            auction["updated_at"] = max(auction["updated_at"], seen)
        published = notice.get("published_at")
        if published and published >= (auction["last_notice_at"] or ""):
            auction["last_notice_at"] = published
        entry = {"source": notice["source"], "label": notice.get("source_label"), "url": notice.get("source_url"), "notice_type": notice.get("notice_type"), "published_at": published}
        if (entry["label"], entry["url"]) not in {(s["label"], s["url"]) for s in auction["sources"]}:
            auction["sources"].append(entry)
        properties = notice.get("properties")
        if properties and (forced or not auction["properties"] or richness(properties) >= richness(auction["properties"])):
            auction["properties"] = located_as_before(auction["properties"], properties)
        self._locate(auction)

    def _update(self, auction: dict, notice: dict, created: bool) -> dict:
        """The fields that a notice may set."""
        kind_of_notice = notice.get("notice_type")
        rank = X.SOURCE_RANK.get(notice["source"], 0)
        leading = created or rank >= max((X.SOURCE_RANK.get(s["source"], 0) for s in auction["sources"]), default=0)
        newer = (notice.get("published_at") or "") >= (auction["last_notice_at"] or "")
        kept = _KEEPS.get(kind_of_notice, frozenset())
        update = {}
        for f in X.MERGED:
            value, old = notice.get(f), auction[f]
            if value in (None, "", []):
                continue
            if f in kept and (old if f == "auction_at" else old is not None):
                continue
            if old in (None, "") and not isinstance(old, bool) or leading and newer:
                update[f] = value
        if created and notice.get("kind"):
            update["kind"] = notice["kind"]
        status = auction["status"]
        closing = X.STATUS_BY_NOTICE.get(kind_of_notice)
        if closing:
            if newer or status in _OPEN:
                update["status"] = closing
        elif kind_of_notice in ("oznamenie", "opakovana"):
            if newer and (created or status in _REVIVED):
                update["status"] = "pripravovana"
        elif kind_of_notice == "dodatok" and notice.get("auction_at") and auction["auction_at"] and differs(auction["auction_at"], notice["auction_at"]):
            update["status"] = "odrocena"
        if kind_of_notice == "vysledok":
            update |= {f: v for f, v in (("sold", notice.get("sold")), ("highest_bid", notice.get("highest_bid") or None)) if v is not None}
        return update

    def _locate(self, auction: dict) -> None:
        """Type and place of the auction, from its properties."""
        estate = auction["properties"]
        if not estate:
            return
        p = next((x for x in estate if x.get("obec") or x.get("ku")), estate[0])
        auction.update({
            "property_type": main_type([x["type"] for x in estate if x.get("type")]), "okres": p.get("okres"), "obec": p.get("obec"), "ku": p.get("ku"),
            "kraj": p.get("kraj") or region_of_district(p.get("okres")) or region_of_town(p.get("obec")),
        })
        point = next((x for x in estate if x.get("lat") is not None), None)
        if point:
            auction.update({"lat": point["lat"], "lng": point["lng"], "geo_precision": point.get("geo_source")})


def merged(notices: list[dict], now: str) -> dict:
    """One auction after its notices in order, where it is known that all of them are of it; a version that says the same is passed over."""
    ledger = Ledger(now)
    home, _ = ledger._home(notices[0], now)
    auction, last = ledger.auctions[home], {}
    for k, n in enumerate(notices):
        name, digest = (n["source"], n["source_id"]), content_hash(n)
        if last.get(name) != digest:
            ledger._apply(auction, n, k == 0, name in last, now)
        last[name] = digest
    return auction
