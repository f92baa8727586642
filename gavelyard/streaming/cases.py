"""Auctions as keyed state of a stream: what is known of every auction now, and that its day has passed.

The stream has notices whose auction is known (`group_key`). State per auction is the list of its notices and a map of what was last
said of it; a row comes out whenever that changes. Notices may come in any order and more than once: they are merged in order of
publication, so any split of a stream ends where the batch does, and nothing is too late. A timer per auction waits for the end of its
day; then an auction that is still open is over (`prebehla`).

An auction has some dozens of notices, which are read again with each batch that brings one; for auctions of any size there are the
mergeable aggregates of `operators.states`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .. import fixed as X
from ..operators.merge import merged

SHOWN = ("status", "auction_at", "min_bid", "highest_bid", "last_notice_at")
OUT = "group_key string, status string, auction_at string, min_bid double, highest_bid double, last_notice_at string, notices long, cause string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def order(n: dict) -> tuple:
    return n.get("published_at") or "", n["source"] != "ov", str(n["source_id"]), n.get("versioned_at") or "", n.get("first_seen") or ""


class Auction(StatefulProcessor):
    """`shift` milliseconds are added to the end of an auction's day; without one no days are watched."""

    def __init__(self, shift: int | None = 0):
        self.shift = shift

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getListState("told", "body string")
        self.shown = handle.getMapState("shown", "field string", "value string")

    def _over_at(self, auction_at: str | None) -> int | None:
        """When the day of an auction is over, in milliseconds; none for a day that is unknown or no day."""
        try:
            day = datetime.fromisoformat((auction_at or "")[:10]).replace(tzinfo=timezone.utc)
        except ValueError:
            return None
        return int((day + timedelta(days=1)).timestamp() * 1000) + self.shift

    def _show(self, key: tuple, now: dict, notices: int, cause: str) -> Iterator[Row]:
        """A row if something has changed since the last one."""
        before = {k[0]: json.loads(v[0]) for k, v in self.shown.iterator()}
        if before == now:
            return
        for field, value in now.items():
            self.shown.updateValue((field,), (json.dumps(value),))
        yield Row(group_key=key[0], **now, notices=notices, cause=cause)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        bodies = [b for (b,) in self.told.get()] if self.told.exists() else []
        fresh = [r["body"] for r in rows if r["body"] not in bodies]
        if not fresh:
            return
        self.told.appendList([(b,) for b in dict.fromkeys(fresh)])
        notices = sorted(map(json.loads, dict.fromkeys(bodies + fresh)), key=order)
        auction = merged(notices, "")
        now = {f: auction.get(f) for f in SHOWN}
        if self.shift is not None:
            self._watch(now, timerValues.getCurrentProcessingTimeInMs())
        yield from self._show(key, now, len(notices), "notice")

    def _watch(self, now: dict, time: int) -> None:
        """An open auction is over now, or when its timer expires."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        over = self._over_at(now["auction_at"])
        if now["status"] in X.ACTIVE_STATUSES and over is not None:
            if over <= time:
                now["status"] = "prebehla"
            else:
                self.handle.registerTimer(over)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = {k[0]: json.loads(v[0]) for k, v in self.shown.iterator()}
        if now.get("status") in X.ACTIVE_STATUSES:
            yield from self._show(key, now | {"status": "prebehla"}, sum(1 for _ in self.told.get()), "time")


def live(notices: DataFrame, days: bool = True, shift: int = 0) -> DataFrame:
    """A row for every change of an auction's state, from a stream of notices with `group_key`.

    Timers make a stream go on without new notices, so one that is to stop when all is taken in (`availableNow`) must not
    watch `days`; readers then see passed days by `serve.effective_status`.
    """
    prepare(notices.sparkSession)
    body = F.to_json(F.struct(*[c for c in notices.columns if c not in ("group_key", "block", "_error")]))
    rows = notices.where("group_key is not null").select("group_key", body.alias("body"))
    return rows.groupBy("group_key").transformWithState(Auction(shift if days else None), OUT, "Update", "ProcessingTime" if days else "None")


def prepare(spark: SparkSession) -> None:
    """Keyed state of this kind is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
