"""Auctions as keyed state: any split of a stream, restarts, and days that pass."""

import json
import random
import time
from datetime import datetime, timedelta, timezone

import pytest

from gavelyard import schema as S
from gavelyard.operators import states
from gavelyard.streaming import cases

from .test_match import story

NOTICE = f"{S.NOTICE}, group_key string"


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({**r, "group_key": r["case_key"]}) for r in rows))


def run(spark, folder, check, got):
    """Take in what has landed, one file a batch."""
    stream = spark.readStream.schema(NOTICE).option("maxFilesPerTrigger", 1).json(str(folder))
    take = lambda batch, number: got.extend((number, r) for r in batch.collect())
    cases.live(stream, days=False).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_a_stream_equals_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [r for k in range(25) for r in story(rng, k)]
    rng.shuffle(rows)
    parts = [rows[k::3] for k in range(3)]
    parts[2] += parts[0][:20]  # told again
    got = []
    for k in range(2):
        land(tmp_path / "in", f"p{k}", parts[k])
    run(spark, tmp_path / "in", tmp_path / "check", got)
    land(tmp_path / "in", "p2", parts[2])
    run(spark, tmp_path / "in", tmp_path / "check", got)  # from the checkpoint on
    last = {r.group_key: r for _, r in got}
    notices = spark.read.schema(NOTICE).json(str(tmp_path / "in")).dropDuplicates(["source", "source_id"])
    want = {r.group_key: r for r in states.states(notices).collect()}
    assert last.keys() == want.keys()
    for key, r in want.items():
        assert tuple(last[key][f] for f in cases.SHOWN) == tuple(r[f] for f in cases.SHOWN), key
        assert last[key].notices <= sum(x["case_key"] == key for x in rows)
    # nothing is said twice in a row
    for key in want:
        said = [tuple(r[f] for f in cases.SHOWN) for _, r in got if r.group_key == key]
        assert all(a != b for a, b in zip(said, said[1:], strict=False))
    more = []
    run(spark, tmp_path / "in", tmp_path / "check", more)
    assert not more


def test_a_day_that_passes_ends_an_open_auction(spark, tmp_path):
    notice = {"source": "ov", "source_label": "l", "kind": "dobrovolna", "notice_type": "oznamenie", "published_at": "2026-01-01", "auctioneer_name": "A", "min_bid": 5.0}
    rows = [notice | {"source_id": k, "case_key": k, "auction_at": at} for k, at in (("past", "2026-01-05"), ("open", "2400-01-05T10:00:00"), ("none", None), ("odd", "soon"))]
    rows += [notice | {"source_id": "gone", "case_key": "closed", "auction_at": "2400-01-05", "notice_type": "upustenie"}]
    land(tmp_path / "in", "p", rows)
    end = datetime(2400, 1, 6, tzinfo=timezone.utc)
    shift = int((datetime.now(timezone.utc) + timedelta(seconds=25) - end).total_seconds() * 1000)  # that day ends in some seconds
    got = []
    stream = spark.readStream.schema(NOTICE).json(str(tmp_path / "in"))
    query = cases.live(stream, shift=shift).writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        for _ in range(240):
            if any(r.cause == "time" for r in got):
                break
            time.sleep(0.5)
    finally:
        query.stop()
    said = {(r.group_key, r.status, r.cause) for r in got}
    assert said == {("past", "prebehla", "notice"), ("open", "pripravovana", "notice"), ("open", "prebehla", "time"), ("none", "pripravovana", "notice"), ("odd", "pripravovana", "notice"), ("closed", "zrusena", "notice")}
