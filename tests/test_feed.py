"""The feed of pages and the register's days as data sources."""

import json
import os

import pytest

from gavelyard.plans import jobs
from gavelyard.sources import feed


@pytest.fixture(scope="module")
def session(spark):
    return feed.register(spark)


def item(k, at=None):
    return {"id": k, "file_name": f"f{k}.xml", "content": "x" * (k % 3), "created_at": f"2031-01-{k // 10 + 1:02d}T00:00:00Z", "updated_at": at, "bulletin_issue": {"year": 2031, "number": k, "published_at": None}}


def write(folder, name, items):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(i) + "\n" for i in items))


def pages(folder, first, last, size=10):
    for p in range(first, last):
        write(folder, f"page-{p:04d}.json", [item(p * size + k) for k in range(size)])


def drained(session, folder, out, check, runs=40, **options):
    """Ids per micro-batch, by runs that stop after one batch each, until nothing is new."""
    got = []

    def take(batch, number):
        got.append((number, sorted(r.id for r in batch.select("id").collect())))

    for _ in range(runs):
        before = len(got)
        stream = session.readStream.format("gavelyard_feed").options(path=str(folder), **options).load()
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination()
        if len(got) == before or not got[-1][1]:
            break
    return got


def test_a_stream_stopped_at_any_page_gives_the_rows_of_one_read(session, tmp_path):
    folder = tmp_path / "pages"
    pages(folder, 0, 5)
    got = drained(session, folder, tmp_path / "out", tmp_path / "check", pages=2, cursor=str(tmp_path / "cursor"))
    assert [len(ids) for _, ids in got if ids] == [20, 20, 10]
    pages(folder, 5, 8)
    got += drained(session, folder, tmp_path / "out", tmp_path / "check", pages=2, cursor=str(tmp_path / "cursor"))
    streamed = [i for _, ids in got for i in ids]
    whole = session.read.format("gavelyard_feed").option("path", str(folder)).load()
    assert sorted(streamed) == sorted(r.id for r in whole.select("id").collect()) == list(range(80))
    assert whole.rdd.getNumPartitions() == 8 and {r.page for r in whole.select("page").distinct().collect()} == {f"page-{p:04d}.json" for p in range(8)}
    # without the checkpoint, a new stream goes on from the cursor
    assert json.loads((tmp_path / "cursor").read_text())["page"] >= "page-0005.json"
    pages(folder, 8, 9)
    rest = drained(session, folder, tmp_path / "out", tmp_path / "new", cursor=str(tmp_path / "cursor"))
    assert {i for _, ids in rest for i in ids} >= set(range(80, 90)) and min(i for _, ids in rest for i in ids) >= 60


def test_an_empty_page_ends_a_read_until_it_is_filled(session, tmp_path):
    folder = tmp_path / "pages"
    pages(folder, 0, 2)
    write(folder, "page-0002.json", [])
    pages(folder, 3, 4)
    first = drained(session, folder, tmp_path, tmp_path / "check", pages=10)
    assert sorted(i for _, ids in first for i in ids) == list(range(20))
    pages(folder, 2, 3)
    again = drained(session, folder, tmp_path, tmp_path / "check", pages=10)
    assert sorted(i for _, ids in again for i in ids) == list(range(20, 40))


def test_since_and_empty_folders(session, tmp_path):
    folder = tmp_path / "pages"
    pages(folder, 0, 3)
    write(folder, "page-0003.json", [item(1, "2031-02-01T00:00:00Z")])
    read = lambda **o: sorted(r.id for r in session.read.format("gavelyard_feed").options(path=f"file://{folder}", **o).load().collect())
    assert read(since="2031-01-03") == [1, *range(20, 30)] and read(since="2031-01-03T00:00:01Z") == [1]
    assert session.read.format("gavelyard_feed").option("path", str(tmp_path / "none")).load().count() == 0


def listing(day, acts):
    rows = "".join(f"<tr><td><a href='/x?actId={a}'>N {a}</a></td><td>Kladivko IČO: 12345678</td><td>Navrhovateľ</td><td>{kind}</td><td></td><td>{day}</td></tr>" for a, kind in acts)
    return f"<table class='search_results'>{rows}</table>"


def test_days_are_partitions_and_full_ones_are_read_by_type(session, tmp_path):
    for d in range(1, 6):
        acts = [(f"{d:02x}{k:02x}", "ab"[k % 2]) for k in range(4 * d)]
        os.makedirs(tmp_path / f"day=2031-01-{d:02d}")
        at = tmp_path / f"day=2031-01-{d:02d}"
        (at / "all.html").write_text(listing("1.1.2031", acts[:8]))  # cut off at eight rows
        for kind in "ab":
            (at / f"act={kind}.html").write_text(listing("1.1.2031", [a for a in acts if a[1] == kind]))
    (tmp_path / "day=2031-01-04" / "act=c.html").write_bytes(b"\xff\xfe")  # can't be read: whoever opens this day fails
    load = lambda: session.read.format("gavelyard_days").options(path=str(tmp_path), limit=8).load()
    with pytest.raises(Exception, match="decode"):
        load().collect()
    some = load().where("day <= date'2031-01-03' and day > date'2031-01-01'")
    assert some.rdd.getNumPartitions() == 3  # the first day by its closed bound
    rows = some.collect()
    assert sorted((r.day.day, r.act_id) for r in rows) == sorted((d, f"{d:02x}{k:02x}") for d in (2, 3) for k in range(4 * d))
    assert {json.loads(r.row)["act_label"] for r in rows} == {"a", "b"}
    assert load().where("day = date'2031-01-05'").count() == 20 and load().where("day in (date'2031-01-01', date'2031-01-05')").rdd.getNumPartitions() == 2
    assert load().where("day = date'2040-01-01'").count() == 0


def test_a_feed_through_the_command_line(session, tmp_path, capsys):
    folder = tmp_path / "pages"
    content = "<Drazba><Cislo>7</Cislo><Drazobnik><ObchodneMenoNazov>Kladivko s.r.o.</ObchodneMenoNazov><Ico>12345678</Ico></Drazobnik><KonanieDatum>20.03.2031</KonanieDatum><KonanieCas>10:00</KonanieCas></Drazba>"
    write(folder, "page-1.json", [item(1) | {"file_name": "X1-OV_DRAZBA_OZNAMENIE_DOBROVOLNA-v-1.xml", "content": content}, item(2)])
    assert jobs.main([str(tmp_path / "store"), "ov", "--feed", str(folder), "--now", "2031-02-01T00:00:00+00:00"]) == 0
    first = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert first["fetched"] == 2 and first["new"] == 1 and first["new_auctions"] == 1
    assert jobs.main([str(tmp_path / "store"), "ov", "--feed", str(folder), "--now", "2031-02-02T00:00:00+00:00"]) == 0
    again = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (again["new"], again["changed"]) == (0, 0)
