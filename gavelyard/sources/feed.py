"""Data sources for feeds that have landed as files: a feed of pages with offsets, and a register's listing by days.

`gavelyard_feed` reads a folder of pages, each a JSON-lines file or a folder of such, whose names sort in the feed's order.
Pages follow one another until one is empty. As a batch it is one partition per page; as a stream its offset is the last
page taken with the last change seen in it, a batch has `pages` pages at most, and a committed offset is noted in the
file `cursor`, if one is named, from which a new stream goes on. Items changed before `since` are left out.

`gavelyard_days` reads a register's listing, a folder `day=YYYY-MM-DD` for every day: `all.html`, and `act=<type>.html` for each type of
act, which are read in place of a listing that has reached the page limit. Each day is one partition, and filters on the day
are pushed down, so other days' folders are never opened.

Both need file systems that all executors can open by path or by a URI that Arrow knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import parse

ITEM = "page string, id long, file_name string, content string, created_at string, updated_at string, bulletin_issue struct<year:int,number:int,published_at:string>"
_ITEM = pa.schema([
    ("page", pa.string()), ("id", pa.int64()), ("file_name", pa.string()), ("content", pa.string()), ("created_at", pa.string()), ("updated_at", pa.string()),
    ("bulletin_issue", pa.struct([("year", pa.int32()), ("number", pa.int32()), ("published_at", pa.string())])),
])
#: Pages of one micro-batch, unless the option `pages` says otherwise.
PAGES = 100
ROWS = 500


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[fs.FileInfo]:
    files, at = opened(path)
    return sorted((f for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)


def lines(path: str, name: str) -> Iterator[dict]:
    """The items of a page."""
    files, at = opened(path)
    whole = files.get_file_info(f"{at}/{name}")
    parts = [whole.path] if whole.is_file else [f.path for f in listed(f"{path}/{name}") if f.is_file]
    for part in parts:
        with files.open_input_stream(part) as f:
            yield from (json.loads(x) for x in f.read().decode().splitlines() if x.strip())


def changed_at(item: dict) -> str:
    return item.get("updated_at") or item.get("created_at") or ""


def since_time(text: str | None) -> str:
    """A day stands for its first second."""
    return f"{text}T00:00:00Z" if len(text or "") == 10 else text or ""


@dataclass
class Page(InputPartition):
    """A page by its name."""

    name: str


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.path, self.since = options["path"].rstrip("/"), since_time(options.get("since"))

    def after(self, name: str) -> list[str]:
        return [f.base_name for f in listed(self.path) if f.base_name > name]

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        rows = [{**item, "page": partition.name} for item in lines(self.path, partition.name) if changed_at(item) >= self.since]
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in some], f.type) for f in _ITEM], schema=_ITEM)


class FeedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(n) for n in self.after("")]


class FeedStreamReader(_Pages, DataSourceStreamReader):
    """Offsets name the last page taken, and the time of the last change in it."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.most, self.cursor = int(options.get("pages", PAGES)), options.get("cursor")
        self.last: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        if self.cursor:
            files, at = opened(self.cursor)
            if files.get_file_info(at).is_file:
                with files.open_input_stream(at) as f:
                    return json.loads(f.read())
        return {"page": "", "at": self.since}

    def latestOffset(self) -> dict:  # noqa: N802  Spark's name
        """As far as the next batch goes: some pages on, but not past an empty page."""
        at = self.last or self.initialOffset()
        for name in self.after(at["page"])[: self.most]:
            change = max(map(changed_at, lines(self.path, name)), default=None)
            if change is None:
                break
            at = {"page": name, "at": max(at["at"], change)}
        self.last = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        # after a restart the first thing asked for is the batch that was planned before
        self.last = max(self.last or end, end, key=lambda o: o["page"])
        return [Page(n) for n in self.after(start["page"]) if n <= end["page"]]

    def commit(self, end: dict) -> None:
        if self.cursor:
            files, at = opened(self.cursor)
            with files.open_output_stream(f"{at}.new") as f:
                f.write(json.dumps(end).encode())
            files.move(f"{at}.new", at)


class Feed(DataSource):
    """Options: path, since, pages (of a micro-batch), cursor (a file)."""

    @classmethod
    def name(cls) -> str:
        return "gavelyard_feed"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:  # noqa: N802  Spark's name
        return FeedStreamReader(self.options)


@dataclass
class Day(InputPartition):
    day: str


class DaysReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.limit = options["path"].rstrip("/"), int(options.get("limit", 20))
        self.low, self.high, self.only = date.min, date.max, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Filters on the day choose partitions; the rest stays with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("day",) or getattr(f, "value", None) is None:
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif isinstance(f, In):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    yield f
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value)
                if isinstance(f, LessThan):
                    yield f
            else:
                yield f

    def partitions(self) -> list[Day]:
        found = [m[1] for f in listed(self.path) if (m := re.fullmatch(r"day=(\d{4}-\d\d-\d\d)", f.base_name))]
        return [Day(d) for d in found if self.low <= date.fromisoformat(d) <= self.high and (self.only is None or date.fromisoformat(d) in self.only)]

    def read(self, partition: Day | None) -> Iterator[tuple]:
        if partition is None:
            return
        folder = f"{self.path}/day={partition.day}"
        files, _ = opened(self.path)
        pages = {f.base_name: f.path for f in listed(folder)}

        def rows(name: str) -> list[dict]:
            with files.open_input_stream(pages[name]) as f:
                return parse.register_listing(f.read().decode())

        found = rows("all.html") if "all.html" in pages else []
        if len(found) >= self.limit:  # the listing is cut off there: ask for every type of act
            found += [r for name in pages if name.startswith("act=") for r in rows(name)]
        for row in {r["act_id"]: r for r in found}.values():
            yield date.fromisoformat(partition.day), row["act_id"], json.dumps(row, ensure_ascii=False)


class Days(DataSource):
    """Options: path, limit (rows of a full page)."""

    @classmethod
    def name(cls) -> str:
        return "gavelyard_days"

    def schema(self) -> str:
        return "day date, act_id string, row string"

    def reader(self, schema) -> DaysReader:
        return DaysReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make both formats known to the session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Feed, Days):
        spark.dataSource.register(source)
    return spark
