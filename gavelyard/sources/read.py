"""Readers: raw filings from a JSON landing zone or a table, register pages, lookup tables; parsing to typed notices."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..operators import serve
from . import feed, parse

ITEM = "id long, file_name string, content string, created_at string, updated_at string, bulletin_issue struct<year:int,number:int,published_at:string>"


def is_auction(file_name: Column) -> Column:
    """The filing filter as an expression, so it reaches the scan before any parsing."""
    form = F.regexp_extract(file_name, r"(?i)^(?:[^-]*-)?(.*)\.xml$", 1)
    form = F.split_part(form, F.lit("-v-"), F.lit(1))
    return F.coalesce(file_name.rlike(r"(?i)\.xml$") & (form.startswith("OV_DRAZBA") | form.endswith("Drazobna_vyhlaska")), F.lit(False))


def landing(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Items of a JSON landing zone, changed from `since` on (a date or a time), in the order of the feed."""
    items = spark.read.schema(ITEM).json(path)
    return with_source(items if since is None else items.where(F.coalesce("updated_at", "created_at") >= (since if len(since) > 10 else f"{since}T00:00:00Z")))


def feed_items(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Items of a feed's pages, changed from `since` on."""
    return with_source(feed.register(spark).read.format(feed.Feed.name()).options(path=path, since=since or "").load().drop("page"))


def feed_stream(spark: SparkSession, path: str, since: str = "", pages: int = feed.PAGES, cursor: str | None = None) -> DataFrame:
    """The same as a stream of `pages` pages a batch, whose offset is the last page and change."""
    options = {"path": path, "since": since, "pages": pages} | ({"cursor": cursor} if cursor else {})
    return with_source(feed.register(spark).readStream.format(feed.Feed.name()).options(**options).load().drop("page"))


def register_days(spark: SparkSession, path: str, days: Column | None = None) -> DataFrame:
    """Listing rows (act_id, row) of a register's days, each act once; a condition on `day` decides which days are opened."""
    rows = feed.register(spark).read.format(feed.Days.name()).option("path", path).load()
    return (rows if days is None else rows.where(days)).dropDuplicates(["act_id"])


def landing_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return with_source(spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_trigger).json(path))


def with_source(items: DataFrame) -> DataFrame:
    return items.withColumns({"source": F.lit("ov"), "source_id": F.col("id").cast("string")}).drop("id")


def raw_in_order(raw: DataFrame, source: str) -> DataFrame:
    """Stored items of a source with their `place` by numeric id, from 1."""
    return serve.placed(raw.where(F.col("source") == source), F.col("source_id").try_cast("long").asc_nulls_first(), F.col("source_id").asc())


def _typed(df: DataFrame, parse_row: Callable[..., dict | None]) -> DataFrame:
    """Notices that `parse_row` makes of the rows of `df`, each row parsed once, whatever is selected or filtered later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (parse_row(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield pa.record_batch([pa.array([json.dumps(n, ensure_ascii=False) for n in found if n], pa.string())], ["body"])

    return df.mapInArrow(run, "body string").select(F.from_json("body", S.struct(f"{S.NOTICE}, _error string")).alias("n")).select("n.*")


def notices(raw: DataFrame) -> DataFrame:
    """Typed notices of the filings that are auctions, and `_error` where one could not be parsed (to try again)."""

    def parsed(name: str, body: str, rest: str) -> dict | None:
        try:
            return parse.filing({**json.loads(rest), "file_name": name, "content": body})
        except Exception as e:  # noqa: BLE001  one bad filing doesn't stop a run
            return {"_error": f"{type(e).__name__}: {e}", "source": "ov", "source_id": json.loads(rest).get("source_id")}

    meta = F.to_json(F.struct("source_id", "created_at", "updated_at", "bulletin_issue"))
    wanted = raw.where(is_auction(F.col("file_name")) & (F.col("content") != ""))
    return _typed(wanted.select("file_name", "content", meta.alias("meta")), parsed)


def register_notices(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Notices of register entries: rows of (act_id, listing row as JSON, detail html, pdf text).

    Entries already `known` (act_id) are left out before parsing; empty pages come back with `_error`.
    """
    if known is not None:
        pages = pages.join(known.select("act_id"), "act_id", "left_anti")

    def parsed(row: str, page: str | None, text: str | None) -> dict | None:
        r = json.loads(row)
        try:
            return parse.register_notice(r, parse.register_detail(page or ""), text)
        except Exception as e:  # noqa: BLE001  one bad page doesn't stop a run
            return {"_error": str(e), "source": "ncrd", "source_id": r.get("act_id")}

    return _typed(pages.select("row", "detail", "text"), parsed)


def register_rows(pages: DataFrame, column: str = "html") -> DataFrame:
    """Listing rows (act_id, row as JSON) of result pages, each act once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch of pages has far more rows than it; they go out as they are read
            rows = (r for page in batch.column(0) for r in parse.register_listing(page.as_py() or ""))
            while some := list(islice(rows, 1000)):
                yield pa.record_batch([pa.array([r["act_id"] for r in some], pa.string()), pa.array([json.dumps(r, ensure_ascii=False) for r in some], pa.string())], ["act_id", "row"])

    return pages.select(column).mapInArrow(run, "act_id string, row string").dropDuplicates(["act_id"])


def full_days(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Days whose listing reached the page limit, so they must be asked for by type of act."""
    day = F.get_json_object("row", "$.auction_date")
    return rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)


def cadastral_units(spark: SparkSession, path: str) -> DataFrame:
    """code, label, lat, lng of a JSON object {code: [label, lat, lng]}."""
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("code", "v"))
    return pairs.select("code", F.col("v")[0].alias("label"), F.col("v")[1].cast("double").alias("lat"), F.col("v")[2].cast("double").alias("lng"))


def parcel_points(spark: SparkSession, path: str) -> DataFrame:
    """ref, lat, lng, geom of a JSON object {ref: [lat, lng, GeoJSON Polygon or MultiPolygon]}; null lat: known not to exist."""
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("ref", "v"))
    at = lambda k: F.try_element_at("v", F.lit(k))
    kind, body = F.get_json_object(at(3), "$.type"), F.get_json_object(at(3), "$.coordinates")
    one, many = F.from_json(body, "array<array<array<double>>>"), F.from_json(body, "array<array<array<array<double>>>>")
    geom = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    return pairs.select("ref", at(1).try_cast("double").alias("lat"), at(2).try_cast("double").alias("lng"), geom.alias("geom"))


def raw_versions(raw: DataFrame) -> DataFrame:
    """One row per (source, source_id): content and times of the newest version, the file name of the first."""
    newest = F.struct(F.coalesce("updated_at", "created_at", F.lit("")).alias("t"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("tie"))
    rest = [c for c in raw.columns if c not in ("source", "source_id", "file_name")]
    picked = raw.groupBy("source", "source_id").agg(F.max_by(F.struct(*rest), newest).alias("_new"), F.min_by("file_name", newest).alias("file_name"))
    return picked.select("source", "source_id", "file_name", "_new.*").select(*raw.columns)


def documents_text(spark: SparkSession, path: str, pages: int = 15) -> DataFrame:
    """Text of PDF files, empty where one can't be read or the optional reader is missing."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        try:
            import io

            import pdfplumber
        except ImportError:
            return pd.Series([""] * len(content))
        out = []
        for data in content:
            try:
                with pdfplumber.open(io.BytesIO(data)) as pdf:
                    out.append("\n".join((p.extract_text() or "") for p in pdf.pages[:pages]).strip())
            except Exception:  # noqa: BLE001  damaged file
                out.append("")
        return pd.Series(out)

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))
