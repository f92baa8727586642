"""Table schemas as DDL. Dates that may lack a time stay text: "no time known" is not midnight."""

from __future__ import annotations

from pyspark.sql.types import StructType

PARCEL = "struct<register:string,number:string,area_m2:double,kind:string>"
PROPERTY = (
    f"struct<type:string,kraj:string,okres:string,obec:string,obec_code:string,ku:string,lv:array<string>,parcels:array<{PARCEL}>,"
    "supisne_cislo:array<string>,area_m2:double,address:string,share:string,lat:double,lng:double,geo_source:string>"
)
RAW_ITEM = (
    "source string, source_id string, file_name string, content string, created_at string, updated_at string, "
    "bulletin_issue struct<year:int,number:int,published_at:string>"
)
NOTICE = (
    "source string, source_id string, source_url string, source_label string, published_at string, kind string, notice_type string, "
    "auction_number string, case_key string, auctioneer_name string, auctioneer_ico string, proposer string, notary string, auction_at string, "
    "venue string, round int, round_text string, min_bid double, min_increment double, deposit double, appraised_value double, highest_bid double, "
    f"sold boolean, inspection string, title string, description string, reason string, properties array<{PROPERTY}>, "
    "documents array<struct<title:string,url:string>>, filing_code string, form_type string, property_kind string, declared_at string, "
    "previous_date string, ncrd_number string, versioned_at string, first_seen string"
)
SOURCE = "struct<source:string,label:string,url:string,notice_type:string,published_at:string>"
HISTORY = "struct<changed_at:string,field:string,old_value:string,new_value:string,source:string,source_id:string>"
AUCTION = (
    "group_key string, kind string, status string, auction_number string, auctioneer_name string, auctioneer_ico string, proposer string, notary string, "
    "auction_at string, venue string, round int, min_bid double, min_increment double, deposit double, appraised_value double, highest_bid double, "
    "sold boolean, inspection string, title string, description string, reason string, property_type string, kraj string, okres string, obec string, "
    f"ku string, lat double, lng double, geo_precision string, sources array<{SOURCE}>, properties array<{PROPERTY}>, history array<{HISTORY}>, "
    "last_notice_at string, first_seen string, last_seen string, updated_at string"
)
ASSIGNMENT = "source string, source_id string, result string, content_hash string, group_key string, first_seen string, case_key string"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


RUN = "run string, source string, started_at string, finished_at string, fetched long, new_notices long, changed_notices long, new_auctions long, errors long, message string"
STATE = "key string, value string, at string"
SEARCH = (
    "search_id string, email string, name string, kraj string, okres string, types array<string>, kinds array<string>, min_price double, max_price double, "
    "round string, q string, active boolean, created_at string"
)
SENT = "search_id string, group_key string, created_at string"
