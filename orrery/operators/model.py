"""Records: from stored JSON to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name, trim_white

RECORD = """id BIGINT, title STRING, user STRUCT<id: STRING, name: STRING, account: STRING>, width INT, height INT,
meta_single_page STRUCT<original_image_url: STRING>, page_count INT,
meta_pages ARRAY<STRUCT<image_urls: STRUCT<original: STRING>>>, tags ARRAY<STRUCT<name: STRING>>,
sanity_level INT, x_restrict INT, visible BOOLEAN, create_date STRING, caption STRING, is_bookmarked BOOLEAN, type STRING"""
#: A page of the feed; its records stay JSON text, key order and all.
FEED_PAGE = "illusts ARRAY<STRING>, next_url STRING"

#: The prefix of image addresses, and the addresses that stand for a page that can't be had.
URL_PREFIX = "https://i.pximg.net/img-original/img/20"
LIMITED_URLS = ("https://s.pximg.net/common/images/limit_unknown_360.png", "https://s.pximg.net/common/images/limit_mypixiv_360.png")


def checked(ok: Column, value: Column, message: Column | str) -> Column:
    """value, or an error that ends the query where ok isn't true."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message) if isinstance(message, str) else message))


def is_limited(url: Column) -> Column:
    return url.isin(*LIMITED_URLS)


def page_url(url: Column) -> Column:
    """The address itself, if it is one: it starts with h and has a slash; behind the known prefix no
    second address follows."""
    rest = F.substring(url, len(URL_PREFIX) + 1, 1 << 30)
    ok = F.when(url.startswith(URL_PREFIX), ~rest.startswith("h") & rest.contains("/")).otherwise(url.startswith("h") & url.contains("/"))
    return checked(ok, url, F.concat(F.lit("bad source url: "), F.coalesce(url, F.lit("null"))))


def pages_of(r: Column) -> Column:
    """ARRAY<STRUCT<pn, url, filename, width, height>>; only the first page's size is known."""
    size = (r["width"] > 0) & (r["height"] > 0)

    def page(url: Column, pn: Column) -> Column:
        return F.struct(pn.alias("pn"), page_url(url).alias("url"), file_name(url).alias("filename"), F.when(pn == 0, r["width"]).alias("width"), F.when(pn == 0, r["height"]).alias("height"))

    one = F.array(page(r["meta_single_page"]["original_image_url"], F.lit(0)))
    many = F.transform(r["meta_pages"], lambda p, i: page(p["image_urls"]["original"], i))
    ok_many = (r["page_count"] >= 2) & (F.size(r["meta_pages"]) == r["page_count"])
    pages = F.when(r["page_count"] == 1, one).otherwise(checked(ok_many, many, "page_count differs from the number of pages"))
    return checked(size, pages, "a width or height isn't above zero")


def parse_records(bronze: DataFrame) -> DataFrame:
    """(seq, iid, raw) -> typed records. A row that can't be read, or breaks an invariant, fails the
    whole load. Keys that the schema doesn't name stay in raw only."""
    r = F.col("_r")
    parsed = bronze.withColumn("_r", F.from_json("raw", RECORD, {"mode": "FAILFAST"}))
    return parsed.select(
        "seq", r["id"].alias("iid"), r["title"].alias("title"), r["user"]["id"].cast("bigint").alias("user_id"), trim_white(r["user"]["name"]).alias("user_name"),
        r["width"].alias("width"), r["height"].alias("height"), r["page_count"].alias("page_count"), F.transform(r["tags"], lambda t: t["name"]).alias("tags"),
        r["sanity_level"].alias("sanity_level"), r["x_restrict"].alias("x_restrict"), r["visible"].alias("visible"), r["create_date"].alias("create_date"), pages_of(r).alias("pages"),
        F.when(r["page_count"] == 1, is_limited(r["meta_single_page"]["original_image_url"])).otherwise(F.lit(False)).alias("deleted"),
    )


def only_ids(bronze: DataFrame) -> DataFrame:
    """(seq, iid, raw) with iid read again from raw, and nothing else read."""
    return bronze.withColumn("iid", F.get_json_object("raw", "$.id").cast("bigint"))
