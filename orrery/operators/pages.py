"""Pages of records: sizes, projection and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display_rating, upscaled_name


def exploded(records: DataFrame) -> DataFrame:
    """(iid, pn, url, filename, width, height), one row per page."""
    return records.select("iid", F.explode("pages").alias("p")).select("iid", "p.*")


def fill_forward(table: DataFrame, key: str, order: str, *columns: str, initial=0) -> DataFrame:
    """Nulls take the last value before them, or initial."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(initial)) for c in columns})


def filled(pages):
    """A pages array with sizes filled forward inside the row, without any shuffle."""
    none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("h"), F.array().cast("array<struct<w:int,h:int,kind:string,filename:string>>").alias("out"))

    def step(acc, p):
        w, h = F.coalesce(p["width"], acc["w"]), F.coalesce(p["height"], acc["h"])
        return F.struct(w.alias("w"), h.alias("h"), F.concat(acc["out"], F.array(F.struct(w.alias("w"), h.alias("h"), F.lit("img").alias("kind"), p["filename"].alias("filename")))).alias("out"))

    return F.aggregate(pages, none, step, lambda acc: acc["out"])


def projected(records: DataFrame) -> DataFrame:
    """The result of a search: id, title, user_id, user_name (primary), tags, pages, create_date, rating."""
    return records.select(F.col("iid").alias("id"), "title", "user_id", F.col("primary_name").alias("user_name"), "tags", filled(F.col("pages")).alias("pages"), "create_date", display_rating(F.col("sanity_level"), F.col("x_restrict")).alias("rating"))


def wire(result: DataFrame) -> DataFrame:
    """Each result as a JSON array of its fields, pages being arrays too."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
    pages = F.concat(F.lit("["), F.array_join(F.transform("pages", lambda p: F.concat(F.lit("["), F.concat_ws(",", p["w"].cast("string"), p["h"].cast("string"), F.lit('"img"'), quoted(p["filename"])), F.lit("]"))), ","), F.lit("]"))
    fields = [F.col("id").cast("string"), quoted(F.col("title")), F.col("user_id").cast("string"), quoted(F.col("user_name")), quoted(F.col("tags")), pages, quoted(F.col("create_date")), F.col("rating").cast("string")]
    return result.select("id", F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]")).alias("json"))


def lookup(pages: DataFrame, not_found: DataFrame, iid: int, pn: int, scale: int | None = None) -> DataFrame:
    """Url and file of one page, unless the file is known to be missing; with scale also its enlarged name."""
    page = pages.filter((F.col("iid") == iid) & (F.col("pn") == pn)).join(not_found, "filename", "left_anti").select("iid", "pn", "url", "filename")
    return page.withColumn("upscaled", upscaled_name(F.col("filename"), scale)) if scale else page


def apply_dimensions(records: DataFrame, dims: DataFrame) -> DataFrame:
    """dims: (iid, sizes), sizes being w, h, w, h … of the pages from the second on. Those of the right
    length are put in; records without such sizes stay as they are."""
    known = dims.select(F.col("iid").alias("_iid"), "sizes")
    joined = records.join(known, (F.col("iid") == F.col("_iid")) & (F.size("sizes") == 2 * (F.col("page_count") - 1)), "left")
    put = F.transform("pages", lambda p, i: F.when(i > 0, p.withField("width", F.element_at("sizes", 2 * i - 1)).withField("height", F.element_at("sizes", 2 * i))).otherwise(p))
    return joined.withColumn("pages", F.when(F.col("sizes").isNull(), F.col("pages")).otherwise(put)).drop("_iid", "sizes")


def dump_dimensions(records: DataFrame) -> DataFrame:
    """The inverse of apply_dimensions(): for records whose pages all have sizes."""
    rest = F.slice("pages", 2, 1 << 30)
    return records.filter((F.col("page_count") > 1) & F.forall(rest, lambda p: p["width"].isNotNull() & p["height"].isNotNull())).select("iid", F.flatten(F.transform(rest, lambda p: F.array(p["width"], p["height"]))).alias("sizes"))
