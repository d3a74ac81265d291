"""Files against records: what to fetch, what nobody refers to, what to evict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def download_queue(pages: DataFrame, files: DataFrame, not_found: DataFrame) -> DataFrame:
    """Pages whose file is neither there nor known to be missing."""
    return pages.join(files.select("filename"), "filename", "left_anti").join(not_found.select("filename"), "filename", "left_anti")


def skipped_count(pages: DataFrame, files: DataFrame, not_found: DataFrame) -> DataFrame:
    """How many pages the queue leaves out because they are known to be missing."""
    return pages.join(files.select("filename"), "filename", "left_anti").join(not_found.select("filename"), "filename", "left_semi").agg(F.count("*").alias("skipped"))


def pending_queue(pending: DataFrame, pages: DataFrame, files: DataFrame, not_found: DataFrame) -> DataFrame:
    """The queue of a list (pos, iid), in which ids may repeat. An id without pages is an error."""
    wanted = pending.join(pages, "iid", "left")
    wanted = wanted.withColumn("filename", F.when(F.col("filename").isNotNull(), F.col("filename")).otherwise(F.raise_error(F.concat(F.lit("no such record: "), F.col("iid").cast("string")))))
    return download_queue(wanted, files, not_found)


def orphans(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Files that no page refers to."""
    return files.join(pages.select("filename"), "filename", "left_anti")


def usage(files: DataFrame) -> DataFrame:
    """One row per file: its largest size and last access."""
    return files.filter("size > 0").groupBy("filename").agg(F.max("size").alias("size"), F.max("accessed").alias("accessed"))


def evict(files: DataFrame, limit: int, days: int = 86_400) -> DataFrame:
    """Files that go, oldest first, until the rest is within the limit: a file goes if it and all newer
    ones are above it. Ties by name, the smaller being older.

    The running sum is made inside ranges of the access time and over the ranges' totals, so no task
    sorts all files. days: seconds of one range where accessed is a time, else units of it.
    """
    one = usage(files)
    stamp = F.col("accessed").cast("long") if dict(one.dtypes)["accessed"].startswith(("timestamp", "bigint", "int")) else F.col("accessed")
    if dict(one.dtypes)["accessed"] == "timestamp_ntz":
        stamp = F.col("accessed").cast("timestamp").cast("long")
    one = one.withColumn("_range", F.floor(stamp / days))
    totals = one.groupBy("_range").agg(F.sum("size").alias("_sum"))
    newer = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select("_range", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_newer"))
    inside = Window.partitionBy("_range").orderBy(F.desc("accessed"), F.desc("filename")).rowsBetween(Window.unboundedPreceding, 0)
    kept = one.withColumn("_inside", F.sum("size").over(inside)).join(totals, "_range")
    return kept.filter(F.col("_newer") + F.col("_inside") > limit).select("filename", "size", "accessed")


def automatic_limit(files: DataFrame, limit: int) -> DataFrame:
    """The limit in automatic mode: never below what is used at the start."""
    return usage(files).agg(F.greatest(F.lit(limit), F.coalesce(F.sum("size"), F.lit(0))).alias("limit"))


def touch(files: DataFrame, accesses: DataFrame) -> DataFrame:
    """Access times brought up to date by (filename, accessed)."""
    last = accesses.groupBy("filename").agg(F.max("accessed").alias("_at"))
    return files.join(last, "filename", "left").withColumn("accessed", F.greatest("accessed", "_at")).drop("_at")


def first_occurrences(items: DataFrame, key: str = "iid", pos: str = "pos") -> DataFrame:
    """Each key once, at its first position."""
    return items.groupBy(key).agg(F.min(pos).alias(pos))


def ordered_lookup(table: DataFrame, items: DataFrame, key: str = "iid", pos: str = "pos") -> DataFrame:
    """Rows for a list of keys, each once, in the list's order; keys that aren't there are left out."""
    return table.join(first_occurrences(items, key, pos), key).orderBy(pos)


def downloaded_in_order(items: DataFrame, downloaded: DataFrame, key: str = "iid", pos: str = "pos") -> DataFrame:
    """The list's keys that are among the downloaded ones, each once, in order."""
    return first_occurrences(items, key, pos).join(downloaded.select(key), key, "left_semi").orderBy(pos)


def add_missing(not_found: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of two sets of file names, and by how many it grew."""
    new = more.select("filename").distinct().join(not_found, "filename", "left_anti")
    return not_found.select("filename").unionByName(new), new.agg(F.count("*").alias("gained"))


def chain(*lists: DataFrame) -> DataFrame:
    """Lists (pos, iid) one after the other, by (part, pos)."""
    out = None
    for part, items in enumerate(lists):
        items = items.select(F.lit(part).alias("part"), "pos", "iid")
        out = items if out is None else out.unionByName(items)
    return out
