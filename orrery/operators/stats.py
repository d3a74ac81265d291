"""Counts, sums and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection_stats(records: DataFrame) -> DataFrame:
    """Records, pages, deleted ones, bytes of titles, distinct users."""
    return records.agg(
        F.count("*").alias("n_records"), F.sum(F.size("pages")).alias("n_pages"), F.count_if("deleted").alias("n_deleted"),
        F.sum(F.octet_length("title")).alias("title_bytes"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("user_name").alias("n_names"),
    )


def tag_stats(records: DataFrame) -> DataFrame:
    return records.select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("n_tags"), F.sum(F.octet_length("tag")).alias("tag_bytes"))


def download_totals(results: DataFrame, seconds: float) -> DataFrame:
    """results (ok, size): how many, how many failed, bytes, MiB and KiB a second."""
    return results.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("size"))), F.lit(0)).alias("bytes")).withColumns({"mib": F.col("bytes") / (1 << 20), "kib_per_s": F.col("bytes") / 1024 / F.lit(seconds)})
