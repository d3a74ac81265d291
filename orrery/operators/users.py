"""Names of users: the primary one, and tags with the name a record came with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def primary_names(records: DataFrame, key: str = "user_id", name: str = "user_name", seq: str = "seq") -> DataFrame:
    """The most frequent name of each user; of equally frequent ones the one that got there first, that
    is, whose last use is earliest. Two aggregations, both combined before their shuffle."""
    used = records.groupBy(key, name).agg(F.count("*").alias("_n"), F.max(seq).alias("_last"))
    return used.groupBy(key).agg(F.max_by(name, F.struct(F.col("_n"), -F.col("_last"))).alias("primary_name"))


def with_primary(records: DataFrame, users: DataFrame) -> DataFrame:
    """records with primary_name, and with tags that start with their own name where it is another.
    Whether users are broadcast is Spark's choice, by their size."""
    joined = records.join(users, "user_id")
    own = F.when(F.col("user_name") == F.col("primary_name"), F.col("tags")).otherwise(F.concat(F.array("user_name"), F.col("tags")))
    return joined.withColumn("tags", own)
