"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Keys are sorted by range within each source: a key's leading
hex digits are its range, so even a source that holds most rows is spread over all ranges. Prefix sums
of sizes are made inside each range and over the totals of the ranges. A source's budget is cut
exactly, inside a document if need be, after as many whole epochs as fit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, text_key, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Documents a range of keys holds on average, at most.
RANGE_ROWS = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with target: words of the mix each source gives.

    The mix has share times all words. Sources by code point, null last, have the weights in turn. No
    target is above epochs times its source's size; what that leaves over is shared again by weight
    until none is above. All of this is one pass over sources by size for weight: a source is full if
    the level that would hold with it and all larger ones open still is above it. One row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    open_ = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("double"))
    open_ = open_.withColumn("full", (F.col("source_size") * epochs).cast("double")).withColumn("ratio", F.col("full") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    below, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("full").over(below), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    open_ = open_.withColumn("level", level)
    # the first source that isn't full sets the level for itself and all after it
    final = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return open_.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("full")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix", keys: bool = False) -> DataFrame:
    """Which part of each document the mix takes.

    docs has doc_id, text, source. One row per document: doc_id, size (words; null text has none),
    source, source_size, target, taken (words, repeats counted). A source's taken words add up to its
    target's whole part; no document is taken more than epochs times its size. The order in which
    documents are taken is by md5 of seed, doc_id and text, so reruns agree and rows without an id or with
    a hot one are spread over all ranges; rows that repeat both are taken one after the other. Null
    sources are one source, the last. Sources of empty texts and an empty table take nothing. Other
    columns are ignored. With keys there is one more column, text_key.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    more = [text_key(F.col("text")).alias("text_key")] if keys else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.col("source").cast("string").alias("source"), key.alias("key"), *more)
    rows = materialize(rows, "mix-sizes")
    n = rows.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / RANGE_ROWS, 16)) + 1) if n > RANGE_ROWS else 1
    rows = rows.withColumn("range", F.substring("key", 1, digits)).withColumn("name", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))))

    ranges = rows.groupBy("name", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    ranges = materialize(ranges, "mix-ranges")
    budget = targets(ranges.groupBy("name").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size")).drop("name"), weights, share, epochs)
    budget = budget.withColumn("name", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))).drop("source")
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("name", "range", before.alias("before_range")).join(budget, "name")

    inside = Window.partitionBy("name", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["name", "range"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("epochs", whole).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size") - F.col("before_range") - F.col("inside"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("rest"), F.col("size")))
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), *(["text_key"] if keys else []))


def repeat_by_mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes part in it, whole each time, with
    all its columns. Rows that repeat doc_id, text and source share what the mix takes of them evenly, and
    one of them has what is left over."""
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    id_, key, source, total, rows, own, n = unused(docs.columns, "mixed_id", "mixed_key", "mixed_source", "mixed_times", "mixed_rows", "text_key", "copies")
    taken = mix(docs, keys=True).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("source").alias(source), F.when(F.col("taken") > 0, times).otherwise(0).alias(total))
    taken = taken.groupBy(id_, key, source).agg(F.sum(total).cast("int").alias(total), F.count("*").cast("int").alias(rows)).filter(F.col(total) > 0)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    joined = docs.withColumn(own, text_key(F.col("text"))).join(taken, same)
    every = joined.withColumn(n, F.floor(F.col(total) / F.col(rows)).cast("int"))
    rest = joined.withColumn(n, F.col(total) % F.col(rows)).filter(F.col(n) > 0).dropDuplicates([id_, key, source])
    each = every.filter(F.col(n) > 0).unionByName(rest)
    return each.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).select(*docs.columns)


#: The same in DuckDB, for source_size, targets, sizes and taken words.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, (CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, (source_size * 2)::DOUBLE AS "full"
  FROM sources),
leveled AS (
  SELECT *, "full" / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum("full") OVER below, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER below, 0)) AS level
  FROM weighted
  WINDOW below AS (ORDER BY "full" / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (
  SELECT *, (SELECT level FROM leveled WHERE level < ratio ORDER BY ratio, source NULLS LAST LIMIT 1) AS final FROM leveled),
budget AS (
  SELECT source, source_size, CASE WHEN final IS NULL OR ratio <= final THEN "full" ELSE final * weight END AS target FROM final),
placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, floor(b.target)::BIGINT AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS inside
  FROM sized d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (whole // source_size) * size + greatest(0, least(whole % source_size - inside, size)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
