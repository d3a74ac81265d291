"""Exact deduplication as a stateful stream.

Arrivals (digest of the normalised text, document id, length, locator) stream through a keyed state
that never expires. The state lies in RocksDB on the executors' disks, with its changes in the shared
folder, and holds for each digest the document that stays, the number of rows and where that
document's content is. Rows that hit a digest already held are then compared by their full bytes; those
of earlier batches are fetched by their locators.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .common import SPACE_CLASS, exists, fresh_path, materialize, only_kept, only_present, text_key

_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
#: The state store: on disk, with its changes in the shared folder instead of whole snapshots each
#: time, and without room set aside for files that stay small.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.changelogCheckpointing.enabled": "true",
    f"{_ROCKS}.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


#: The columns of arrivals that the stream takes.
ARRIVAL = ("doc_id", "n_points", "locator", "digest")


def arrivals(docs: DataFrame, digest=sha256_digest, keys: bool = False) -> DataFrame:
    return texts_of(docs, digest).select("doc_id", "n_points", "locator", *(["text_key"] if keys else []), "digest")


def _rank() -> Column:
    """The larger struct stays: most code points, then smallest doc_id, null ids last."""
    return F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("neg_id"), F.col("locator"))


def taken_in(rows: DataFrame, home: str, batch: str) -> DataFrame:
    """The arrivals of a batch, written under its name once: a batch that is run again isn't written again."""
    path = f"{home}/arrivals/{batch}"
    if not exists(rows.sparkSession, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fold_stream(rows: DataFrame, home: str, files_per_batch: int) -> DataFrame:
    """Run the stream over the arrivals that lie in home and that it hasn't seen; the last state of each
    digest comes out.

    Each micro-batch pre-aggregates before its shuffle, so a digest that a third of all rows carry
    sends one row per task, and appends only the digests whose state changed.
    """
    spark, schema, log = rows.sparkSession, StructType([rows.schema[c] for c in ARRIVAL]), f"{home}/log"
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/arrivals/*")
        held = stream.groupBy("digest").agg(F.max(_rank()).alias("best"), F.count("*").alias("group_size"))

        def append(batch: DataFrame, epoch: int) -> None:
            # one folder per epoch, overwritten when an epoch is run again after a failure
            batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

        query = held.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(append).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not exists(spark, log):
        return spark.createDataFrame([], held.schema)
    changes = spark.read.schema(held.schema.add("epoch", IntegerType())).parquet(log)
    last = F.max(F.struct("epoch", "best", "group_size")).alias("last")
    return changes.groupBy("digest").agg(last).select("digest", "last.best", "last.group_size")


def texts_of(docs: DataFrame, digest) -> DataFrame:
    """(doc_id, n_points, locator, text_key, norm, digest) of documents."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        F.input_file_name().alias("locator"),
        text_key(F.col("text")).alias("text_key"),
        normalised(F.col("text")).alias("norm"),
    )
    return rows.withColumn("digest", digest(F.col("norm")))


def fetched(wanted: DataFrame, digest) -> DataFrame:
    """texts_of() the arrivals in wanted (digest, locator, doc_id), read where their locators say. Only
    files that hold one are read; the driver gets the names of these, as for any scan. A text that is
    no longer there is an error."""
    spark = wanted.sparkSession
    files = [r["locator"] for r in wanted.select("locator").distinct().collect()]
    if "" in files:
        raise ValueError("documents that were held under a lasting state must have come from files")
    empty = spark.createDataFrame([], "doc_id long, text string")
    rows = texts_of(spark.read.parquet(*map(unquote, files)) if files else empty, digest)
    keys = wanted.select(*(F.col(c).alias(f"held_{c}") for c in ("digest", "locator", "doc_id"))).distinct()
    same = (F.col("digest") == F.col("held_digest")) & (F.col("locator") == F.col("held_locator")) & F.col("doc_id").eqNullSafe(F.col("held_doc_id"))
    found = materialize(rows.join(keys, same, "left_semi"), "exact-fetched")
    if found.select("digest", "locator", "doc_id").distinct().count() != keys.count():
        raise ValueError("the content of documents held under a lasting state is no longer where their locators say")
    return found


def differing(docs: DataFrame, held: DataFrame, digest=sha256_digest, earlier: DataFrame | None = None) -> DataFrame:
    """Digests under which more than one text came: the byte-by-byte check of all hits.

    A filter of fixed size picks the rows whose digest was hit. Their least and greatest text are
    combined in each task before the shuffle, so copies don't travel; the two are equal only if all
    bytes of all texts are. earlier (norm, digest) has one text of each digest that came in a batch before.
    """
    rows = docs.select(normalised(F.col("text")).alias("norm")).select("norm", digest(F.col("norm")).alias("digest"))
    rows = only_present(rows, F.col("digest"), held.filter("group_size > 1").select("digest"))
    if earlier is not None:
        rows = rows.unionByName(earlier.select("norm", "digest"))
    return rows.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).filter("least <> most").select("digest")


def dedup_exact(docs: DataFrame, digest=sha256_digest, files_per_batch: int = 64, home: str | None = None, batch: str | None = None) -> DataFrame:
    """Texts that are equal without their white space: which one stays.

    docs has doc_id and text. One row per document comes out: doc_id, keep_id, group_size, kept,
    text_sha256 (of the normalised text, by the default digest). Of equal texts the row with the most
    code points stays, then the smallest doc_id (null last). Null text is empty, and all empty texts
    are one group. Rows that repeat a doc_id count one by one; if the row that stays repeats with the
    same id and length, each of these rows is kept. Other columns are ignored.

    digest may be any function of the normalised text. Should two texts share a digest, the check of
    full bytes finds it, and the documents concerned are grouped by their texts instead.

    home is a shared folder where the state lasts, so that documents meet those of all earlier calls with
    the same home and digest; without it the state serves this call alone. docs is then judged by all that
    came so far (a later batch's longer copy may take a place), and must come from Parquet files that stay:
    the texts of earlier batches are fetched by the locators held. batch names docs: the rows of one name
    count once, so a batch whose call failed is run again, under its name, before the next. There is one
    writer of a home at a time.
    """
    return judged(docs, digest, files_per_batch, home=home, batch=batch).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def judged(docs: DataFrame, digest=sha256_digest, files_per_batch: int = 64, keys: bool = False, home: str | None = None, batch: str | None = None) -> DataFrame:
    """dedup_exact(), and with keys two more columns: text_key, and norm, which is null but where texts
    share a digest."""
    spark, lasting, batch = docs.sparkSession, home is not None, batch or uuid.uuid4().hex
    home = home.rstrip("/") if lasting else fresh_path(spark, "exact")
    rows = taken_in(arrivals(docs, digest, keys), home, batch)
    held = materialize(fold_stream(rows, home, files_per_batch), "exact-held")
    before = earlier = None
    if lasting:
        before = others(rows, home, batch)
        met = before.join(rows.select("digest"), "digest", "left_semi")
        earlier = fetched(met.groupBy("digest").agg(F.min(F.struct("locator", "doc_id")).alias("one")).select("digest", "one.*"), digest)
    mixed = differing(docs, held, digest, earlier)
    if lasting:
        mixed.write.mode("overwrite").parquet(f"{home}/mixed/{batch}")
        mixed = spark.read.schema(mixed.schema).parquet(f"{home}/mixed/*").distinct()
    else:
        mixed = materialize(mixed, "exact-mixed")
    any_mixed = not mixed.isEmpty()
    out = rows.join(held, "digest")
    if any_mixed:
        out = out.join(mixed, "digest", "left_anti")
    keep_id = F.when(F.col("best.has_id"), -F.col("best.neg_id"))
    stays = F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_points") == F.col("best.n_points"))
    columns = ["doc_id", keep_id.alias("keep_id"), "group_size", stays.alias("kept"), F.col("digest").alias("text_sha256")]
    more = ["text_key", "norm"] if keys else []
    result = out.withColumn("norm", F.lit(None).cast("string")).select(*columns, *more)
    if any_mixed:
        texts = texts_of(docs, digest).join(mixed, "digest", "left_semi")
        every = texts if before is None else texts.unionByName(fetched(before.join(mixed, "digest", "left_semi"), digest))
        best = every.groupBy("digest", "norm").agg(F.max(_rank()).alias("best"), F.count("*").alias("group_size"))
        result = result.unionByName(texts.join(best, ["digest", "norm"]).select(*columns, *more))
    return result


def others(rows: DataFrame, home: str, batch: str) -> DataFrame:
    """The arrivals in home of all batches but this one."""
    spark, name = rows.sparkSession, F.element_at(F.split(F.input_file_name(), "/"), -2)
    every = spark.read.schema(StructType([rows.schema[c] for c in ARRIVAL])).parquet(f"{home}/arrivals/*")
    return every.withColumn("_batch", name).filter(F.col("_batch") != quote(batch)).drop("_batch")


def keep_first_copies(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of equal texts, whatever
    other texts its doc_id has. Of rows that all stay by dedup_exact() (one id, one length, the white
    space elsewhere) it is the one of least text_key."""
    kept = judged(docs, digest, keys=True).filter("kept").groupBy("text_sha256", "norm").agg(F.min(F.struct("text_key", "doc_id")).alias("best"))
    return only_kept(docs, kept.select("best.doc_id", "best.text_key"))
