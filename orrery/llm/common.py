"""What several operators share: the cluster's shared folder and tables written to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, here and in the SQL twins: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or (only where the
    session names none and runs on one machine, as in tests) a folder of our own which is then set as
    that. On a cluster a folder that only one machine sees would lose data, so there it must be set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back. It cuts the lineage at files that
    outlive any executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver next happens to
    collect its garbage; they would else lie beside those of the next steps. The first round lets go
    of the plans that Python held, the second finds the shuffles that these held."""
    for wait in (0.5, 0.1):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many _ as make it none of the columns, whose letters' case does not count."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def text_key(text: Column) -> Column:
    """What tells texts apart under one doc_id: SHA-256 of the whole text; null text is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def only_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id and text are in kept (doc_id, text_key);
    rows that repeat both stay once. The text is part of the key, so rows with a null or hot doc_id are
    judged one by one and are spread over the tasks."""
    own, id_, key = unused(docs.columns, "text_key", "kept_id", "kept_key")
    kept = kept.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    keyed = docs.withColumn(own, text_key(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).select(*docs.columns)


#: Bits of the filters of only_present(): 512 KB, whatever the number of keys.
FILTER_BITS = 1 << 22


def only_present(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among keys (a table of one column), and all of those whose key is.

    The filter that is broadcast has a fixed size. It spares rows the shuffle of a join that follows;
    where the keys are so many that it is full, it lets more rows through, and none fewer.
    """
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))
    pages = keys.select(slot(F.col(keys.columns[0])).alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    out = rows.withColumn("_slot", slot(key)).withColumn("_page", F.bitmap_bucket_number("_slot")).withColumn("_bit", F.bitmap_bit_position("_slot"))
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    return out.join(F.broadcast(pages), "_page").filter(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).select(*rows.columns)
