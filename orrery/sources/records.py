"""Where records come from and where they are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

BRONZE = "seq long, iid long, raw string"


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """(seq, iid, raw) of plain Parquet, or of a table in parts. Order is seq's; sort only what is shown.
    A filter on iid reaches the files."""
    return spark.read.schema(BRONZE).parquet(store.current(spark, path)[0] or path)


def point(bronze: DataFrame, iid: int) -> DataFrame:
    return bronze.filter(F.col("iid") == iid)


def import_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one JSON array of records -> bronze. The records keep their text; keys aren't
    reordered. A JSON array can't be split, so the file passes through one task."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("pos", "raw"))
    return items.select((F.col("pos") + 1).cast("long").alias("seq"), F.get_json_object("raw", "$.id").cast("long").alias("iid"), "raw")


def write_bronze(bronze: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd") -> None:
    """mode="overwrite" is truncate-and-reload; Spark's commit makes either all or nothing."""
    bronze.write.mode(mode).option("compression", codec).parquet(path)


def swap(df: DataFrame, path: str) -> None:
    """Replace a table that df itself may read: all of it or, after a crash at any point, nothing."""
    store.put(df, path)


def decode_blobs(stored: DataFrame) -> DataFrame:
    """(seq, iid, data) of a legacy store -> bronze. Plain blobs are UTF-8 JSON. Blobs tagged L are LZ4
    blocks behind their size; they are unpacked in Arrow batches."""

    def run(batches):
        for b in batches:
            yield b[["seq", "iid"]].assign(raw=[plain(bytes(d)).decode() for d in b["data"]])

    return stored.select("seq", "iid", "data").mapInPandas(run, BRONZE)


def plain(blob: bytes) -> bytes:
    if blob[:1] != b"L":
        return blob
    size = int.from_bytes(blob[1:5], "little")
    try:
        import pyarrow as pa

        out = pa.decompress(blob[5:], decompressed_size=size, codec="lz4_raw", asbytes=True)
    except (ImportError, NotImplementedError):
        out = lz4_block(blob[5:])
    if len(out) != size:
        raise ValueError("LZ4 block of another size than it says")
    return out


def lz4_block(src: bytes) -> bytes:
    """Unpack one block of the public LZ4 block format, runs of literals and copies from what is out
    already, where Arrow has been built without that codec."""
    out, i = bytearray(), 0

    def length(start: int) -> int:
        nonlocal i
        if start == 15:
            while True:
                start += src[i]
                i += 1
                if src[i - 1] != 255:
                    break
        return start

    while i < len(src):
        token = src[i]
        i += 1
        n = length(token >> 4)
        out += src[i : i + n]
        i += n
        if i >= len(src):
            break
        back = int.from_bytes(src[i : i + 2], "little")
        i += 2
        n = length(token & 15) + 4
        if not 0 < back <= len(out):
            raise ValueError("LZ4 copy from before the start")
        for at in range(len(out) - back, len(out) - back + n):
            out.append(out[at])
    return bytes(out)


def encode_blobs(bronze: DataFrame) -> DataFrame:
    """bronze -> (seq, iid, data) with plain blobs; compressing is the file format's work here."""
    return bronze.select("seq", "iid", F.col("raw").cast("binary").alias("data"))
