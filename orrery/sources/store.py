"""Tables that change as a whole or not at all.

A table is a folder of numbered parts: a base, and deltas that came after it. A part counts once the mark
of its completeness lies in it, which is put there last; until then readers see the table as it was. What
a crash leaves behind has no mark and is cleared away by a later writer. There is one writer at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MARK = "_whole"
_PART = re.compile(r"(base|delta)-(\d{8,})$")


def _open(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, path: str) -> list[tuple[int, str, str, bool]]:
    """(number, kind, folder, whole) of all parts, by number."""
    at, fs = _open(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    found = [(int(m[2]), m[1], f"{path}/{n}") for n in names if (m := _PART.match(n))]
    return sorted((*p, fs.exists(_open(spark, f"{p[2]}/{MARK}")[0])) for p in found)


def current(spark: SparkSession, path: str) -> tuple[str | None, list[tuple[int, str]]]:
    """The folder of the newest whole base, and number and folder of the whole deltas since."""
    whole = [p for p in _parts(spark, path) if p[3]]
    base = max((p[0] for p in whole if p[1] == "base"), default=0)
    return next((p[2] for p in whole if p[0] == base), None), [(p[0], p[2]) for p in whole if p[1] == "delta" and p[0] > base]


def put(df: DataFrame, path: str, kind: str = "base") -> None:
    """Add a part; a base replaces the table, which df itself may read. The state before the last one is
    kept, for readers that have it open."""
    spark = df.sparkSession
    before = _parts(spark, path)
    folder = f"{path}/{kind}-{before[-1][0] + 1 if before else 1:08d}"
    df.write.mode("overwrite").parquet(folder)
    mark(spark, folder)
    if kind == "base":
        last = max((p[0] for p in before if p[1] == "base" and p[3]), default=0)
        for p in before:
            if p[0] < last or not p[3]:
                at, fs = _open(spark, p[2])
                fs.delete(at, True)


def mark(spark: SparkSession, folder: str) -> None:
    """From here on the part counts."""
    at, fs = _open(spark, f"{folder}/{MARK}")
    fs.create(at, True).close()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The base alone; None where there is none."""
    base, _ = current(spark, path)
    return spark.read.schema(schema).parquet(base) if base else None
