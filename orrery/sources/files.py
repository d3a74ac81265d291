"""Listings of files, and sizes of images."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = "filename string, size long, accessed timestamp"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, size, accessed) of the non-empty files of a folder, by any file system Spark reads.
    accessed is the time of the last change, which is what such stores keep; contents aren't read."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("accessed"))
    return found.filter("size > 0")


def list_local(spark: SparkSession, path: str) -> DataFrame:
    """The same for a folder on the driver, with true access times."""
    from datetime import UTC, datetime

    rows = [(e.name, s.st_size, datetime.fromtimestamp(s.st_atime, UTC)) for e in os.scandir(path) if e.is_file() and (s := e.stat()).st_size]
    return spark.createDataFrame(rows, LISTING)


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, GIF or JPEG file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 <= len(data) and data[i] == 0xFF:
            if 0xC0 <= data[i + 1] <= 0xCF and data[i + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[i + 7 : i + 9], "big"), int.from_bytes(data[i + 5 : i + 7], "big")
            i += 2 + int.from_bytes(data[i + 2 : i + 4], "big")
    return None


def measured(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """(iid, pn, width, height) of pages without a size whose file is in the folder and can be measured."""
    images = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    wanted = pages.filter(F.col("width").isNull() | F.col("height").isNull()).select("iid", "pn", "filename")

    def run(batches):
        for b in batches:
            sizes = [image_size(bytes(c)) or (None, None) for c in b["content"]]
            yield b[["iid", "pn"]].assign(width=[s[0] for s in sizes], height=[s[1] for s in sizes])

    found = wanted.join(images, "filename").mapInPandas(run, "iid long, pn int, width int, height int")
    return found.filter((F.col("width") > 0) & (F.col("height") > 0))
