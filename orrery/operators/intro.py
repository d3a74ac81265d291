"""The text that search runs over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized

#: Separates fields and flags.
SEPARATOR = "\\"


def flags(sanity: Column, x_restrict: Column, width: Column, height: Column, page_count: Column) -> Column:
    """Flag tokens, each with its separator: numbers as $s, $x, $r; then what holds of $n, $h, $w, $l, $t."""
    token = lambda name, value: F.concat(F.lit(SEPARATOR + "$" + name), value.cast("string"))
    flag = lambda name, ok: F.when(ok, SEPARATOR + "$" + name).otherwise("")
    return F.concat(
        token("s", sanity), token("x", x_restrict), token("r", x_restrict + F.floor(sanity / 2)), flag("n", sanity != 2), flag("h", sanity >= 6),
        flag("w", width >= height), flag("l", (width >= height) | (page_count > 1)), flag("t", width <= height),
    )


def with_intro(records: DataFrame) -> DataFrame:
    """Records (after with_primary) with intro: title, primary name and tags, normalised together, and
    the flags, which are not."""
    text = F.concat_ws(SEPARATOR, F.array("title", "primary_name"), F.col("tags"))
    own = flags(F.col("sanity_level"), F.col("x_restrict"), F.col("width"), F.col("height"), F.col("page_count"))
    booleans = {"is_wide": F.col("width") >= F.col("height"), "is_tall": F.col("width") <= F.col("height"), "is_long": (F.col("width") >= F.col("height")) | (F.col("page_count") > 1)}
    return records.withColumn("intro", F.concat(normalized(text), own)).withColumns(booleans)
