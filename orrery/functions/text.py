"""Text normalisation and the string functions built on it."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code points with the Unicode property White_Space.
WHITE_SPACE = r"\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_WHITE = re.compile(f"[{WHITE_SPACE}]")


@lru_cache(1)
def compatibility_variants() -> dict[int, str]:
    """CJK compatibility ideographs -> base ideograph and variation selector.

    Built from the rule behind the standardised variants: a base's compatibility forms, in code point
    order, take the selectors from U+FE00 on.
    """
    out: dict[int, str] = {}
    used: dict[str, int] = {}
    for c in (*range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)):
        base = unicodedata.normalize("NFD", chr(c))
        if base != chr(c):
            out[c] = base + chr(0xFE00 + used.setdefault(base, 0))
            used[base] += 1
    return out


def normalize_text(s: str | None) -> str | None:
    """Lower case, then compatibility ideographs as variants, then NFKC, then no white space. Lower
    case comes first, so what NFKC makes of signs like ™ stays upper case. Null stays null."""
    if s is None:
        return None
    s = s.lower()
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s.translate(compatibility_variants()))
    return _WHITE.sub("", s)


@F.pandas_udf(StringType())
def _normalized(s: pd.Series) -> pd.Series:
    return s.map(normalize_text, na_action="ignore")


#: White space of ASCII, which is all that a text of ASCII can have.
_ASCII_WHITE = " \n\t\r\x0b\x0c"


def normalized(c: Column) -> Column:
    """normalize_text() of a column. Texts of ASCII, as their byte count tells, are done by the JVM;
    only the others are sent to Python."""
    ascii_ = F.length(c) == F.octet_length(c)
    native = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), _ASCII_WHITE, F.lower(c))
    return F.when(ascii_, native).otherwise(_normalized(F.when(~ascii_, c)))


def computed_once(table: DataFrame, **columns: Column) -> DataFrame:
    """table with more columns that later filters can't copy into each of their terms: each is made by
    a generator of one row, which costs no shuffle."""
    for name, c in columns.items():
        table = table.select("*", F.explode(F.array(c)).alias(name))
    return table


def trim_white(c: Column) -> Column:
    """Without White_Space at either end (trim() takes only U+0020)."""
    return F.regexp_replace(c, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def file_name(url: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(url, "/", -1)


def upscaled_name(filename: Column, scale: Column | int) -> Column:
    """The name of a file's enlarged copy."""
    return F.format_string("%s_%dx.png", F.replace(filename, F.lit("."), F.lit("_")), F.lit(scale) if isinstance(scale, int) else scale)


def ratio_bucket(ratio: Column) -> Column:
    """The enlargement that serves a ratio: 2, 3 or 4."""
    return F.when(ratio <= 2, 2).when(ratio <= 3, 3).otherwise(4)


def display_rating(sanity: Column, x_restrict: Column) -> Column:
    return F.shiftright(sanity, 1) + x_restrict


def register(spark: SparkSession) -> None:
    """Make `normalized` known to SQL."""
    spark.udf.register("normalized", _normalized)
