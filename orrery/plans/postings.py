"""Optional n-gram postings: candidates by gram, then verification by the text itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import condition, prepared


def build(table: DataFrame, text: str = "intro", key: str = "iid") -> DataFrame:
    """(gram, key): each distinct character and pair of characters of each text."""
    chars = table.select(key, F.split(text, "").alias("_c")).withColumn("_c", F.filter("_c", lambda c: c != ""))
    ahead = F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0)))
    pairs = F.filter(F.zip_with("_c", ahead, lambda a, b: F.concat(a, b)), lambda p: p.isNotNull())
    return chars.select(key, F.explode(F.array_distinct(F.concat("_c", pairs))).alias("gram"))


def appended(postings: DataFrame, delta: DataFrame, text: str = "intro", key: str = "iid") -> DataFrame:
    """Postings after a delta: those of its texts take the place of what their keys had."""
    return postings.join(delta.select(key), key, "left_anti").select(key, "gram").unionByName(build(delta, text, key))


def grams_of(term: str) -> list[str]:
    return sorted({term[i : i + 2] for i in range(len(term) - 1)} or {term})


def select(table: DataFrame, postings: DataFrame, filters: Iterable[str], bans: Iterable[str] = (), text: str = "intro", key: str = "iid") -> DataFrame:
    """search.select() through the postings; without filters there is nothing to look up, and it scans."""
    filters, bans = list(filters), list(bans)
    where = condition(F.col(text), filters, bans)
    wanted = sorted({g for t in prepared(filters) for g in grams_of(t)})
    if not wanted:
        return table.filter(where) if where is not None else table
    hits = postings.filter(F.col("gram").isin(wanted)).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(wanted)).select(key)
    return table.join(hits, key, "left_semi").filter(where)


def choose(rarest: int, rows: int, share: float = 0.01) -> str:
    """scan, or postings if the rarest gram leaves few enough rows."""
    return "postings" if rarest < share * rows else "scan"


def planned(table: DataFrame, postings: DataFrame, filters: Iterable[str], bans: Iterable[str] = (), text: str = "intro", key: str = "iid") -> DataFrame:
    """search.select() by the cheaper plan: the rows of the rarest gram of the filters, verified against
    all terms, or a scan where even that gram is frequent. Only counts of the query's grams are collected."""
    filters = list(filters)
    where = condition(F.col(text), filters, bans)
    wanted = sorted({g for t in prepared(filters) for g in grams_of(t)})
    if not wanted:
        return table.filter(where) if where is not None else table
    counts = {r["gram"]: r["count"] for r in postings.filter(F.col("gram").isin(wanted)).groupBy("gram").count().collect()}
    rarest = min(wanted, key=lambda g: counts.get(g, 0))
    if choose(counts.get(rarest, 0), table.count()) == "scan":
        return table.filter(where)
    return table.join(postings.filter(F.col("gram") == rarest).select(key), key, "left_semi").filter(where)
