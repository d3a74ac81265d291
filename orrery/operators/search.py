"""Conjunctive substring search with exclusions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

SAFE_FILTER = "$s2"


def prepared(terms: Iterable[str]) -> list[str]:
    """Terms as the text has them; a term that is blank then is an error."""
    out = [normalize_text(t) for t in terms]
    if "" in out:
        raise ValueError("blank search term")
    return list(dict.fromkeys(out))


def condition(text: Column, filters: Iterable[str] = (), bans: Iterable[str] = (), safe: bool = False) -> Column | None:
    """All filters in the text and no ban; None without any term. A stored text column gets all of it
    pushed to the scan."""
    terms = [text.contains(t) for t in [*prepared(filters), *([SAFE_FILTER] if safe else [])]] + [~text.contains(b) for b in prepared(bans)]
    return reduce(Column.__and__, terms) if terms else None


def select(table: DataFrame, filters: Iterable[str] = (), bans: Iterable[str] = (), text: str = "intro", seq: str = "seq", safe: bool = False, disabled: bool = False, ordered: bool = True) -> DataFrame:
    """Matching rows, newest first. Without terms: all rows. disabled: the index is empty, so any term
    finds nothing."""
    c = condition(F.col(text), filters, bans, safe)
    found = table if c is None else table.filter(F.lit(False) if disabled else c)
    return found.orderBy(F.desc(seq)) if ordered else found


# Other plans for the same answer, for differential tests.


def select_by_sets(table: DataFrame, filters: Iterable[str] = (), bans: Iterable[str] = (), text: str = "intro", key: str = "iid") -> DataFrame:
    """Keys: intersect of the filters' hits, less the union of the bans' hits."""
    hits = lambda t: table.filter(F.col(text).contains(t)).select(key)
    wanted, unwanted = prepared(filters), prepared(bans)
    found = reduce(DataFrame.intersect, map(hits, wanted)) if wanted else table.select(key)
    return found.join(reduce(DataFrame.union, map(hits, unwanted)).distinct(), key, "left_anti") if unwanted else found


def select_by_verification(table: DataFrame, filters: Iterable[str], bans: Iterable[str] = (), text: str = "intro", key: str = "iid") -> DataFrame:
    """Keys: the hits of the longest filter, verified against the rest."""
    wanted = sorted(prepared(filters), key=len, reverse=True)
    candidates = table.filter(F.col(text).contains(wanted[0])).select(key, text)
    rest = [F.instr(F.col(text), t) > 0 for t in wanted[1:]] + [F.instr(F.col(text), b) == 0 for b in prepared(bans)]
    return (candidates.filter(reduce(Column.__and__, rest)) if rest else candidates).select(key)
