"""The paged feed as a streaming source of Spark."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FEED = "stage int, page int, pos int, raw string"
#: Seconds between pages, and after the far side said that there were too many requests.
PAUSE, LIMITED = 3, 60


class RateLimited(Exception):
    """Raised by a fetcher when it should be called later."""


def folder_fetcher(folder: str) -> Callable[[str], dict]:
    """Pages from files: an address is a file name in the folder."""
    return lambda url: json.loads((Path(folder) / url).read_text(encoding="utf-8"))


def walk(fetch: Callable[[str], dict], url: str | None, known: Callable[[int], bool], limit: int | None = None, pause: float = PAUSE, limited: float = LIMITED, sleep=time.sleep) -> Iterator[tuple[str, list[dict]]]:
    """Pages from url on, to the first without a new record, the last one, or the limit. known says
    whether an id was seen; ids of earlier pages count as seen."""
    seen: set[int] = set()
    n = 0
    while url and (limit is None or n < limit):
        try:
            page = fetch(url)
        except RateLimited:
            sleep(limited)
            continue
        items = page["illusts"]
        yield url, items
        new = {i["id"] for i in items if i["id"] not in seen and not known(i["id"])}
        seen |= new
        n += 1
        url = page.get("next_url")
        if not new:
            return
        if url:
            sleep(pause)


class FeedReader(SimpleDataSourceStreamReader):
    """One page per step; the offset is the address of the next page."""

    def __init__(self, options: dict):
        self.fetch, self.first = folder_fetcher(options["folder"]), options.get("first", "page-0.json")
        self.stage, self.left = int(options.get("stage", 0)), int(options.get("limit", 1 << 30))

    def initialOffset(self) -> dict:
        return {"url": self.first, "page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not start["url"] or start["page"] >= self.left:
            return iter([]), start
        page = self.fetch(start["url"])
        rows = [(self.stage, start["page"], i, json.dumps(x, ensure_ascii=False, separators=(",", ":"))) for i, x in enumerate(page["illusts"])]
        return iter(rows), {"url": page.get("next_url") or "", "page": start["page"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        out = []
        while start["page"] < end["page"]:
            rows, start = self.read(start)
            out += rows
        return iter(out)


class FeedSource(DataSource):
    """spark.dataSource.register(FeedSource); spark.readStream.format("orrery_feed").option("folder", …)"""

    @classmethod
    def name(cls) -> str:
        return "orrery_feed"

    def schema(self) -> str:
        return FEED

    def simpleStreamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)
