import json
import random

import pytest

from orrery.sources import feed, store
from orrery.streaming import sync

from .test_records import record


def test_replay_is_the_sequential_walk(spark):
    rng = random.Random(3)
    for _ in range(4):
        known = set(rng.sample(range(40), 20))
        pages = [[rng.randrange(40) for _ in range(5)] for _ in range(12)]
        urls = {f"p{k}": {"illusts": [{"id": i} for i in p], "next_url": f"p{k + 1}" if k < 11 else None} for k, p in enumerate(pages)}
        want = [(int(u[1:]), k) for u, items in feed.walk(urls.get, "p0", known.__contains__, pause=0) for k, _ in enumerate(items)]
        rows = [(0, p, k, i) for p, own in enumerate(pages) for k, i in enumerate(own)]
        got = sync.until_nothing_new(spark.createDataFrame(rows, "stage int, page int, pos int, iid long"), spark.createDataFrame([(i,) for i in known], "iid long"))
        assert sorted((r.page, r.pos) for r in got.collect()) == sorted(want)


def test_walk_waits_and_stops():
    slept, calls = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) == 1:
            raise feed.RateLimited
        return {"illusts": [{"id": len(calls)}], "next_url": "next"}

    assert len(list(feed.walk(fetch, "a", lambda i: False, limit=2, sleep=slept.append))) == 2 and slept == [60, 3, 3]


def batch(spark, *rows):
    return spark.createDataFrame([(s, 0, k, json.dumps(r)) for k, (s, r) in enumerate(rows)], feed.FEED)


def test_classes_order_and_rollback(spark, tmp_path):
    c = sync.Collection(spark, str(tmp_path / "c"))
    status = lambda df: {r.iid: r.status for r in df.collect()}
    assert status(c.apply(batch(spark, (0, record(3)), (0, record(2)), (1, record(1))))) == dict.fromkeys((1, 2, 3), "New")
    # newest first within a batch: the first of the feed gets the highest sequence
    assert [r.iid for r in c.bronze().orderBy("seq").collect()] == [1, 2, 3]
    last = c.bronze()
    got = c.apply(batch(spark, (0, record(4, visible=False)), (0, record(3, title="new")), (0, record(2, caption="new")), (1, record(1, visible=False))))
    assert status(got) == {4: "New", 3: "IntroChanged", 2: "IntroUnchanged", 1: "Hidden"}
    assert [r.iid for r in c.bronze().orderBy("seq").collect()] == [1, 2, 3, 4]
    assert c.table().filter("iid = 3").first().intro.startswith("new\\") and json.loads(c.bronze().filter("iid = 1").first().raw)["visible"]
    assert status(c.apply(batch(spark, (0, record(3, title="new"))), last_batch=c.bronze().select("iid", "raw"))) == {3: "Skipped"} and last is not None
    before = sorted(map(tuple, c.bronze().collect()))
    with pytest.raises(Exception):
        c.apply(batch(spark, (0, record(5)), (1, record(6, width=0))))
    assert sorted(map(tuple, c.bronze().collect())) == before


@pytest.mark.parametrize("fail", ["write", "mark", "clear"])
def test_no_crash_loses_a_row(spark, tmp_path, monkeypatch, fail):
    """Whatever step a writer dies at, the table is as it was before or as it is after."""
    at = str(tmp_path / "t")
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "i long")
    read = lambda: sorted(r.i for r in store.read(spark, at, "i long").collect())
    store.put(rows(1, 2, 3), at)
    store.put(rows(1, 2, 3, 4), at)

    def dies(*_):
        raise OSError("dead")

    with monkeypatch.context() as m:
        if fail == "write":
            m.setattr(store, "_parts", dies)
        elif fail == "mark":
            m.setattr(store, "mark", dies)
        else:
            real = store._open
            m.setattr(store, "_open", lambda s, p: dies() if p.endswith("base-00000001") and store.MARK not in p else real(s, p))
        with pytest.raises(OSError):
            store.put(rows(5), at)
    assert read() == ([5] if fail == "clear" else [1, 2, 3, 4])
    store.put(rows(6, 7), at)
    assert read() == [6, 7] and len(store._parts(spark, at)) == 2


def test_deltas_skips_and_compaction(spark, tmp_path):
    c = sync.Collection(spark, str(tmp_path / "c"))
    first = [(1, record(i, user={"id": i % 5, "name": f"N{i % 5}", "account": ""})) for i in range(100, 0, -1)]
    c.apply(batch(spark, *first))
    assert store.current(spark, c.path)[1] == []
    # a name gains: the user's other records are written again, no others
    more = [(1, record(200 + i, user={"id": 2, "name": "New", "account": ""})) for i in range(30)]
    status = {r.iid: r.status for r in c.apply(batch(spark, *more, (1, record(99, title="x", user={"id": 4, "name": "N4", "account": ""})))).collect()}
    assert status[99] == "IntroChanged" and status[210] == "New"
    want = sorted((r.iid, r.intro) for r in c.table().collect())
    assert sorted((r.iid, r.intro) for r in c.stored().collect()) == want and any("new\\n2" in t for _, t in want)
    assert sorted(r.iid for r in c.select(["new"]).collect()) == sorted([200 + i for i in range(30)] + list(range(2, 101, 5)))
    # the batch before is remembered
    again = c.apply(batch(spark, (1, record(99, title="x", user={"id": 4, "name": "N4", "account": ""})), (1, record(1, title="y"))))
    assert {r.iid: r.status for r in again.collect()} == {99: "Skipped", 1: "IntroChanged"}
    _, deltas = store.current(spark, c.path)
    assert len(deltas) == 1 and spark.read.parquet(deltas[0][1]).count() == 1
    assert c.stored().count() == 130 and "StringContains(intro,new)" in c.select(["new"])._jdf.queryExecution().toString()


def test_pending_list_is_taken_up_again(spark, tmp_path):
    c, got = sync.Collection(spark, str(tmp_path / "c")), []

    def dies(df):
        raise OSError("no network")

    with pytest.raises(OSError):
        c.update_then_download(batch(spark, (0, record(3)), (1, record(1))), dies)
    c.update_then_download(batch(spark, (0, record(5)), (1, record(1, title="b"))), lambda df: got.extend(r.iid for r in df.collect()))
    assert got == [3, 1, 5]
    c.recover(dies)
    last = sync.hooked(c.apply(batch(spark, (1, record(8)), (0, record(9)), (1, record(5)))))
    # 5 is as it was in the batch before
    assert [json.loads(r.raw)["id"] for r in last.collect()] == [9, 8]


def test_stream_of_pages(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    for k in range(3):
        (folder / f"page-{k}.json").write_text(json.dumps({"illusts": [record(10 - 2 * k), record(9 - 2 * k)], "next_url": f"page-{k + 1}.json" if k < 2 else None}))
    reader = feed.FeedReader({"folder": str(folder)})
    at, rows = reader.initialOffset(), []
    for _ in range(4):
        got, after = reader.read(at)
        rows += got
        assert list(reader.readBetweenOffsets(at, after)) == list(reader.read(at)[0])
        at = after
    assert [json.loads(r[3])["id"] for r in rows] == [10, 9, 8, 7, 6, 5]
    spark.dataSource.register(feed.FeedSource)
    spark.createDataFrame(rows, feed.FEED).write.parquet(str(tmp_path / "in"))
    seen = []
    c = sync.Collection(spark, str(tmp_path / "c"))
    query = c.follow(spark.readStream.schema(feed.FEED).parquet(str(tmp_path / "in")), str(tmp_path / "ck"), lambda df, epoch: seen.append(df.count()))
    query.awaitTermination()
    assert sum(seen) == 6 and [r.iid for r in c.bronze().orderBy("seq").collect()] == [5, 6, 7, 8, 9, 10]


def test_compaction_rule():
    assert sync.needs_compaction(159, 5, 5) and not sync.needs_compaction(160, 5, 5)
