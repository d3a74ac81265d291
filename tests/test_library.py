import random

from orrery.operators import library, upsert
from orrery.sources import files


def test_eviction_is_popping_the_oldest(spark):
    rng = random.Random(2)
    for limit in (0, 300, 900, 10**6):
        rows = [(f"f{i}", rng.randint(1, 60), rng.randint(0, 40)) for i in range(60)]
        order = sorted(rows, key=lambda r: (r[2], r[0]))
        left, gone = sum(r[1] for r in rows), []
        while left > limit:
            gone.append(order.pop(0))
            left -= gone[-1][1]
        got = library.evict(spark.createDataFrame(rows, "filename string, size long, accessed long"), limit, days=7)
        assert sorted(r.filename for r in got.collect()) == sorted(r[0] for r in gone)
    again = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("e", 0, 9)], "filename string, size long, accessed long")
    assert [tuple(r) for r in library.usage(again).collect()] == [("a", 5, 2)] and library.automatic_limit(again, 3).first()[0] == 5


def test_queues_and_sets(spark):
    pages = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "iid long, filename string")
    have, missing = spark.createDataFrame([("a",), ("z",)], "filename string"), spark.createDataFrame([("c",)], "filename string")
    names = lambda df: sorted(r.filename for r in df.collect())
    assert names(library.download_queue(pages, have, missing)) == ["b", "d"] and library.skipped_count(pages, have, missing).first()[0] == 1
    assert names(library.orphans(have, pages)) == ["z"]
    pending = spark.createDataFrame([(0, 3), (1, 3), (2, 1)], "pos long, iid long")
    assert names(library.pending_queue(pending, pages, have, missing)) == ["b", "d", "d"]
    try:
        library.pending_queue(spark.createDataFrame([(0, 77)], "pos long, iid long"), pages, have, missing).collect()
        raise AssertionError("an unknown id must be an error")
    except Exception as e:
        assert "no such record" in str(e)
    both, gained = library.add_missing(missing, have.union(missing))
    assert names(both) == ["a", "c", "z"] and gained.first()[0] == 2
    assert [r.iid for r in library.downloaded_in_order(pending, spark.createDataFrame([(1,), (3,)], "iid long")).collect()] == [3, 1]


def test_listing_and_sizes(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    (tmp_path / "1_p1.png").write_bytes(png)
    (tmp_path / "empty").write_bytes(b"")
    assert [(r.filename, r["size"]) for r in files.list_files(spark, str(tmp_path)).collect()] == [("1_p1.png", len(png))]
    assert [r.filename for r in files.list_local(spark, str(tmp_path)).collect()] == ["1_p1.png"]
    pages = spark.createDataFrame([(1, 1, "1_p1.png", None, None), (1, 0, "x", 3, 3)], "iid long, pn int, filename string, width int, height int")
    assert [tuple(r) for r in files.measured(spark, str(tmp_path), pages).collect()] == [(1, 1, 7, 9)]
    assert files.image_size(b"GIF89a\x02\0\x03\0") == (2, 3) and files.image_size(b"junk") is None
    assert files.image_size(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08\0\5\0\6") == (6, 5)


def test_versions(spark):
    v = spark.createDataFrame([(1, 1, "a", 10), (1, 3, "c", 30), (1, 2, "b", 20), (2, 1, "x", 40)], "k int, v int, t string, seq int")
    assert sorted(tuple(r) for r in upsert.latest(v, ["k"], "v", "seq").collect()) == [(1, 3, "c", 10), (2, 1, "x", 40)]
    new = upsert.new_sequence(spark.range(25).withColumnRenamed("id", "pos"), 100, run=4)
    assert sorted((r.pos, r.seq) for r in new.collect()) == [(p, 100 + 25 - p) for p in range(25)]
    old, now = (spark.createDataFrame([(1, t)], "iid long, raw string") for t in ('{"b":1,"a":2}', '{"a":3,"b":1}'))
    assert upsert.json_diff(old, now).first()["diff"] == ['-   "a": 2,', '+   "a": 3,']
