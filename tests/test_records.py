import json

import pytest
from pyspark.sql import functions as F

from orrery.operators import intro, model, pages, stats, users
from orrery.sources import records, state
from orrery.streaming import sync

BASE = model.URL_PREFIX


def record(i, **over):
    n = over.pop("n", 1)
    url = lambda p: f"{BASE}24/01/{i}_p{p}.jpg"
    r = {"id": i, "title": f"T {i}", "user": {"id": "7", "name": "　Ann ", "account": "a"}, "width": 30, "height": 20, "meta_single_page": {"original_image_url": url(0)} if n == 1 else {}, "page_count": n,
         "meta_pages": [] if n == 1 else [{"image_urls": {"original": url(p)}} for p in range(n)], "tags": [{"name": "Cat"}], "sanity_level": 2, "x_restrict": 0, "visible": True, "create_date": "2024", "caption": "", "is_bookmarked": True, "type": "illust", "unknown": 1}
    return r | over


def bronze(spark, *items):
    return spark.createDataFrame([(k, r["id"], json.dumps(r)) for k, r in enumerate(items, 1)], records.BRONZE)


def test_intro_and_flags(spark):
    table = sync.with_intros(bronze(spark, record(1), record(2, width=20, n=2), record(3, width=10, height=10, sanity_level=6, x_restrict=1), record(4, width=1, height=2, sanity_level=4)))
    got = {r.iid: r.intro for r in table.collect()}
    assert got == {
        1: r"t1\ann\cat\$s2\$x0\$r1\$w\$l", 2: r"t2\ann\cat\$s2\$x0\$r1\$w\$l\$t",
        3: r"t3\ann\cat\$s6\$x1\$r4\$n\$h\$w\$l\$t", 4: r"t4\ann\cat\$s4\$x0\$r2\$n\$t",
    }


def test_names_and_tags(spark):
    named = lambda i, n, u=7: record(i, user={"id": u, "name": n, "account": ""})
    table = sync.with_intros(bronze(spark, named(1, "A"), named(2, "B"), named(3, "B"), named(4, "A"), named(5, "C", 8)))
    got = {r.iid: (r.primary_name, r.tags) for r in table.collect()}
    assert got[1] == ("B", ["A", "Cat"]) and got[2] == ("B", ["Cat"]) and got[5] == ("C", ["Cat"])


def test_bad_records_fail_the_load(spark):
    for bad in ({"width": 0}, {"page_count": 3}, {"meta_single_page": {}}, {"meta_single_page": {"original_image_url": "ftp"}}, {"meta_single_page": {"original_image_url": BASE + "https://x/y"}}, {"width": "wide"}):
        with pytest.raises(Exception):
            model.parse_records(bronze(spark, record(1), record(2, **bad))).collect()


def test_limited_and_pages(spark):
    table = sync.with_intros(bronze(spark, record(1, meta_single_page={"original_image_url": model.LIMITED_URLS[0]}), record(2, n=3)))
    assert {r.iid: r.deleted for r in table.collect()} == {1: True, 2: False}
    sized = pages.apply_dimensions(table, spark.createDataFrame([(2, [5, 6, 7, 8]), (1, [1, 2])], "iid long, sizes array<int>"))
    out = {r.id: r for r in pages.projected(sized).collect()}
    assert [(p.w, p.h, p.filename) for p in out[2].pages] == [(30, 20, "2_p0.jpg"), (5, 6, "2_p1.jpg"), (7, 8, "2_p2.jpg")] and out[2].rating == 1
    assert [(p.w, p.h) for p in pages.projected(table.filter("iid = 2")).first().pages] == [(30, 20)] * 3
    assert pages.dump_dimensions(sized).first().sizes == [5, 6, 7, 8]
    wire = json.loads(pages.wire(pages.projected(table.filter("iid = 2"))).first().json)
    assert wire[:5] == [2, "T 2", 7, "Ann", ["Cat"]] and wire[5][0] == [30, 20, "img", "2_p0.jpg"] and wire[6:] == ["2024", 1]
    flat = pages.exploded(table)
    assert pages.lookup(flat, spark.createDataFrame([("2_p1.jpg",)], "filename string"), 2, 2, 2).first().upscaled == "2_p2_jpg_2x.png"
    assert pages.lookup(flat, spark.createDataFrame([("2_p1.jpg",)], "filename string"), 2, 1).isEmpty()
    assert tuple(stats.collection_stats(table.withColumn("x", F.lit(1))).first())[:3] == (2, 4, 1)


def test_import_store_swap_and_blobs(spark, tmp_path):
    items = [{"id": 9, "z": 1, "a": "é"}, {"id": 8}]
    (tmp_path / "fav.json").write_text(json.dumps(items, ensure_ascii=False), encoding="utf-8")
    got = records.import_json_array(spark, str(tmp_path / "fav.json"))
    assert [(r.seq, r.iid, json.loads(r.raw)) for r in got.collect()] == [(1, 9, items[0]), (2, 8, items[1])] and list(json.loads(got.first().raw)) == ["id", "z", "a"]
    at = str(tmp_path / "bronze")
    records.write_bronze(got, at)
    records.swap(records.read_bronze(spark, at).filter("iid = 9"), at)
    assert records.read_bronze(spark, at).count() == 1 and records.point(records.read_bronze(spark, at), 9).count() == 1
    # one literal run of "abcd", a copy of 8 from 4 back, then literals
    block = bytes([0x44]) + b"abcd" + b"\x04\x00" + bytes([0x50]) + b"wxyz!"
    want = b"abcd" * 3 + b"wxyz!"
    assert records.plain(b"L" + len(want).to_bytes(4, "little") + block) == want and records.plain(b"{}") == b"{}"
    assert records.decode_blobs(records.encode_blobs(got)).count() == 2
    assert model.only_ids(got).select("iid").first()[0] == 9


def test_state_and_config(spark, tmp_path):
    assert state.load(spark, str(tmp_path), "not_found").isEmpty()
    for k in range(2):
        state.save(spark.createDataFrame([(f"f{k}",)], "filename string"), str(tmp_path), "not_found")
    assert state.load(spark, str(tmp_path), "not_found").first()[0] == "f1"
    (tmp_path / "c.json").write_text('{"home": "/h", "port": 1, "other": 2}')
    c = state.read_config(str(tmp_path / "c.json"), {"ORRERY_SAFE_MODE": "true", "ORRERY_PORT": "9"})
    assert (c.port, c.safe_mode, c.at("pix"), c.host) == (9, True, "/h/pix", "127.0.0.1")


def test_fill_forward_leading_null(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5), (1, 2, None)], "k int, o int, v int")
    assert [r.v for r in pages.fill_forward(df, "k", "o", "v").orderBy("o").collect()] == [0, 5, 5]


def test_flags_are_columns_too(spark):
    assert intro.SEPARATOR == "\\"
    r = sync.with_intros(bronze(spark, record(1))).first()
    assert r.is_wide and not r.is_tall and r.is_long
    assert users.primary_names(spark.createDataFrame([], "seq long, user_id long, user_name string")).isEmpty()
