import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import search
from orrery.plans import postings


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, i * 3 % 101, "".join(rng.choices(["a", "b", "\\", "$s2", "%", "_", "界", ".*"], k=rng.randint(0, 9)))) for i in range(101)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "seq long, iid long, intro string").cache()


CASES = [(["a"], []), (["a", "b"], []), (["a"], ["b"]), ([], ["a", "%"]), (["%"], ["_"]), (["\\a"], []), (["b\\"], ["界"]), (["界"], []), ([".*"], ["a"]), (["a", "a"], []), (["a"], ["a"]), ([], [])]


@pytest.mark.parametrize("filters,bans", CASES)
def test_all_plans_agree_with_brute_force(table, rows, filters, bans):
    want = [i for s, i, t in sorted(rows, reverse=True) if all(f in t for f in filters) and not any(b in t for b in bans)]
    assert [r.iid for r in search.select(table, filters, bans).collect()] == want
    assert sorted(r.iid for r in search.select_by_sets(table, filters, bans).collect()) == sorted(want)
    assert sorted(r.iid for r in postings.select(table, postings.build(table), filters, bans).collect()) == sorted(want)
    grams = postings.build(table)
    assert sorted(r.iid for r in postings.planned(table, grams, filters, bans).collect()) == sorted(want)
    if filters:
        assert sorted(r.iid for r in search.select_by_verification(table, filters, bans).collect()) == sorted(want)


def test_postings_after_a_delta(spark, table):
    delta = spark.createDataFrame([(3, "ab界"), (500, "%"), (6, "")], "iid long, intro string")
    after = table.select("iid", "intro").join(delta, "iid", "left_anti").unionByName(delta)
    got = postings.appended(postings.build(table), delta)
    assert sorted(map(tuple, got.select("iid", "gram").collect())) == sorted(map(tuple, postings.build(after).select("iid", "gram").collect()))
    assert {g for i, g in map(tuple, got.select("iid", "gram").collect()) if i == 3} == {"a", "b", "界", "ab", "b界"}


def test_rare_terms_are_looked_up(spark):
    texts = spark.range(1000).select(F.col("id").alias("iid"), F.when(F.col("id") == 7, "abz").otherwise("ab").alias("intro"))
    plan = lambda t: postings.planned(texts, postings.build(texts), [t])._jdf.queryExecution().toString()
    assert "Join LeftSemi" in plan("z") and "Join LeftSemi" not in plan("b")


def test_stored_column_is_searched(spark):
    from orrery.plans import catalog, registry  # noqa: F401

    for name in ("select_mixed", "select_all_terms", "select_ban_only"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "StringContains(norm,the)" in plan and "Python" not in plan and "Arrow" not in plan


def test_blank_safe_and_disabled(table, rows):
    with pytest.raises(ValueError, match="blank"):
        search.select(table, [" 　"])
    assert search.select(table, ["a"], safe=True).count() == sum("a" in t and "$s2" in t for _, _, t in rows)
    assert search.select(table, ["a"], disabled=True).isEmpty() and search.select(table, disabled=True).count() == len(rows)
    assert postings.choose(1, 1000) == "postings" and postings.choose(500, 1000) == "scan"
