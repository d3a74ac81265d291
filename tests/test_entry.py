"""Every registered query of the library against its SQL twin."""

import os

import duckdb
import pytest

from orrery.plans import catalog, record_queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id"]


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(catalog.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_filters_reach_the_scan(spark, tmp_path):
    from orrery.operators import search

    spark.createDataFrame([(1, "abc", "x")], "seq long, intro string, more string").write.parquet(str(tmp_path / "t"))
    found = search.select(spark.read.parquet(str(tmp_path / "t")), ["a"], ["q"], ordered=False).select("seq")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(intro,a)" in plan and "Not(StringContains(intro,q))" in plan and "more" not in plan
