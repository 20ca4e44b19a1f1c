import pytest

from siftwell.operators import search
from siftwell.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
WITHOUT_SQL = sorted(set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(name, spark):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_ann_gates(spark):
    for r in QUERIES["ann_figures"](spark, "/root/testdata/sf0.01").collect():
        assert r["recall"] >= r["gate"]


@pytest.mark.parametrize(("name", "pools"), [("quality_search", [200]), ("pipeline_presets", [30, 200])])
def test_pools_of_the_profiles(spark, monkeypatch, name, pools):
    asked, own = [], search.candidates
    monkeypatch.setattr(search, "candidates", lambda c, q, mode, k, *rest: (asked.append(k), own(c, q, mode, k, *rest))[1])
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert asked == pools


def test_reconcile_sees_every_corpus(spark):
    got = {(r["corpus_id"], r["problem"]) for r in QUERIES["reconcile_diff"](spark, "/root/testdata/sf0.01").collect()}
    assert len({c for c, _ in got}) > 1 and {p for _, p in got} == {"extra", "gap", "conflicting"}


@pytest.mark.parametrize("name", ["tiered_merge", "tiered_candidates"])
def test_tiers_have_every_vector(spark, name):
    found = {r["vec_id"] for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    assert any(k % 2 and k % 3 for k in found) and not any(k % 7 == 0 for k in found)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
