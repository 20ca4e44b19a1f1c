import pytest

from siftwell.llm import packing, registry
from siftwell.session import table

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.count()
    assert len(df.columns) == len(set(df.columns))


def test_draws_and_shares_are_in_tokens(spark):
    small = "/root/testdata/sf0.001"
    tokens = {(r["id"], r["size"]) for r in packing.token_sizes(table(spark, small, "documents"), "doc_id", "text").collect()}
    draws = {(r["doc_id"], r["size"]) for r in QUERIES["p9_draws"](spark, small).collect()}
    assert draws and draws <= tokens
    by = {r["source"]: r["size"] for r in registry._sized(spark, small, True).groupBy("source").sum("size").withColumnRenamed("sum(size)", "size").collect()}
    shares = QUERIES["p9_shares"](spark, small).collect()
    assert all(r["size"] == by.get(r["source"], 0) for r in shares) and sum(r["size"] for r in shares) > 0


def test_shortfalls_come_from_the_draw(spark):
    plan = QUERIES["p9_found"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "Window" in plan
