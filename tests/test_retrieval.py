import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell import evaluate
from siftwell.errors import EngineError
from siftwell.operators import dense, evaluation, fusion, lexical, search
from siftwell.operators.protocols import LexicalRetriever
from siftwell.plans import retrieval
from siftwell.sources import payloads
from tests.conftest import rows

CORPUS = [("c1", "docs/north", 1, 0, 0, "alpha orchard", "north"), ("c2", "docs/north", 1, 1, 1, "shared guide", "north"), ("c3", "docs/south", 1, 0, 0, "alpha harbor", "south")]


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame(CORPUS, "chunk_key string, document_id string, document_revision long, start_line int, end_line int, text string, tenant string")
    df = df.select("*", F.create_map(F.lit("tenant"), "tenant").alias("metadata"), F.lit("").alias("context"), F.lit("t").alias("title"))
    return search.Corpus(df, lexical.build(df, "chunk_key", "text", "metadata"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_bm25_and_multiset(spark, corpus):
    got = rows(lexical.search(corpus.index, asked(spark, "alpha alpha shared"), "query_id", "text", 10))
    assert [(r[1], round(r[2], 6)) for r in sorted(got, key=lambda r: r[3])] == [("c2", 0.980829), ("c1", 0.940007), ("c3", 0.940007)]


def test_filter_before_truncation(spark, corpus):
    from siftwell.functions.filters import MetadataFilter

    q = asked(spark, "alpha")
    for wanted, expected in (({"tenant": "north"}, ["c1"]), ({"tenant": ["south", "north", "north"]}, ["c1", "c3"]), ({"tenant": []}, []), ({}, [])):
        got = lexical.search(corpus.index, q, "query_id", "text", 1 if expected == ["c1"] else 10, corpus.allowed(MetadataFilter(wanted)))
        assert sorted(r["chunk_key"] for r in got.collect()) == expected


def test_search_without_terms_and_errors(spark, corpus):
    got = search.search(corpus, asked(spark, "the of", "", "zebra", "alpha"), "lexical", 2)
    assert {r["query_id"] for r in got.collect()} == {3}
    for mode, k in (("none", 5), ("lexical", 0), ("lexical", 101)):
        with pytest.raises(EngineError):
            search.search(corpus, asked(spark, "alpha"), mode, k)
    with pytest.raises(EngineError):
        search.search(corpus, asked(spark, "alpha"), "dense", 3)


def test_fallback_to_lexical(spark, corpus):
    trace = search.Trace()

    def broken(_):
        raise ValueError("no model")

    assert search.with_fallback(corpus, asked(spark, "alpha"), broken, 3, trace).count() == 2
    assert any("lexical only" in n for n in trace.notes)


def test_rrf(spark):
    a = spark.createDataFrame([(1, 2, 1), (1, 1, 2)], "query_id int, chunk_key int, rank int")
    b = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id int, chunk_key int, rank int")
    got = sorted(fusion.rrf([(a, 1.0), (b, 1.0)]).collect(), key=lambda r: r["rank"])
    assert [r["chunk_key"] for r in got] == [1, 2] and all(math.isclose(r["score"], 0.032522475, abs_tol=1e-8) for r in got)
    assert [r["chunk_key"] for r in fusion.rrf([(a, 1.0), (b, -1.0)], top_k=1).collect()] == [2]
    assert fusion.rrf([(a, float("nan"))]).count() == 0 and fusion.rrf([(a, 1.0)], k=float("inf")).count() == 0


def test_mmr_and_stitch(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1, [1.0, 0.0], ["x"]), (1, "b", 0.99, 2, [1.0, 0.0], ["x"]), (1, "c", 0.5, 3, [0.0, 1.0], ["y"])], "query_id int, chunk_key string, score double, rank int, embedding array<float>, terms array<string>")
    order = lambda d: [r["chunk_key"] for r in sorted(d.collect(), key=lambda r: r["rank"])]
    assert order(fusion.mmr(df, 2)) == ["a", "c"] or order(fusion.mmr(df, 2)) == ["a", "b"]
    assert order(fusion.mmr(df, 3, 0.1)) == ["a", "c", "b"]
    assert order(fusion.mmr(df.withColumn("embedding", F.lit(None).cast("array<float>")), 3, 0.1)) == ["a", "c", "b"]
    lines = spark.createDataFrame([(1, "a", 1, "d", 1, 0, 4), (1, "b", 2, "d", 1, 5, 6), (1, "c", 3, "d", 1, 8, 9), (1, "e", 4, "f", 1, 0, 4), (1, "g", 5, "d", 2, 0, 4)], "query_id int, chunk_key string, rank int, document_id string, document_revision int, start_line int, end_line int")
    assert order(fusion.stitch(lines)) == ["a", "c", "e", "g"]


def circle(spark, n=128):
    return spark.createDataFrame([(i, [math.cos(i * 2 * math.pi / n), math.sin(i * 2 * math.pi / n)]) for i in range(n)], "key int, vector array<float>")


def test_dense_exact(spark):
    v = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [1.0, 0.0]), ("c", [0.6, 0.8])], "key string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    got = sorted(dense.batch_search(v, q, 2, 2).collect(), key=lambda r: r["rank"])
    assert [r["key"] for r in got] == ["a", "c"]
    got = sorted(dense.batch_search(v.filter("key <> 'a'"), q, 5, 2).collect(), key=lambda r: r["rank"])
    assert [r["key"] for r in got] == ["c", "b"]
    assert dense.batch_search(v.limit(0), q, 2, 2).count() == 0 and dense.batch_search(v, q.limit(0), 2, 2).count() == 0


def test_tiers(spark):
    base = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "key string, vector array<float>")
    delta = spark.createDataFrame([("c", [0.8, 0.6])], "key string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    live = dense.tiered(base, delta, base.filter("key = 'a'").select("key"))
    assert [r["key"] for r in sorted(dense.batch_search(live, q, 5, 2).collect(), key=lambda r: r["rank"])] == ["c", "b"]
    stats = dense.index_stats(live, 2).first()
    assert (stats["vectors"], stats["bytes"]) == (2, 16)


@pytest.mark.parametrize("path", ["ivf", "sq8", "signs", "prefix", "pq"])
def test_access_paths_against_exact(spark, path):
    v = payloads.synthetic_vectors(spark, 600, 16).cache()
    q = v.filter("key < 20").select(F.col("key").alias("query_id"), "vector")
    exact = dense.batch_search(v, q, 10, 16)
    if path == "ivf":
        found = dense.InvertedLists.fit(v, 16, 8).search(q, 10, 8)
    else:
        m = np.array([r["vector"] for r in v.collect()], np.float32)
        pq = dense.ProductQuantizer.fit(m, 4, 32, 8)
        assert pq.decode(pq.encode(m)).shape == m.shape
        found = dense.coarse_then_exact(v, q, 10, 16, path, pool=600 if path == "prefix" else 200, quantizer=pq, prefix=8)
    o = evaluation.overlap(found, exact, 10).first()
    assert o["recall"] == 1.0 and o["overlap"] >= 0.9


def test_filtered_search_is_complete(spark):
    v = circle(spark).filter("key IN (73, 91, 117)")
    q = spark.createDataFrame([(1, [math.cos(73 * 2 * math.pi / 128), math.sin(73 * 2 * math.pi / 128)])], "query_id int, vector array<float>")
    got = sorted(dense.InvertedLists.fit(v, 2, 3).search(q, 10, 3).collect(), key=lambda r: r["rank"])
    assert len(got) == 3 and got[0]["key"] == 73


def test_algorithm_policy():
    assert dense.resolve_algorithm(1999) == "exact" and dense.resolve_algorithm(2000) == "ivf" and dense.resolve_algorithm(5, "ivf_pq") == "ivf_pq"
    with pytest.raises(EngineError):
        dense.resolve_algorithm(5, "tree")


def test_qrels_metrics(spark):
    found = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "a", 3), (2, "x", 1)], "query_id int, document_id string, rank int")
    wanted = spark.createDataFrame([(1, ["a"]), (2, ["q", "r"]), (3, [])], "query_id int, relevant array<string>")
    got = {r["query_id"]: (r["recall"], r["mrr"], round(r["ndcg"], 6)) for r in evaluation.qrels_metrics(found, wanted, 3).collect()}
    assert got == {1: (2.0, 1.0, 1.5), 2: (0.0, 0.0, 0.0), 3: (1.0, 0.0, 1.0)}


def test_context_packing(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1)], "query_id int, rank int, n int")
    assert [r["rank"] for r in fusion.packed_context(df, F.col("n"), 10).collect()] == [1]


def test_payloads(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"id": "a", "title": "T", "content": "x", "metadata": {"k": "v"}}\n{"id": "", "content": "x"}\nnot json\n{"id": "b"}\n')
    got = {r["doc_key"]: r["fault"] for r in payloads.documents(spark, str(tmp_path / "d.json")).collect()}
    assert got == {"a": None, "": "id", None: "json", "b": "content"}
    assert payloads.search_request('{"query": "q"}')["top_k"] == 8
    for bad in ("[]", "x", '{"query": " "}', '{"query": "q", "top_k": 101}', '{"query": "q", "mode": "z"}', '{"query": "q", "filter": {"a": 1}}'):
        with pytest.raises(EngineError):
            payloads.search_request(bad)
    (tmp_path / "q.json").write_text('{"documents": [{"id": "a", "text": "t", "metadata": {"s": "g"}}], "queries": [{"text": "q", "relevant": ["a"], "filter": {"s": ["g"]}}]}')
    docs, queries = payloads.qrels(spark, str(tmp_path / "q.json"))
    assert docs.count() == 1 and queries.first()["relevant"] == ["a"]
    r = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, rank int, chunk_id string")
    assert payloads.results_json(r).first()["body"] == '{"results":[{"rank":1,"chunk_id":"a"},{"rank":2,"chunk_id":"b"}]}'


@pytest.mark.parametrize("wanted", ["exact", "ivf", "ivf_sq8", "ivf_pq", "auto"])
def test_built_indexes(spark, wanted):
    v = payloads.synthetic_vectors(spark, 400, 16).cache()
    q = v.filter("key < 10").select(F.col("key").alias("query_id"), "vector")
    index = dense.build_index(v, 16, wanted, **({} if wanted in ("exact", "auto") else {"lists_": 8, "probes": 8}))
    assert index.stats().first()["vectors"] == 400
    exact = dense.batch_search(v, q, 5, 16)
    assert evaluation.overlap(index.search(q, 5), exact, 5).first()["recall"] == 1.0
    few = index.search(q, 5, v.filter("key IN (3, 7)").select("key"))
    assert few.groupBy("query_id").count().filter("count <> 2").count() == 0


def test_any_column_filters(spark, corpus):
    got = search.search(corpus, asked(spark, "alpha"), "lexical", 5, wanted=F.col("metadata")["tenant"] != "north")
    assert [r["chunk_key"] for r in got.collect()] == ["c3"]
    with pytest.raises(EngineError):
        search.PROFILES["balanced"].overridden(lam=2.0)


def test_lists_lose_little(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(80, 16))[r.integers(80, size=4020)] + r.normal(scale=0.25, size=(4020, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    every = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "key long, vector array<float>").cache()
    v, q = every.filter("key >= 20"), every.filter("key < 20").select(F.col("key").alias("query_id"), "vector")
    exact = dense.batch_search(v, q, 10, 16)
    for codec in ("flat", "sq8", "pq"):
        o = evaluation.overlap(dense.InvertedLists.fit(v, 16, 16, codec=codec).search(q, 10, 4, 40), exact, 10).first()
        assert o["recall"] >= evaluation.GATES[{"flat": "ivf"}.get(codec, f"ivf_{codec}")] and o["overlap"] >= 0.8
    o = evaluation.overlap(dense.build_index(v, 16).search(q, 10), exact, 10).first()
    assert o["recall"] >= evaluation.GATES["ivf"] and o["overlap"] >= 0.8


def test_gates_measure_probed_lists(spark, monkeypatch):
    used, own = [], dense.InvertedLists.search

    def search_(self, q, k, probes=16, *rest):
        used.append((len(self.centroids), probes, self.codec))
        return own(self, q, k, probes, *rest)

    monkeypatch.setattr(dense.InvertedLists, "search", search_)
    paths = {r["path"] for r in retrieval.ann_figures(spark, "/root/testdata/sf0.01").collect()}
    assert paths == {*evaluation.GATES, "ivf_default"}
    assert {(c, p) for n, p, c in used if p < n} == {("flat", 16), ("sq8", 16), ("pq", 16)} and (256, 16, "flat") in used
    used.clear()
    figures = evaluate.run_dense(spark, 2000, 32, 20)
    assert {c for n, p, c in used if p < n} == {"flat", "sq8", "pq"} and figures["all ivf_pq"]["gate"] == evaluation.GATES["ivf_pq"]


def test_lists_are_kept_and_pruned(spark, tmp_path):
    v = payloads.synthetic_vectors(spark, 800, 16).cache()
    q = v.filter("key < 7").select(F.col("key").alias("query_id"), "vector")
    for codec in ("flat", "sq8", "pq"):
        made = dense.InvertedLists.fit(v, 16, 20, codec=codec, path=f"{tmp_path}/{codec}")
        again = dense.InvertedLists.read(spark, f"{tmp_path}/{codec}")
        assert rows(made.search(q, 5, 3, 50)) == rows(again.search(q, 5, 3, 50))
    one = q.filter("query_id = 3")
    plan = dense.InvertedLists.read(spark, f"{tmp_path}/flat").search(one, 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan
    assert made.search(q.limit(0), 5, 2).count() == 0


def test_one_usable_vector_of_several(spark):
    df = spark.createDataFrame([(1, [9.0, 9.0]), (1, [0.6, 0.8]), (1, None), (2, [1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0])], "k long, v array<float>")
    assert [(a, [round(x, 3) for x in b]) for a, b in rows(dense.usable_vectors(df, "k", "v", 2))] == [(1, [0.6, 0.8]), (3, [1.0, 0.0])]


def test_many_queries_in_bounded_blocks(spark, monkeypatch):
    """70,000 queries: matrices stay bounded, results are those of few queries."""
    from siftwell.operators import blocks

    v = payloads.synthetic_vectors(spark, 400, 8).cache()
    q = payloads.synthetic_vectors(spark, 70_000, 8, seed=5).withColumnRenamed("key", "query_id").cache()
    uneven = v.filter("key < 3").coalesce(1).unionByName(v.filter("key >= 3").coalesce(1)).coalesce(1)  # batches of several sizes in one task
    got = dense.batch_search(uneven, q, 3, 8).filter("query_id < 20")
    assert rows(got) == rows(dense.batch_search(v, q.filter("query_id < 20"), 3, 8))
    assert blocks.CELLS * 8 <= 64 << 20


@pytest.mark.parametrize("rows_a_batch", [7, 1000])
def test_batches_of_any_size(spark, rows_a_batch):
    """More queries than a step takes, batches of uneven sizes."""
    v = payloads.synthetic_vectors(spark, 900, 8, partitions=2).cache()
    q = v.withColumnRenamed("key", "query_id")
    m = np.array([r["vector"] for r in v.orderBy("key").collect()])
    want = {(i, int(k)) for i in range(900) for k in np.argsort(-(m[i] @ m.T), kind="stable")[:3]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        for found in (dense.batch_search(v, q, 3, 8), dense.coarse_then_exact(v, q, 3, 8, "prefix", 900, prefix=8), dense.coded_products(v, q, 3, 8, "cosine"), dense.InvertedLists.fit(v, 8, 5).search(q, 3, 5)):
            assert {(r["query_id"], r["key"]) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_across_batches(spark):
    df = spark.createDataFrame([(f"k{i:03d}", [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(100)], "key string, vector array<float>").repartition(7)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = sorted(dense.batch_search(df, q, 4, 2).collect(), key=lambda r: r["rank"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["key"] for r in got] == ["k001", "k002", "k004", "k005"]


@pytest.mark.parametrize("stem", [False, True])
def test_both_ways_of_lexical_search_agree(spark, stem, tmp_path):
    import random

    r = random.Random(4)
    words = [f"word{i}" for i in range(60)] + ["caches", "caching", "the", ""]
    df = spark.createDataFrame([(f"c{i:03d}", " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for i in range(300)] + [("long", "alpha " * 50_000), ("null", None)], "chunk_key string, text string")
    index = lexical.build(df, "chunk_key", "text", options=lexical.TokenOptions(stem=stem))
    q = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(8))) for i in range(40)] + [(99, "alpha alpha"), (100, None), (101, "nowhere")], "query_id int, text string")
    w = lexical.weighted(index, lexical.query_terms(q, "query_id", "text", index.options))
    one = rows(lexical.top(lexical.best_by_blocks(index, w, 7), 7))
    assert one == rows(lexical.top(lexical.scores(index, w), 7)) and len(one) > 100
    index.write(f"{tmp_path}/index")
    again = lexical.LexicalIndex.read(spark, f"{tmp_path}/index")
    assert rows(lexical.search(again, q, "query_id", "text", 7)) == rows(lexical.search(index, q, "query_id", "text", 7)) == one
    single = q.filter("query_id = 99")
    plan = lexical.search(again, single, "query_id", "text", 3)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)


def test_a_missing_chunk_is_an_error(spark, corpus):
    found = spark.createDataFrame([(1, 1, 0.5, "no such chunk")], "query_id int, rank int, score double, chunk_key string")
    with pytest.raises(Exception, match="corrupt_index"):
        search.resolved(corpus, found).collect()


def test_other_retrievers_can_be_fused(spark, corpus):
    class Fixed:
        def retrieve(self, queries, k, allowed=None):
            return queries.select("query_id", F.lit("c3").alias("chunk_key"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    got = search.retrieved([(LexicalRetriever(corpus.index), 1.0), (Fixed(), 5.0)], asked(spark, "alpha"), 5)
    assert sorted(got.collect(), key=lambda r: r["rank"])[0]["chunk_key"] == "c3"


def test_perturbed_queries(spark):
    v = payloads.synthetic_vectors(spark, 200, 16).cache()
    q = payloads.perturbed_queries(v, 9)
    assert q.count() == 9 and rows(q) == rows(payloads.perturbed_queries(v.repartition(3), 9))
    found = dense.batch_search(v, q, 1, 16).collect()
    assert all(r["key"] == r["query_id"] and 0.99 < r["score"] < 1 for r in found)


def test_supplied_vectors(spark):
    from siftwell.functions.vectors import with_supplied

    v = spark.createDataFrame([("a", [1.0, 0.0])], "text string, vector array<float>")
    df = spark.createDataFrame([(1, "a"), (2, "a")], "i int, t string")
    assert rows(with_supplied(df, "t", v)) == [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0])]
    with pytest.raises(Exception, match="no vector for b"):
        with_supplied(spark.createDataFrame([(1, "b")], "i int, t string"), "t", v).collect()


def test_pooled_pairs_are_what_the_coarse_search_finds(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[450:] = x[:450]  # every vector twice: ties at the edges of pools and lists
    v = dense.materialize(spark.createDataFrame([(i * 7 % 900, a.tolist()) for i, a in enumerate(x)], "key long, vector array<float>").repartition(3, "key"), "v")
    q = v.filter("key % 4 = 0").select(F.col("key").alias("query_id"), "vector")
    exact = dense.materialize(dense.batch_search(v, q, 10, 16), "exact")
    paths = {"sq8": {"pool": 11}, "signs": {"pool": 20}, "prefix": {"pool": 30, "prefix": 8}, "pq": {"pool": 15, "quantizer": dense.ProductQuantizer.fit(x[:450].astype(np.float32), 4, 16)}}
    got = {(r["path"], r["query_id"], r["key"]) for r in dense.pooled(v, q, exact, 16, paths).collect()}
    near = {(r["query_id"], r["key"]) for r in exact.collect()}
    for name, o in paths.items():
        found = {(r["query_id"], r["key"]) for r in dense.coarse_then_exact(v, q, 10, 16, name, **o).collect()}
        own = {p[1:] for p in got if p[0] == name}
        assert own == found & near and (name == "sq8" or 0 < len(own) < len(near))


@pytest.mark.parametrize("columns", [5, 200, 3000])
def test_edge_of_the_best_by_groups(columns):
    s = np.random.default_rng(1).integers(0, 400, (20, columns)).astype(np.float32)
    for k in (1, 5, 10):
        if k < columns:
            edge = dense.kth_at_least(s, k)
            assert ((s >= edge[:, None]).sum(axis=1) >= k).all()


def test_gates_of_codes_do_not_rescore_every_pool(spark, monkeypatch):
    monkeypatch.setattr(dense, "coarse_then_exact", lambda *a, **o: pytest.fail("every pool of every slice is scored"))
    assert sorted(tuple(r) for r in retrieval.rescored_gates(spark, "/root/testdata/sf0.001").collect()) == [(n, True) for n in ("pq", "prefix", "signs", "sq8")]


def test_a_block_of_queries_is_as_large_as_its_terms():
    import pickle

    import pyarrow as pa

    n = 20_000
    t = pa.table({"query_id": pa.array(range(n)), "term": pa.array([f"w{i}" for i in range(n)]), "qweight": pa.array(np.ones(n))})
    assert len(pickle.dumps(lexical._block(t, 10_000))) < 60 * n


def test_presets_run_one_after_another(spark, monkeypatch):
    written, own = [], retrieval.fresh_path
    monkeypatch.setattr(retrieval, "fresh_path", lambda s, name: (written.append(name), own(s, name))[1])
    got = retrieval.pipeline_presets(spark, "/root/testdata/sf0.001")
    assert written == ["preset"] * 4 and {r[0] for r in got.select("preset").distinct().collect()} == {"standard", "context", "quality", "quality_context"}


def test_mmr_by_terms_against_sets():
    import pandas as pd

    rng = np.random.default_rng(2)
    terms = [[f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 9))] for _ in range(200)]
    frame = pd.DataFrame({"rank": range(1, 201), "score": np.linspace(1, 0, 200), "embedding": [None] * 200, "terms": terms})
    sets, worst, expected = [set(t) for t in terms], np.zeros(200), []
    relevance = np.linspace(1, 0, 200)
    while len(expected) < 50:
        value = [-np.inf if i in expected else 0.5 * relevance[i] - 0.5 * worst[i] for i in range(200)]
        expected.append(int(np.argmax(value)))
        a = sets[expected[-1]]
        worst = np.maximum(worst, [len(a & b) / len(a | b) if a | b else 0.0 for b in sets])
    assert (fusion._mmr(frame, 50, 0.5)["rank"].tolist(), [r - 1 for r in fusion._mmr(frame.assign(own=frame["rank"]), 50, 0.5)["own"]]) == (list(range(1, 51)), expected)
