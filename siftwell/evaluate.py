"""python -m siftwell.evaluate qrels FILE | dense [--rows N --dimension D --queries Q] | runtime [...]: quality and latency figures as JSON."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.chunking import ChunkOptions
from siftwell.functions.filters import matches_row
from siftwell.functions.vectors import HashEmbedder, embedded
from siftwell.operators import dense, evaluation, lexical, search
from siftwell.session import local_session, materialize
from siftwell.sources import payloads
from siftwell.sources.store import prepare


def run_qrels(spark: SparkSession, path: str, k: int = 3, dimension: int = 384) -> dict:
    """Mean recall, MRR and nDCG of each profile over a judgement file; the queries of each filter search under it, to k results, and are judged by the ranks they get."""
    docs, queries = payloads.qrels(spark, path)
    embedder = HashEmbedder(dimension)
    docs = docs.select("doc_key", F.lit(1).alias("revision"), F.lit("").alias("title"), F.col("text").alias("content"), "metadata")
    documents, chunks = prepare(docs, ChunkOptions(), embedder)
    rows = materialize(chunks.join(documents.select("doc_key", "title", "metadata"), "doc_key").withColumnsRenamed({"doc_key": "document_id", "revision": "document_revision"}), "rows")
    vectors = materialize(dense.usable_vectors(rows, "chunk_key", "embedding", dimension), "vectors")
    corpus = search.Corpus(rows, lexical.build(rows, "chunk_key", "indexed_text", "metadata"), vectors, dimension)
    q = materialize(embedded(queries, "text", embedder, "vector"), "queries")
    own = F.to_json("filter")
    kinds = [r[0] for r in q.select(own).distinct().collect()]
    out = {}
    for name, profile in search.PROFILES.items():
        ranked = None
        for kind in kinds:
            wanted = None if kind is None else matches_row(F.col("metadata"), F.from_json(F.lit(kind), q.schema["filter"].dataType))
            found = search.search(corpus, q.filter(own.eqNullSafe(F.lit(kind))).select("query_id", "text", "vector"), "hybrid", k, profile, wanted)
            ranked = found if ranked is None else ranked.unionByName(found)
        if ranked is None:
            ranked = spark.createDataFrame([], "query_id int, document_id string, rank int")
        m = evaluation.qrels_metrics(ranked, q.select("query_id", "relevant"), k)
        out[name] = m.agg(*[F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")]).first().asDict()
    return out


def run_dense(spark: SparkSession, rows: int = 25_000, dimension: int = 384, queries: int = 100, k: int = 10) -> dict:
    """Access paths (lists with a quarter of them probed, at most 64, with each codec; as built by default; exhaustive) against the exact search on generated vectors, over all rows and over a filtered subset of 101; time per query of the batch."""
    v = materialize(payloads.synthetic_vectors(spark, rows, dimension), "vectors")
    q = materialize(v.filter(F.col("key") < queries).select(F.col("key").alias("query_id"), "vector"), "queries")
    subset = v.filter(F.pmod("key", F.lit(max(1, rows // 101))) == 0)
    out = {}
    for name, vectors in (("all", v), ("filtered", subset)):
        exact, seconds = _timed(dense.batch_search(vectors, q, k, dimension))
        lists = {name: dense.InvertedLists.fit(vectors, dimension, 256, codec=codec) for name, codec in dense.CODECS.items()}
        probes = max(1, min(64, len(lists["ivf"].centroids) // 4))
        paths = {
            "exact": exact,
            **{name: built.search(q, k, probes) for name, built in lists.items()},
            "ivf_default": dense.ListIndex(vectors, dimension).search(q, k),
            "ivf_exhaustive": lists["ivf"].search(q, k, 256),
            "sq8": dense.coarse_then_exact(vectors, q, k, dimension, "sq8"),
        }
        for path, found in paths.items():
            o = evaluation.overlap(found, exact, k).first().asDict()
            gate = evaluation.GATES.get(path.removesuffix("_default"))
            out[f"{name} {path}"] = o | ({"gate": gate} if gate else {}) | ({"ms_per_query": round(seconds / queries * 1000, 4)} if path == "exact" else {})
    return out


def run_runtime(spark: SparkSession, rows: int = 25_000, dimension: int = 384, queries: int = 100, k: int = 10) -> dict:
    """Time per query with 0, 5 and 10 % of the vectors in the delta, and of folding it into the base."""
    v = materialize(payloads.synthetic_vectors(spark, rows, dimension), "vectors")
    q = materialize(v.filter(F.col("key") < queries).select(F.col("key").alias("query_id"), "vector"), "queries")
    out = {}
    for percent in (0, 5, 10):
        cut = rows - rows * percent // 100
        live = dense.tiered(v.filter(F.col("key") < cut), v.filter(F.col("key") >= cut), v.filter("key < 0").select("key"))
        _, seconds = _timed(dense.batch_search(live, q, k, dimension))
        out[f"{percent} % delta"] = {"ms_per_query": round(seconds / queries * 1000, 4)}
    began = time.perf_counter()
    materialize(live, "base")
    return out | {"compaction": {"seconds": round(time.perf_counter() - began, 3)}}


def _timed(df: DataFrame) -> tuple[DataFrame, float]:
    began = time.perf_counter()
    got = materialize(df, "results")
    return got, time.perf_counter() - began


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siftwell.evaluate")
    p.add_argument("what", choices=["qrels", "dense", "runtime"])
    p.add_argument("path", nargs="?")
    for name, value in (("rows", 25_000), ("dimension", 384), ("queries", 100), ("k", 10)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--report", help="also write the figures to this file")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    if a.what == "qrels":
        figures = run_qrels(spark, a.path, a.k, a.dimension)
    else:
        figures = (run_dense if a.what == "dense" else run_runtime)(spark, a.rows, a.dimension, a.queries, a.k)
    text = json.dumps(figures, indent=1)
    if a.report:
        with open(a.report, "w") as f:
            f.write(text)
    print(text)


if __name__ == "__main__":
    main()
