"""Retrieval quality and latency figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least recall by access path.
GATES = {"exact": 1.0, "ivf": 0.95, "ivf_sq8": 0.93, "ivf_pq": 0.90}


def qrels_metrics(results: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, ndcg) for every query of ``relevance`` (query_id, relevant array).

    Matches count per result row by document, so recall may exceed 1; without relevant documents recall and nDCG are 1.
    ``results`` has (query_id, document_id, rank).
    """
    n = F.size("relevant")
    hits = results.filter(F.col("rank") <= k).select(F.col("query_id").alias("_q"), "document_id", "rank")
    j = relevance.join(hits, (F.col("query_id") == F.col("_q")) & F.array_contains("relevant", F.col("document_id")), "left")
    per = j.groupBy("query_id").agg(F.first(n).alias("n"), F.count("rank").alias("hits"), F.min("rank").alias("first"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n", F.lit(k)), F.lit(1))), F.lit(0.0), lambda t, i: t + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    return per.select(
        "query_id",
        F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(1.0).alias("recall"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("n") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(1.0).alias("ndcg"),
    )


def overlap(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: queries, recall (the exact nearest is among the k found), overlap (share of the exact k found)."""
    f = found.filter(F.col("rank") <= k).select("query_id", "key", F.lit(1).alias("hit"))
    e = exact.filter(F.col("rank") <= k).select("query_id", "key", "rank")
    j = e.join(f, ["query_id", "key"], "left")
    return j.agg(
        F.countDistinct("query_id").alias("queries"),
        F.avg(F.when(F.col("rank") == 1, F.coalesce("hit", F.lit(0)))).alias("recall"),
        F.avg(F.coalesce("hit", F.lit(0))).alias("overlap"),
    )


def percentiles(df: DataFrame, value: str, points: list[float], by: list[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, per group."""
    return df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(f"p{int(p * 100)}") for p in points])
