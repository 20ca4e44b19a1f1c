"""Merging and reordering candidate lists: reciprocal ranks, coverage, diversity, stitching, context packing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.lexical import top

RRF_K = 60.0


def rrf(lists: list[tuple[DataFrame, float]], k: float = RRF_K, top_k: int = 0) -> DataFrame:
    """(query_id, chunk_key, score, rank): weighted reciprocal-rank fusion of lists with (query_id, chunk_key, rank).

    Lists of a negative or non-finite weight are left out; an invalid k gives no rows; ``top_k`` 0 keeps all.
    """
    used = [d.select("query_id", "chunk_key", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for d, w in lists if np.isfinite(w) and w >= 0]
    if not used or not np.isfinite(k) or k < 0:
        return lists[0][0].select("query_id", "chunk_key", F.lit(0.0).alias("score"), "rank").limit(0)
    every = reduce(DataFrame.unionByName, used)
    return top(every.groupBy("query_id", "chunk_key").agg(F.round(F.sum("part"), 12).alias("score")), top_k or 2_147_483_647)


def term_overlap(query_terms: Column, terms: Column) -> Column:
    """The share of the distinct query terms among the terms."""
    q = F.array_distinct(query_terms)
    return F.size(F.array_intersect(q, terms)) / F.size(q)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct terms; 0 if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def coverage_rerank(candidates: DataFrame, coverage: Column, has_terms: Column) -> DataFrame:
    """0.6 of the score, stretched to [0, 1] within the query's pool, and 0.4 of the coverage; queries without terms keep score and order.

    A pool of (nearly) equal scores counts as 1 each.
    """
    pool = Window.partitionBy("query_id")
    low, high = F.min("score").over(pool), F.max("score").over(pool)
    base = F.when(high - low > 1e-9, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    scored = candidates.withColumn("_new", F.when(has_terms, F.round(0.6 * base + 0.4 * coverage, 9)).otherwise(F.col("score")))
    return top(scored.drop("score").withColumnRenamed("_new", "score"), 2_147_483_647)


def _mmr(frame: pd.DataFrame, k: int, lam: float) -> pd.DataFrame:
    frame = frame.sort_values("rank")
    if not len(frame):
        return frame
    relevance = frame["score"].to_numpy(float)
    span = np.ptp(relevance) if len(relevance) else 0.0
    relevance = (relevance - relevance.min()) / (span if span > 1e-9 else 1.0)
    vectors = frame["embedding"].tolist()
    if all(v is not None and len(v) for v in vectors):
        m = np.array(vectors, float)
        sims = m @ m.T
    else:
        sets = [set(t) for t in frame["terms"]]
        number = {w: i for i, w in enumerate(set().union(*sets))}
        has = np.zeros((len(sets), len(number)))
        for i, own in enumerate(sets):
            has[i, [number[w] for w in own]] = 1
        shared, size = has @ has.T, has.sum(axis=1)
        union = size[:, None] + size - shared
        sims = np.where(union > 0, shared / np.maximum(union, 1), 0.0)
    worst, left, chosen = np.zeros(len(frame)), np.ones(len(frame), bool), []
    while left.any() and len(chosen) < k:
        value = np.where(left, lam * relevance - (1 - lam) * worst, -np.inf)
        i = int(np.argmax(value))
        chosen.append(i)
        left[i] = False
        worst = np.maximum(worst, sims[i])
    out = frame.iloc[chosen].copy()
    out["rank"] = np.arange(1, len(out) + 1, dtype="int32")
    return out


def mmr(candidates: DataFrame, k: int, lam: float = 0.5) -> DataFrame:
    """Maximal marginal relevance per query; pools are bounded by the search's pool. Candidates have (query_id, rank, score, embedding, terms).

    The rank is the order of choice; scores stay. Without all embeddings the overlap of terms is the similarity.
    """
    return candidates.groupBy("query_id").applyInPandas(lambda f: _mmr(f, k, lam), candidates.schema)


def _stitch(frame: pd.DataFrame, max_gap: int) -> pd.DataFrame:
    frame = frame.sort_values("rank").reset_index(drop=True)
    keep = np.ones(len(frame), bool)
    doc = list(zip(frame["document_id"], frame["document_revision"], strict=True))
    start, end = frame["start_line"].to_numpy(), frame["end_line"].to_numpy()
    for i in range(len(frame)):
        if keep[i]:
            for j in range(i + 1, len(frame)):
                if keep[j] and doc[i] == doc[j] and max(start[j] - end[i], start[i] - end[j], 0) <= max_gap:
                    keep[j] = False
    out = frame[keep].copy()
    out["rank"] = np.arange(1, len(out) + 1, dtype="int32")
    return out


def stitch(candidates: DataFrame, max_gap: int = 1) -> DataFrame:
    """Drops candidates that adjoin a better one of the same document revision (line gap up to ``max_gap``); dropped ones drop nothing."""
    return candidates.groupBy("query_id").applyInPandas(lambda f: _stitch(f, max_gap), candidates.schema)


def packed_context(results: DataFrame, tokens: Column, budget: int) -> DataFrame:
    """The results, in rank order, that fit into the budget; the first one that does not ends the list."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("tokens", tokens).withColumn("used", F.sum("tokens").over(w)).filter(F.col("used") <= budget)

