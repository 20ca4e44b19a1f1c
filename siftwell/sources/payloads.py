"""Service payloads: documents in, results out; relevance judgements; synthetic vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import MAX_TOP_K, EngineError
from siftwell.functions.filters import MetadataFilter, tag_fault

DOCUMENT_JSON = "id string, content_type string, title string, content string, metadata map<string,string>, _corrupt_record string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, title, content, metadata, fault) of JSON documents, a line each; faults stay as rows."""
    raw = spark.read.schema(DOCUMENT_JSON).json(path)
    bad_id = F.col("id").isNull() | (F.col("id") == "") | F.col("id").rlike(r"[\x00-\x1f\x7f]")
    fault = F.when(F.col("_corrupt_record").isNotNull(), "json").when(bad_id, "id").when(F.col("content").isNull(), "content").otherwise(tag_fault(F.col("metadata")))
    return raw.select(F.col("id").alias("doc_key"), F.coalesce("title", F.lit("")).alias("title"), "content", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), fault.alias("fault"))


def search_request(body: str) -> dict:
    """A checked search request: query, mode, top_k, filter."""
    try:
        r = json.loads(body)
    except ValueError as e:
        raise EngineError("invalid_argument", "not JSON") from e
    if not isinstance(r, dict) or not isinstance(r.get("query"), str) or not r["query"].strip():
        raise EngineError("invalid_argument", "query is missing")
    top_k = r.get("top_k", 8)
    if not isinstance(top_k, int) or isinstance(top_k, bool) or not 1 <= top_k <= MAX_TOP_K:
        raise EngineError("invalid_argument", f"top_k must be 1 to {MAX_TOP_K}")
    if r.get("mode", "hybrid") not in ("hybrid", "lexical", "dense"):
        raise EngineError("invalid_argument", "unknown mode")
    return {"query": r["query"], "mode": r.get("mode", "hybrid"), "top_k": top_k, "filter": MetadataFilter(r["filter"]) if "filter" in r else None}


def results_json(results: DataFrame) -> DataFrame:
    """(query_id, body): the results of each query as one JSON array in rank order."""
    columns = [c for c in results.columns if c != "query_id"]
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in columns if c != "rank"])), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("results"))
    return rows.select("query_id", F.to_json(F.struct("results")).alias("body"))


def qrels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of a judgement file: documents (doc_key, text, metadata), queries (query_id, text, relevant, filter)."""
    schema = "documents array<struct<id:string,text:string,metadata:map<string,string>>>, queries array<struct<text:string,relevant:array<string>,filter:map<string,array<string>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    docs = raw.select(F.explode("documents").alias("d")).select(F.col("d.id").alias("doc_key"), "d.text", "d.metadata")
    return docs, raw.select(F.posexplode("queries").alias("query_id", "q")).select("query_id", "q.text", "q.relevant", "q.filter")


def synthetic_vectors(spark: SparkSession, rows: int, dimension: int, seed: int = 7814435183056219185, partitions: int = 8) -> DataFrame:
    """(key, vector): unit vectors from a xorshift64* generator, each row from a state of its own, so any partitioning gives the same rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["id"].to_numpy(np.uint64)
            with np.errstate(over="ignore"):
                state = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed)
                out = np.empty((len(ids), dimension))
                for j in range(dimension):
                    state ^= state >> np.uint64(12)
                    state ^= state << np.uint64(25)
                    state ^= state >> np.uint64(27)
                    out[:, j] = (state * np.uint64(2685821657736338717) >> np.uint64(11)).astype(float) / (1 << 53) * 2 - 1
            out /= np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.DataFrame({"key": f["id"], "vector": list(out.astype(np.float32))})

    return spark.range(0, rows, 1, partitions).mapInPandas(run, "key bigint, vector array<float>")


def perturbed_queries(vectors: DataFrame, queries: int, noise: float = 0.05, seed: int = 11) -> DataFrame:
    """(query_id, vector): the vectors of the keys under ``queries``, each moved by noise of that length and made a unit vector again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, v in zip(f["key"], f["vector"], strict=True):
                step = np.random.default_rng([seed, int(key)]).normal(size=len(v))
                moved = v + noise * step / np.linalg.norm(step)
                out.append((moved / np.linalg.norm(moved)).astype(np.float32))
            yield pd.DataFrame({"query_id": f["key"], "vector": out})

    return vectors.filter(F.col("key") < queries).select("key", "vector").mapInPandas(run, "query_id bigint, vector array<float>")
