"""What can be exchanged: tokenizers, retrievers, rankers, stores of jobs and of generations. Any object with these methods will do."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators import dense, lexical


class Tokenizer(Protocol):
    """(keys, terms, tfs, token_count) of a text column; ``lexical.counted`` is one."""

    def __call__(self, df: DataFrame, keys: list[str], text: str) -> DataFrame: ...


class Retriever(Protocol):
    """(query_id, chunk_key, score, rank): the k best allowed chunks of each query; ``allowed`` is a condition on chunks, applied before the cut."""

    def retrieve(self, queries: DataFrame, k: int, allowed: Column | None = None) -> DataFrame: ...


class Ranker(Protocol):
    """(query_id, chunk_key, score, rank): candidates in another order."""

    def rank(self, queries: DataFrame, found: DataFrame) -> DataFrame: ...


class JobStore(Protocol):
    """A log of job snapshots; ``sources.jobs.JobLog`` is one."""

    def append(self, snapshots: DataFrame) -> None: ...

    def latest(self) -> DataFrame: ...

    def compact(self, max_jobs: int = 128, max_bytes: int = 16 << 20) -> int: ...


class Backend(Protocol):
    """Generations of a corpus; ``sources.store.Store`` is one."""

    def activate(self, documents: DataFrame, chunks: DataFrame) -> DataFrame: ...

    def erase(self, keys: DataFrame) -> DataFrame: ...

    def table(self, name: str, generation: int | None = None) -> DataFrame: ...

    def fetch(self, keys: DataFrame, text: bool = True, embedding: bool = False) -> DataFrame: ...

    def stats(self) -> DataFrame: ...


@dataclass
class LexicalRetriever:
    """BM25 over ``query_id, text``."""

    index: lexical.LexicalIndex

    def retrieve(self, queries: DataFrame, k: int, allowed: Column | None = None) -> DataFrame:
        return lexical.search(self.index, queries, "query_id", "text", k, allowed)


@dataclass
class DenseRetriever:
    """Inner products over ``query_id, vector``; ``access`` is the path of unfiltered searches, filtered ones are exact, as lists would miss some of few allowed vectors."""

    chunks: DataFrame
    vectors: DataFrame
    dimension: int
    access: dense.DenseIndex | None = None

    def retrieve(self, queries: DataFrame, k: int, allowed: Column | None = None) -> DataFrame:
        asking = queries.filter("vector IS NOT NULL")
        if allowed is None and self.access is not None:
            found = self.access.search(asking, k)
        else:
            vectors = self.vectors
            if allowed is not None:
                vectors = vectors.join(self.chunks.filter(allowed).select("chunk_key"), F.col("key") == F.col("chunk_key"), "left_semi")
            found = dense.batch_search(vectors, asking, k, self.dimension)
        return found.withColumnRenamed("key", "chunk_key")
