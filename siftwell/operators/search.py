"""Batch search: candidates, fusion, reranking, diversity, stitching, projection, composed from the single operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.errors import MAX_TOP_K, EngineError
from siftwell.functions.filters import MetadataFilter
from siftwell.functions.text import tokens
from siftwell.operators import dense, fusion, lexical
from siftwell.operators.protocols import DenseRetriever, LexicalRetriever, Retriever
from siftwell.session import materialize

MODES = ("hybrid", "lexical", "dense")


@dataclass(frozen=True)
class Profile:
    """How many candidates each retriever gives, and whether results are diversified and stitched."""

    name: str
    factor: int
    least: int
    quality: bool = False
    lam: float = 0.5
    max_gap: int = 1
    rrf_k: float = 60.0
    lexical_weight: float = 1.0
    dense_weight: float = 1.0

    def __post_init__(self):
        if self.factor < 1 or self.least < 1 or not 0 <= self.lam <= 1:
            raise EngineError("invalid_argument", f"profile {self.name}")

    def pool(self, top_k: int) -> int:
        return max(self.factor * top_k, self.least)

    def overridden(self, **changes) -> Profile:
        return replace(self, **changes)


#: The profiles.
PROFILES = {"efficiency": Profile("efficiency", 3, 24), "balanced": Profile("balanced", 6, 60), "quality": Profile("quality", 20, 200, True)}


@dataclass
class Corpus:
    """One generation, indexed. ``chunks`` has one row per chunk_key with document_id, document_revision, lines, title, metadata, text, context."""

    chunks: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame | None = None  # key, vector
    dimension: int = 0
    dense: dense.DenseIndex | None = None  # the access path of unfiltered dense searches; without one they are exact

    def allowed(self, wanted: MetadataFilter | Column | None) -> Column | None:
        """A filter as a condition on ``chunks``; any boolean Column over them is a filter too."""
        return wanted.column(F.col("metadata")) if isinstance(wanted, MetadataFilter) else wanted


@dataclass
class Trace:
    """What a search did, stage by stage."""

    notes: list[str] = field(default_factory=list)

    def add(self, note: str) -> None:
        self.notes.append(note)


def candidates(corpus: Corpus, queries: DataFrame, mode: str, k: int, wanted: MetadataFilter | Column | None, profile: Profile) -> DataFrame:
    """(query_id, chunk_key, score, rank) of one retriever or of both fused; filters apply before any truncation."""
    if mode in ("hybrid", "dense") and corpus.vectors is None:
        raise EngineError("unsupported", "the corpus has no vectors")
    both = [("lexical", LexicalRetriever(corpus.index), profile.lexical_weight), ("dense", DenseRetriever(corpus.chunks, corpus.vectors, corpus.dimension, corpus.dense), profile.dense_weight)]
    return retrieved([(r, w) for name, r, w in both if mode in (name, "hybrid")], queries, k, corpus.allowed(wanted), profile.rrf_k)


def retrieved(retrievers: list[tuple[Retriever, float]], queries: DataFrame, k: int, allowed: Column | None = None, rrf_k: float = fusion.RRF_K) -> DataFrame:
    """The candidates of any retrievers, fused by reciprocal ranks if there are several."""
    lists = [(r.retrieve(queries, k, allowed), w) for r, w in retrievers]
    return lists[0][0] if len(lists) == 1 else fusion.rrf(lists, rrf_k, k)


def reranked(corpus: Corpus, queries: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates with the coverage of the query's terms blended in. Terms of candidates are looked up in the index."""
    terms = lexical.query_terms(queries, "query_id", "text", corpus.index.options)
    share = lexical.coverage(corpus.index, terms, found)
    j = found.drop("rank").join(share, ["query_id", "chunk_key"], "left")
    return fusion.coverage_rerank(j, F.coalesce("coverage", F.lit(0.0)), F.col("coverage").isNotNull()).drop("coverage")


def diversified(corpus: Corpus, found: DataFrame, k: int, profile: Profile) -> DataFrame:
    """MMR to k, then stitching; the result may have fewer than k rows.

    Terms are only needed by queries of which some candidate has no vector, so only those candidates' texts are read. The wide columns
    are joined last, by chunk, and shuffled once, by query.
    """
    found = materialize(found.select("query_id", "chunk_key", "score", "rank"), "ranked")
    lines = corpus.chunks.select("chunk_key", "document_id", "document_revision", "start_line", "end_line")
    rows, bare = found, found
    if corpus.vectors is not None:
        bare = found.join(corpus.vectors.select(F.col("key").alias("_v")), F.col("chunk_key") == F.col("_v"), "left_anti")
    bare = materialize(bare.select(F.col("query_id").alias("_q")).distinct(), "bare")
    if bare.isEmpty():
        rows = rows.withColumn("terms", F.lit(None).cast("array<string>"))
    else:
        terms = found.join(bare, F.col("query_id") == F.col("_q"), "left_semi").select("query_id", "chunk_key").join(corpus.chunks.select("chunk_key", tokens(F.col("text"), drop_stopwords=corpus.index.options.drop_stopwords).alias("terms")), "chunk_key")
        rows = rows.join(terms, ["query_id", "chunk_key"], "left")
    rows = rows.join(lines, "chunk_key")
    if corpus.vectors is not None:
        rows = rows.join(corpus.vectors.select(F.col("key").alias("chunk_key"), F.col("vector").alias("embedding")), "chunk_key", "left")
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    return fusion.stitch(fusion.mmr(rows, k, profile.lam), profile.max_gap).select("query_id", "chunk_key", "score", "rank")


def search(corpus: Corpus, queries: DataFrame, mode: str = "hybrid", top_k: int = 10, profile: str | Profile = "balanced", wanted: MetadataFilter | Column | None = None, pool: int | None = None, trace: Trace | None = None) -> DataFrame:
    """(query_id, rank, score, chunk_key, document_id, document_revision, title, metadata, start_line, end_line, text, context).

    ``queries`` has (query_id, text) and, for dense modes, vector. Texts are fetched for the final rows only.
    """
    if mode not in MODES:
        raise EngineError("invalid_argument", f"unknown mode {mode}")
    if not 1 <= top_k <= MAX_TOP_K:
        raise EngineError("invalid_argument", f"top_k must be 1 to {MAX_TOP_K}")
    p = profile if isinstance(profile, Profile) else PROFILES[profile]
    note = (trace or Trace()).add
    size = max(top_k, pool or p.pool(top_k))
    note(f"{mode}: {size} candidates, profile {p.name}")
    found = materialize(candidates(corpus, queries, mode, size, wanted, p), "candidates")
    found = reranked(corpus, queries, found)
    if p.quality:
        note(f"mmr {p.lam} to {top_k}, stitch {p.max_gap}")
        found = diversified(corpus, found, top_k, p)
    return resolved(corpus, found.filter(F.col("rank") <= top_k))


def resolved(corpus: Corpus, found: DataFrame) -> DataFrame:
    """Hits with what is cited of their chunks. A hit whose chunk is gone is an error, not a missing row: the index and the chunks would be of different generations."""
    cited = [c for c in ("document_id", "document_revision", "title", "metadata", "start_line", "end_line", "text", "context") if c in corpus.chunks.columns]
    j = found.join(corpus.chunks.select(F.col("chunk_key").alias("_k"), *cited), F.col("chunk_key") == F.col("_k"), "left")
    known = F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("corrupt_index: unknown chunk "), F.col("chunk_key").cast("string")))).otherwise(F.col("chunk_key"))
    return j.select("query_id", "rank", "score", known.alias("chunk_key"), *cited)


# --- pipelines of stages ---

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """A list of stages over candidates; presets compose the usual ones, any DataFrame -> DataFrame function is a stage."""

    stages: list[tuple[str, Stage]]

    def run(self, found: DataFrame, trace: Trace | None = None) -> DataFrame:
        for name, stage in self.stages:
            (trace or Trace()).add(name)
            found = found.transform(stage)
        return found

    def with_stage(self, name: str, stage: Stage) -> Pipeline:
        return Pipeline([*self.stages, (name, stage)])

    @staticmethod
    def preset(name: str, corpus: Corpus, queries: DataFrame, top_k: int, profile: Profile = PROFILES["balanced"]) -> Pipeline:
        """standard; context (standard and stitching, whose freed places are filled again); quality; quality_context."""
        rerank = ("rerank", lambda d: reranked(corpus, queries, d))
        cut = ("top", lambda d: d.filter(F.col("rank") <= top_k))
        none = profile.overridden(max_gap=-1)
        stages = {
            "standard": [rerank, cut],
            "context": [rerank, ("stitch", lambda d: diversified(corpus, d, 2_147_483_647, profile.overridden(lam=1.0))), cut],
            "quality": [rerank, ("mmr", lambda d: diversified(corpus, d, top_k, none)), cut],
            "quality_context": [rerank, ("mmr and stitch", lambda d: diversified(corpus, d, top_k, profile)), cut],
        }
        return Pipeline(stages[name])


def with_fallback(corpus: Corpus, queries: DataFrame, embed: Callable[[DataFrame], DataFrame], top_k: int, trace: Trace) -> DataFrame:
    """Hybrid search that falls back to lexical search, with a note, if the embedder fails; the service's own search fails instead."""
    try:
        with_vectors = materialize(embed(queries), "query-vectors")
    except Exception as e:  # noqa: BLE001 - any failure of a pluggable embedder
        trace.add(f"embedder failed ({type(e).__name__}), lexical only")
        return search(corpus, queries, "lexical", top_k, trace=trace)
    return search(corpus, with_vectors, "hybrid", top_k, trace=trace)
