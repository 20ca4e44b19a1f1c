"""Derived indexes kept beside a corpus, valid for one fingerprint of its vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftwell.operators import dense, lexical


def vector_fingerprint(vectors: DataFrame, key: str = "key", vector: str = "vector") -> str:
    """A checksum of keys and vectors that does not depend on their order: row hashes, added and xored, with the count."""
    h = F.xxhash64(F.col(key), F.col(vector))
    r = vectors.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{r['n']}-{r['x'] & (1 << 64) - 1:016x}-{int(r['s']) & (1 << 64) - 1:016x}"


def cached(path: str, vectors: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "key", vector: str = "vector") -> DataFrame:
    """The index under the vectors' fingerprint; built and written if there is none, so an outdated one is never read."""
    at = f"{path.rstrip('/')}/{vector_fingerprint(vectors, key, vector)}"
    try:
        return vectors.sparkSession.read.parquet(at)
    except AnalysisException:
        build(vectors).write.mode("overwrite").parquet(at)
        return vectors.sparkSession.read.parquet(at)


def lexical_index(path: str, chunks: DataFrame, options: lexical.TokenOptions = lexical.TokenOptions()) -> lexical.LexicalIndex:
    """The lexical index of (chunk_key, indexed_text, metadata) under a path that names their generation; built and kept if there is none."""
    spark = chunks.sparkSession
    try:
        return lexical.LexicalIndex.read(spark, path)
    except AnalysisException:
        lexical.build(chunks, "chunk_key", "indexed_text", "metadata", options).write(path)
        return lexical.LexicalIndex.read(spark, path)


def dense_index(path: str, vectors: DataFrame, dimension: int, wanted: str = "auto", lists: int = 256, probes: int = 16) -> dense.DenseIndex:
    """The access path that the number of vectors asks for; inverted lists are kept under the vectors' fingerprint."""
    algorithm = dense.resolve_algorithm(vectors.count(), wanted)
    if algorithm == "exact":
        return dense.ExactIndex(vectors, dimension)
    at = f"{path.rstrip('/')}/{algorithm}-{lists}-{vector_fingerprint(vectors)}"
    try:
        built = dense.InvertedLists.read(vectors.sparkSession, at)
    except AnalysisException:
        built = dense.InvertedLists.fit(vectors, dimension, lists, codec=dense.CODECS[algorithm], path=at)
    return dense.ListIndex(vectors, dimension, probes=probes, built=built)
