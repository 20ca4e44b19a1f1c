"""Vector functions: as Columns for single products, as numpy in Arrow batches for bulk work, and the hash embedder."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from siftwell.functions.hashing import fnv1a

TINY = 1e-12
UNIT_TOLERANCE = 1e-3


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The product in double precision; the shorter vector's length counts."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(_double(a), 1, n), F.slice(_double(b), 1, n), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; a vector without length stays as it is."""
    n = norm(v)
    return F.when(n > TINY, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na > TINY) & (nb > TINY), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def vector_fault(v: Column, dimension: int) -> Column:
    """Why a vector cannot be indexed: null, dimension, not_finite, not_unit; null if it can."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(v.isNull(), "null")
        .when(F.size(v) != dimension, "dimension")
        .when(bad, "not_finite")
        .when(F.abs(dot(v, v) - 1) > UNIT_TOLERANCE, "not_unit")
    )


def quantize_sq8(v: Column) -> Column:
    """127 steps either way, rounded half away from zero."""
    return F.transform(_double(v), lambda x: F.round(F.greatest(F.least(x * 127, F.lit(127.0)), F.lit(-127.0))).cast("tinyint"))


def dot_sq8(a: Column, b: Column) -> Column:
    """The integer product of two quantised vectors, scaled back."""
    products = F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int"))
    return F.aggregate(products, F.lit(0), lambda t, x: t + x) / F.lit(127.0 * 127.0)


def sign_words(v: Column, dimension: int) -> Column:
    """One bit per component (1 if not negative), in words of 32 bits held as BIGINT."""
    words = []
    for start in range(0, dimension, 32):
        part = F.slice(v, start + 1, min(32, dimension - start))
        words.append(F.aggregate(F.transform(part, lambda x, i: F.when(x >= 0, F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda t, x: t + x))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def parsed_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


class Embedder(Protocol):
    """Texts to vectors; ``identity`` names the space, vectors of different identities must not be mixed."""

    dimension: int
    identity: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of words and word pairs; needs no model. Unit length."""

    identity = "hash-embed-v1"
    _word = re.compile(rb"[A-Za-z0-9]+")

    def __init__(self, dimension: int = 256):
        if dimension < 1:
            raise ValueError("dimension must be positive")
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        features, owner, size = [], [], []
        for i, text in enumerate(texts):
            words = [w.lower() for w in self._word.findall((text or "").encode())]
            features += words
            size += [1.0] * len(words)
            features += [a + b"_" + b for a, b in zip(words, words[1:], strict=False)]
            size += [0.5] * max(0, len(words) - 1)
            owner += [i] * (len(features) - len(owner))
        out = np.zeros((len(texts), self.dimension))
        if features:
            distinct = {f: k for k, f in enumerate(dict.fromkeys(features))}
            h = fnv1a(list(distinct))[np.fromiter((distinct[f] for f in features), np.int64, len(features))]
            sign = np.where(h >> np.uint64(63) == 1, -1.0, 1.0)
            np.add.at(out, (np.array(owner), (h % np.uint64(self.dimension)).astype(np.int64)), sign * np.array(size))
        lengths = np.linalg.norm(out, axis=1)
        empty = np.flatnonzero(lengths == 0)
        if len(empty):
            slots = fnv1a([(texts[i] or "").encode() for i in empty]) % np.uint64(self.dimension)
            out[empty, slots.astype(np.int64)] = 1.0
            lengths[empty] = 1.0
        return (out / lengths[:, None]).astype(np.float32)


class SuppliedEmbedder:
    """Vectors that come with the data: an exact look-up of the text, for tests and prepared corpora."""

    def __init__(self, vectors: dict[str, list[float]], identity: str):
        self.vectors, self.identity = vectors, identity
        self.dimension = len(next(iter(vectors.values())))

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vectors[t] for t in texts], np.float32)


class HttpEmbedder:
    """Vectors from a local embedding service, through a transport that is given (a callable: JSON body to JSON answer).

    No network is used here by itself. Answers may come in any order, each with the number of its text; what is missing, repeated or of
    another dimension is refused.
    """

    def __init__(self, transport: Callable[[str], str], dimension: int, identity: str, batch: int = 32):
        self.transport, self.dimension, self.identity, self.batch = transport, dimension, identity, batch

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            data = json.loads(self.transport(json.dumps({"input": part})))["data"]
            if sorted(d["index"] for d in data) != list(range(len(part))) or any(len(d["embedding"]) != self.dimension for d in data):
                raise ValueError("the embedding service did not answer every text once, in the right dimension")
            for d in data:
                out[i + d["index"]] = d["embedding"]
        return out


def embedded(df: DataFrame, text: str, embedder: Embedder, output: str = "embedding", batch: int = 256) -> DataFrame:
    """Adds the vector of a text; checks number, dimension and finiteness of what the embedder returns."""
    schema = StructType([*df.schema.fields, StructField(output, ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame[text]]
            got = [embedder.embed(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            v = np.concatenate(got) if got else np.zeros((0, embedder.dimension), np.float32)
            if v.shape != (len(texts), embedder.dimension) or not np.isfinite(v).all():
                raise ValueError(f"embedder returned {v.shape} for {len(texts)} texts of dimension {embedder.dimension}, or values that are not finite")
            yield frame.assign(**{output: list(v)})

    return df.mapInPandas(run, schema)


def with_supplied(df: DataFrame, text: str, vectors: DataFrame, output: str = "embedding") -> DataFrame:
    """Adds the vector that comes with the data for a text, from (text, vector) with distinct texts, by a join; a text without one is an error."""
    v = vectors.select(F.col("text").alias("_text"), F.col("vector").cast("array<float>").alias("_vector"))
    j = df.join(v, F.col(text) == F.col("_text"), "left")
    known = F.when(F.col("_vector").isNull(), F.raise_error(F.concat(F.lit("not_found: no vector for "), F.substring(F.coalesce(F.col(text), F.lit("null")), 1, 80)))).otherwise(F.col("_vector"))
    return j.withColumn(output, known).drop("_text", "_vector")
