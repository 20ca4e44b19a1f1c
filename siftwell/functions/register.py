"""The functions under SQL names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import text
from siftwell.functions.chunking import ChunkOptions, chunk_text
from siftwell.functions.hashing import fnv1a_hex
from siftwell.functions.vectors import HashEmbedder


def register(spark: SparkSession, options: ChunkOptions = ChunkOptions(), dimension: int = 256) -> list[str]:
    """``porter_stem(word)``, ``fnv1a64(text)``, ``hash_embed(text)`` and the table function ``chunk_document(text)``; their names."""

    @F.pandas_udf(T.StringType())
    def porter_stem(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else text.stem(w))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def hash_embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(HashEmbedder(dimension).embed([t or "" for t in texts])))

    @F.udtf(returnType="ordinal: int, text: string, context: string, start_line: int, end_line: int")
    class ChunkDocument:
        def eval(self, content: str) -> Iterator[tuple]:
            for i, c in enumerate(chunk_text(content, options)):
                yield i, c["text"], c["context"], c["start_line"], c["end_line"]

    spark.udf.register("porter_stem", porter_stem)
    spark.udf.register("fnv1a64", fnv1a_hex)
    spark.udf.register("hash_embed", hash_embed)
    spark.udtf.register("chunk_document", ChunkDocument)
    return ["porter_stem", "fnv1a64", "hash_embed", "chunk_document"]
