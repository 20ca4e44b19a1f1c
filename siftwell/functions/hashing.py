"""64-bit FNV-1a keys and hashes, a batch of strings at a time.

All rows of a batch advance together, byte position by byte position, as one unsigned vector; the multiplication wraps
as it should, which BIGINT arithmetic in SQL would refuse.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The offset basis (deliberately not the standard one, existing keys depend on it) and the prime.
BASIS = 1469598103934665603
PRIME = 1099511628211


def fnv1a(texts: Sequence[bytes], basis: int = BASIS) -> np.ndarray:
    """The hashes of a batch. Longer strings come first, so those still going are always a prefix of the batch."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    out = np.full(len(texts), basis, np.uint64)
    if not len(texts):
        return out
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    state = out[order]
    prime = np.uint64(PRIME)
    going = len(texts)
    with np.errstate(over="ignore"):
        for i in range(int(sizes[0])):
            while going and sizes[going - 1] <= i:
                going -= 1
            state[:going] = (state[:going] ^ flat[starts[:going] + i]) * prime
    out[order] = state
    return out


def hex16(values: np.ndarray) -> list[str]:
    return [f"{int(v):016x}" for v in values]


@F.pandas_udf(StringType())
def fnv1a_hex(texts: pd.Series) -> pd.Series:
    """The hash as 16 hexadecimal digits; null for null."""
    known = texts.notna()
    out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    out[known] = hex16(fnv1a([t.encode() for t in texts[known]]))
    return out


def _newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def stable_chunk_key(document: Column, start_line: Column, end_line: Column, text: Column) -> Column:
    """The key of a chunk: its document, lines and text."""
    lines = F.concat_ws(":", start_line.cast("string"), end_line.cast("string"))
    return F.concat(F.lit("chk_"), fnv1a_hex(F.concat_ws("\n", document, lines, _newlines(text))))


def hashed_field(c: Column) -> Column:
    """A field as it enters a content hash: its bytes' number, a colon, itself and a line break."""
    c = F.coalesce(c, F.lit(""))
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c, F.lit("\n"))


def content_hash(title: Column, content: Column, metadata: Column) -> Column:
    """The hash of title, content (newlines normalised) and the metadata entries in key order; null fields count as empty."""
    entries = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(hashed_field(e["key"]), hashed_field(e["value"])))
    whole = F.concat(hashed_field(title), hashed_field(_newlines(content)), F.coalesce(F.array_join(entries, ""), F.lit("")))
    return F.concat(F.lit("fnv1a64:"), fnv1a_hex(whole))
