"""Declarative metadata filters: every key must match, with any of its values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell import errors
from siftwell.errors import EngineError


class MetadataFilter:
    """None of a filter restricts nothing; a filter without keys, or a key without values, matches nothing."""

    def __init__(self, wanted: dict[str, list[str] | str]):
        if not all(isinstance(v, str) or isinstance(v, (list, tuple, set)) and all(isinstance(x, str) for x in v) for v in wanted.values()):
            raise EngineError("invalid_argument", "filter values must be strings")
        self.wanted = {k: sorted({v} if isinstance(v, str) else set(v)) for k, v in wanted.items()}
        if any(len(v) > errors.MAX_FILTER_VALUES_PER_KEY for v in self.wanted.values()) or sum(map(len, self.wanted.values())) > errors.MAX_FILTER_VALUES:
            raise EngineError("invalid_argument", "too many filter values")

    def column(self, metadata: Column) -> Column:
        """True or false, never null."""
        if not self.wanted or not all(self.wanted.values()):
            return F.lit(False)
        return reduce(lambda a, b: a & b, [F.coalesce(metadata[k].isin(v), F.lit(False)) for k, v in self.wanted.items()])


def matches(metadata: Column, wanted: MetadataFilter | None) -> Column:
    return F.lit(True) if wanted is None else wanted.column(metadata)


def matches_row(metadata: Column, wanted: Column) -> Column:
    """The same for filters that come as a MAP<STRING, ARRAY<STRING>> column, one per query; a null filter restricts nothing."""
    every = F.forall(F.map_entries(wanted), lambda e: F.coalesce(F.array_contains(e["value"], metadata[e["key"]]), F.lit(False)))
    return F.when(wanted.isNull(), True).when(F.size(wanted) == 0, False).otherwise(F.coalesce(every, F.lit(False)))


def tag_fault(metadata: Column) -> Column:
    """Why metadata break the limits: tags, key, value, total; null if they do not."""
    keys, values = F.map_keys(metadata), F.map_values(metadata)
    sizes = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + F.coalesce(F.octet_length(x), F.lit(0)))
    return (
        F.when(F.size(metadata) > errors.MAX_TAGS, "tags")
        .when(F.exists(keys, lambda k: (k == "") | (F.octet_length(k) > errors.MAX_KEY_BYTES)), "key")
        .when(F.exists(values, lambda v: v.isNull() | (F.octet_length(v) > errors.MAX_VALUE_BYTES)), "value")
        .when(sizes(keys) + sizes(values) > errors.MAX_TAG_BYTES, "total")
    )
