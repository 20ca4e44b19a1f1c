"""Applying a change feed: ordered inserts, updates and deletes as composable patches.

A change becomes a patch: the place of its last reset (an insert, a delete or a full update) and, for every column, the
last place that set it and the value. Two patches compose by taking the later entry of each part; that is associative,
commutative and idempotent, so repeated and out-of-order changes cannot alter the result, and the changes of one key
may be folded in any grouping. ``compose`` folds them as a tree: ranges of the feed first (a hot key is split over all
its ranges and each task folds its own rows before the shuffle), then the ranges of a key; ``apply_to`` puts the
composed patch of each key on the base table.

Defined results
- null key parts: a null key is a key like any other;
- null order values: before all others; ties in the order: the greater (operation, values) decides, nulls first, always the same one;
- repeated rows: no effect; empty feed: the base as it is; empty base: what the feed builds;
- unknown or null operation: the row is no change and is ignored;
- values: null in a full change is the value null; in a partial update (op ``patch``) null leaves the column as it is;
- extra columns: ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, PATCH, DELETE = "put", "patch", "delete"


def patches(feed: DataFrame, keys: list[str], order: list[Column], operation: Column, values: list[str], chunk: Column) -> DataFrame:
    """(keys, chunk, reset, set_0..): each change as a patch; ``operation`` gives put, patch, delete or something else."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    vals = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]) if values else F.struct(F.lit(0).alias("v0"))
    base = feed.select(*keys, chunk.alias("chunk"), place.alias("place"), operation.alias("op"), vals.alias("vals"))
    full = F.col("op").isin(PUT, DELETE)
    return base.filter(F.col("op").isin(PUT, PATCH, DELETE)).select(
        *keys,
        "chunk",
        F.when(full, F.struct("place", (F.col("op") == PUT).alias("live"), "vals")).alias("reset"),
        *[F.when((F.col("op") == PATCH) & F.col(f"vals.v{i}").isNotNull(), F.struct("place", F.col(f"vals.v{i}").alias("v"))).alias(f"set_{i}") for i in range(len(values))],
        F.when(F.col("op") == PATCH, F.col("place")).alias("touched"),
    )


def _fold(df: DataFrame, by: list[str], n: int, partial: bool) -> DataFrame:
    sets = [f"set_{i}" for i in range(n)] + ["touched"] if partial else []
    return df.groupBy(*by).agg(F.max("reset").alias("reset"), *[F.max(s).alias(s) for s in sets])


def compose(feed: DataFrame, keys: list[str], order: list[Column], operation: Column, values: list[str], chunk: Column | None = None, partial: bool = True) -> DataFrame:
    """One composed patch per key, by a two-level tree. ``chunk`` numbers the ranges of the feed; None folds per key at once
    (task-side partial folds still apply). ``partial=False`` promises that there are no partial updates."""
    p = patches(feed, keys, order, operation, values, chunk if chunk is not None else F.lit(0))
    if chunk is not None:
        p = _fold(p, [*keys, "chunk"], len(values), partial)
    return _fold(p, keys, len(values), partial)


def apply_to(base: DataFrame | None, composed: DataFrame, keys: list[str], values: list[str], partial: bool = True) -> DataFrame:
    """(keys, values): the state after the patches; with ``base`` None the table starts empty.

    A patch on a key that is not there builds a row from the columns it sets.
    """
    if base is None:
        j, had = composed, F.lit(False)
        old = [F.lit(None)] * len(values)
    else:
        b = base.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)], F.lit(True).alias("_had"))
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)])
        j, had = composed.join(b, on, "full_outer"), F.coalesce(F.col("_had"), F.lit(False))
        old = [F.col(f"_v{i}") for i in range(len(values))]
    reset = F.col("reset").isNotNull()
    key = [F.when(had, F.col(f"_b{i}")).otherwise(F.col(k)).alias(k) if base is not None else F.col(k) for i, k in enumerate(keys)]
    out, later = [], F.lit(False)
    for i, v in enumerate(values):
        value = F.when(reset, F.col(f"reset.vals.v{i}")).otherwise(old[i])
        if partial:
            newer = F.col(f"set_{i}").isNotNull() & (~reset | (F.col(f"set_{i}.place") > F.col("reset.place")))
            value = F.when(newer, F.col(f"set_{i}.v")).otherwise(F.when(reset & ~F.col("reset.live"), F.lit(None)).otherwise(value))
        out.append(value.alias(v))
    if partial:
        later = F.col("touched").isNotNull() & (~reset | (F.col("touched") > F.col("reset.place")))
    live = F.when(reset, F.col("reset.live") | F.coalesce(later, F.lit(False))).otherwise(had | F.coalesce(later, F.lit(False)))
    return j.filter(live).select(*key, *out)
