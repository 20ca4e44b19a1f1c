"""Positions and running sums within groups of any size.

A plain window puts a whole group into one task. Here a group is cut into buckets that follow the order; rows
are numbered within (group, bucket), and each bucket gets the count (and sum) of the buckets before it from a small
aggregate. A hot group is thus spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, group: list[str], bucket: Column, order: list[Column], position: str = "position", weight: str | None = None, running: str | None = None) -> DataFrame:
    """Adds ``position`` (from 1) by ``order`` within ``group`` and, with ``weight``, the running sum up to and with the row.

    ``bucket`` must not decrease along ``order`` (any value will do if the order is only bucket, then order). Null weights
    count as 0. Nulls in the group are a group.
    """
    rows = df.withColumn("_bucket", F.coalesce(bucket.cast("long"), F.lit(-1).cast("long")))
    aggs = [F.count("*").alias("_n")] + ([F.sum(F.coalesce(weight, F.lit(0))).alias("_w")] if weight else [])
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*group, "_bucket").agg(*aggs)
    offsets = offsets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *([F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_sum_before")] if weight else []))
    w = Window.partitionBy(*group, "_bucket").orderBy(*order)
    on = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = rows.withColumn("_local", F.row_number().over(w))
    if weight:
        out = out.withColumn("_local_sum", F.sum(F.coalesce(weight, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(offsets, on).withColumn(position, F.col("_local") + F.col("_before"))
    if weight:
        out = out.withColumn(running or "running", F.col("_local_sum") + F.col("_sum_before"))
    return out.drop("_bucket", "_b", "_before", "_local", "_local_sum", "_sum_before", *[f"_g{i}" for i in range(len(group))])


def running_max(df: DataFrame, group: list[str], order: Column, ties: list[Column], value: str, output: str, buckets: int = 256) -> DataFrame:
    """Adds the greatest ``value`` of the rows before each row of its group by (``order``, ``ties``); null for the first.

    ``order`` is a number. It is cut into buckets over its whole range; what came before a row's bucket is a running maximum over
    the buckets, so a hot group is spread over as many tasks as it has buckets.
    """
    edge = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, width = edge["lo"] or 0, max(1, (edge["hi"] or 0) - (edge["lo"] or 0))
    rows = df.withColumn("_bucket", F.coalesce(F.floor((order - F.lit(lo)) * F.lit(buckets) / F.lit(width)), F.lit(-1)).cast("long"))
    per = rows.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b")).agg(F.max(value).alias("_m"))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.max("_m").over(before)).drop("_m")
    on = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_own", F.max(value).over(within)).join(per, on)
    return out.withColumn(output, F.greatest("_own", "_before")).drop("_bucket", "_b", "_own", "_before", *[f"_g{i}" for i in range(len(group))])
