"""One ranking from several scores of different scale: weighted Borda count.

Each list is turned into competition ranks (ties share the average of their ranks), so ranges and distributions of the scores
cannot matter. An item that a list does not score gets the middle of the ranks left over. Points are the number of
items ranked behind; they are weighted, summed, and ordered with the item's id as tie-break.

Defined results
- repeated (query, list) rows: count once (if they disagree, the greatest row by weight, type and hits);
- null, negative or non-finite weights: the list is ignored; weight 0: its items take part, its points are 0;
- null or non-finite scores, null items, null or empty hits: ignored; a query without any hit left: no rows;
- an item twice in a list: its better score;
- null query or list numbers: a group like any other;
- equal points: the smaller item first; empty tables: no rows; extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.ranking import positions

#: Score types for which smaller is better.
SMALLER_IS_BETTER = ["l2"]
FINITE = "{0} IS NOT NULL AND NOT isnan({0}) AND abs({0}) < double('infinity')"


def list_ranks(lists: DataFrame) -> DataFrame:
    """(query_id, list_no, weight, item, place, rank, tied, ranked): each usable hit with its ordinal place (ties by item), its
    averaged competition rank, the number of items that share its score and the number of items its list ranks. A list is the
    array of one row, so no window holds more than one record had."""
    one = (
        lists.select("query_id", "list_no", F.struct(F.col("weight").cast("double").alias("weight"), "score_type", "hits").alias("row"))
        .filter(FINITE.format("row.weight") + " AND row.weight >= 0")
        .groupBy("query_id", "list_no")
        .agg(F.max("row").alias("row"))
    )
    hits = one.select("query_id", "list_no", F.col("row.weight").alias("weight"), F.lower(F.trim("row.score_type")).alias("type"), F.explode("row.hits").alias("hit"))
    hits = hits.select("query_id", "list_no", "weight", F.col("hit.chunk").alias("item"), F.when(F.col("type").isin(SMALLER_IS_BETTER), -F.col("hit.score")).otherwise(F.col("hit.score")).alias("good"))
    hits = hits.filter("item IS NOT NULL AND " + FINITE.format("good"))
    best = hits.groupBy("query_id", "list_no", "item").agg(F.max("weight").alias("weight"), (F.max("good") + 0.0).alias("good"))
    within = Window.partitionBy("query_id", "list_no")
    ties = Window.partitionBy("query_id", "list_no", "good")
    return best.select(
        "query_id",
        "list_no",
        "weight",
        "item",
        F.row_number().over(within.orderBy(F.desc("good"), "item")).alias("place"),
        (F.rank().over(within.orderBy(F.desc("good"))) + (F.count("*").over(ties) - 1) / 2.0).alias("rank"),
        F.count("*").over(ties).alias("tied"),
        F.count("*").over(within).alias("ranked"),
    )


def fuse(ranks: DataFrame, buckets: int = 256) -> DataFrame:
    """(query_id, item, points, rank, n, all_lists, slack): every item of every query, ranked by Borda points, from the rows of ``list_ranks``.

    ``n`` is the number of the query's items, ``all_lists`` the sum of its lists' weights, ``slack`` the weighted sum of how far the item's
    places may lie before its averaged ranks. Missing ranks are never written
    out as rows: a query's items all start from the points of being missing everywhere, and each hit adds its
    difference to that. Queries with very many items are ranked in buckets of points, not in one task.
    """
    items = ranks.groupBy("query_id", "item").agg(F.sum("weight").alias("own"), F.sum(F.col("weight") * F.col("rank")).alias("own_rank"), F.sum(F.col("weight") * F.col("ranked")).alias("own_ranked"), F.sum(F.col("weight") * (F.col("tied") - 1) / 2).alias("slack"))
    sizes = items.groupBy("query_id").agg(F.count("*").alias("n"))
    weights = ranks.filter("place = 1").groupBy("query_id").agg(F.sum("weight").alias("all_lists"), F.sum(F.col("weight") * F.col("ranked")).alias("all_ranked"))
    q = sizes.alias("s").join(weights.alias("t"), F.col("s.query_id").eqNullSafe(F.col("t.query_id"))).select(F.col("s.query_id").alias("_q"), "n", "all_lists", "all_ranked")
    j = items.join(q, F.col("query_id").eqNullSafe(F.col("_q")))
    n = F.col("n")
    missing = n * F.col("all_lists") - ((1 + n) * F.col("all_lists") + F.col("all_ranked")) / 2
    points = F.round(missing + ((1 + n) * F.col("own") + F.col("own_ranked")) / 2 - F.col("own_rank"), 9)
    scored = j.select("query_id", "item", points.alias("points"), "n", "all_lists", "slack", (n * F.col("all_lists")).alias("_most"))
    share = F.when(F.col("_most") > 0, F.col("points") / F.col("_most")).otherwise(F.lit(0.0))
    bucket = -F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * buckets)
    return positions(scored, ["query_id"], bucket, [F.desc("points"), F.asc("item")], "rank").select("query_id", "item", "points", "rank", "n", "all_lists", "slack")


def reciprocal(ranks: DataFrame, items: DataFrame, k: float = 60.0) -> DataFrame:
    """(query_id, item, value): the sum of weight / (k + place) over the lists that have the item, rounded to 9 places, for given (query_id, item)."""
    wanted = items.select(F.col("query_id").alias("_q"), F.col("item").alias("_i"))
    j = ranks.join(wanted, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("item") == F.col("_i")), "left_semi")
    return j.groupBy("query_id", "item").agg(F.round(F.sum(F.col("weight") / (k + F.col("place"))), 9).alias("value"))


def reciprocal_most(k: float = 60.0) -> Column:
    """The most that ``reciprocal`` can be for a row of ``fuse``.

    1 / (k + place) is convex, so for places from 1 to n it lies below its chord a - b (place - 1). The points are the sum of
    weight * (n - rank) over all lists, so the weighted sum of (rank - 1) is (n - 1) * all_lists - points; places lie before the averaged
    ranks of ties by ``slack`` at most. A list without the item adds nothing to the value and nothing negative to the bound.
    """
    a, n = F.lit(1.0 / (k + 1)), F.col("n")
    b = F.when(n > 1, (a - 1.0 / (k + n)) / (n - 1)).otherwise(F.lit(0.0))
    return a * F.col("all_lists") - b * ((n - 1) * F.col("all_lists") - F.col("points") - F.col("slack"))


def first_by_reciprocal(ranks: DataFrame, fused: DataFrame, top: int, k: float = 60.0) -> DataFrame:
    """(query_id, item, value, place): the ``top`` items of each query by ``reciprocal``, found through the Borda ranking.

    The first items by Borda points give a value that the last one returned must reach; the points bound what any other item can have, so
    only those whose bound reaches that value are looked at. Nothing is missed.
    """
    lead = reciprocal(ranks, fused.filter(F.col("rank") <= top), k)
    least = lead.groupBy("query_id").agg(F.min("value").alias("_least"), F.count("*").alias("_have"))
    least = least.select(F.col("query_id").alias("_lq"), F.when(F.col("_have") < top, 0.0).otherwise(F.col("_least")).alias("_least"))
    open_ = fused.join(least, F.col("query_id").eqNullSafe(F.col("_lq"))).filter(reciprocal_most(k) >= F.col("_least") - 1e-8)
    exact = reciprocal(ranks, open_, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("value"), "item")
    return exact.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
