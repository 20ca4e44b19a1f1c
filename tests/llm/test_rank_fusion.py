import math
import random

from siftwell.llm import rank_fusion
from tests.conftest import rows

SCHEMA = "query_id long, list_no int, score_type string, weight float, hits array<struct<chunk:long,score:double>>, item int, rank int, points int"
NAN, INF = float("nan"), float("inf")


def fused(spark, data):
    return rank_fusion.fuse(rank_fusion.list_ranks(spark.createDataFrame([(*d, 1, 2, 3) for d in data], SCHEMA)))


def by_hand(data):
    lists = {}
    for q, n, kind, w, hits in data:
        if w is not None and math.isfinite(w) and w >= 0 and hits:
            best = {}
            for c, s in hits:
                if c is not None and s is not None and math.isfinite(s):
                    good = -s if kind == "l2" else s
                    best[c] = max(good, best.get(c, -INF))
            lists[q, n] = (w, best)
    out = []
    for q in {q for q, _ in lists}:
        own = [x for (y, _), x in lists.items() if y == q]
        items = set().union(*[b for _, b in own])
        points = {}
        for item in items:
            total = 0
            for w, b in own:
                if not b:
                    continue
                rank = (sum(v > b[item] for v in b.values()) + 1 + (sum(v == b[item] for v in b.values()) - 1) / 2) if item in b else (len(b) + 1 + len(items)) / 2
                total += w * (len(items) - rank)
            points[item] = round(total, 6)
        for i, item in enumerate(sorted(items, key=lambda x: (-points[x], x)), 1):
            out.append((q, item, points[item], i))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(1)
    data = []
    for q in range(60):
        for n in range(r.randrange(1, 5)):
            hits = [(r.randrange(12), r.choice([1.0, 2.0, 2.5, r.random() * 100, -3.0])) for _ in range(r.randrange(0, 12))]
            data.append((q, n, r.choice(["bm25", "l2", "cosine"]), r.choice([0.0, 0.5, 1.0, 2.0]), hits))
    got = sorted(((x["query_id"], x["item"], round(x["points"], 6), x["rank"]) for x in fused(spark, data + data[:20]).collect()), key=repr)
    assert got == by_hand(data)


def test_dirt(spark):
    data = [
        (1, 0, "bm25", 1.0, [(1, 5.0), (2, NAN), (3, None), (None, 9.0), (4, INF), (1, 7.0)]),
        (1, 1, "bm25", -1.0, [(9, 5.0)]), (1, 2, "bm25", NAN, [(9, 5.0)]), (1, 3, "bm25", None, [(9, 5.0)]), (1, 4, "bm25", INF, [(9, 5.0)]),
        (1, 5, "bm25", 1.0, None), (1, 6, "bm25", 1.0, []), (1, 7, None, 1.0, [(2, 1.0)]), (2, 0, "l2", 0.0, [(5, 0.1), (6, 0.2)]), (None, None, "l2", 1.0, [(5, 0.1), (6, 0.2)]), (3, 0, "bm25", 1.0, [(None, 1.0)]),
    ]
    got = rows(fused(spark, data).select("query_id", "item", "rank"))
    assert got == sorted([(1, 1, 1), (1, 2, 2), (2, 5, 1), (2, 6, 2), (None, 5, 1), (None, 6, 2)], key=repr)
    assert rows(fused(spark, [])) == []


def test_scale_cannot_matter(spark):
    small = [(1, 0, "bm25", 1.0, [(1, 0.3), (2, 0.2), (3, 0.1)]), (1, 1, "bm25", 1.0, [(3, 3.0), (2, 2.0), (1, 1.0)])]
    large = [small[0], (1, 1, "bm25", 1.0, [(c, s**9 * 1e6) for c, s in small[1][4]])]
    assert rows(fused(spark, small)) == rows(fused(spark, large))


def test_one_large_query(spark):
    hits = [(i, float(i % 1000)) for i in range(20_000)]
    got = fused(spark, [(1, 0, "bm25", 1.0, hits), (1, 1, "l2", 0.5, hits[:100])])
    assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, 20_001))


def test_first_by_reciprocal_misses_nothing(spark):
    """Against the sum over all places, with ties, missing items and uneven weights; most items are never looked at."""
    r = random.Random(3)
    data = []
    for q in range(80):
        pool = r.randrange(1, 60)
        for n in range(r.randrange(1, 6)):
            hits = [(r.randrange(pool), r.choice([1.0, 1.0, 2.0, 3.0, r.random() * 9])) for _ in range(r.randrange(1, 50))]
            data.append((q, n, r.choice(["bm25", "l2"]), r.choice([0.0, 0.1, 1.0, 3.0]), hits))
    ranks = rank_fusion.list_ranks(spark.createDataFrame([(*d, 1, 2, 3) for d in data], SCHEMA)).cache()
    fused_rows = rank_fusion.fuse(ranks).cache()
    got = rows(rank_fusion.first_by_reciprocal(ranks, fused_rows, 3).select("query_id", "item", "value"))
    every = rank_fusion.reciprocal(ranks, fused_rows).collect()
    want = []
    for q in {x["query_id"] for x in every}:
        want += [tuple(x) for x in sorted((x for x in every if x["query_id"] == q), key=lambda x: (-x["value"], x["item"]))[:3]]
    assert got == sorted(want, key=repr)
    j = fused_rows.withColumn("most", rank_fusion.reciprocal_most()).join(rank_fusion.reciprocal(ranks, fused_rows), ["query_id", "item"])
    assert j.filter("value > most + 1e-9").count() == 0 and j.filter("most < 0.03").count() > 0
