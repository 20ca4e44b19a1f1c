import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwell.llm import packing
from tests.conftest import rows


def packed(spark, sizes, capacity=100, **options):
    return packing.pack(spark.createDataFrame(list(enumerate(sizes)), "id long, size long"), capacity, **options).collect()


def check(got, sizes, capacity):
    used, parts = Counter(), defaultdict(list)
    for r in got:
        used[r["container"]] += r["size"]
        parts[r["id"]].append((r["part"], r["offset"], r["size"]))
    assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
    for i, s in enumerate(sizes):
        own = sorted(parts[i])
        assert sum(p[2] for p in own) == max(1, s) and len(own) == max(1, -(-s // capacity))
        assert [p[0] for p in own] == list(range(len(own))) and [p[1] for p in own] == [k * capacity for k in range(len(own))]
    return sum(used.values()) / (len(used) * capacity)


@pytest.mark.parametrize("seed", range(3))
def test_valid_and_full(spark, seed):
    r = random.Random(seed)
    sizes = [min(2000, max(1, int(r.lognormvariate(3, 1)))) for _ in range(3000)]
    assert check(packed(spark, sizes), sizes, 100) > 0.98


def test_edges(spark):
    assert packed(spark, []) == []
    assert check(packed(spark, [100, 200, 250, 1, 99]), [100, 200, 250, 1, 99], 100) == 650 / 700
    assert check(packed(spark, [1]), [1], 100) == 0.01
    same = [7] * 5000  # one length has all rows
    assert check(packed(spark, same), same, 100) > 0.97
    big = [100_000]
    assert check(packed(spark, big), big, 100) == 1.0


def test_step_groups_are_balanced(spark):
    r = random.Random(5)
    got = packed(spark, [min(100, max(1, int(r.lognormvariate(3, 1)))) for _ in range(8000)], group=16)
    work, tokens, count = Counter(), Counter(), defaultdict(set)
    for x in got:
        work[x["step_group"]] += x["size"] ** 2
        tokens[x["step_group"]] += x["size"]
        count[x["step_group"]].add(x["container"])
    assert max(len(c) for c in count.values()) <= 17
    assert max(work.values()) < 1.2 * min(work.values()) and max(tokens.values()) - min(tokens.values()) <= 200  # of 1,600: a container more or less and what is not full


def test_tiers_change_the_plan(spark):
    """A document lies in a window of its tier or, where those would stay empty, of a longer one; windows nest in containers."""
    r = random.Random(7)
    sizes = [min(1600, max(1, int(r.lognormvariate(4, 1.2)))) for _ in range(4000)]
    seen = []
    for tiers in ([100, 200, 400], [200], []):
        got = packed(spark, sizes, 800, tiers=tiers)
        assert check(got, sizes, 800) > 0.99
        used, at = Counter(), defaultdict(set)
        for x in got:
            used[x["tier"], x["window"]] += x["size"]
            at[x["tier"], x["window"]].add(x["container"])
            assert x["size"] <= x["tier"] and x["tier"] in (*tiers, 800)
        assert all(n <= t for (t, _), n in used.items()) and all(len(c) == 1 for c in at.values())
        assert {t for t, _ in used} == {*tiers, 800}
        seen.append(sorted((x["id"], x["part"], x["tier"]) for x in got))
        fill = {x["tier"]: x["fill"] for x in packing.tier_fill(packing.pack(spark.createDataFrame(list(enumerate(sizes)), "id long, size long"), 800, tiers)).collect()}
        assert set(fill) == {*tiers, 800} and all(f >= 0.97 for f in fill.values())
    assert seen[0] != seen[1] != seen[2] != seen[0]


def test_half_empty_windows_are_dissolved():
    plan = packing.plan_containers({150: 1000}, 2048, [256, 512, 1024])
    assert set(plan.fill) == {2048} and plan.containers == -(-1000 // 13)
    assert packing.plan_containers({}, 2048, [256]).containers == 0
    with pytest.raises(ValueError):
        packing.plan_containers({1: 1}, 2048, [300, 700])


def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "  "), (5, "é" * 10), (5, "é" * 10)], "doc_id long, text string")
    assert rows(packing.measured_sizes(df, "doc_id", "text")) == [(1, 3), (4, 1), (5, 5), (5, 5)]
    for file in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"):
        got = {r["id"]: r["size"] for r in packing.token_sizes(df, "doc_id", "text", f"/opt/tokenizers/{file}").collect()}
        assert set(got) == {1, 4, 5} and got[1] in (2, 3)
    assert packing.token_sizes(df.limit(0), "doc_id", "text").count() == 0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, 60, 5), (1, 60, 6), (None, 30, 7)], "id long, size long, whole int")
    got = packing.pack(df, 100).collect()
    assert sorted((r["id"] or 0, r["size"]) for r in got) == [(0, 30), (1, 60), (1, 60)] and len({r["container"] for r in got}) == 2


def test_a_long_plan_stays_small():
    r = random.Random(1)
    h = Counter(min(2048, max(1, int(r.lognormvariate(5, 1.2)))) for _ in range(50_000))
    small = packing.plan_containers(h, 2048, [256, 512, 1024])
    large = packing.plan_containers({k: v * 10**6 for k, v in h.items()}, 2048, [256, 512, 1024])
    assert len(large.rows) < 2 * len(small.rows) < 60_000
    assert sum(k * v * 10**6 for k, v in h.items()) > 0.999 * 2048 * large.containers


def test_measure_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert rows(packing.measured_sizes(df, "doc_id", "text", F.length)) == [(1, 5)]
