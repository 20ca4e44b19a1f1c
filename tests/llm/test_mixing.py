import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siftwell.llm import mixing
from tests.conftest import rows

DOCS = "id long, source string, size long, weight double, key double, budget int"
TARGETS = "source string, target_share double, max_repeats int, size int"


def drawn(spark, docs, targets, seed=0):
    d = spark.createDataFrame([(*x, 1.0, 2) for x in docs], DOCS)
    t = spark.createDataFrame([(*x, 3) for x in targets], TARGETS)
    draws, report = mixing.draw(d, t, seed)
    return draws.collect(), {r["source"]: r for r in report.collect()}


def test_shares_epochs_and_caps(spark):
    r = random.Random(1)
    docs = [(i, r.choice(["hot"] * 6 + ["mid", "mid", "small"]), r.randrange(1, 50), r.random()) for i in range(4000)]
    targets = [("hot", 0.3, 1), ("mid", 0.4, 3), (" SMALL\t", 0.3, 2), ("none", 0.0, 1), ("absent", 0.1, 4)]
    draws, report = drawn(spark, docs, targets)
    sizes, total = Counter(), sum(d[2] for d in docs)
    for _, s, n, _w in docs:
        sizes[s] += n
    times = defaultdict(Counter)
    for x in draws:
        times[x["source"]][x["id"]] += 1
    for s, share, cap in (("hot", 0.3, 1), ("mid", 0.4, 3), ("small", 0.3, 2)):
        got = report[s]
        assert got["size"] == sizes[s] and max(times[s].values()) <= cap
        assert got["drawn"] == sum(x["size"] for x in draws if x["source"] == s)
        if sizes[s] * cap < share * total:
            assert got["short"] and got["drawn"] == sizes[s] * cap
        else:
            assert not got["short"] and share * total - 50 < got["drawn"] <= share * total
        whole = min(cap, math.floor(share * total / sizes[s]))
        assert set(times[s].values()) <= {whole, whole + 1} and (whole == 0 or len(times[s]) == sum(d[1] == s for d in docs))
    assert report["absent"]["short"] and report["absent"]["drawn"] == 0 and not report["none"]["short"]
    assert abs(sum(x["share"] for x in report.values()) - 1) < 1e-9
    assert Counter((x["id"], x["epoch"]) for x in draws).most_common(1)[0][1] == 1


def test_same_draw_again_and_prefers_quality(spark):
    docs = [(i, "a", 1, 0.9 if i % 2 else 0.1) for i in range(4000)]
    one, _ = drawn(spark, docs, [("a", 0.25, 1)])
    two, _ = drawn(spark, docs[::-1], [("a", 0.25, 1)])
    assert {x["id"] for x in one} == {x["id"] for x in two} and len(one) == 1000
    other, _ = drawn(spark, docs, [("a", 0.25, 1)], seed=7)
    assert {x["id"] for x in other} != {x["id"] for x in one}
    assert sum(x["id"] % 2 for x in one) > 800


def test_dirt_and_empty(spark):
    docs = [(1, None, 5, 1.0), (2, "a", 5, None), (2, "a", 5, float("nan")), (None, "a", 5, -1.0), (3, "unknown", 5, 1.0)]
    draws, report = drawn(spark, docs, [("A ", 1.0, 2), ("a", 0.5, 1), (None, 0.1, 1), ("b", None, None)])
    assert set(report) == {"a", "b"} and report["a"]["size"] == 15 and len(draws) == 3
    draws, report = drawn(spark, [], [("a", 1.0, 1)])
    assert draws == [] and report["a"]["share"] == 0.0 and not report["a"]["short"]
    assert drawn(spark, docs, []) == ([], {})


def test_sized(spark):
    df = spark.createDataFrame([(1, " Wiki\t", "abcd efgh", 1), (2, "wiki", None, 1), (3, "wiki", "", 1), (4, None, "x", 1), (5, "wiki", "  ", 1), (6, "wiki", "y" * 300_000, 1)], "doc_id long, source string, text string, size int")
    got = mixing.sized(df, "doc_id", "text", "source", F.length("text"))
    assert rows(got.select("id", "source", "size")) == [(1, "wiki", 9), (5, "wiki", 2), (6, "wiki", 300_000)]
    assert all(mixing.LEAST_WEIGHT <= r["weight"] <= 1 for r in got.collect())


def test_only_ratios_of_weights_count(spark):
    r = random.Random(2)
    docs = [(i, "a", 1, r.random()) for i in range(2000)]
    draws = [{x["id"] for x in drawn(spark, [(i, s, n, w * scale) for i, s, n, w in docs], [("a", 0.3, 1)])[0]} for scale in (1, 1024, 1 / 1024)]
    assert draws[0] == draws[1] == draws[2] and len(draws[0]) == 600


def test_quality_weight(spark):
    prose = "The keeper of the harbour writes down every ship that passes, its flag, its cargo and the weather of the day. " * 2 + "Nobody reads the book until winter comes and somebody asks when the red schooner left."
    texts = [prose, "spam spam spam spam " * 20, "iVBORw0KGgoAAAANSUhEUgAA" * 20, "1 2 3 4 5 6 7 8 9 " * 20, "ok", "同じ文書を保存する前に、検索と要約の違いを週末までに調べる必要がある。" * 3, " \n\t"]
    got = [x["w"] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", mixing.quality_weight(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got[0] > 0.7 and got[5] > 0.4 and max(got[1:5]) < 0.4 and all(mixing.LEAST_WEIGHT <= w <= 1 for w in got)
