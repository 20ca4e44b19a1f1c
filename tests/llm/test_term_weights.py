import math
import random

import pytest

from siftwell.llm import term_weights
from tests.conftest import rows

POSTINGS = "term string, doc long, tf int, record int, length string, df int"


def weights(spark, postings, ids):
    p = spark.createDataFrame([(*x, 1, "c", 2) for x in postings], POSTINGS)
    return term_weights.term_weights(p, spark.createDataFrame([(i, 0) for i in ids], "chunk_id long, tf int"))


def by_hand(postings, ids):
    tf = {}
    for t, d, n in set(postings):
        if t is not None and d in ids and n is not None and n > 0:
            tf[d, t.strip(" ").lower()] = tf.get((d, t.strip(" ").lower()), 0) + n
    length, df = {}, {}
    for (d, t), n in tf.items():
        length[d] = length.get(d, 0) + n
        df[t] = df.get(t, 0) + 1
    n, avg = len(length), sum(length.values()) / max(1, len(length))
    return sorted((d, t, f, df[t], round(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[d] / avg)), 6)) for (d, t), f in tf.items())


@pytest.mark.parametrize("limit", [200_000, 2])
def test_against_brute_force(spark, monkeypatch, limit):
    """With a low limit the frequency table is not broadcast whole."""
    monkeypatch.setattr(term_weights, "BROADCAST_TERMS", limit)
    monkeypatch.setattr(term_weights, "HEAD_SHARE", 0.05)
    r = random.Random(1)
    data = [(r.choice(["hot", " Hot", "HOT ", "a", "b", "rare" + str(i % 40), None, ""]), r.randrange(40), r.choice([1, 2, 5, 0, -1, None])) for i in range(900)]
    data += r.sample(data, 100) + [("x" * 50_000, 3, 2)]
    ids = set(range(35)) | {None}
    got = weights(spark, data, ids)
    assert sorted((x["record"], x["term"], x["tf"], x["df"], round(x["weight"], 6)) for x in got.collect()) == by_hand(data, ids - {None})


def test_empty(spark):
    assert rows(weights(spark, [], [1])) == [] and rows(weights(spark, [("a", 1, 1)], [])) == []


@pytest.mark.parametrize("records", [2, 3, 30])
def test_near_the_top_keeps_every_best_term(spark, records):
    r = random.Random(records)
    data = [(f"t{int(r.paretovariate(0.6)) % 40}", r.randrange(records), r.choice([1, 1, 2, 3, 9])) for _ in range(records * 30)]
    w = weights(spark, data, range(records)).cache()
    near = {(x["record"], x["term"]) for x in term_weights.near_the_top(w).collect()}
    value = {(x["record"], x["term"]): round(x["tf"] * math.log(x["records"] / x["df"]), 6) for x in w.collect()}
    for d in range(records):
        own = {k: v for k, v in value.items() if k[0] == d}
        assert {k for k, v in own.items() if v == max(own.values())} <= near
    assert records < 30 or len(near) < len(value) / 2
