import numpy as np
import pytest

from siftwell.llm import neighbours
from tests.conftest import rows

SCHEMA = "id long, v array<float>, code string, h int, rep int, list int"


def frame(spark, data):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", 1, 2, 3) for i, v in data], SCHEMA)


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(2, n // 100), dim))
    x = centres[r.integers(len(centres), size=n)] + r.normal(size=(n, dim)) * 0.8
    near = r.integers(n, size=n // 10)
    return np.vstack([x, x[near] + r.normal(size=(len(near), dim)) * 0.25]).astype(np.float32)


def exact(x, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    return {(i, j) for i, j in zip(*np.nonzero(s >= least), strict=True) if i < j}, s


def test_recall_of_pairs_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 100)
    x = clustered(3000, 16, 1)
    df = frame(spark, list(enumerate(x * 3)))
    pairs, members = neighbours.similar_pairs(df, "id", "v", 16, 0.95)
    got = {(r["a"], r["b"]) for r in neighbours.expanded_pairs(pairs, members).collect()}
    truth, s = exact(x, 0.95)
    assert got <= truth and len(got) >= 0.97 * len(truth)
    found = neighbours.nearest(df, "id", "v", 16, 5)
    np.fill_diagonal(s, -2)
    best = {i: set(np.argsort(-s[i])[:5]) for i in range(len(x))}
    hits, seen = 0, 0
    for r in found.collect():
        hits += r["neighbour"] in best[r["id"]]
        seen += 1
        assert abs(s[r["id"], r["neighbour"]] - r["similarity"]) < 1e-3
    assert seen == 5 * len(x) and hits >= 0.9 * seen


def test_oversized_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 10_000)
    monkeypatch.setattr(neighbours, "MAX_STORED", 100)
    x = clustered(400, 8, 2)
    pairs, members = neighbours.similar_pairs(frame(spark, list(enumerate(x))), "id", "v", 8, 0.95)
    assert {(r["a"], r["b"]) for r in neighbours.expanded_pairs(pairs, members).collect()} == exact(x, 0.95)[0]


@pytest.mark.parametrize("crowd", [50, 1000])
def test_crowds_of_probing_rows_are_split(spark, monkeypatch, crowd):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 150)
    monkeypatch.setattr(neighbours, "MAX_STORED", 60)
    monkeypatch.setattr(neighbours, "MAX_PROBING", crowd)
    x = clustered(500, 8, 6)
    df = frame(spark, list(enumerate(x)))
    coded, _, placed = neighbours.prepare(df, "id", "v", 8)
    sizes = placed.groupBy("cell").agg({"id": "count"}).collect()
    assert len(sizes) > 10 and coded.count() == len(x)
    monkeypatch.setattr(neighbours, "LIST_SIZE", 10_000)
    pairs, members = neighbours.similar_pairs(df, "id", "v", 8, 0.95)
    assert {(r["a"], r["b"]) for r in neighbours.expanded_pairs(pairs, members).collect()} == exact(x, 0.95)[0]


def test_exact_mode(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 20)
    monkeypatch.setattr(neighbours, "MAX_STORED", 90)
    monkeypatch.setattr(neighbours, "MAX_PROBING", 150)
    x = clustered(700, 8, 7)
    df = frame(spark, list(enumerate(x)))
    pairs, members = neighbours.similar_pairs(df, "id", "v", 8, 0.9, exact=True)
    truth, s = exact(x, 0.9)
    assert {(r["a"], r["b"]) for r in neighbours.expanded_pairs(pairs, members).collect()} == truth
    np.fill_diagonal(s, -2)
    for r in neighbours.nearest(df, "id", "v", 8, 3, exact=True).collect():
        assert r["similarity"] >= np.sort(s[r["id"]])[-3] - 1e-3


def test_many_near_copies(spark):
    """A hot list: half of the vectors nearly equal."""
    r = np.random.default_rng(8)
    x = np.vstack([np.ones(16) + r.normal(size=(20_000, 16)) * 1e-3, r.normal(size=(20_000, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<float>").repartition(8)
    coded, _, placed = neighbours.prepare(df, "id", "v", 16)
    biggest = placed.groupBy("cell").count().agg({"count": "max"}).first()[0]
    assert biggest <= 1.5 * (neighbours.MAX_STORED + neighbours.MAX_PROBING)
    assert neighbours.nearest(df, "id", "v", 16, 2).count() == 2 * len(x)


def test_too_many_pairs_of_copies_are_refused(spark):
    df = frame(spark, [(i, np.eye(8)[0]) for i in range(100)])
    pairs, members = neighbours.similar_pairs(df, "id", "v", 8, 0.9)
    with pytest.raises(ValueError):
        neighbours.expanded_pairs(pairs, members, 1000)
    assert members.count() == 100 and rows(pairs) == []


def test_copies_and_unusable(spark):
    x = np.random.default_rng(3).normal(size=(60, 8)).astype(np.float32)
    hot = [(1000 + i, x[0]) for i in range(200)]
    data = [*enumerate(x), *hot, (5, x[5]), (70, None), (71, []), (72, x[0][:7]), (73, [float("nan")] + [0.0] * 7), (74, [float("inf")] + [0.0] * 7), (75, [0.0] * 8), (None, x[1]), (76, [None] + [1.0] * 7), (77, x[1] * 7)]
    df = frame(spark, data)
    pairs, members = neighbours.similar_pairs(df, "id", "v", 8, 0.9999)
    assert members.count() == 201
    every = {(r["a"], r["b"]) for r in neighbours.expanded_pairs(pairs, members).collect()}
    assert len(every) == 201 * 200 // 2 + 1 and (1, 77) in every
    got = neighbours.nearest(df, "id", "v", 8, 3)
    assert {r["id"] for r in got.select("id").distinct().collect()} == {*range(60), *range(1000, 1200), 77}
    assert rows(got.filter("id = 1100").select("rank", "neighbour", "similarity")) == [(1, 0, 1.0), (2, 1000, 1.0), (3, 1001, 1.0)]
    assert [r[1] for r in rows(got.filter("id = 0").select("rank", "neighbour"))] == [1000, 1001, 1002]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny(spark, n):
    df = frame(spark, [(i, np.eye(8)[i]) for i in range(n)])
    pairs, members = neighbours.similar_pairs(df, "id", "v", 8, 0.5)
    assert rows(neighbours.expanded_pairs(pairs, members)) == []
    assert neighbours.nearest(df, "id", "v", 8, 3).count() == n * max(0, n - 1)


def test_id_with_two_vectors(spark):
    a, b = np.eye(8)[0], np.eye(8)[1]
    df = frame(spark, [(1, a), (1, b), (2, a), (3, b)])
    pairs, members = neighbours.similar_pairs(df, "id", "v", 8, 0.9)
    assert len(rows(neighbours.expanded_pairs(pairs, members))) == 1


def test_coding_error():
    x = np.random.default_rng(4).normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = neighbours.decode(neighbours.encode(x), 64)
    assert np.abs(d @ d.T - x @ x.T).max() <= neighbours.code_error(64)


def test_graph_search_against_all_centroids():
    x = clustered(20_000, 16, 5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.Index(x, 20_000 * 40)
    assert len(index.centroids) > 500
    ids, _ = index.search(x[:2000])
    best = np.argmax(x[:2000] @ index.centroids.T, axis=1)
    assert (ids[:, 0] == best).mean() > 0.97
