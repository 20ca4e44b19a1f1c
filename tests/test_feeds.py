import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import changefeed, differences, incremental, ranking
from tests.conftest import rows

REV = "k string, j int, rev int, at int, deleted boolean, hash string, extra string, _digest int, _last int"


def states(spark, data, where=None):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in data], REV)
    digest = F.when(F.col("hash").isNotNull(), incremental.content_digest("hash"))
    return incremental.latest_state(df, ["k", "j"], ["rev", "at"], digest, F.col("deleted"), where)


def test_changed_records(spark):
    current = states(spark, [("same", 1, 2, 1, False, "h"), ("same", 1, 2, 1, False, "h"), ("new", 1, 1, 1, False, "h"), ("newgone", 1, 1, 1, True, None), ("chg", 1, 3, 1, False, "b"), ("chg", 1, 2, 9, False, "a"), ("gone", 1, 2, 2, True, "h"), ("back", 1, 2, 2, False, "h"), ("nohash", 1, 1, 1, False, None), (None, None, 1, 1, False, "n"), ("bothgone", 1, 1, 1, True, "q"), ("nullflag", 1, 1, 1, None, "h")])
    state = states(spark, [("same", 1, 1, 1, False, "h"), ("chg", 1, 1, 1, False, "a"), ("gone", 1, 1, 1, False, "h"), ("back", 1, 1, 1, True, "h"), ("nohash", 1, 1, 1, False, None), ("bothgone", 1, 1, 1, True, "z"), ("other", 1, 1, 1, False, "h")])
    got = {(r["k"], r["change"]) for r in incremental.changed_records(current, state, ["k", "j"]).collect()}
    assert got == {("new", "new"), ("chg", "changed"), ("gone", "deleted"), ("back", "restored"), ("nohash", "changed"), (None, "new"), ("nullflag", "new")}


def test_changed_records_empty_and_ties(spark):
    none = states(spark, [])
    one = states(spark, [("a", 1, 1, 1, False, "x"), ("a", 1, 1, 1, False, "y")])
    assert one.count() == 1 and rows(one) == rows(states(spark, [("a", 1, 1, 1, False, "y"), ("a", 1, 1, 1, False, "x")]))
    assert incremental.changed_records(none, one, ["k", "j"]).count() == 0
    assert incremental.changed_records(one, none, ["k", "j"]).count() == 1


def test_ledger_runs_and_failures(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", ["k", "j"])
    first = states(spark, [("a", 1, 1, 1, False, "1"), ("b", 1, 1, 1, False, "1")])
    run = ledger.begin(first)
    assert run.changes.count() == 2
    again = ledger.begin(first)  # the first run died before its commit
    assert again.changes.count() == 2
    assert again.commit() == 1
    with pytest.raises(RuntimeError):
        run.commit()  # it was only slow, not dead
    second = states(spark, [("a", 1, 2, 1, False, "2"), ("b", 1, 1, 1, False, "1"), ("c", 1, 1, 1, False, "1")])
    run = ledger.begin(second)
    assert {(r["k"], r["change"]) for r in run.changes.collect()} == {("a", "changed"), ("c", "new")}
    run.abandon()
    run = ledger.begin(second)
    run.commit()
    assert ledger.begin(second).changes.count() == 0
    run = ledger.begin(second.filter("k <> 'c'"), full_snapshot=True)
    assert [(r["k"], r["change"]) for r in run.changes.collect()] == [("c", "deleted")]
    run.commit()
    assert ledger.pointer()["version"] == 3 and ledger.state().filter("deleted").count() == 1


def test_carried(spark):
    revs = spark.createDataFrame([("a", "r1"), ("m", "r1"), ("z", "r1"), ("z", "r2"), ("a", None), ("a", "r3"), ("a", "none")], "external_id string, run_id string")
    runs = spark.createDataFrame([("r1", "m", False, 2), ("r1", "z", False, 1), ("r2", "", True, 1), ("r2", "", True, 1), ("r3", "", False, 1), ("r3", None, None, 0)], "run_id string, last_document string, complete boolean, updated_at int")
    assert rows(incremental.carried(revs, runs, ["external_id"], "external_id")) == [("a", "r1"), ("m", "r1"), ("z", "r2")]


COPY = "c int, k string, v string, m map<string,string>, at int, place string, f0 string, cell int"


def diff(spark, left, right, **options):
    a, b = (spark.createDataFrame([(*r, "p", "q", 1) for r in x], COPY) for x in (left, right))
    fields = {"v": differences.newline_folded(F.col("v")), "m": differences.map_entries_sorted(F.col("m"))}
    return rows(differences.differences(a, b, ["c", "k"], fields, ["at"], ("only right", "only left"), **options))


def test_differences_cases(spark):
    left = [(1, "a", "x\r\ny", {"p": "1", "q": None}, 1), (1, "a", "x\ny", {"q": None, "p": "1"}, 1), (1, "b", None, None, 1), (1, "c", "", {}, 1), (None, None, "n", None, 1), (2, "a", "left", None, 1), (3, "long", "z" * 100_000, None, 1)]
    right = [(1, "a", "x\ry", {"q": None, "p": "1"}, 7), (1, "b", "", None, 1), (1, "c", "", None, 1), (None, None, "n", None, 1), (4, "a", "right", None, 1), (3, "long", "z" * 99_999 + "y", None, 1)]
    assert diff(spark, left, right) == sorted([(1, "b", "v"), (1, "c", "m"), (2, "a", "only left"), (3, "long", "v"), (4, "a", "only right")], key=repr)
    assert diff(spark, [], []) == [] and diff(spark, left[:1], []) == [(1, "a", "only left")] and diff(spark, [], left[:1]) == [(1, "a", "only right")]
    assert diff(spark, left, left) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_against_brute_force(spark, seed):
    r = random.Random(seed)
    left = {(r.randrange(5), f"k{i}"): r.choice("abc") for i in range(600)}
    right = {k: (r.choice("abc") if r.random() < 0.05 else v) for k, v in left.items() if r.random() > 0.02} | {(9, f"n{i}"): "x" for i in range(5)}
    expected = [(*k, "only left") for k in left if k not in right] + [(*k, "only right") for k in right if k not in left] + [(*k, "v") for k in left if k in right and left[k] != right[k]]
    as_rows = lambda d: [(*k, v, None, 1) for k, v in d.items()]
    assert diff(spark, as_rows(left), as_rows(right), leaf_rows=2) == sorted(expected, key=repr)


FEED = "k string, o int, op string, a string, b int, place int, reset string, chunk int"


def applied(spark, changes, base=None, partial=True, chunk=True):
    feed = spark.createDataFrame([(*c, 1, "r", 2) for c in changes], FEED)
    composed = changefeed.compose(feed, ["k"], [F.col("o")], F.col("op"), ["a", "b"], F.col("o") % 3 if chunk else None, partial)
    b = None if base is None else spark.createDataFrame(base, "k string, a string, b int")
    return rows(changefeed.apply_to(b, composed, ["k"], ["a", "b"], partial))


def by_hand(changes, base=()):
    state = {k: [a, b] for k, a, b in base}
    for k, o, op, a, b in sorted({c for c in changes if c[2] in ("put", "patch", "delete")}, key=lambda c: -1 if c[1] is None else c[1]):
        if op == "put":
            state[k] = [a, b]
        elif op == "delete":
            state.pop(k, None)
        else:
            old = state.get(k, [None, None])
            state[k] = [old[0] if a is None else a, old[1] if b is None else b]
    return sorted(((k, *v) for k, v in state.items()), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_change_feed_against_replay(spark, seed):
    r = random.Random(seed)
    orders = list(range(300))
    r.shuffle(orders)
    changes = [(r.choice(["hot", "hot", "a", "b", None]), o, r.choice(["put", "patch", "patch", "delete", "noise", None]), r.choice(["x", "y", None]), r.choice([1, 2, None])) for o in orders]
    changes += r.sample(changes, 80)
    base = [("hot", "base", 0), ("only base", "keep", 5), ("b", None, None)]
    assert applied(spark, changes, base) == by_hand(changes, base)
    assert applied(spark, changes) == by_hand(changes) == applied(spark, changes, chunk=False)
    full = [c for c in changes if c[2] != "patch"]
    assert applied(spark, full, partial=False) == by_hand(full)


def test_change_feed_edges(spark):
    assert applied(spark, []) == [] and applied(spark, [], [("a", "x", 1)]) == [("a", "x", 1)]
    assert applied(spark, [("a", None, "put", "n", 1), ("a", 0, "put", "z", 2)]) == [("a", "z", 2)]
    assert applied(spark, [("a", 1, "delete", None, None), ("a", 1, "put", "z", 2)]) == applied(spark, [("a", 1, "put", "z", 2), ("a", 1, "delete", None, None)])
    assert applied(spark, [("a", 1, "put", "l" * 200_000, 2)])[0][1] == "l" * 200_000


def test_positions(spark):
    r = random.Random(3)
    data = [(r.choice(["g", "g", "h", None]), r.randrange(50), r.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, x int, w int")
    got = ranking.positions(df, ["g"], F.col("x") / 10, [F.col("x"), F.col("w")], "pos", "w", "until")
    for g in ("g", "h", None):
        own = sorted((x, w) for y, x, w in data if y == g)
        mine = sorted((row["pos"], row["x"], row["w"], row["until"]) for row in got.collect() if row["g"] == g)
        assert [m[0] for m in mine] == list(range(1, len(own) + 1)) and [(m[1], m[2]) for m in mine] == own
        assert [m[3] for m in mine] == [sum(w for _, w in own[: i + 1]) for i in range(len(own))]


def test_levels_of_ranges(spark):
    """Ranges are cut level by level; equal copies end at the first one."""
    rows_ = [(i, f"k{i}", i % 7) for i in range(3000)]
    left = spark.createDataFrame(rows_, "c long, k string, v int")
    right = spark.createDataFrame([(c, k, v + (c in (5, 1700))) for c, k, v in rows_ if c != 2999], "c long, k string, v int")
    prints = [differences.fingerprints(differences._prepared(d, ["c", "k"], {"v": F.col("v")}, []), 2, 1, 0) for d in (left, right)]
    found, n, shift = differences.unequal_ranges(*prints, 3000, 1, first_bits=2, step_bits=3)
    assert n == 3 and shift == differences._LINE_BITS - 12
    _, n, shift = differences.unequal_ranges(prints[0], prints[0], 3000, 1, first_bits=2, step_bits=3)
    assert n == 0 and shift == differences._LINE_BITS - 2
    got = differences.differences(left, right, ["c", "k"], {"v": F.col("v")}, [], ("only right", "only left"))
    assert sorted(rows(got)) == [(5, "k5", "v"), (1700, "k1700", "v"), (2999, "k2999", "only left")]


def test_ledger_writes_only_what_changed(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", ["k"])
    frame = lambda *r: spark.createDataFrame(list(r), "k int, deleted boolean, digest string")
    state = {}
    for n in range(20):
        change = frame(*[(i, i == n - 1, f"{n}-{i}") for i in (n, max(0, n - 1))] if n else [(0, False, "0-0")])
        run = ledger.begin(change.dropDuplicates(["k"]))
        got = rows(run.changes.select("k", "deleted", "digest"))
        run.commit()
        state |= {k: (k, d, h) for k, d, h in got}
        if n == 3:
            assert [spark.read.parquet(p).count() for p in ledger.pointer()["state"]] == [1, 2, 2, 2]
    assert ledger.pointer()["version"] == 20 and len(ledger.pointer()["state"]) <= ledger.SEGMENTS
    assert rows(ledger.state()) == sorted(state.values(), key=repr)


def test_running_max(spark):
    r = random.Random(9)
    data = [(r.choice(["hot", "hot", "a", None]), r.randrange(500), i, r.randrange(100)) for i in range(600)]
    got = ranking.running_max(spark.createDataFrame(data, "g string, t long, i int, v int"), ["g"], F.col("t"), [F.col("i")], "v", "before", 16)
    want = []
    for x in data:
        earlier = [y[3] for y in data if y[0] == x[0] and (y[1], y[2]) < (x[1], x[2])]
        want.append((*x, max(earlier) if earlier else None))
    assert rows(got) == sorted(want, key=repr)
    assert ranking.running_max(spark.createDataFrame([], "g string, t long, v int"), ["g"], F.col("t"), [], "v", "before").count() == 0
