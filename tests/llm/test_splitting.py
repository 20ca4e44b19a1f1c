import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import splitting
from tests.conftest import rows


def joined(pieces, data):
    return b"".join(data[p["new_byte"] : p["end_byte"]] for p in pieces)


def check(text, limit, overlap):
    data = splitting.normalised(text)
    pieces = splitting.split_text(text, limit, overlap)
    lines = data.split(b"\n")
    assert joined(pieces, data) == data
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert b["start_byte"] <= b["new_byte"] == a["end_byte"] and b["start_byte"] > a["start_byte"]
        assert b["start_line"] <= a["end_line"] + 1 or b["new_byte"] > 0
    for p in pieces:
        assert p["end_byte"] - p["start_byte"] <= limit and len(p["text"].encode("utf-8", "surrogatepass")) <= limit + 4
        assert 0 <= p["start_line"] <= p["end_line"] < len(lines)
        assert data[: p["start_byte"]].count(b"\n") == p["start_line"]
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list("ab .!?\n\r\t#éß漢🌲。") + ["# ", "\n\n"]), max_size=400).map("".join), st.integers(4, 60), st.integers(0, 3))
def test_any_text(text, limit, overlap):
    check(text, limit, overlap)


def test_boundaries_in_order():
    section = "# One\n" + "word " * 30 + "\n\n"
    pieces = check(section * 4, 200, 0)
    assert [p["level"] for p in pieces] == ["section"] * 4
    paragraphs = "\n\n".join("para " * 10 for _ in range(10))
    assert {p["level"] for p in check(paragraphs, 120, 0)[:-1]} == {"paragraph"}
    assert {p["level"] for p in check("A sentence here. " * 30, 60, 0)[:-1]} == {"sentence"}
    assert {p["level"] for p in check("word " * 60, 50, 0)[:-1]} == {"word"}
    assert {p["level"] for p in check("x" * 300, 50, 0)[:-1]} == {"character"}


def test_overlap_lines():
    text = "\n".join(f"line number {i}" for i in range(100))
    pieces = check(text, 200, 2)
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert b["start_line"] == a["end_line"] - 1 and b["text"].split("\n")[:2] == a["text"].split("\n")[-2:]


def test_long_lines_are_repeated_too():
    """Lines of more than half of the limit are repeated whole, as long as one character fits beside them and the piece before has more."""
    text = "\n".join(f"{i} " + "x" * 46 for i in range(10, 50))
    pieces = check(text, 150, 2)
    for a, b in zip(pieces, pieces[1:], strict=False):
        lines = a["text"].split("\n")
        want = min(2, len(lines) - 1)
        assert b["repeated_lines"] >= min(want, 1) and b["text"].startswith("\n".join(lines[len(lines) - b["repeated_lines"] :]))
    assert all(p["repeated_lines"] == 2 for p in pieces[1:])
    one = check("y" * 500 + "\nend", 100, 2)
    assert [p["repeated_lines"] for p in one][:4] == [0, 0, 0, 0]


def test_ten_megabyte_line():
    import time

    began = time.time()
    pieces = splitting.split_text("a" * 10_000_000 + "\n" + "b c " * 100_000, 1600, 2)
    assert pieces[-1]["end_byte"] == 10_400_001 and time.time() - began < 20


def test_long_runs():
    long = "\n".join("x" * 50 for _ in range(10))
    pieces = splitting.split_text(f"a\n\n{long}\n \t\nshort\r\n\r\n# H\n{long}", 300, 1)
    assert [r for p in pieces for r in p["long_runs"]] == [{"start_line": 2, "end_line": 11}, {"start_line": 15, "end_line": 25}]


SCHEMA = "c long, k string, body string, ordinal int, k0 string, t string, level string"


def split(spark, data, **options):
    df = spark.createDataFrame([(*d, 9, "x", "y", "z") for d in data], SCHEMA)
    return splitting.split_documents(df, ["c", "k"], "body", 100, 1, **options)


def test_documents(spark):
    big = "one two three. " * 20
    data = [(1, "a", big), (1, "a", big), (None, None, big), (2, "null", None), (2, "empty", ""), (2, "small", "x"), (2, "crlf", "\r\n" * 70), (3, "huge", "word " * 200_000)]
    got = split(spark, data)
    keys = {(r["c"], r["k"]) for r in got.select("c", "k").distinct().collect()}
    assert keys == {(1, "a"), (None, None), (3, "huge")}
    assert got.filter("k = 'a'").count() == len(splitting.split_text(big, 100, 1))
    assert split(spark, data, whole=True).filter("k = 'small'").first()["text"] == "x"
    assert rows(split(spark, [])) == []
    with pytest.raises(ValueError):
        splitting.split_documents(spark.createDataFrame([], SCHEMA), ["k"], "body", 3)


def test_linear_time():
    import time

    r = random.Random(1)
    text = " ".join("w" * r.randrange(1, 12) for _ in range(400_000))
    began = time.time()
    assert len(splitting.split_text(text, 1600, 2)) > 1000
    assert time.time() - began < 10


def test_long_runs_come_from_the_cuts(monkeypatch):
    r = random.Random(5)
    scan, found = splitting.oversized_runs, 0
    for _ in range(300):
        text = "".join(r.choice(["word ", "a. ", "é", "\n", "\n", " \t\n", "\n\n", "# h\n", "x" * 30]) for _ in range(r.randrange(200)))
        data = splitting.normalised(text)
        starts = [0, *[i + 1 for i, c in enumerate(data) if c == 10]]
        want = scan(data, starts, 48)
        with monkeypatch.context() as m:
            m.setattr(splitting, "oversized_runs", lambda *a: [])
            pieces = splitting.split_text(text, 48, r.randrange(3))
        assert [(x["start_line"], x["end_line"]) for p in pieces for x in p["long_runs"]] == want
        assert all(p["new_byte"] <= starts[x["start_line"]] < p["end_byte"] for p in pieces for x in p["long_runs"])
        found += len(want)
    assert found > 100 and splitting.entered_runs(b"x" * 60, [0], [], 48) == []
