import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.errors import EngineError
from siftwell.functions import chunking, filters, hashing, text, vectors
from tests.conftest import rows

STEMS = """caresses caress ponies poni agreed agre hopping hop filing file happy happi relational relat conditional condition rational ration
nation nation adoption adopt vision vision decision decision retrieval retriev generalization gener electrical electr goodness good
adjustment adjust replacement replac controlling control databases databas dont dont x1 x1""".split()


@pytest.mark.parametrize("word,stem", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stem(word, stem):
    assert text.stem(word) == stem


def test_stem_of_anything():
    for w in ("", "a", "s", "ss", "ed", "eed", "ing", "bed", "sing", "sky", "y", "yyy", "tion", "ation", "ll", "e", "123", "ies"):
        assert isinstance(text.stem(w), str)


def test_fnv():
    assert hashing.hex16(hashing.fnv1a([b"", b"a", b"alpha"])) == ["14650fb0739d0383", "44bd8ad473cd9906", "5acb56cc7a626865"]
    assert len(hashing.fnv1a([])) == 0


def test_keys_and_hashes(spark):
    df = spark.createDataFrame([("docs/south", 0, 0, "alpha harbor"), ("docs/north", 0, 0, "alpha orchard"), ("docs/north", 1, 1, "shared guide")], "d string, a int, b int, t string")
    got = [r[0] for r in df.select(hashing.stable_chunk_key(F.col("d"), F.col("a"), F.col("b"), F.col("t"))).collect()]
    assert got == ["chk_47dab79789ab2d8a", "chk_5583ba9912e902a1", "chk_70af86446fd77893"]
    one = spark.createDataFrame([("South", "alpha harbor", {"tenant": "south"})], "t string, c string, m map<string,string>")
    assert one.select(hashing.content_hash(F.col("t"), F.col("c"), F.col("m"))).first()[0] == "fnv1a64:71942e7f9fb8d3f4"


def test_tokens(spark):
    df = spark.createDataFrame([("Don't STOP the café x Kelvin a1",), (None,), ("",), ("y" * 41 + " ok",)], "t string")
    got = [r[0] for r in df.select(text.tokens(F.col("t"))).collect()]
    assert got == [["dont", "stop", "caf", "elvin", "a1"], [], [], ["ok"]]


def test_hash_embedding():
    e = vectors.HashEmbedder(16).embed(["alpha harbor", "", "..."])
    expected = np.zeros(16)
    expected[[0, 1, 5]] = [-1 / 3, -2 / 3, 2 / 3]
    assert np.allclose(e[0], expected, atol=1e-6)
    assert np.allclose(np.linalg.norm(e, axis=1), 1)


def test_embedder_checks(spark):
    class Broken:
        dimension, identity = 4, "broken"

        def embed(self, texts):
            return np.zeros((len(texts), 3))

    with pytest.raises(Exception, match="embedder returned"):
        vectors.embedded(spark.createDataFrame([("a",)], "t string"), "t", Broken()).collect()


def test_vector_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [0.5, 9.0])], "a array<float>, b array<float>")
    got = [tuple(round(x, 6) for x in r) for r in df.select(vectors.dot(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (0.6, 0.6) and got[1] == (0.0, 0.0) and got[2][0] == 0.5
    faults = spark.createDataFrame([([1.0, 0.0],), ([1.0],), (None,), ([float("nan"), 0.0],), ([2.0, 0.0],)], "v array<float>")
    assert [r[0] for r in faults.select(vectors.vector_fault(F.col("v"), 2)).collect()] == [None, "dimension", "null", "not_finite", "not_unit"]
    q = spark.createDataFrame([([0.5 / 127, -0.5 / 127, 2.0, -2.0],)], "v array<double>").select(vectors.quantize_sq8(F.col("v"))).first()[0]
    assert q == [1, -1, 127, -127]
    t = df.select(vectors.parsed_vector(vectors.vector_text(F.col("b")))).collect()
    assert [round(x, 5) for x in t[0][0]] == [0.6, 0.8]


def test_chunks_within_the_limit():
    o = chunking.ChunkOptions(max_lines=20, target_tokens=10, max_tokens=12, overlap_tokens=2)
    c = chunking.chunk_text("# H\nalpha beta gamma\n\U0001f332 delta epsilon\nlast", o)
    assert c == chunking.chunk_text("# H\r\nalpha beta gamma\r\U0001f332 delta epsilon\nlast", o)
    assert all(len(x["text"].encode()) <= 12 for x in c) and c[0]["start_line"] == 0 and c[-1]["end_line"] == 3
    o = chunking.ChunkOptions(heading_context=False, target_tokens=9, max_tokens=12, overlap_tokens=2)
    c = chunking.chunk_text("alpha beta gamma delta epsilon\r\n" + "\U0001f332" * 3, o)
    assert len(c) > 2 and all(len(x["text"].encode()) <= 12 for x in c) and {x["end_line"] for x in c} <= {0, 1}


def test_chunk_context_and_overlap():
    lines = [f"line {i}" for i in range(10)]
    c = chunking.chunk_text("\n".join(lines), chunking.ChunkOptions(max_lines=4, overlap_lines=1))
    assert [(x["start_line"], x["end_line"]) for x in c] == [(0, 3), (3, 6), (6, 9)]
    c = chunking.chunk_text("# A\n## B ##\ntext\n# C\nmore", chunking.ChunkOptions(max_lines=1, overlap_lines=0))
    assert [x["context"] for x in c] == ["A", "A › B", "A › B", "C", "C"]
    assert chunking.chunk_text(None) == [] and chunking.chunk_text("") == [] and chunking.chunk_text("\n \n") == []


def test_chunk_long_line_and_measure():
    o = chunking.ChunkOptions(max_chars=20, overlap_lines=0)
    c = chunking.chunk_text("One sentence. Another one here, and more " + "x" * 50, o)
    assert all(len(x["text"]) <= 20 for x in c) and c[0]["text"] == "One sentence."
    words = chunking.ChunkOptions(max_tokens=3, measure=lambda t: len(t.split()), heading_context=False)
    assert all(len(x["text"].split()) <= 3 for x in chunking.chunk_text("a b c d e f g\nh i j", words))


def test_fingerprint():
    a, b = chunking.ChunkOptions(max_tokens=10), chunking.ChunkOptions(max_tokens=10, reserved_tokens=2)
    assert a.fingerprint != b.fingerprint and a.limit == 10 and b.limit == 8


FILTERS = [
    (None, {"tenant": "north"}, True),
    ({}, {"tenant": "north"}, False),
    ({"tenant": []}, {"tenant": "north"}, False),
    ({"tenant": ["north"], "visibility": ["team"]}, {"tenant": "north", "visibility": "team", "kind": "guide"}, True),
    ({"tenant": ["north"], "visibility": ["team"]}, {"tenant": "north", "visibility": "private"}, False),
    ({"tenant": ["north"], "visibility": ["team"]}, {"tenant": "north"}, False),
    ({"tenant": ["south", "north", "north"], "visibility": ["team"]}, {"tenant": "south", "visibility": "team"}, True),
    ({"tenant": ["south", "north", "north"], "visibility": ["team"]}, {"visibility": "team"}, False),
    ({"tenant": ["north"]}, None, False),
]


def test_filters(spark):
    for wanted, metadata, expected in FILTERS:
        df = spark.createDataFrame([(metadata, wanted)], "m map<string,string>, w map<string,array<string>>")
        f = None if wanted is None else filters.MetadataFilter(wanted)
        assert df.select(filters.matches(F.col("m"), f), filters.matches_row(F.col("m"), F.col("w"))).first()[:] == (expected, expected)
    for bad in ({"a": [1]}, {"a": [str(i) for i in range(257)]}, {str(i): [str(j) for j in range(256)] for i in range(5)}):
        with pytest.raises(EngineError):
            filters.MetadataFilter(bad)


def test_tag_faults(spark):
    cases = [({"a": "b"}, None), ({}, None), ({"": "b"}, "key"), ({"k" * 129: "b"}, "key"), ({"a": "v" * 4097}, "value"), ({f"k{i}": "v" for i in range(65)}, "tags"), ({f"k{i}": "v" * 4000 for i in range(20)}, "total")]
    df = spark.createDataFrame([(m,) for m, _ in cases], "m map<string,string>")
    assert [r[0] for r in df.select(filters.tag_fault(F.col("m"))).collect()] == [x for _, x in cases]


def test_line_chunks(spark):
    df = spark.createDataFrame([("d", "a\r\n \n\nb  "), ("e", None)], "doc_key string, content string")
    assert rows(chunking.line_chunks(df)) == [("d", 0, "a"), ("d", 3, "b")]
