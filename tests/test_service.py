import json

import pytest

from siftwell import evaluate, migrate, schema
from siftwell.errors import EngineError
from siftwell.functions.register import register
from siftwell.functions.vectors import HttpEmbedder
from siftwell.operators import dense, lexical
from siftwell.service import Service
from siftwell.sources import payloads, sidecar
from siftwell.sources.store import prepare
from tests.conftest import rows
from tests.test_retrieval import CORPUS


def doc(key, content, **metadata):
    return json.dumps({"id": key, "title": key, "content": content, "metadata": metadata})


def test_service(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/store", queue=2)
    code, job = s.ingest(doc("a", "shared permission marker terminal setup", sensitivity="general"))
    assert code == 201 and s.job(job["job_id"])[1]["status"] == "ready"
    assert s.ingest(doc("a", "shared permission marker terminal setup", sensitivity="general"))[0] == 200
    assert s.ingest(doc("b", "shared permission marker terminal setup", sensitivity="restricted"), True)[0] == 202
    first = s.waiting["b"][0]
    assert s.ingest(doc("b", "shared permission marker terminal setup", sensitivity="restricted"), True)[1]["job_id"] == first.job_id
    assert s.ingest(doc("b", "shared permission marker terminal setup again", sensitivity="restricted"), True)[0] == 202 and first.status == "superseded"
    assert s.ingest(doc("c", "x"), True)[0] == 202 and s.ingest(doc("d", "x"), True)[0] == 503
    assert s.delete("c")[0] == 200 and s.run_queue() == 1
    for mode in ("hybrid", "lexical", "dense"):
        code, out = s.search(json.dumps({"query": "permission marker", "mode": mode, "filter": {"sensitivity": "general"}}))
        assert code == 200 and [r["document_id"] for r in out["results"]] == ["a"] and out["filter_ack"] == {"sensitivity": ["general"]}
    assert s.search(json.dumps({"query": "permission marker", "filter": {}}))[1]["results"] == []
    assert len(s.search(json.dumps({"query": "permission marker"}))[1]["results"]) == 2
    assert s.delete("a")[0] == 200 and s.delete("nothing")[0] == 404 and s.job("nothing")[0] == 404
    assert [r["document_id"] for r in s.search(json.dumps({"query": "permission"}))[1]["results"]] == ["b"]
    for bad in ("x", "{}", '{"id": "a\\u0001", "content": "c"}', '{"id": "a"}', doc("k", "c", **{"x" * 129: "v"})):
        assert s.ingest(bad)[0] == 400
    assert s.search("{}")[0] == 400


def test_a_service_started_again_takes_up_its_jobs(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    s = Service(spark, path)
    done = s.ingest(doc("a", "alpha text"))[1]["job_id"]
    old = s.ingest(doc("b", "first"), True)[1]["job_id"]
    new = s.ingest(doc("b", "second"), True)[1]["job_id"]
    published = s.ingest(doc("c", "gamma text"), True)[1]
    d = s.waiting.pop("c")
    s.store.activate(*prepare(spark.createDataFrame([("c", d[0].revision, "c", "gamma text", {})], "doc_key string, revision long, title string, content string, metadata map<string,string>"), s.options, s.embedder))  # published, then the service died
    again = Service(spark, path)
    status = {j: again.job(j)[1]["status"] for j in (done, old, new, published["job_id"])}
    assert status == {done: "ready", old: "superseded", new: "queued", published["job_id"]: "ready"}
    assert again.run_queue() == 1 and again.job(new)[1]["status"] == "ready"
    assert rows(again.store.table("documents").select("doc_key", "content")) == [("a", "alpha text"), ("b", "second"), ("c", "gamma text")]
    assert Service(spark, path).waiting == {}


def test_kept_indexes(spark, tmp_path, monkeypatch):
    """The second service opens the indexes of the first; searches go through the lists when asked for."""
    path = f"file://{tmp_path}/store"
    s = Service(spark, path, algorithm="ivf")
    for i in range(3):
        s.ingest(doc(f"d{i}", f"passage number {i} about harbours"), True)
    assert s.run_queue() == 3
    one = s.search(json.dumps({"query": "harbours passage"}))[1]
    assert len(one["results"]) == 3 and isinstance(s.corpus().dense, dense.ListIndex)
    monkeypatch.setattr(dense.InvertedLists, "fit", lambda *a, **k: pytest.fail("built again"))
    monkeypatch.setattr(lexical, "build", lambda *a, **k: pytest.fail("built again"))
    assert Service(spark, path, algorithm="ivf").search(json.dumps({"query": "harbours passage"}))[1] == one


def test_failed_embedding_keeps_the_old_revision(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/store")
    s.ingest(doc("a", "first text"))
    s.embedder = HttpEmbedder(lambda body: '{"data": []}', s.embedder.dimension, s.embedder.identity)
    code, job = s.ingest(doc("a", "second text"))
    assert code == 503 and job["status"] == "failed" and s.store.table("documents").first()["content"] == "first text"


def test_http_embedder_checks_order():
    def transport(body):
        texts = json.loads(body)["input"]
        return json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(texts)))]})

    assert HttpEmbedder(transport, 2, "x", 2).embed(["a", "bb", "ccc"])[:, 0].tolist() == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        HttpEmbedder(transport, 3, "x").embed(["a"])


def test_sql_functions(spark):
    register(spark, dimension=4)
    r = spark.sql("SELECT porter_stem('ponies') AS s, fnv1a64('a') AS h, size(hash_embed('a b')) AS d").first()
    assert (r["s"], r["h"], r["d"]) == ("poni", "44bd8ad473cd9906", 4)
    assert spark.sql("SELECT * FROM chunk_document('# H\ntext')").first()["context"] == "H"


def test_schema(spark):
    spark.sql("DROP DATABASE IF EXISTS siftwell_test CASCADE")
    try:
        assert schema.create_tables(spark, "siftwell_test") == schema.create_tables(spark, "siftwell_test") == 1
        assert spark.table("siftwell_test.schema_migrations").count() == 1
        assert schema.layout_faults(spark.table("siftwell_test.chunks"), "chunks") == []
        assert schema.layout_faults(spark.range(1), "terms") == ["term: missing instead of string", "df: missing instead of bigint"]
        spark.sql("INSERT INTO siftwell_test.schema_migrations VALUES (9, current_timestamp())")
        with pytest.raises(EngineError):
            schema.create_tables(spark, "siftwell_test")
    finally:
        spark.sql("DROP DATABASE siftwell_test CASCADE")


def test_sidecar_is_rebuilt_for_other_vectors(spark, tmp_path):
    v = payloads.synthetic_vectors(spark, 50, 4)
    built = []

    def build(d):
        built.append(1)
        return d.select("key")

    for d in (v, v.repartition(3), v.filter("key > 0")):
        assert sidecar.cached(f"{tmp_path}/index", d, build).count() == d.count()
    assert len(built) == 2


def test_score_chunks(spark):
    df = spark.createDataFrame([c[:1] + c[5:6] for c in CORPUS], "chunk_key string, text string")
    index = lexical.build(df, "chunk_key", "text")
    terms = lexical.query_terms(spark.createDataFrame([(1, "alpha alpha shared")], "q int, t string"), "q", "t", index.options)
    got = lexical.score_chunks(index, terms, spark.createDataFrame([(1, "c2"), (1, "c1"), (1, "none")], "query_id int, chunk_key string"))
    assert [(k, round(s, 6)) for _, k, s in rows(got)] == [("c1", 0.940007), ("c2", 0.980829), ("none", 0.0)]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "q.json").write_text(json.dumps({"documents": [{"id": "a", "text": "storage of generations", "metadata": {"s": "g"}}, {"id": "b", "text": "ranking of passages", "metadata": {"s": "r"}}], "queries": [{"text": "storage generations", "relevant": ["a"]}, {"text": "ranking", "relevant": ["b"], "filter": {"s": ["r"]}}]}))
    evaluate.main(["qrels", str(tmp_path / "q.json"), "--dimension", "64", "--k", "3", "--report", str(tmp_path / "r.json")])
    figures = json.loads((tmp_path / "r.json").read_text())
    assert figures["balanced"]["mrr"] == 1.0 and set(figures) == {"efficiency", "balanced", "quality"}
    evaluate.main(["dense", "--rows", "2000", "--dimension", "32", "--queries", "20"])
    evaluate.main(["runtime", "--rows", "500", "--dimension", "16", "--queries", "5"])
    out = capsys.readouterr().out
    assert '"filtered ivf"' in out and '"10 % delta"' in out
    s = Service(spark, f"file://{tmp_path}/a")
    s.ingest(doc("a", "text"))
    migrate.main([f"file://{tmp_path}/a", f"file://{tmp_path}/b", "--report", str(tmp_path / "m.json")])
    assert json.loads((tmp_path / "m.json").read_text())["documents"] == 1


def test_qrels_filter_before_the_search(spark, tmp_path):
    many = [{"id": f"x{i}", "text": "storage generations", "metadata": {"s": "x"}} for i in range(130)]
    few = [{"id": "y", "text": "storage of many other things that are said at some length", "metadata": {"s": "y"}}, {"id": "z", "text": "ranking", "metadata": {"s": "y"}}]
    queries = [{"text": "storage generations", "relevant": ["y"], "filter": {"s": ["y"]}}, {"text": "ranking", "relevant": ["z"]}, {"text": "ranking", "relevant": ["z"], "filter": {}}]
    (tmp_path / "q.json").write_text(json.dumps({"documents": many + few, "queries": queries}))
    figures = evaluate.run_qrels(spark, str(tmp_path / "q.json"), 1, 64)
    assert all(abs(f["recall"] - 2 / 3) < 1e-9 and abs(f["mrr"] - 2 / 3) < 1e-9 for f in figures.values())
