import json

import pytest
from pyspark.sql import functions as F

from siftwell.errors import EngineError
from siftwell.functions.chunking import ChunkOptions
from siftwell.functions.vectors import HashEmbedder
from siftwell.operators import lexical, migration
from siftwell.sources import jobs
from siftwell.sources.store import MaintenancePolicy, Store, prepare
from siftwell.streaming import ingest
from tests.conftest import rows

DOC = "doc_key string, revision long, title string, content string, metadata map<string,string>"
OPTIONS, EMBEDDER = ChunkOptions(max_lines=1, overlap_lines=0), HashEmbedder(16)


def prepared(spark, *docs):
    return prepare(spark.createDataFrame(list(docs), DOC), OPTIONS, EMBEDDER)


NORTH, SOUTH = ("docs/north", 1, "North", "alpha orchard\nshared guide", {"tenant": "north"}), ("docs/south", 1, "South", "alpha harbor", {"tenant": "south"})


def found(spark, store, query):
    index = lexical.build(store.table("chunks"), "chunk_key", "indexed_text")
    q = spark.createDataFrame([(1, query)], "query_id int, text string")
    return lexical.search(index, q, "query_id", "text", 10).count()


def test_contract(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.generation == 0 and store.table("chunks").count() == 0
    store.activate(*prepared(spark, NORTH, SOUTH))
    pinned = store.generation
    assert store.table("chunks").count() == 3 and found(spark, store, "orchard") == 1
    assert rows(store.activate(*prepared(spark, NORTH)))[0][2] == "unchanged" and store.generation == pinned
    store.activate(*prepared(spark, ("docs/north", 2, "North v2", "replacement cedar", {"tenant": "north"})))
    assert found(spark, store, "orchard") == 0 and found(spark, store, "cedar") == 1
    assert store.table("chunks", pinned).count() == 3  # readers of the old generation see the old state
    with pytest.raises(EngineError, match="already_exists"):
        store.activate(*prepared(spark, NORTH))
    docs, chunks = prepared(spark, ("docs/east", 1, "East", "alpha estuary\nsecond", {}))
    before = store.generation
    with pytest.raises(EngineError, match="embeddings"):
        store.activate(docs, chunks.withColumn("embedding", F.when(F.col("ordinal") == 0, F.col("embedding"))))
    with pytest.raises(EngineError, match="mix"):
        store.activate(*prepare(spark.createDataFrame([("docs/east", 1, "E", "x", {})], DOC), ChunkOptions(max_lines=2), EMBEDDER))
    assert store.generation == before
    gone = spark.createDataFrame([("docs/north", 3)], "doc_key string, revision long")
    assert rows(store.erase(gone)) == [("docs/north", 3, True)] and rows(store.erase(gone)) == [("docs/north", 3, False)]
    with pytest.raises(EngineError):
        store.activate(*prepared(spark, ("docs/north", 2, "back", "again", {})))
    assert rows(store.table("revisions").select("doc_key", "revision", "deleted")) == [("docs/north", 3, True), ("docs/south", 1, False)]


def test_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    base = store.manifest()
    store.activate(*prepared(spark, NORTH))
    with pytest.raises(EngineError, match="another writer"):
        store._publish(base, {}, 0)


def test_fetch_stats_compact_checkpoint(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.activate(*prepared(spark, NORTH, SOUTH))
    keys = [r["chunk_key"] for r in store.table("chunks").orderBy("text").collect()]
    wanted = spark.createDataFrame([(keys[2], 0), ("unknown", 1), (keys[0], 2)], "chunk_key string, ordinality int")
    assert [r["chunk_key"] for r in store.fetch(wanted).collect()] == [keys[2], keys[0]]
    assert "embedding" not in store.fetch(wanted).columns and "text" not in store.fetch(wanted, text=False, embedding=True).columns
    s = store.stats().first()
    assert (s["documents"], s["chunks"], s["base"], s["delta"], s["dimension"]) == (2, 3, 0, 3, 16)
    assert store.compact() is False and store.compact(override_budget=True) is True
    assert store.stats().first()["base"] == 3
    store.erase(spark.createDataFrame([("docs/south", 2)], "doc_key string, revision long"))
    assert store.stats().first()["tombstones"] == 1 and store.compact() is True and store.stats().first()["tombstones"] == 0
    n = store.checkpoint(f"file://{tmp_path}/copy")
    assert Store(spark, f"file://{tmp_path}/copy").generation == n


def test_maintenance_policy():
    p = MaintenancePolicy()
    assert p.required(0, 2000, 0, 4) and not p.required(0, 1999, 0, 4) and p.required(100, 10, 0, 4) and not p.required(100, 9, 9, 4) and p.required(100, 0, 10, 4) and p.required(10**6, 0, 0, 384)


def test_migration_resumes(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    a.activate(*prepared(spark, *[(f"d{i:02}", 1, f"t{i}", f"text {i}", {}) for i in range(7)]))
    source, destination = migration.StoreEndpoint(a), migration.StoreEndpoint(b)
    part = migration.keyset_batch(source.documents(), "doc_key", None, 3)
    destination.write(part, source.chunks().join(part.select("doc_key"), "doc_key", "left_semi"))
    report = migration.migrate(source, destination, 2)
    assert report.documents == 7 and report.resumed_after == "d02" and report.batches == 2 and json.loads(report.to_json())["documents"] == 7
    assert migration.migrate(source, destination, 2).batches == 0
    b.activate(*prepared(spark, ("extra", 1, "x", "y", {})))
    with pytest.raises(EngineError, match="extra"):
        migration.migrate(source, destination)


def test_audits(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "k string, v int")
    x = migration.audit(df, ["k"], ["v"]).first()
    assert x["documents"] == 2 and x == migration.audit(df.orderBy(F.desc("k")), ["k"], ["v"]).first()
    assert x != migration.audit(df.fillna({"v": 0}), ["k"], ["v"]).first()
    s = spark.createDataFrame([(1, "a", 0.5)], "query_id int, key string, score double")
    assert migration.sampled_search_equality(s, s.withColumn("score", F.col("score") + 1e-6)).count() == 0
    assert migration.sampled_search_equality(s, s.withColumn("score", F.col("score") + 1e-3)).count() == 1


CHANGE = "doc_key string, operation string, revision long, title string, content string, metadata map<string,string>, updated_at_ms long"


def test_apply_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    batch = lambda *r: ingest.apply_batch(store, spark.createDataFrame(list(r), CHANGE))
    assert batch(("a", " UPSERT", 1, "t", "one", {}, 1), ("a", "upsert", 2, "t", "two", {}, 2), ("b", "upsert", 1, "t", "b", {}, 1), (None, "upsert", 1, "t", "b", {}, 1), ("z", "rename", 1, "t", "b", {}, 1)) == {"indexed": 2}
    assert batch(("a", "upsert", 2, "t", "two", {}, 2), ("b", "upsert", 0, "t", "old", {}, 1)) == {"unchanged": 1, "stale": 1}
    assert batch(("b", "erase", 4, None, None, None, 1), ("b", "upsert", 3, "t", "x", {}, 9)) == {"erased": 1}
    assert batch(("b", "upsert", 3, "t", "late", {}, 9)) == {"stale": 1}
    assert rows(store.table("documents").select("doc_key", "revision", "content")) == [("a", 2, "two")]


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"doc_key": f"d{i % 5}", "operation": "erase" if i % 7 == 0 else "upsert", "revision": (i * 13) % 37, "title": "t", "content": f"c{i}", "metadata": {}, "updated_at_ms": i} for i in range(37)]
    (source / "1.json").write_text("\n".join(map(json.dumps, lines[:20])))
    store = Store(spark, f"file://{tmp_path}/store")

    def run():
        q = ingest.ingest(spark, str(source), store, f"{tmp_path}/checkpoint", files_per_batch=1)
        q.processAllAvailable()
        q.stop()

    run()
    (source / "2.json").write_text("\n".join(map(json.dumps, lines[20:])))
    run()
    last = {}
    for x in sorted(lines, key=lambda x: x["revision"]):
        last[x["doc_key"]] = (x["doc_key"], x["revision"], x["operation"] == "erase")
    assert rows(store.table("revisions").select("doc_key", "revision", "deleted")) == sorted(last.values())


JOB = "log_seq long, job_id string, corpus_id long, doc_key string, operation string, revision long, status string, updated_at_ms long"


def test_jobs(spark):
    log = spark.createDataFrame(
        [(1, "a", 1, "d", "upsert", 1, "ready", 10), (2, "b", 1, "d", "upsert", 2, "queued", 11), (3, "b", 1, "d", "upsert", 2, "embedding", 12), (4, "c", 1, "d", "upsert", 1, "chunking", 9), (5, "e", 1, "x", "ERASE ", 4, "ready", 20), (6, "f", 1, "x", "upsert", 3, "ready", 21), (7, None, 1, "x", "upsert", 9, "ready", 22)], JOB
    )
    latest = jobs.latest_snapshots(log)
    assert latest.count() == 5 and latest.filter("job_id = 'b'").first()["status"] == "embedding"
    assert {r["job_id"]: r["action"] for r in jobs.recovered(latest, ["corpus_id", "doc_key"]).collect()} == {"a": "activate", "b": "requeue", "c": "supersede", "e": "erase", "f": "keep"}
    size = F.when(F.col("job_id") == "f", 100).otherwise(10)
    keep = lambda n, b: {r["job_id"] for r in jobs.retained(latest, size, n, b).collect()}
    assert keep(128, 1000) == {"a", "b", "c", "e", "f"} and keep(1, 1000) == {"b", "c", "f"} and keep(2, 50) == {"a", "b", "c", "e"} and keep(5, 15) == {"b", "c", "e"}


def test_restore(spark, tmp_path):
    a = Store(spark, f"file://{tmp_path}/a")
    a.activate(*prepared(spark, NORTH, SOUTH))
    a.checkpoint(f"file://{tmp_path}/saved")
    a.erase(spark.createDataFrame([("docs/south", 2)], "doc_key string, revision long"))
    before = a.generation
    assert a.restore(f"file://{tmp_path}/saved") == before + 1 and a.table("documents").count() == 2
    with pytest.raises(EngineError, match="not_found"):
        a.restore(f"file://{tmp_path}/nothing")


def test_job_log(spark, tmp_path):
    log = jobs.JobLog(spark, f"file://{tmp_path}/log")
    row = lambda seq, job, status, at: (seq, job, 1, "d", "upsert", 1, "h", status, 1, at)
    frame = lambda *r: spark.createDataFrame(list(r), jobs.JobLog.SCHEMA)
    assert log.latest().count() == 0
    log.append(frame(row(1, "a", "queued", 1), row(2, "a", "ready", 2), row(3, "b", "ready", 3)))
    log.append(frame(row(4, "c", "embedding", 4)))
    with pytest.raises(EngineError):
        log.append(frame(row(5, "d", "lost", 5)))
    assert rows(log.latest().select("job_id", "status")) == [("a", "ready"), ("b", "ready"), ("c", "embedding")]
    assert log.compact(max_jobs=1) == 2 and rows(log.latest().select("job_id")) == [("b",), ("c",)]


def test_options_are_checked():
    for bad in (lambda: ChunkOptions(max_chars=-1), lambda: MaintenancePolicy(delta_rows=-1)):
        with pytest.raises(EngineError):
            bad()


def test_chunks_are_embedded_once(spark, tmp_path):
    """Each text of an activation is embedded once, though faults, verdicts and tables read its chunks."""
    log = tmp_path / "calls"

    class Counting(HashEmbedder):
        def embed(self, texts):
            with open(log, "a") as f:
                f.write("".join(f"{t!r}\n" for t in texts))
            return super().embed(texts)

    store = Store(spark, f"file://{tmp_path}/store")
    store.activate(*prepare(spark.createDataFrame([NORTH, SOUTH], DOC), OPTIONS, Counting(16)))
    calls = log.read_text().splitlines()
    assert len(calls) == len(set(calls)) == 3


def test_a_change_writes_only_what_is_new(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.activate(*prepared(spark, *[(f"d{i:03}", 1, "t", f"text {i}", {}) for i in range(50)]))
    store.activate(*prepared(spark, ("d007", 2, "t", "other", {}), ("new", 1, "t", "fresh", {})))
    store.erase(spark.createDataFrame([("d008", 5)], "doc_key string, revision long"))
    m = store.manifest()
    assert [spark.read.parquet(p).count() for p in m["tables"]["documents"]] == [50, 2] and [spark.read.parquet(p).count() for p in m["tables"]["revisions"]] == [50, 2, 1]
    assert store.table("documents").count() == 50 and store.table("chunks").count() == 50 and store.table("revisions").count() == 51
    assert rows(store.table("documents").filter("doc_key IN ('d007', 'd008')").select("doc_key", "content")) == [("d007", "other")]
    before = [rows(store.table(t).drop("delta", "metadata")) for t in ("documents", "chunks", "revisions")]
    assert store.compact(override_budget=True) and store.segments() == 1
    assert [rows(store.table(t).drop("delta", "metadata")) for t in ("documents", "chunks", "revisions")] == before
    assert store.find_by_uri("new").first()["chunks"][0]["text"] == "fresh" and store.find_by_uri("d008").count() == 0


def test_validators(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    docs, chunks = prepared(spark, NORTH)
    for bad, fault in ((docs.withColumn("content_hash", F.lit("fnv1a64:0")), "content_hash"), (docs.withColumn("revision", F.lit(-1).cast("long")), "revision"), (docs.unionByName(docs), "document_key")):
        with pytest.raises(EngineError, match=fault):
            store.activate(bad, chunks)
    with pytest.raises(EngineError, match="norm"):
        store.activate(docs, chunks.withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    with pytest.raises(EngineError, match="chunk_key"):
        store.activate(docs, chunks.withColumn("chunk_key", F.lit("same")))
    assert store.generation == 0


@pytest.mark.parametrize("damage", ["embedding", "text", "metadata"])
def test_a_damaged_copy_fails(spark, tmp_path, damage):
    a = Store(spark, f"file://{tmp_path}/a")
    a.activate(*prepared(spark, NORTH, SOUTH))

    class Damaging(migration.StoreEndpoint):
        def chunks(self):
            c = super().chunks()
            if damage == "embedding":
                return c.withColumn("embedding", F.when(F.col("text") == "alpha harbor", F.reverse("embedding")).otherwise(F.col("embedding")))
            return c.withColumn("text", F.concat("text", F.lit("!"))) if damage == "text" else c

        def documents(self):
            d = super().documents()
            return d.withColumn("metadata", F.create_map(F.lit("tenant"), F.lit("east"))) if damage == "metadata" else d

    with pytest.raises(EngineError, match="differ"):
        migration.migrate(migration.StoreEndpoint(a), Damaging(Store(spark, f"file://{tmp_path}/b")))
    assert migration.migrate(migration.StoreEndpoint(a), migration.StoreEndpoint(Store(spark, f"file://{tmp_path}/c"))).chunks == 3


def test_jdbc_ranges_hold_every_key_once():
    import bisect

    e = migration.JdbcEndpoint(None, "jdbc:none", partitions=4)
    keys = sorted(f"k{i:03}" for i in range(40)) + ["o'x"]
    conditions = e.ranges(sorted(keys))
    assert len(conditions) == 4 and conditions[0].endswith("IS NULL") and e.ranges([]) == ["1 = 1"]
    edges = [c.split("'")[1] for c in conditions[1:]]
    assert edges == sorted(edges) and len({bisect.bisect_right(edges, k) for k in keys}) == 4
    assert "o''x" in " ".join(migration.JdbcEndpoint(None, "", partitions=2).ranges(["a", "o'x"]))
    assert e.merge_statements("chunks")[0].startswith("DELETE")


def test_job_log_survives_a_torn_compaction(spark, tmp_path):
    log = jobs.JobLog(spark, f"file://{tmp_path}/log")
    frame = lambda *r: spark.createDataFrame(list(r), jobs.JobLog.SCHEMA)
    log.append(frame((1, "a", 1, "d", "upsert", 1, "h", "ready", 1, 1)))
    frame().write.parquet(log._at(1))  # a compaction that died before its mark
    assert log.version() == 0 and log.latest().count() == 1
    assert log.compact() == 1 and log.version() == 1
    log.append(frame((2, "b", 1, "d", "upsert", 1, "h", "ready", 1, 2)))
    assert log.latest().count() == 2 and log.compact() == 2 and log.version() == 2


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from siftwell import session

    monkeypatch.setattr(session, "ship_package", lambda s: None)
    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="x", master="spark://host:7077", getConf=lambda: conf), conf=conf)
    with pytest.raises(EngineError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)


def test_scratch_tables_are_removed(spark):
    import os

    from siftwell import session

    with session.scratch(spark):
        df = session.materialize(spark.range(3), "within")
        assert df.count() == 3
        path = session._SCOPES[-1][0].removeprefix("file://").removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.isdir(path)
