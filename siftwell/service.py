"""The service's operations on a store: ingest, job, delete, search; bodies and results are JSON.

Without a server: authentication, processes and text generation are left out.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import EngineError
from siftwell.functions.chunking import SERVICE_OPTIONS, ChunkOptions
from siftwell.functions.hashing import content_hash
from siftwell.functions.vectors import Embedder, HashEmbedder
from siftwell.operators import dense, search
from siftwell.session import scratch
from siftwell.sources import jobs, payloads, sidecar
from siftwell.sources.store import Store, prepare

#: Status codes.
INDEXED, UNCHANGED, QUEUED, INVALID, UNKNOWN, FAILED = 201, 200, 202, 400, 404, 503

#: A service that starts takes up so many jobs of its log at most; compaction keeps fewer.
KNOWN_JOBS = 100_000


@dataclass
class Job:
    job_id: str
    doc_key: str
    operation: str
    revision: int
    content_hash: str | None
    status: str
    created_at_ms: int
    updated_at_ms: int
    error: str | None = None


class Service:
    """One corpus. Every state of a job is logged beside the store before it counts, with the document of a waiting one, so a service that
    is started again finds its jobs, takes up what was not finished and knows what was. Indexes are kept by generation."""

    def __init__(self, spark: SparkSession, path: str, options: ChunkOptions = SERVICE_OPTIONS, embedder: Embedder | None = None, queue: int = 64, algorithm: str = "auto"):
        self.spark, self.store, self.options, self.queue, self.algorithm = spark, Store(spark, path), options, queue, algorithm
        self.embedder = embedder or HashEmbedder()
        self.log = jobs.JobLog(spark, f"{path.rstrip('/')}/jobs")
        self.jobs: dict[str, Job] = {}
        self.waiting: dict[str, tuple[Job, dict]] = {}
        self._seq = 0
        self._corpus: tuple[int, search.Corpus] | None = None
        self._recover()

    def _recover(self) -> None:
        """Jobs of an earlier service: final ones as they are, the newest unfinished one of a document waits again, others are superseded.

        A job that was published but not logged as ready is found by the store's revisions.
        """
        latest = self.log.latest().orderBy("log_seq").limit(KNOWN_JOBS).collect()
        known = {r["doc_key"]: (r["revision"], r["deleted"]) for r in self._revisions({r["doc_key"] for r in latest})}
        actions = {r["job_id"]: r["action"] for r in jobs.recovered(self.log.latest(), ["corpus_id", "doc_key"]).select("job_id", "action").collect()} if latest else {}
        for r in latest:
            self._seq = max(self._seq, r["log_seq"])
            job = Job(r["job_id"], r["doc_key"], r["operation"], r["revision"], r["content_hash"], r["status"], r["created_at_ms"], r["updated_at_ms"])
            self.jobs[job.job_id] = job
        for job in list(self.jobs.values()):
            if job.status in jobs.TERMINAL:
                continue
            done = known.get(job.doc_key, (0, False))
            if done[0] >= job.revision and (done[0] == job.revision and done[1] == (job.operation == "erase")):
                self._set([job], "ready")
            elif actions.get(job.job_id) == "requeue" and done[0] < job.revision:
                if job.operation == "erase":
                    self.store.erase(self._one(job.doc_key, job.revision))
                    self._set([job], "ready")
                elif (d := self._kept(job)) is not None:
                    self._set([job], "queued")
                    self.waiting[job.doc_key] = (job, d)
                else:
                    self._set([job], "failed")
            else:
                self._set([job], "superseded")

    def _revisions(self, keys: set[str]) -> list:
        return self.store.table("revisions").filter(F.col("doc_key").isin(sorted(keys))).collect() if keys else []

    def _one(self, key: str, revision: int) -> DataFrame:
        return self.spark.createDataFrame([(key, revision)], "doc_key string, revision long")

    def _keep(self, job: Job, document: dict) -> None:
        """The document of a waiting job, as a file of its own."""
        p, fs = self.store._fs(f"{self.store.path}/waiting/{job.job_id}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()

    def _kept(self, job: Job) -> dict | None:
        path = f"{self.store.path}/waiting/{job.job_id}.json"
        p, fs = self.store._fs(path)
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else None

    def _forget(self, job: Job) -> None:
        p, fs = self.store._fs(f"{self.store.path}/waiting/{job.job_id}.json")
        fs.delete(p, False)

    def ingest(self, body: str, asynchronous: bool = False) -> tuple[int, dict]:
        """Validate a document and index it, at once or with ``run_queue``."""
        try:
            d = self._document(body)
        except EngineError as e:
            return INVALID, {"error": str(e)}
        one = self.spark.createDataFrame([(d["title"], d["content"], d["metadata"])], "t string, c string, m map<string,string>")
        digest = one.select(content_hash(F.col("t"), F.col("c"), F.col("m"))).first()[0]
        known = self.store.table("revisions").filter(F.col("doc_key") == d["id"]).first()
        pending = self.waiting.get(d["id"])
        if pending and pending[0].content_hash == digest:
            return QUEUED, asdict(pending[0])  # the same content is already on its way
        if not pending and known and not known["deleted"] and known["content_hash"] == digest:
            return UNCHANGED, {"doc_key": d["id"], "revision": known["revision"], "status": "unchanged"}
        if not pending and len(self.waiting) >= self.queue:
            return FAILED, {"error": "resource_exhausted: the queue is full"}
        revision = max(known["revision"] if known else 0, pending[0].revision if pending else 0) + 1
        job = self._job(d["id"], "upsert", revision, digest)
        self._keep(job, d)
        self._log([job])
        if pending:
            self._set([pending[0]], "superseded")
            self._forget(pending[0])
        self.waiting[d["id"]] = (job, d)
        if asynchronous:
            return QUEUED, asdict(job)
        self.run_queue(d["id"])
        return (INDEXED if job.status == "ready" else FAILED), asdict(job)

    def run_queue(self, only: str | None = None) -> int:
        """Work off what waits, all documents in one generation; the number of jobs."""
        todo = {k: v for k, v in self.waiting.items() if only in (None, k)}
        for k in todo:
            del self.waiting[k]
        if not todo:
            return 0
        rows = [(d["id"], j.revision, d["title"], d["content"], d["metadata"]) for j, d in todo.values()]
        df = self.spark.createDataFrame(rows, "doc_key string, revision long, title string, content string, metadata map<string,string>")
        try:
            every = [j for j, _ in todo.values()]
            self._set(every, "chunking")
            documents, chunks = prepare(df, self.options, self.embedder)
            self._set(every, "publishing")  # cutting, embedding and writing are one pass
            with scratch(self.spark):
                self.store.activate(documents, chunks)
            outcome, error = "ready", None
        except Exception as e:  # noqa: BLE001 - the old generation stays, the jobs tell why
            outcome, error = "failed", str(e)[:500]
        for j in every:
            j.error = error
        self._set(every, outcome)
        for j in every:
            self._forget(j)
        return len(todo)

    def delete(self, doc_key: str) -> tuple[int, dict]:
        """Erase a document; a waiting ingestion of it loses."""
        waiting = self.waiting.pop(doc_key, None)
        if waiting:
            self._set([waiting[0]], "superseded")
            self._forget(waiting[0])
        known = self.store.table("revisions").filter(F.col("doc_key") == doc_key).first()
        if not known and not waiting:
            return UNKNOWN, {"error": f"not_found: {doc_key}"}
        revision = max(known["revision"] if known else 0, waiting[0].revision if waiting else 0) + 1
        job = self._job(doc_key, "erase", revision, None)
        self._log([job])
        with scratch(self.spark):
            self.store.erase(self._one(doc_key, revision))
        self._set([job], "ready")
        return UNCHANGED, asdict(job)

    def job(self, job_id: str) -> tuple[int, dict]:
        return (200, asdict(self.jobs[job_id])) if job_id in self.jobs else (UNKNOWN, {"error": f"not_found: {job_id}"})

    def search(self, body: str) -> tuple[int, dict]:
        """Ranked passages; the applied filter is acknowledged."""
        try:
            r = payloads.search_request(body)
        except EngineError as e:
            return INVALID, {"error": str(e)}
        c = self.corpus()
        vector = [float(x) for x in self.embedder.embed([r["query"]])[0]]
        q = self.spark.createDataFrame([(0, r["query"], vector)], "query_id int, text string, vector array<float>")
        with scratch(self.spark):
            found = search.search(c, q, r["mode"], r["top_k"], wanted=r["filter"])
            bodies = payloads.results_json(found).collect()
        out = {"results": json.loads(bodies[0]["body"])["results"] if bodies else []}
        if r["filter"] is not None:
            out["filter_ack"] = r["filter"].wanted
        return 200, out

    def corpus(self) -> search.Corpus:
        """The indexed current generation. Its indexes are kept beside the store, the dense one under the fingerprint of its vectors, and opened again by the next service."""
        n = self.store.generation
        if self._corpus is None or self._corpus[0] != n:
            docs = self.store.table("documents").select("doc_key", "title", "metadata")
            rows = self.store.table("chunks").join(docs, "doc_key").withColumnsRenamed({"doc_key": "document_id", "revision": "document_revision"})
            vectors = dense.usable_vectors(rows, "chunk_key", "embedding", self.embedder.dimension)
            path = f"{self.store.path}/indexes"
            index = sidecar.lexical_index(f"{path}/lexical-{n:010d}", rows)
            access = sidecar.dense_index(f"{path}/dense", vectors, self.embedder.dimension, self.algorithm)
            self._corpus = (n, search.Corpus(rows, index, vectors, self.embedder.dimension, access))
        return self._corpus[1]

    def _document(self, body: str) -> dict:
        try:
            d = json.loads(body)
        except ValueError as e:
            raise EngineError("invalid_argument", "not JSON") from e
        if not isinstance(d, dict) or not isinstance(d.get("id"), str) or not d["id"] or any(ord(c) < 32 or ord(c) == 127 for c in d["id"]):
            raise EngineError("invalid_argument", "id")
        if not isinstance(d.get("content"), str) or not isinstance(d.get("title", ""), str):
            raise EngineError("invalid_argument", "content or title")
        metadata = d.get("metadata", {})
        if not isinstance(metadata, dict) or not all(isinstance(v, str) for v in metadata.values()):
            raise EngineError("invalid_argument", "metadata")
        from siftwell.functions.filters import tag_fault

        fault = self.spark.createDataFrame([(metadata,)], "m map<string,string>").select(tag_fault(F.col("m"))).first()[0]
        if fault:
            raise EngineError("invalid_argument", f"metadata: {fault}")
        return {"id": d["id"], "title": d.get("title", ""), "content": d["content"], "metadata": metadata}

    def _job(self, doc_key: str, operation: str, revision: int, digest: str | None) -> Job:
        now = int(time.time() * 1000)
        job = Job(f"job_{uuid.uuid4().hex[:16]}", doc_key, operation, revision, digest, "queued", now, now)
        self.jobs[job.job_id] = job
        return job

    def _set(self, changed: list[Job], status: str) -> None:
        for job in changed:
            job.status, job.updated_at_ms = status, int(time.time() * 1000)
        self._log(changed)

    def _log(self, changed: list[Job]) -> None:
        """Append snapshots; the log decides what happened if the service ends here."""
        rows = []
        for j in changed:
            self._seq += 1
            rows.append((self._seq, j.job_id, 0, j.doc_key, j.operation, j.revision, j.content_hash, j.status, j.created_at_ms, j.updated_at_ms))
        if rows:
            self.log.append(self.spark.createDataFrame(rows, jobs.JobLog.SCHEMA).coalesce(1))
