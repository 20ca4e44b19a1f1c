"""Queries on revisions, jobs, stores, audits, migrations and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.chunking import ChunkOptions
from siftwell.functions.text import normalized_newlines
from siftwell.functions.vectors import HashEmbedder
from siftwell.operators import evaluation, lexical, migration
from siftwell.operators.ranking import running_max
from siftwell.plans.retrieval import corpus, queries_of
from siftwell.plans.texts import _TF, sql_tokens
from siftwell.session import fresh_path, materialize, table
from siftwell.sources import jobs, payloads
from siftwell.sources.store import Store, fetched, prepare
from siftwell.streaming import ingest

KEYS = ["corpus_id", "external_id"]


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_revisions").groupBy(*KEYS).agg(F.max("revision").alias("revision"), F.countDistinct("revision").alias("revisions"))


def active_after_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose highest revision is no deletion."""
    last = F.max(F.struct("revision", "recorded_at", "deleted")).alias("l")
    return table(spark, sf_dir, "document_revisions").groupBy(*KEYS).agg(last).filter("NOT l.deleted").select(*KEYS, F.col("l.revision").alias("revision"))


def stale_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions recorded after a higher one of the same document: an activation in order of recording would reject them."""
    rows = table(spark, sf_dir, "document_revisions").select(*KEYS, "revision", "recorded_at").distinct()
    known = running_max(rows, KEYS, F.unix_micros("recorded_at"), [F.col("revision")], "revision", "known")
    return known.filter("known >= revision").select(*KEYS, "revision", "known").distinct()


def job_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_snapshots(table(spark, sf_dir, "index_jobs")).select("job_id", "log_seq", "doc_key", "revision", "status")


def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = jobs.latest_snapshots(table(spark, sf_dir, "index_jobs"))
    return jobs.recovered(latest, ["corpus_id", "doc_key"]).groupBy("status", "action").agg(F.count("*").alias("jobs"))


def job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a compacted log keeps: at most 128 final ones within 16 MiB."""
    latest = materialize(jobs.latest_snapshots(table(spark, sf_dir, "index_jobs")), "latest")
    size = F.octet_length(F.concat_ws("|", "job_id", "doc_key", "content_hash", "status")) + 64
    return jobs.retained(latest, size).select("job_id", "status")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
    return c.groupBy("corpus_id").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("chunks"), F.sum(F.when(F.size("embedding") == 64, 256).otherwise(0)).alias("dense_bytes"), F.round(F.avg("token_count"), 6).alias("average_tokens"))


def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per shard on either side, and whether the sides' checksums are equal."""
    audits = [
        migration.audit(table(spark, sf_dir, t).withColumn("content", normalized_newlines(F.col("content"))), KEYS, ["revision", "content_hash"], "vector_checksum", ["shard"]).select(
            "shard", F.col("documents").alias(f"{n}_documents"), F.col("document_checksum").alias(f"{n}_d"), F.col("vector_checksum").alias(f"{n}_v")
        )
        for t, n in (("corpus_documents", "source"), ("replica_documents", "replica"))
    ]
    j = audits[0].join(audits[1], "shard", "full_outer")
    return j.select("shard", "source_documents", "replica_documents", F.coalesce(F.col("source_d") == F.col("replica_d"), F.lit(False)).alias("documents_equal"), F.coalesce(F.col("source_v") == F.col("replica_v"), F.lit(False)).alias("vectors_equal"))


_SIDE = "{0} AS (SELECT DISTINCT shard, corpus_id, external_id, revision, content_hash, vector_checksum FROM {1})"
AUDIT_SQL = (
    "WITH "
    + _SIDE.format("s", "corpus_documents")
    + ", "
    + _SIDE.format("r", "replica_documents")
    + """,
a AS (SELECT shard, count(DISTINCT (corpus_id, external_id, revision, content_hash, vector_checksum)) AS n, list(DISTINCT (corpus_id, external_id, revision, content_hash) ORDER BY (corpus_id, external_id, revision, content_hash)) AS d, list(DISTINCT (corpus_id, external_id, vector_checksum) ORDER BY (corpus_id, external_id, vector_checksum)) AS v FROM s GROUP BY shard),
b AS (SELECT shard, count(DISTINCT (corpus_id, external_id, revision, content_hash, vector_checksum)) AS n, list(DISTINCT (corpus_id, external_id, revision, content_hash) ORDER BY (corpus_id, external_id, revision, content_hash)) AS d, list(DISTINCT (corpus_id, external_id, vector_checksum) ORDER BY (corpus_id, external_id, vector_checksum)) AS v FROM r GROUP BY shard)
SELECT coalesce(a.shard, b.shard) AS shard, a.n AS source_documents, b.n AS replica_documents, coalesce(a.d = b.d, false) AS documents_equal, coalesce(a.v = b.v, false) AS vectors_equal FROM a FULL JOIN b ON a.shard = b.shard
"""
)


def reconcile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids resuming a copy: extra, conflicting or skipped documents in the replica, each corpus up to its own last key there."""
    side = lambda t: table(spark, sf_dir, t).select(*KEYS, "revision", "content_hash").distinct()
    return migration.reconcile(side("corpus_documents"), side("replica_documents"), "external_id", ["revision", "content_hash"], ["corpus_id"])


RECONCILE_SQL = """
WITH s AS (SELECT DISTINCT corpus_id, external_id, revision, content_hash FROM corpus_documents), d AS (SELECT DISTINCT corpus_id, external_id, revision, content_hash FROM replica_documents), l AS (SELECT corpus_id, max(external_id) AS last FROM d GROUP BY 1),
j AS (SELECT coalesce(s.corpus_id, d.corpus_id) AS corpus_id, s.external_id AS a, d.external_id AS b, s.revision IS DISTINCT FROM d.revision OR s.content_hash IS DISTINCT FROM d.content_hash AS x FROM s FULL JOIN d ON s.corpus_id = d.corpus_id AND s.external_id = d.external_id)
SELECT corpus_id, coalesce(a, b) AS external_id, CASE WHEN a IS NULL THEN 'extra' WHEN b IS NULL THEN 'gap' ELSE 'conflicting' END AS problem FROM j LEFT JOIN l USING (corpus_id) WHERE a IS NULL OR (b IS NULL AND a <= last) OR (b IS NOT NULL AND x)
"""


def keyset_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 256 documents after a position, in key order."""
    rows = table(spark, sf_dir, "corpus_documents").select("corpus_id", "external_id").distinct().select(F.concat_ws("/", F.lpad(F.col("corpus_id").cast("string"), 4, "0"), "external_id").alias("doc_key"))
    return migration.keyset_batch(rows, "doc_key", "0003/", 256)


def qrels_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search judged by whether it finds chunks of the query chunk's own document."""
    c = corpus(spark, sf_dir, dense_too=False)
    q = queries_of(c)
    found = lexical.search(c.index, q, "query_id", "text", 3).join(c.chunks.select("chunk_key", "document_id"), "chunk_key")
    relevant = c.chunks.select(F.col("chunk_key").alias("query_id"), F.array("document_id").alias("relevant")).join(q.select("query_id"), "query_id")
    m = evaluation.qrels_metrics(found, relevant, 3)
    return m.select("query_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time from a job's creation to its last snapshot, by status."""
    latest = jobs.latest_snapshots(table(spark, sf_dir, "index_jobs")).withColumn("ms", (F.col("updated_at_ms") - F.col("created_at_ms")).cast("double"))
    p = evaluation.percentiles(latest, "ms", [0.5, 0.95, 0.99], ["status"])
    return p.select("status", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


def chunk_fetch_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks fetched by lists of keys, in their order; unknown keys are left out."""
    wanted = table(spark, sf_dir, "ranked_lists").filter("hits IS NOT NULL").groupBy("query_id", "list_no").agg(F.max("hits").alias("hits"))
    wanted = wanted.select("query_id", "list_no", F.posexplode("hits").alias("ordinality", "h")).select("query_id", "list_no", "ordinality", F.col("h.chunk").alias("chunk_key"))
    c = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]).drop("chunk_key").withColumnsRenamed({"chunk_id": "chunk_key", "document_id": "doc_key"})
    found = fetched(wanted, c.select("chunk_key", "doc_key", "ordinal", "start_line", "end_line"))
    return found.select("query_id", "list_no", "ordinality", F.col("chunk_key").alias("chunk_id"), F.col("doc_key").alias("document_id"), "ordinal", "start_line", "end_line")


def store_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus through prepare, activate, a second revision of every third document, erasure of every seventh and compaction: the state at the end."""
    docs = table(spark, sf_dir, "corpus_documents").filter("content IS NOT NULL").groupBy(*KEYS).agg(F.max(F.struct(F.coalesce("title", F.lit("")).alias("title"), "content")).alias("d"))
    docs = docs.select(F.concat_ws("/", *KEYS).alias("doc_key"), F.lit(1).alias("revision"), "d.title", "d.content", F.create_map(F.lit("corpus"), F.col("corpus_id").cast("string")).alias("metadata"))
    docs = materialize(docs.withColumn("n", F.length("doc_key") % 21), "docs")
    store, options, embedder = Store(spark, fresh_path(spark, "store")), ChunkOptions(), HashEmbedder(16)
    store.activate(*prepare(docs, options, embedder))
    again = docs.filter("n % 3 = 0").withColumn("revision", F.lit(2)).withColumn("title", F.concat("title", F.lit(" v2")))
    store.activate(*prepare(again, options, embedder))
    store.erase(docs.filter("n % 7 = 0").select("doc_key", F.lit(3).alias("revision")))
    store.compact(override_budget=True)
    return store.table("documents").select("doc_key", "revision", "title")


LIFECYCLE_SQL = """
WITH d AS (SELECT corpus_id || '/' || external_id AS doc_key, max(coalesce(title, '')) AS title FROM corpus_documents WHERE content IS NOT NULL GROUP BY ALL), n AS (SELECT *, length(doc_key) % 21 AS n FROM d)
SELECT doc_key, CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS revision, title || CASE WHEN n % 3 = 0 THEN ' v2' ELSE '' END AS title FROM n WHERE n % 7 <> 0
"""


def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a first load of the store, with lengths: everything that was given is there."""
    docs = table(spark, sf_dir, "corpus_documents").filter("content IS NOT NULL").dropDuplicates(KEYS)
    docs = docs.select(F.concat_ws("/", "corpus_id", "external_id").alias("doc_key"), "revision", "title", "content", "metadata")
    store = Store(spark, fresh_path(spark, "store"))
    store.activate(*prepare(docs))
    return store.table("documents").select("doc_key", "revision", F.octet_length(F.coalesce("content", F.lit(""))).alias("bytes"))


STORE_STATISTICS_SQL = "SELECT DISTINCT corpus_id || '/' || external_id AS doc_key, revision, strlen(content)::INTEGER AS bytes FROM corpus_documents WHERE content IS NOT NULL"


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job log, as a stream of files, ingested into a store: the revisions it ends with."""
    log = table(spark, sf_dir, "index_jobs").filter("status = 'ready' AND job_id IS NOT NULL")
    changes = log.select(
        F.concat_ws("/", "corpus_id", "doc_key").alias("doc_key"), "operation", "revision", F.col("doc_key").alias("title"), F.coalesce("content_hash", F.lit("")).alias("content"), F.create_map(F.lit("corpus"), F.col("corpus_id").cast("string")).alias("metadata"), "updated_at_ms"
    )
    source = fresh_path(spark, "changes")
    changes.repartition(2).write.json(source)
    store = Store(spark, fresh_path(spark, "store"))
    query = ingest.ingest(spark, source, store, fresh_path(spark, "checkpoint"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return store.table("revisions").select("doc_key", "revision", "deleted")


STREAM_SQL = """
WITH r AS (SELECT corpus_id || '/' || doc_key AS doc_key, revision, lower(trim(operation)) = 'erase' AS deleted, updated_at_ms FROM index_jobs WHERE status = 'ready' AND job_id IS NOT NULL)
SELECT doc_key, revision, deleted FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY revision DESC, updated_at_ms, deleted DESC) AS k FROM r) WHERE k = 1
"""


def migrate_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus with chunks and embeddings copied from store to store in batches: the report."""
    docs = table(spark, sf_dir, "corpus_documents").filter("content IS NOT NULL").dropDuplicates(KEYS)
    docs = docs.select(F.concat_ws("/", "corpus_id", "external_id").alias("doc_key"), "revision", "title", "content", F.map_filter("metadata", lambda k, v: v.isNotNull()).alias("metadata"))
    a, b = Store(spark, fresh_path(spark, "source")), Store(spark, fresh_path(spark, "destination"))
    a.activate(*prepare(docs, embedder=HashEmbedder(16)))
    report = migration.migrate(migration.StoreEndpoint(a), migration.StoreEndpoint(b), 10_000)
    same = b.table("chunks").count() == a.table("chunks").count() == report.chunks
    return spark.createDataFrame([(report.documents, report.source_checksum == report.destination_checksum and same)], "documents long, equal boolean")


MIGRATE_SQL = "SELECT count(DISTINCT (corpus_id, external_id)) AS documents, true AS equal FROM corpus_documents WHERE content IS NOT NULL"


def synthetic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,000 generated unit vectors, by key and first components."""
    rows = payloads.synthetic_vectors(spark, 2000, 384)
    return rows.select("key", F.size("vector").alias("dimension"), F.round(F.col("vector")[0], 4).alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_revision, active_after_erase, stale_revisions, job_latest_snapshot, job_recovery, job_retention, corpus_stats, corpus_audit, reconcile_diff, keyset_batch, qrels_metrics, latency_percentiles,
        chunk_fetch_ordinal, store_lifecycle, store_statistics, stream_ingest, migrate_store, synthetic_vectors,
    )
}
_LATEST = "WITH j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY log_seq DESC) AS k FROM index_jobs WHERE job_id IS NOT NULL) WHERE k = 1)"
_LEX3 = (
    _TF
    + f""", l AS (SELECT c.chunk_id, coalesce(sum(tf), 0) AS len FROM c LEFT JOIN tf USING (chunk_id) GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS a FROM l), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qs AS (SELECT DISTINCT chunk_id, text, document_id FROM chunks WHERE chunk_id % 20 = 0), q AS (SELECT chunk_id AS query_id, term, count(*) AS qtf FROM (SELECT chunk_id, unnest({sql_tokens('text')}) AS term FROM qs) GROUP BY ALL),
b AS (SELECT q.query_id, tf.chunk_id, round(sum(q.qtf * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * l.len / greatest(st.a, 1)))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (chunk_id) CROSS JOIN st GROUP BY ALL),
r AS (SELECT b.query_id, row_number() OVER (PARTITION BY b.query_id ORDER BY score DESC, b.chunk_id) AS rank, x.document_id FROM b JOIN (SELECT DISTINCT chunk_id, document_id FROM chunks) x USING (chunk_id)),
h AS (SELECT qs.chunk_id AS query_id, r.rank FROM qs LEFT JOIN r ON r.query_id = qs.chunk_id AND r.rank <= 3 AND r.document_id = qs.document_id)"""
)
ORACLE = {
    "latest_revision": "SELECT corpus_id, external_id, max(revision) AS revision, count(DISTINCT revision) AS revisions FROM document_revisions GROUP BY 1, 2",
    "active_after_erase": "SELECT corpus_id, external_id, revision FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id, external_id ORDER BY revision DESC, recorded_at DESC, deleted DESC) AS k FROM document_revisions) WHERE k = 1 AND NOT deleted",
    "stale_revisions": "WITH d AS (SELECT DISTINCT corpus_id, external_id, revision, recorded_at FROM document_revisions) SELECT DISTINCT corpus_id, external_id, revision, known FROM (SELECT *, max(revision) OVER (PARTITION BY corpus_id, external_id ORDER BY recorded_at, revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM d) WHERE known >= revision",
    "job_latest_snapshot": _LATEST + " SELECT job_id, log_seq, doc_key, revision, status FROM j",
    "job_recovery": _LATEST + """, n AS (SELECT *, max(revision) OVER (PARTITION BY corpus_id, doc_key) AS newest, row_number() OVER (PARTITION BY corpus_id, doc_key, status = 'ready' ORDER BY revision DESC, job_id) AS r FROM j)
SELECT status, CASE WHEN status = 'ready' AND r = 1 THEN CASE WHEN lower(trim(operation)) = 'erase' THEN 'erase' ELSE 'activate' END WHEN status IN ('ready', 'failed', 'superseded', 'cancelled') THEN 'keep' WHEN revision = newest THEN 'requeue' ELSE 'supersede' END AS action, count(*) AS jobs FROM n GROUP BY ALL""",
    "job_retention": _LATEST + ", t AS (SELECT job_id, status, row_number() OVER (ORDER BY updated_at_ms DESC, job_id DESC) AS k2 FROM j WHERE status IN ('ready', 'failed', 'superseded', 'cancelled')) SELECT job_id, status FROM t WHERE k2 <= 128 UNION ALL SELECT job_id, status FROM j WHERE status NOT IN ('ready', 'failed', 'superseded', 'cancelled')",
    "corpus_stats": "WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks) SELECT corpus_id, count(DISTINCT document_id) AS documents, count(*) AS chunks, sum(CASE WHEN len(embedding) = 64 THEN 256 ELSE 0 END)::BIGINT AS dense_bytes, round(avg(token_count), 6) AS average_tokens FROM c GROUP BY 1",
    "corpus_audit": AUDIT_SQL,
    "reconcile_diff": RECONCILE_SQL,
    "keyset_batch": "SELECT DISTINCT lpad(corpus_id::VARCHAR, 4, '0') || '/' || external_id AS doc_key FROM corpus_documents WHERE lpad(corpus_id::VARCHAR, 4, '0') || '/' || external_id > '0003/' ORDER BY 1 LIMIT 256",
    "qrels_metrics": _LEX3 + " SELECT query_id, round(count(rank)::DOUBLE, 6) AS recall, round(coalesce(1.0 / min(rank), 0), 6) AS mrr, round(coalesce(sum(1 / log2(rank + 1)), 0), 6) AS ndcg FROM h GROUP BY query_id",
    "latency_percentiles": _LATEST + " SELECT status, round(quantile_cont((updated_at_ms - created_at_ms)::DOUBLE, 0.5), 4) AS p50, round(quantile_cont((updated_at_ms - created_at_ms)::DOUBLE, 0.95), 4) AS p95, round(quantile_cont((updated_at_ms - created_at_ms)::DOUBLE, 0.99), 4) AS p99 FROM j GROUP BY 1",
    "chunk_fetch_ordinal": "WITH w AS (SELECT query_id, list_no, max(hits) AS hits FROM ranked_lists WHERE hits IS NOT NULL GROUP BY 1, 2), h AS (SELECT query_id, list_no, unnest(hits) AS h, (generate_subscripts(hits, 1) - 1)::INTEGER AS ordinality FROM w), c AS (SELECT DISTINCT chunk_id, document_id, ordinal, start_line, end_line FROM chunks) SELECT query_id, list_no, ordinality, chunk_id, document_id, ordinal, start_line, end_line FROM h JOIN c ON c.chunk_id = h.h.chunk",
    "store_lifecycle": LIFECYCLE_SQL,
    "store_statistics": STORE_STATISTICS_SQL,
    "stream_ingest": STREAM_SQL,
    "migrate_store": MIGRATE_SQL,
}
