"""Queries on revision logs, copies of a corpus and job logs (problems 1, 3 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import changefeed, differences, incremental
from siftwell.session import fresh_path, table

KEYS = ["corpus_id", "external_id"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose current state no migration run has safely carried yet.

    The carried state is the ledger's first version (keys and digests). A run joins the hashed current rows with it, stages its changes and
    the next version, and commits; the result are the changes of the committed run.
    """
    revisions = table(spark, sf_dir, "document_revisions")
    digest = F.when(F.col("content_hash").isNotNull(), incremental.content_digest("content_hash"))
    current = incremental.latest_state(revisions, KEYS, ["revision", "recorded_at"], digest, F.col("deleted"))
    done = incremental.carried(revisions, table(spark, sf_dir, "migration_runs"), KEYS, "external_id")
    state = incremental.latest_state(done, KEYS, ["revision", "recorded_at"], digest, F.col("deleted"))
    ledger = incremental.Ledger(spark, fresh_path(spark, "ledger"), KEYS)
    ledger.seed(state)
    run = ledger.begin(current)
    run.commit()
    return run.changes.select(*KEYS, "revision")


P1_SQL = """
WITH r AS (SELECT DISTINCT corpus_id, external_id, revision, coalesce(deleted, false) AS deleted, content_hash, recorded_at, run_id FROM document_revisions),
f AS (SELECT run_id, last_document, complete FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, complete DESC, last_document DESC) AS k FROM migration_runs) WHERE k = 1),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id, external_id ORDER BY revision DESC NULLS LAST, recorded_at DESC NULLS LAST) AS k FROM r) WHERE k = 1),
car AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.corpus_id, r.external_id ORDER BY r.revision DESC NULLS LAST, r.recorded_at DESC NULLS LAST) AS k
        FROM r JOIN f ON r.run_id = f.run_id WHERE f.complete OR f.last_document >= r.external_id) WHERE k = 1)
SELECT cur.corpus_id, cur.external_id, cur.revision FROM cur LEFT JOIN car ON cur.corpus_id = car.corpus_id AND cur.external_id = car.external_id
WHERE CASE WHEN car.external_id IS NULL THEN NOT cur.deleted
           WHEN car.deleted <> cur.deleted THEN true
           ELSE NOT cur.deleted AND (cur.content_hash IS NULL OR car.content_hash IS NULL OR cur.content_hash <> car.content_hash) END
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on one side only and every field that differs between the source and the replica copy."""
    fields = {
        "revision": F.col("revision"),
        "title": F.col("title"),
        "content": differences.newline_folded(F.col("content")),
        "metadata": differences.map_entries_sorted(F.col("metadata")),
        "content_hash": F.col("content_hash"),
        "vector_checksum": F.col("vector_checksum"),
    }
    source, replica = table(spark, sf_dir, "corpus_documents"), table(spark, sf_dir, "replica_documents")
    return differences.differences(source, replica, KEYS, fields, ["revision"], ("missing_in_source", "missing_in_replica"))


P3_SQL = r"""
WITH s AS (SELECT DISTINCT corpus_id, external_id, revision, title, regexp_replace(content, '\r\n?', chr(10), 'g') AS content, list_sort(map_entries(metadata)) AS metadata, content_hash, vector_checksum FROM corpus_documents),
d AS (SELECT DISTINCT corpus_id, external_id, revision, title, regexp_replace(content, '\r\n?', chr(10), 'g') AS content, list_sort(map_entries(metadata)) AS metadata, content_hash, vector_checksum FROM replica_documents),
b AS (SELECT s.corpus_id, s.external_id, s.revision IS DISTINCT FROM d.revision AS revision, s.title IS DISTINCT FROM d.title AS title, s.content IS DISTINCT FROM d.content AS content,
        s.metadata IS DISTINCT FROM d.metadata AS metadata, s.content_hash IS DISTINCT FROM d.content_hash AS content_hash, s.vector_checksum IS DISTINCT FROM d.vector_checksum AS vector_checksum
      FROM s JOIN d ON s.corpus_id = d.corpus_id AND s.external_id = d.external_id)
SELECT corpus_id, external_id, 'missing_in_replica' AS field FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.corpus_id = s.corpus_id AND d.external_id = s.external_id)
UNION SELECT corpus_id, external_id, 'missing_in_source' FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE d.corpus_id = s.corpus_id AND d.external_id = s.external_id)
UNION SELECT corpus_id, external_id, 'revision' FROM b WHERE revision UNION SELECT corpus_id, external_id, 'title' FROM b WHERE title
UNION SELECT corpus_id, external_id, 'content' FROM b WHERE content UNION SELECT corpus_id, external_id, 'metadata' FROM b WHERE metadata
UNION SELECT corpus_id, external_id, 'content_hash' FROM b WHERE content_hash UNION SELECT corpus_id, external_id, 'vector_checksum' FROM b WHERE vector_checksum
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that exist after all finished jobs, with revision and hash.

    Two passes of the same patch composition: the snapshots of a job compose to its final one, the finished jobs of a
    document to its last change. In the first pass each task folds its own stretch of the log before the shuffle; in the
    second, jobs are spread over 64 chunks by their id, so the hot document is folded in pieces too.
    """
    log = table(spark, sf_dir, "index_jobs").filter(F.col("job_id").isNotNull())
    snapshot = ["corpus_id", "doc_key", "operation", "revision", "content_hash", "status", "updated_at_ms"]
    per_job = changefeed.compose(log, ["job_id"], [F.col("updated_at_ms"), F.col("log_seq")], F.lit(changefeed.PUT), snapshot, partial=False)
    jobs = changefeed.apply_to(None, per_job, ["job_id"], snapshot, partial=False).filter(F.col("status") == "ready")
    op = F.lower(F.trim(F.col("operation")))
    kind = F.when(op == "upsert", changefeed.PUT).when(op == "erase", changefeed.DELETE)
    keys, values = ["corpus_id", "doc_key"], ["revision", "content_hash"]
    order = [F.col("revision"), -F.col("updated_at_ms"), F.col("job_id")]
    per_doc = changefeed.compose(jobs, keys, order, kind, values, chunk=F.pmod(F.xxhash64("job_id"), F.lit(64)), partial=False)
    return changefeed.apply_to(None, per_doc, keys, values, partial=False)


P6_SQL = """
WITH j AS (SELECT * FROM (SELECT *, lower(trim(operation)) AS op, row_number() OVER (PARTITION BY job_id ORDER BY updated_at_ms DESC NULLS LAST, log_seq DESC) AS k FROM index_jobs WHERE job_id IS NOT NULL) WHERE k = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, doc_key ORDER BY revision DESC NULLS LAST, updated_at_ms ASC NULLS LAST, job_id DESC) AS r FROM j WHERE status = 'ready' AND op IN ('upsert', 'erase'))
SELECT corpus_id, doc_key, revision, content_hash FROM d WHERE r = 1 AND op = 'upsert'
"""

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p6_found": p6_found}
ORACLE = {"p1_found": P1_SQL, "p3_found": P3_SQL, "p6_found": P6_SQL}
