"""The catalog as SQL tables, with a schema version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.errors import EngineError

VERSION = 1

#: Tables and columns of the catalog.
TABLES = {
    "corpora": "corpus_id bigint, name string, dimension int, embedding_identity string, chunking_fingerprint string, generation bigint",
    "document_revisions": "corpus_id bigint, external_id string, revision bigint, deleted boolean, content_hash string, recorded_at timestamp",
    "documents": "doc_key string, revision bigint, title string, content string, metadata map<string,string>, content_hash string, chunking_fingerprint string, embedding_identity string",
    "chunks": "chunk_key string, doc_key string, revision bigint, ordinal int, text string, indexed_text string, context string, start_line int, end_line int, token_count int, embedding array<float>",
    "terms": "term string, df bigint",
    "postings": "term string, chunk_key string, tf bigint, weight double",
    "index_jobs": "log_seq bigint, job_id string, corpus_id bigint, doc_key string, operation string, revision bigint, content_hash string, status string, created_at_ms bigint, updated_at_ms bigint, error struct<code:int,message:string>, mutation_applied boolean",
    "migration_runs": "run_id string, corpus_id bigint, source_fingerprint string, last_document string, documents bigint, chunks bigint, complete boolean, updated_at timestamp",
    "schema_migrations": "version int, applied_at timestamp",
}


def create_tables(spark: SparkSession, database: str) -> int:
    """Create what is missing and record the version; a newer catalog than this code knows is refused. Postings are bucketed by term, so joins on it need no shuffle."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    existing = {t.name for t in spark.catalog.listTables(database)}
    if "schema_migrations" in existing:
        known = spark.table(f"{database}.schema_migrations").agg({"version": "max"}).first()[0] or 0
        if known > VERSION:
            raise EngineError("unsupported", f"the catalog has version {known}")
    else:
        known = 0
    for name, columns in TABLES.items():
        if name not in existing:
            bucket = " CLUSTERED BY (term) INTO 64 BUCKETS" if name == "postings" else ""
            spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet{bucket}")
    if known < VERSION:
        spark.sql(f"INSERT INTO {database}.schema_migrations VALUES ({VERSION}, current_timestamp())")
    return VERSION


def layout_faults(df: DataFrame, name: str) -> list[str]:
    """How a table departs from the catalog's layout: missing columns and other types; extra columns are no fault."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([], TABLES[name]).schema
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"{f.name}: {have.get(f.name, 'missing')} instead of {f.dataType.simpleString()}" for f in wanted.fields if have.get(f.name) != f.dataType.simpleString()]
