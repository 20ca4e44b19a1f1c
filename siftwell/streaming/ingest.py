"""Streaming ingestion: a log of changes becomes generations of a store, a micro-batch at a time.

The order of changes is their revision, not their arrival: a batch keeps the highest revision per document, and the store's own
revisions decide what is stale, however late it comes; there is no watermark. A batch that is run again finds its
revisions known and changes nothing, so restarts are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.chunking import ChunkOptions
from siftwell.functions.hashing import content_hash
from siftwell.functions.vectors import Embedder
from siftwell.sources.store import Store, prepare

CHANGES = "doc_key string, operation string, revision bigint, title string, content string, metadata map<string,string>, updated_at_ms bigint"


def newest(changes: DataFrame) -> DataFrame:
    """The change of each document with the highest revision; of equal ones the first, an erase before an upsert."""
    op = F.lower(F.trim("operation"))
    rows = changes.filter(F.col("doc_key").isNotNull() & F.col("revision").isNotNull() & op.isin("upsert", "erase")).withColumn("operation", op)
    # a map cannot be compared, so the choice is made on a key of comparable columns
    best = F.max_by(F.struct("operation", "title", "content", "metadata"), F.struct("revision", -F.col("updated_at_ms"), (op == "erase").cast("int")))
    picked = rows.groupBy("doc_key").agg(F.max("revision").alias("revision"), best.alias("c"))
    return picked.select("doc_key", "revision", "c.*")


def apply_batch(store: Store, changes: DataFrame, options: ChunkOptions = ChunkOptions(), embedder: Embedder | None = None) -> dict[str, int]:
    """Counts by outcome: indexed, unchanged, stale, erased. Documents whose content is the active one are not prepared again."""
    batch = newest(changes).persist()
    try:
        known = store.table("revisions").select(F.col("doc_key").alias("_k"), F.col("revision").alias("_r"), F.col("content_hash").alias("_h"), F.col("deleted").alias("_d"))
        j = batch.join(known, F.col("doc_key") == F.col("_k"), "left")
        fresh = F.col("_r").isNull() | (F.col("revision") > F.col("_r"))
        same = ~F.coalesce("_d", F.lit(True)) & (F.col("_h") == content_hash(F.col("title"), F.col("content"), F.col("metadata")))
        outcome = F.when(~fresh, F.when(same, "unchanged").otherwise("stale")).when(F.col("operation") == "erase", "erased").otherwise(F.when(same, "unchanged").otherwise("indexed"))
        marked = j.withColumn("outcome", outcome).drop("_k", "_r", "_h", "_d").persist()
        counts = {r["outcome"]: r["count"] for r in marked.groupBy("outcome").count().collect()}
        if counts.get("indexed"):
            documents, chunks = prepare(marked.filter("outcome = 'indexed'"), options, embedder)
            store.activate(documents, chunks)
        if counts.get("erased"):
            store.erase(marked.filter("outcome = 'erased'").select("doc_key", "revision"))
        marked.unpersist()
        return counts
    finally:
        batch.unpersist()


def ingest(spark: SparkSession, source: str, store: Store, checkpoint: str, options: ChunkOptions = ChunkOptions(), embedder: Embedder | None = None, files_per_batch: int = 64):
    """A running query that applies the JSON change files arriving in ``source``; stop it, or wait with ``processAllAvailable``."""
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(source)

    def step(batch: DataFrame, _: int) -> None:
        apply_batch(store, batch, options, embedder)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def latest_states(stream: DataFrame) -> DataFrame:
    """(doc_key, revision, operation, content_hash) kept up to date by key: a streaming fold of the highest revision, for ``complete`` or ``update`` sinks."""
    best = F.max(F.struct("revision", -F.col("updated_at_ms"), "operation", "content_hash")).alias("b")
    return stream.groupBy("doc_key").agg(best).select("doc_key", "b.revision", "b.operation", "b.content_hash")
