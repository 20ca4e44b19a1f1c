"""Copying a corpus between two endpoints, resumable and verified: audits, reconciliation, keyset batches."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from siftwell.errors import EngineError
from siftwell.operators import dense
from siftwell.session import materialize
from siftwell.sources.store import Store


def row_digest(df: DataFrame, *columns: str) -> Column:
    """A 64-bit hash of a row's fields, each marked as null or present; a map counts as the sorted set of its entries."""
    parts = []
    for c in columns:
        value = F.array_sort(F.map_entries(c)) if isinstance(df.schema[c].dataType, MapType) else F.col(c)
        parts.append(F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.to_json(F.struct(value.alias("v"))) if isinstance(df.schema[c].dataType, (MapType, ArrayType)) else value.cast("string"))))
    return F.xxhash64(*parts)


def audit(documents: DataFrame, keys: list[str], fields: list[str], vectors: str | None = None, by: list[str] = ()) -> DataFrame:
    """(by, documents, document_checksum, vector_checksum): order-insensitive checksums of distinct rows, mergeable across partitions."""
    digest = lambda *c: row_digest(documents, *c)
    rows = documents.select(*by, digest(*keys, *fields).alias("d"), digest(*keys, vectors).alias("v") if vectors else F.lit(0).cast("bigint").alias("v")).distinct()
    return rows.groupBy(*by).agg(F.count("*").alias("documents"), F.hex(F.bit_xor("d")).alias("document_checksum"), F.hex(F.bit_xor("v")).alias("vector_checksum"))


def keyset_batch(documents: DataFrame, key: str, after: str | None, limit: int) -> DataFrame:
    """The next ``limit`` documents by key after ``after`` (from the start if null). The filter reaches the scan; the limit is a distributed top-k."""
    rows = documents if after is None else documents.filter(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def reconcile(source: DataFrame, destination: DataFrame, key: str, fields: list[str], by: list[str] = ()) -> DataFrame:
    """(by, key, problem): extra (only in the destination), conflicting (fields differ), gap (missing below the destination's last key, of the same ``by``). None may be there when a copy resumes."""
    s = source.select(*by, F.col(key).alias("_s"), F.struct(*fields).alias("a"))
    d = destination.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(key).alias("_d"), F.struct(*fields).alias("b"))
    same = F.col("_s") == F.col("_d")
    for c in by:
        same &= F.col(c) == F.col(f"_{c}")
    j = s.join(d, same, "full_outer").select(*[F.coalesce(c, f"_{c}").alias(c) for c in by], "_s", "_d", "a", "b")
    last = destination.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max(key).alias("_last"))
    if by:
        of = F.lit(True)
        for c in by:
            of &= F.col(c) == F.col(f"_{c}")
        j = j.join(last, of, "left")
    else:
        j = j.crossJoin(F.broadcast(last))
    problem = F.when(F.col("_s").isNull(), "extra").when(F.col("_d").isNull() & (F.col("_s") <= F.col("_last")), "gap").when(F.col("_d").isNotNull() & ~F.col("a").eqNullSafe(F.col("b")), "conflicting")
    return j.select(*by, F.coalesce("_s", "_d").alias(key), problem.alias("problem")).filter("problem IS NOT NULL")


class Endpoint(ABC):
    """One side of a migration."""

    @abstractmethod
    def documents(self) -> DataFrame: ...

    @abstractmethod
    def chunks(self) -> DataFrame: ...

    @abstractmethod
    def write(self, documents: DataFrame, chunks: DataFrame) -> None: ...

    @abstractmethod
    def load_progress(self) -> dict | None: ...

    @abstractmethod
    def save_progress(self, progress: dict) -> None: ...


class StoreEndpoint(Endpoint):
    """A generation store; progress lies beside it as JSON lines, the last one holds."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def documents(self) -> DataFrame:
        return self.store.table("documents")

    def chunks(self) -> DataFrame:
        return self.store.table("chunks").drop("delta")

    #: Readers merge so many segments at most before the copy folds them.
    SEGMENTS = 32

    def write(self, documents: DataFrame, chunks: DataFrame) -> None:
        self.store.activate(documents, chunks)
        if self.store.segments() > self.SEGMENTS:
            self.store.compact(override_budget=True)

    def load_progress(self) -> dict | None:
        p, fs = self.store._fs(f"{self.store.path}/progress.json")
        return json.loads(self.spark.read.text(f"{self.store.path}/progress.json", wholetext=True).first()[0]) if fs.exists(p) else None

    def save_progress(self, progress: dict) -> None:
        p, fs = self.store._fs(f"{self.store.path}/progress.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(progress).encode()))
        out.close()


class JdbcEndpoint(Endpoint):
    """A relational database through Spark's JDBC source. Reading is partitioned by ``partitions`` ranges of the documents' keys; a batch is
    written to staging tables and moved by one statement each, which replaces rows of the same key, so a repeated batch doubles nothing."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, partitions: int = 32):
        self.spark, self.url, self.properties, self.partitions = spark, url, properties or {}, partitions

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, table, properties=self.properties)

    def ranges(self, sample: list[str]) -> list[str]:
        """Conditions that cut the keys into ranges at the values of a sorted sample; together they hold every row once."""
        quote = lambda x: "'" + x.replace("'", "''") + "'"
        edges = [sample[i * len(sample) // self.partitions] for i in range(1, self.partitions)] if len(sample) >= self.partitions else sorted(set(sample))
        edges = sorted(set(edges))
        if not edges:
            return ["1 = 1"]
        return [f"doc_key < {quote(edges[0])} OR doc_key IS NULL", *[f"doc_key >= {quote(a)} AND doc_key < {quote(b)}" for a, b in zip(edges, edges[1:], strict=False)], f"doc_key >= {quote(edges[-1])}"]

    def _ranged(self, table: str) -> DataFrame:
        keys = self._read(f"(SELECT doc_key FROM {table} ORDER BY doc_key) AS k").sample(0.01, 7).limit(100_000).toPandas()["doc_key"].dropna()
        return self.spark.read.jdbc(self.url, table, predicates=self.ranges(sorted(keys)), properties=self.properties)

    def documents(self) -> DataFrame:
        return self._ranged("documents")

    def chunks(self) -> DataFrame:
        return self._ranged("chunks")

    def merge_statements(self, table: str) -> list[str]:
        """What moves a staged batch into a table: its documents' old rows go first."""
        return [f"DELETE FROM {table} WHERE doc_key IN (SELECT doc_key FROM staged_documents)", f"INSERT INTO {table} SELECT * FROM staged_{table}"]

    def write(self, documents: DataFrame, chunks: DataFrame) -> None:
        documents.write.jdbc(self.url, "staged_documents", mode="overwrite", properties=self.properties)
        chunks.write.jdbc(self.url, "staged_chunks", mode="overwrite", properties=self.properties)
        connection = self.spark.sparkContext._jvm.java.sql.DriverManager.getConnection(self.url, self.properties.get("user", ""), self.properties.get("password", ""))
        try:
            connection.setAutoCommit(False)
            for table in ("chunks", "documents"):
                for sql in self.merge_statements(table):
                    connection.createStatement().executeUpdate(sql)
            connection.commit()
        finally:
            connection.close()

    def load_progress(self) -> dict | None:
        row = self._read("migration_progress").orderBy(F.desc("updated_at")).first()
        return json.loads(row["progress"]) if row else None

    def save_progress(self, progress: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(progress),)], "progress string").withColumn("updated_at", F.current_timestamp())
        row.write.jdbc(self.url, "migration_progress", mode="append", properties=self.properties)


@dataclass
class Report:
    documents: int
    chunks: int
    batches: int
    resumed_after: str | None
    source_checksum: str
    destination_checksum: str
    searches: int

    def to_json(self) -> str:
        return json.dumps(asdict(self))


#: What is compared of a document and of a chunk.
FIELDS = ["revision", "title", "content", "metadata", "content_hash", "chunking_fingerprint", "embedding_identity"]
CHUNK_FIELDS = ["doc_key", "revision", "ordinal", "text", "indexed_text", "context", "start_line", "end_line"]


def fingerprint(endpoint: Endpoint) -> tuple[int, int, str]:
    """(documents, chunks, checksum) over documents with their metadata, chunks and embeddings."""
    d = audit(endpoint.documents(), ["doc_key"], FIELDS).first()
    c = audit(endpoint.chunks(), ["chunk_key"], CHUNK_FIELDS, "embedding").first()
    one = lambda r: (r["documents"], f"{r['document_checksum']}-{r['vector_checksum']}") if r else (0, "")
    (n, x), (m, y) = one(d), one(c)
    return n, m, f"{x}/{y}"


def migrate(source: Endpoint, destination: Endpoint, batch: int = 256, searches: int = 16) -> Report:
    """Copy in key order, a batch at a time, from where an interrupted run stopped.

    At the end both sides must have equal checksums of documents, chunks and embeddings, the source must still be what it was, and
    ``searches`` dense searches with vectors of the source must find the same on both sides.
    """
    if not 1 <= batch <= 10_000:
        raise EngineError("invalid_argument", "batch must be 1 to 10000")
    key = "doc_key"
    before = fingerprint(source)
    progress = destination.load_progress()
    if progress and progress["source_checksum"] != before[2]:
        raise EngineError("invalid_argument", "the source changed since the run began")
    plain = lambda d: d.withColumn("metadata", F.array_sort(F.map_entries("metadata")))
    problem = reconcile(plain(source.documents()), plain(destination.documents()), key, FIELDS).first()
    if problem:
        raise EngineError("already_exists", f"{problem['problem']}: {problem[key]}")
    after = destination.documents().agg(F.max(key)).first()[0]
    resumed, batches = after, 0
    while True:
        part = materialize(keyset_batch(source.documents(), key, after, batch), "batch")
        last = part.agg(F.max(key)).first()[0]
        if last is None:
            break
        destination.write(part, source.chunks().join(F.broadcast(part.select(F.col(key).alias("_k"))), F.col(key) == F.col("_k"), "left_semi"))
        after, batches = last, batches + 1
        destination.save_progress({"last_document": after, "source_checksum": before[2], "complete": False})
    end, again = fingerprint(destination), fingerprint(source)
    if again != before:
        raise EngineError("invalid_argument", "the source changed during the copy")
    if end != before:
        raise EngineError("corrupt_index", "the copies differ")
    if not search_equality(source, destination, searches).isEmpty():
        raise EngineError("corrupt_index", "searches find other chunks in the copy")
    destination.save_progress({"last_document": after, "source_checksum": before[2], "complete": True})
    return Report(end[0], end[1], batches, resumed, before[2], end[2], searches)


def search_equality(source: Endpoint, destination: Endpoint, searches: int, k: int = 10) -> DataFrame:
    """Rows on which dense searches on both sides do not agree; the queries are ``searches`` vectors of the source, chosen by a hash."""
    dimension = source.chunks().agg(F.max(F.size("embedding"))).first()[0] or 0
    if dimension <= 0 or not searches:
        return source.documents().select(F.lit(0).alias("query_id"), F.col("doc_key").alias("key")).limit(0)
    sides = [dense.usable_vectors(e.chunks(), "chunk_key", "embedding", dimension) for e in (source, destination)]
    asked = sides[0].orderBy(F.xxhash64("key"), "key").limit(searches).select(F.col("key").alias("query_id"), "vector")
    asked = materialize(asked, "queries")
    return sampled_search_equality(*[dense.batch_search(v, asked, k, dimension) for v in sides])


def sampled_search_equality(left: DataFrame, right: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Rows (query_id, key) on which two result tables (query_id, key, score) do not agree."""
    l, r = left.select("query_id", "key", F.col("score").alias("a")), right.select("query_id", "key", F.col("score").alias("b"))
    return l.join(r, ["query_id", "key"], "full_outer").filter(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))
