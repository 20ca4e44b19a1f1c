"""A corpus as immutable generations of Parquet tables, with atomic revisioned changes.

A generation has ``documents``, ``chunks`` (with ``delta`` marks) and ``revisions`` (the latest known revision of every document, erased ones
too). Each table is a list of segments. A change writes segments with what is new only, reads them back for faults, and then
renames a manifest with the longer lists into place; readers pin a number and never see a mix. What a revision supersedes is left
out when reading, by the latest revisions; ``compact`` folds all segments into one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import EngineError
from siftwell.functions.chunking import ChunkOptions, chunk_documents
from siftwell.functions.hashing import content_hash
from siftwell.functions.vectors import UNIT_TOLERANCE, Embedder, dot, embedded
from siftwell.session import materialize, remove_path

DOCUMENTS = "doc_key string, revision bigint, title string, content string, metadata map<string,string>, content_hash string, chunking_fingerprint string, embedding_identity string"
CHUNKS = "chunk_key string, doc_key string, revision bigint, ordinal int, text string, indexed_text string, context string, start_line int, end_line int, embedding array<float>, delta boolean"
REVISIONS = "doc_key string, revision bigint, deleted boolean, content_hash string"
SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS, "revisions": REVISIONS}


def prepare(documents: DataFrame, options: ChunkOptions = ChunkOptions(), embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) ready for ``Store.activate``, from (doc_key, revision, title, content, metadata)."""
    docs = documents.select("doc_key", F.col("revision").cast("bigint").alias("revision"), "title", "content", "metadata").withColumn("content_hash", content_hash(F.col("title"), F.col("content"), F.col("metadata")))
    docs = docs.withColumn("chunking_fingerprint", F.lit(options.fingerprint)).withColumn("embedding_identity", F.lit(embedder.identity if embedder else None).cast("string"))
    chunks = chunk_documents(docs, options).join(docs.select("doc_key", "revision"), "doc_key")
    chunks = embedded(chunks, "indexed_text", embedder) if embedder else chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    return docs, chunks


def fetched(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of (chunk_key, ordinality and whatever else tells lists apart); unknown keys are left out, a key asked for twice comes twice."""
    return keys.join(chunks.withColumnRenamed("chunk_key", "_c"), F.col("chunk_key") == F.col("_c")).drop("_c")


@dataclass(frozen=True)
class MaintenancePolicy:
    """When the delta should be folded into the base."""

    delta_rows: int = 10_000
    delta_share: float = 0.1
    tombstone_share: float = 0.1
    memory_bytes: int = 1 << 30
    exact_below: int = 2000

    def __post_init__(self):
        if min(self.delta_rows, self.delta_share, self.tombstone_share, self.memory_bytes, self.exact_below) < 0:
            raise EngineError("invalid_argument", "policy values must not be negative")

    def required(self, base: int, delta: int, tombstones: int, dimension: int) -> bool:
        return (
            delta >= self.delta_rows
            or base > 0 and (delta >= self.delta_share * base or tombstones >= self.tombstone_share * base)
            or (base + delta) * dimension * 4 > self.memory_bytes
            or base == 0 and delta >= self.exact_below
        )


class Store:
    """The generations under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- generations ---

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        folder, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json"))

    def manifest(self, generation: int | None = None) -> dict:
        names = self._manifests()
        if not names:
            return {"generation": 0, "tables": {}, "tombstones": 0, "merged": True}
        name = names[-1] if generation is None else f"{generation:010d}.json"
        if name not in names:
            raise EngineError("not_found", f"generation {generation}")
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).first()[0])

    @property
    def generation(self) -> int:
        return self.manifest()["generation"]

    def table(self, name: str, generation: int | None = None) -> DataFrame:
        """A table of a generation (the latest by default): the segments, without what later revisions supersede."""
        return self._merged(self.manifest(generation), name)

    def _merged(self, m: dict, name: str) -> DataFrame:
        if not m["tables"].get(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(*m["tables"][name])
        if m["merged"]:
            return rows
        if name == "revisions":
            # one fold by key, in each task before the shuffle
            last = rows.groupBy("doc_key").agg(F.max(F.struct("revision", "deleted", "content_hash")).alias("r"))
            return last.select("doc_key", "r.revision", "r.deleted", "r.content_hash")
        live = self._merged(m, "revisions").filter("NOT deleted").select(F.col("doc_key").alias("_k"), F.col("revision").alias("_r"))
        return rows.join(live, (F.col("doc_key") == F.col("_k")) & (F.col("revision") == F.col("_r")), "left_semi")

    def _segment(self, base: dict, token: str, name: str, df: DataFrame) -> str:
        """Write a segment of the generation after ``base``; nobody reads it before a manifest names it."""
        path = f"{self.path}/generations/{base['generation'] + 1:010d}-{token}/{name}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]).write.parquet(path)
        return path

    def _publish(self, base: dict, segments: dict[str, str], tombstones: int, replace: bool = False) -> int:
        """Make the next generation of written segments, after those of ``base`` or in their place; a generation that appeared meanwhile wins and this one fails."""
        n, token = base["generation"] + 1, uuid.uuid4().hex
        kept = {} if replace else base["tables"]
        tables = {name: [*kept.get(name, []), *([segments[name]] if name in segments else [])] for name in SCHEMAS}
        merged = replace or not base["tables"]
        temp, fs = self._fs(f"{self.path}/manifests/.{token}.tmp")
        final, _ = self._fs(f"{self.path}/manifests/{n:010d}.json")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps({"generation": n, "tables": tables, "tombstones": tombstones, "merged": merged}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise EngineError("already_exists", f"generation {n} was published by another writer")
        return n

    # --- changes ---

    def verdicts(self, incoming: DataFrame, base: dict | None = None) -> DataFrame:
        """(doc_key, revision, content_hash, verdict): apply, unchanged or stale, against the latest known revisions."""
        known = self._merged(base or self.manifest(), "revisions").select(F.col("doc_key").alias("_k"), F.col("revision").alias("_r"), F.col("content_hash").alias("_h"), F.col("deleted").alias("_d"))
        j = incoming.join(known, F.col("doc_key") == F.col("_k"), "left")
        verdict = (
            F.when(F.col("_r").isNull() | (F.col("revision") > F.col("_r")), "apply")
            .when((F.col("revision") == F.col("_r")) & ~F.col("_d") & (F.col("content_hash") == F.col("_h")), "unchanged")
            .otherwise("stale")
        )
        return j.withColumn("verdict", verdict).drop("_k", "_r", "_h", "_d")

    @staticmethod
    def document_faults(documents: DataFrame) -> DataFrame:
        """(doc_key, fault): empty or repeated keys, null content, a content hash that is not that of the content."""
        key = documents.groupBy("doc_key").agg(F.count("*").alias("n")).filter("doc_key IS NULL OR doc_key = '' OR n > 1").select("doc_key", F.lit("document_key").alias("fault"))
        wrong = ~F.coalesce(F.col("content_hash") == content_hash(F.col("title"), F.col("content"), F.col("metadata")), F.lit(False))
        own = F.when(F.col("content").isNull(), "content").when(F.coalesce(F.col("revision"), F.lit(-1)) < 0, "revision").when(wrong, "content_hash")
        return key.unionByName(documents.select("doc_key", own.alias("fault")).filter("fault IS NOT NULL"))

    @staticmethod
    def chunk_faults(chunks: DataFrame) -> DataFrame:
        """(doc_key, fault): repeated chunks, gaps in the ordinals, partial or mixed embeddings, embeddings that are not finite or not of unit length."""
        chunk = chunks.groupBy("chunk_key").agg(F.count("*").alias("n"), F.min("doc_key").alias("doc_key")).filter("n > 1").select("doc_key", F.lit("chunk_key").alias("fault"))
        off = ~F.coalesce(F.abs(dot(F.col("embedding"), F.col("embedding")) - 1) <= UNIT_TOLERANCE, F.lit(False))
        per = chunks.groupBy("doc_key").agg(
            F.count("*").alias("n"), F.max("ordinal").alias("last"), F.countDistinct("ordinal").alias("d"), F.count("embedding").alias("e"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"),
            F.max(F.when(F.col("embedding").isNotNull(), off)).alias("off"),
        )
        fault = F.when(F.expr("last <> n - 1 OR d <> n"), "ordinals").when(F.expr("e NOT IN (0, n) OR e > 0 AND lo <> hi"), "embeddings").when(F.col("off"), "norm")
        return chunk.unionByName(per.select("doc_key", fault.alias("fault")).filter("fault IS NOT NULL"))

    def activate(self, documents: DataFrame, chunks: DataFrame) -> DataFrame:
        """Make prepared documents current, all or none: (doc_key, revision, verdict). A stale revision or a fault leaves everything as it was.

        Chunks are made (cut, embedded) once, as they are written; the faults are looked for in what was written.
        """
        base, token = self.manifest(), uuid.uuid4().hex
        documents = materialize(documents, "incoming")
        fault = self.document_faults(documents).first()
        if fault:
            raise EngineError("invalid_argument", f"{fault['fault']} of {fault['doc_key']}")
        verdicts = materialize(self.verdicts(documents, base).select("doc_key", "revision", "verdict"), "verdicts")
        stale = verdicts.filter("verdict = 'stale'").first()
        if stale:
            raise EngineError("already_exists", f"revision {stale['revision']} of {stale['doc_key']} is not newer")
        self._same_space(documents)
        keys = verdicts.filter("verdict = 'apply'").select(F.col("doc_key").alias("_k"))
        if keys.isEmpty():
            return verdicts
        fresh = documents.join(keys, F.col("doc_key") == F.col("_k"), "left_semi")
        paths = {"chunks": self._segment(base, token, "chunks", chunks.withColumn("delta", F.lit(True)).join(keys, F.col("doc_key") == F.col("_k"), "left_semi"))}
        fault = self.chunk_faults(self.spark.read.schema(CHUNKS).parquet(paths["chunks"])).first()
        if fault:
            remove_path(self.spark, paths["chunks"].rpartition("/")[0])
            raise EngineError("invalid_argument", f"{fault['fault']} of {fault['doc_key']}")
        paths["documents"] = self._segment(base, token, "documents", fresh)
        paths["revisions"] = self._segment(base, token, "revisions", fresh.select("doc_key", "revision", F.lit(False).alias("deleted"), "content_hash"))
        self._publish(base, paths, base["tombstones"] + self._in_base(base, keys))
        return verdicts

    def _in_base(self, base: dict, keys: DataFrame) -> int:
        """How many chunks of the base a change of these documents (_k) buries."""
        return self._merged(base, "chunks").filter("NOT delta").join(keys, F.col("doc_key") == F.col("_k"), "left_semi").count()

    def _same_space(self, documents: DataFrame) -> None:
        """One chunking and one embedding identity per corpus."""
        for c in ("chunking_fingerprint", "embedding_identity"):
            seen = {r[0] for r in self.table("documents").select(c).distinct().limit(3).collect()} | {r[0] for r in documents.select(c).distinct().limit(3).collect()}
            if len(seen) > 1:
                raise EngineError("invalid_argument", f"the corpus would mix {c}: {sorted(map(str, seen))}")

    def erase(self, keys: DataFrame) -> DataFrame:
        """(doc_key, revision, removed) for (doc_key, revision): removes documents and remembers the revision; erasing again is no error, an older revision is."""
        base = self.manifest()
        known = self._merged(base, "revisions").select(F.col("doc_key").alias("_k"), F.col("revision").alias("_r"), F.col("deleted").alias("_d"))
        j = keys.select("doc_key", F.col("revision").cast("bigint").alias("revision")).join(known, F.col("doc_key") == F.col("_k"), "left")
        stale = F.col("_r").isNotNull() & ((F.col("revision") < F.col("_r")) | (F.col("revision") == F.col("_r")) & ~F.col("_d"))
        j = j.select("doc_key", "revision", F.coalesce(~F.col("_d"), F.lit(False)).alias("removed"), stale.alias("stale"), (F.col("_r").isNull() | (F.col("revision") > F.col("_r"))).alias("record"))
        j = materialize(j, "erasures")
        late = j.filter("stale").first()
        if late:
            raise EngineError("already_exists", f"revision of {late['doc_key']} is not newer")
        marks = j.filter("record").select("doc_key", "revision", F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("content_hash"))
        if not marks.isEmpty():
            buried = self._in_base(base, marks.select(F.col("doc_key").alias("_k")))
            path = self._segment(base, uuid.uuid4().hex, "revisions", marks)
            self._publish(base if base["tables"] else base | {"tables": {"revisions": []}}, {"revisions": path}, base["tombstones"] + buried)
        return j.select("doc_key", "revision", "removed")

    def compact(self, override_budget: bool = False, policy: MaintenancePolicy = MaintenancePolicy()) -> bool:
        """Fold all segments into one, the delta into the base, and forget tombstones, if the policy asks for it or the budget is overridden."""
        s = self.stats().first()
        if not override_budget and not policy.required(s["base"], s["delta"], s["tombstones"], s["dimension"] or 0):
            return False
        self._copy(self, self.manifest(), self.manifest(), True, 0)
        return True

    def _copy(self, source: Store, m: dict, base: dict, folded: bool, tombstones: int) -> int:
        """Write a generation of ``source`` as single segments and publish them in place of those of ``base``."""
        token, paths = uuid.uuid4().hex, {}
        for name in SCHEMAS:
            rows = source._merged(m, name)
            paths[name] = self._segment(base, token, name, rows.withColumn("delta", F.lit(False)) if name == "chunks" and folded else rows)
        return self._publish(base, paths, tombstones, True)

    def checkpoint(self, path: str) -> int:
        """Copy the current generation to another path; its number."""
        other, m = Store(self.spark, path), self.manifest()
        return other._copy(self, m, {"generation": m["generation"] - 1, "tables": {}}, False, m["tombstones"])

    def restore(self, path: str) -> int:
        """Take over the latest generation of a checkpoint as this store's next one; its number."""
        other = Store(self.spark, path)
        m = other.manifest()
        if not m["tables"]:
            raise EngineError("not_found", f"no checkpoint under {path}")
        return self._copy(other, m, self.manifest(), False, m["tombstones"])

    def segments(self) -> int:
        """How many segments a reader of the chunks merges."""
        return len(self.manifest()["tables"].get("chunks", []))

    # --- reading ---

    def fetch(self, keys: DataFrame, text: bool = True, embedding: bool = False) -> DataFrame:
        """The chunks of (chunk_key, ordinality) in that order; unknown keys are left out. Unwanted columns are not read."""
        chunks = self.table("chunks").select("chunk_key", "doc_key", "revision", "ordinal", "start_line", "end_line", *(["text", "context"] if text else []), *(["embedding"] if embedding else []))
        docs = self.table("documents").select(F.col("doc_key").alias("_k"), "title", "metadata")
        return fetched(keys, chunks).join(docs, F.col("doc_key") == F.col("_k")).drop("_k").orderBy("ordinality")

    def find_by_uri(self, uri: str) -> DataFrame:
        """The document with this key, with its chunks in order; none if it is unknown or erased."""
        docs = self.table("documents").filter(F.col("doc_key") == uri)
        chunks = self.table("chunks").filter(F.col("doc_key") == uri).groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_key", "text", "start_line", "end_line"))).alias("chunks"))
        return docs.join(chunks.withColumnRenamed("doc_key", "_k"), F.col("doc_key") == F.col("_k"), "left").drop("_k")

    def stats(self) -> DataFrame:
        """One row: documents, chunks, base, delta, tombstones, dimension, dense_bytes, generation."""
        m = self.manifest()
        c = self.table("chunks").agg(
            F.count("*").alias("chunks"), F.count(F.when(~F.col("delta"), 1)).alias("base"), F.count(F.when(F.col("delta"), 1)).alias("delta"), F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("dimension"), F.coalesce(F.sum(F.when(F.col("embedding").isNotNull(), F.size("embedding") * 4)), F.lit(0)).alias("dense_bytes")
        )
        return self.table("documents").agg(F.count("*").alias("documents")).crossJoin(c).withColumn("tombstones", F.lit(m["tombstones"])).withColumn("generation", F.lit(m["generation"]))
