"""The log of ingestion jobs: latest snapshots, recovery, retention, and the table of a service."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftwell.errors import EngineError
from siftwell.session import materialize, remove_path

#: The states of a job; the last four are final.
STATUSES = ["queued", "chunking", "embedding", "publishing", "ready", "failed", "superseded", "cancelled"]
TERMINAL = STATUSES[4:]


def latest_snapshots(log: DataFrame, position: str = "log_seq") -> DataFrame:
    """The last snapshot of each job in arrival order: the last write wins. One shuffle, folded per task before it."""
    columns = [c for c in log.columns if c not in ("job_id", position)]
    last = log.filter("job_id IS NOT NULL").groupBy("job_id").agg(F.max_by(F.struct(*columns), position).alias("s"), F.max(position).alias(position))
    return last.select("job_id", position, *[F.col(f"s.{c}").alias(c) for c in columns])


def recovered(latest: DataFrame, document: list[str]) -> DataFrame:
    """What a restart does with each job: activate or erase the newest ready one of a document, requeue the unfinished newest, supersede other unfinished ones, keep the rest."""
    final, ready = F.col("status").isin(TERMINAL), F.col("status") == "ready"
    # one row per document by folds, so a document with very many jobs is no task of its own
    chosen = latest.groupBy(*[F.col(d).alias(f"_k{i}") for i, d in enumerate(document)]).agg(F.max("revision").alias("_newest"), F.min(F.when(ready, F.struct(-F.col("revision"), "job_id"))).alias("_ready"))
    on = reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"_k{i}")) for i, d in enumerate(document)])
    rows = latest.join(chosen, on)
    operation = F.lower(F.trim("operation"))
    action = (
        F.when(ready & (F.col("job_id") == F.col("_ready.job_id")), F.when(operation == "erase", "erase").otherwise("activate"))
        .when(final, "keep")
        .when(F.col("revision") == F.col("_newest"), "requeue")
        .otherwise("supersede")
    )
    return rows.withColumn("action", action).drop("_newest", "_ready", *[f"_k{i}" for i in range(len(document))])


def retained(latest: DataFrame, size: Column, max_jobs: int = 128, max_bytes: int = 16 << 20) -> DataFrame:
    """The jobs a compacted log keeps: all unfinished ones, and of the final ones the newest ``max_jobs`` that fit, one by one, into ``max_bytes``.

    A job that is too big for what is left is passed over, smaller ones after it may still fit; the loop runs over the candidates that can
    matter only, which ``max_jobs`` bounds as long as they fit, and is continued where some do not.
    """
    spark = latest.sparkSession
    final = latest.filter(F.col("status").isin(TERMINAL)).select("job_id", "updated_at_ms", size.alias("bytes"))
    chosen, left, seen, edge = [], max_bytes, 0, None
    while len(chosen) < max_jobs and left > 0:
        page = final.filter(F.col("bytes") <= left)
        if edge is not None:
            page = page.filter((F.col("updated_at_ms") < edge[0]) | (F.col("updated_at_ms") == edge[0]) & (F.col("job_id") < edge[1]))
        rows = page.orderBy(F.desc("updated_at_ms"), F.desc("job_id")).limit(max_jobs - len(chosen)).collect()
        for r in rows:
            if r["bytes"] <= left:
                chosen.append(r["job_id"])
                left -= r["bytes"]
        seen += len(rows)
        if not rows:
            break
        edge = (rows[-1]["updated_at_ms"], rows[-1]["job_id"])
    keep = spark.createDataFrame([(c,) for c in chosen], "_id string")
    kept = latest.filter(F.col("status").isin(TERMINAL)).join(F.broadcast(keep), F.col("job_id") == F.col("_id"), "left_semi")
    return latest.filter(~F.col("status").isin(TERMINAL)).unionByName(kept)


class JobLog:
    """The job log as versions, each a folder of appended Parquet files; the highest version with its mark of completion is read.

    A torn write leaves no committed file behind, so readers never see half a record; compaction writes a version beside the old one and marks it by a
    rename, so a crash at any time leaves one whole log.
    """

    SCHEMA = "log_seq long, job_id string, corpus_id long, doc_key string, operation string, revision long, content_hash string, status string, created_at_ms long, updated_at_ms long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 before the first compaction."""
        folder, fs = self._fs(f"{self.path}/marks")
        return max((int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()), default=0) if fs.exists(folder) else 0

    def _at(self, version: int) -> str:
        return f"{self.path}/log-{version:010d}"

    def append(self, snapshots: DataFrame) -> None:
        """Snapshots with rising log_seq; states out of the vocabulary are refused before anything is written."""
        bad = snapshots.filter(~F.col("status").isin(STATUSES) | F.col("job_id").isNull()).first()
        if bad:
            raise EngineError("invalid_argument", f"job {bad['job_id']} with status {bad['status']}")
        columns = self.spark.createDataFrame([], self.SCHEMA).columns
        snapshots.select(*columns).write.mode("append").parquet(self._at(self.version()))

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self._at(self.version()))
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def latest(self) -> DataFrame:
        return latest_snapshots(self.read())

    def compact(self, max_jobs: int = 128, max_bytes: int = 16 << 20) -> int:
        """Go over to a version with the last snapshots of the jobs that are kept; the number of them. The version before stays until the next compaction."""
        old = self.version()
        size = F.octet_length(F.concat_ws("|", "job_id", "doc_key", "content_hash", "status")) + 64
        kept = retained(materialize(self.latest(), "latest"), size, max_jobs, max_bytes)
        kept.write.mode("overwrite").parquet(self._at(old + 1))
        temp, fs = self._fs(f"{self.path}/marks/.{old + 1}.tmp")
        fs.create(temp, True).close()
        mark, _ = self._fs(f"{self.path}/marks/{old + 1}")
        if fs.exists(mark) or not fs.rename(temp, mark):
            raise EngineError("already_exists", "another writer compacted the log")
        if old:
            remove_path(self.spark, self._at(old - 1))
        return self.read().count()
