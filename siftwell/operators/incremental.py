"""Only new or changed records: a versioned ledger of keys and content hashes.

``changed_records`` joins hashed current rows with the ledger's state; ``Ledger`` persists that state in immutable segments, one
per version with what it changed, and swaps the version pointer atomically, after the caller's work has succeeded.

Defined results
- null content hash: equals nothing, so a live record without a hash is always selected again;
- null key parts: compared null-safely, a null key is a key like any other;
- repeated rows and ties: the row with the highest order decides, then the greatest hash, then the deletion;
- null ``deleted``: counts as not deleted; null order values come first;
- empty tables: without current rows there is nothing to select, without state every live row is new;
- extra columns: ignored, whatever their names; the working columns are built before any join.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftwell.session import remove_path


def content_digest(*columns: str) -> Column:
    """SHA-256 over the columns, each marked as null or present and length-prefixed, so that no two rows share a serial form."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def latest_state(rows: DataFrame, keys: list[str], order: list[str], digest: Column, deleted: Column, where: Column | None = None) -> DataFrame:
    """The row of each key that is last by ``order``, as (keys, order, deleted, digest).

    One shuffle on the key with partial aggregation before it, so a hot key or corpus arrives as one row per task.
    """
    picked = rows.filter(where) if where is not None else rows
    struct = F.struct(*[F.col(c) for c in order], digest.alias("_digest"), F.coalesce(deleted, F.lit(False)).alias("_deleted"))
    last = picked.select(*keys, struct.alias("_last")).groupBy(*keys).agg(F.max("_last").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in order], F.col("_last._deleted").alias("deleted"), F.col("_last._digest").alias("digest"))


def changed_records(current: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows that differ from the state, as the columns of ``current`` and ``change`` (new, changed, deleted, restored).

    Both sides have one row per key, with ``deleted`` and ``digest``. A row of the current table that is deleted and
    unknown to the state is no change. Keys that only the state knows are no change either: a full snapshot has them as
    deleted rows (``mark_missing``).
    """
    c = current.alias("c")
    s = state.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("deleted").alias("_s_deleted"), F.col("digest").alias("_s_digest"), F.lit(True).alias("_s_known"))
    on = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"_s_{k}")) for k in keys])
    known, gone, was_gone = F.col("_s_known").isNotNull(), F.col("c.deleted"), F.col("_s_deleted")
    same = F.coalesce(F.col("c.digest") == F.col("_s_digest"), F.lit(False))
    change = (
        F.when(~known & ~gone, "new")
        .when(known & gone & ~was_gone, "deleted")
        .when(known & ~gone & was_gone, "restored")
        .when(known & ~gone & ~was_gone & ~same, "changed")
    )
    return c.join(s, on, "left").select("c.*", change.alias("change")).filter("change IS NOT NULL")


def mark_missing(current: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """For full snapshots: adds a deleted row for every live key of the state that the current table lacks."""
    live = state.filter(~F.col("deleted"))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    gone = live.alias("l").join(current.alias("c"), on, "left_anti").select(*keys, F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("digest"))
    return current.unionByName(gone, allowMissingColumns=True)


class Ledger:
    """State of a consumer: a list of immutable segments and a pointer file that is replaced by a rename.

    A version adds a segment with the keys it touched, so a run writes what changed and not the whole state; the latest segment that has a
    key decides. Every ``SEGMENTS`` versions they are folded into one. A run is ``begin`` (writes the next version and the change set beside it), the caller's work on ``Run.changes``, and
    ``commit``. Until the commit readers see the old version; a run that dies leaves it untouched and its
    records are selected again by the next run, none is skipped and none that was committed is repeated. Two runs that
    race are told apart by the version they started from: the later commit raises.
    """

    SEGMENTS = 16

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        """{"version": n, "state": segments} of the last commit; version 0 before the first."""
        jvm, folder, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(folder):
            return {"version": 0, "state": []}
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"version": 0, "state": []}
        text = self.spark.sparkContext.wholeTextFiles(f"{self.path}/commits/{names[-1]}").values().first()
        return json.loads(text)

    def state(self) -> DataFrame | None:
        """The committed state, or None before the first commit."""
        at = self.pointer()["state"]
        return self._merged([self.spark.read.parquet(p) for p in at]) if at else None

    def _merged(self, segments: list[DataFrame]) -> DataFrame:
        """The last row of each key; a fold in each task before one shuffle."""
        columns = [*self.keys, "deleted", "digest"]
        if len(segments) == 1:
            return segments[0].select(*columns)
        rows = reduce(DataFrame.unionByName, [d.select(*columns, F.lit(i).alias("_n")) for i, d in enumerate(segments)])
        last = rows.groupBy(*self.keys).agg(F.max(F.struct("_n", "deleted", "digest")).alias("_l"))
        return last.select(*self.keys, F.col("_l.deleted").alias("deleted"), F.col("_l.digest").alias("digest"))

    def begin(self, current: DataFrame, full_snapshot: bool = False) -> Run:
        """Select the changes of ``current`` (keys, deleted, digest and any payload) and stage the next version."""
        base = self.pointer()
        state = self.state()
        if state is None:
            state = self.spark.createDataFrame([], current.select(*self.keys, "deleted", "digest").schema)
        if full_snapshot:
            current = mark_missing(current, state, self.keys)
        token = uuid.uuid4().hex
        changes_path, state_path = f"{self.path}/staged/{token}/changes", f"{self.path}/versions/{base['version'] + 1:010d}-{token}"
        changed_records(current, state, self.keys).write.parquet(changes_path)
        changes = self.spark.read.parquet(changes_path)
        touched = changes.select(*self.keys, "deleted", "digest")
        segments = [*base["state"], state_path]
        if len(segments) > self.SEGMENTS:
            touched, segments = self._merged([*[self.spark.read.parquet(p) for p in base["state"]], touched]), [state_path]
        touched.write.parquet(state_path)
        return Run(self, base["version"], token, changes, changes_path, state_path, segments)

    def seed(self, state: DataFrame) -> DataFrame:
        """Commit a state that is known from elsewhere (keys, deleted, digest) and return it as read back."""
        base, token = self.pointer(), uuid.uuid4().hex
        path = f"{self.path}/versions/{base['version'] + 1:010d}-{token}"
        state.select(*self.keys, "deleted", "digest").write.parquet(path)
        self._swap(base["version"], [path])
        return self.spark.read.parquet(path)

    def _swap(self, base: int, segments: list[str]) -> None:
        jvm, temp, fs = self._fs(f"{self.path}/commits/.{uuid.uuid4().hex}.tmp")
        _, final, _ = self._fs(f"{self.path}/commits/{base + 1:010d}.json")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": base + 1, "state": segments}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise RuntimeError(f"another run committed version {base + 1} first")


class Run:
    """One staged run of a ledger."""

    def __init__(self, ledger: Ledger, base: int, token: str, changes: DataFrame, changes_path: str, state_path: str, segments: list[str]):
        self.ledger, self.base, self.token, self.changes = ledger, base, token, changes
        self._changes_path, self._state_path, self._segments = changes_path, state_path, segments

    def commit(self) -> int:
        """Make the staged version current; the number of the version."""
        self.ledger._swap(self.base, self._segments)
        return self.base + 1

    def abandon(self) -> None:
        """Remove what was staged."""
        for p in (self._changes_path, self._state_path):
            try:
                remove_path(self.ledger.spark, p)
            except AnalysisException:
                pass


def carried(revisions: DataFrame, runs: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Revision rows that a migration run has safely carried.

    A row is carried if the last snapshot of its run is complete or had passed the row's ``position`` (byte order).
    The snapshots are reduced to one row per run before the join; rows without a run never reach it.
    """
    final = (
        runs.filter(F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(F.max(F.struct("updated_at", F.coalesce("complete", F.lit(False)).alias("complete"), "last_document")).alias("f"))
        .select(F.col("run_id").alias("_run"), F.col("f.complete").alias("_complete"), F.col("f.last_document").alias("_last"))
    )
    rows = revisions.filter(F.col("run_id").isNotNull())
    return rows.join(final, F.col("run_id") == F.col("_run")).filter(F.col("_complete") | (F.col("_last") >= F.col(position))).drop("_run", "_complete", "_last")
