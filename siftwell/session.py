"""Sessions, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from siftwell.errors import EngineError

_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siftwell")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so they need no path to it of their own."""
    sc = spark.sparkContext
    root = Path(__file__).parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    _SHIPPED.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="siftwell-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/siftwell.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"siftwell/{f.relative_to(root)}")
    sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; a file or a folder of files."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, ``spark.checkpoint.dir``; removed when the driver ends.

    Only where that is unset and there is but one machine (a local master, as in tests) a local folder is made and set.
    """
    ship_package(spark)
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _SCRATCH:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise EngineError("invalid_argument", "spark.checkpoint.dir is not set: executors of several machines need a folder that all of them share")
            base = "file://" + tempfile.mkdtemp(prefix="siftwell-")
            sc.setCheckpointDir(base)
        _SCRATCH[app] = f"{base.rstrip('/')}/siftwell-{app}"
        atexit.register(_clean_up, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _clean_up(spark: SparkSession, path: str) -> None:
    """A folder without a scheme is one of the default file system; the session may be gone by now."""
    try:
        remove_path(spark, path)
    except Exception:  # noqa: BLE001 - the interpreter is ending
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: Paths made within each open ``scratch``, innermost last.
_SCOPES: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at the end; results must have been fetched by then. For applications that answer many requests."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove_path(spark, path)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage and survives lost executors, and is computed once, however often it is read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
