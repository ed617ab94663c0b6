"""Session helpers: reading tables, shipping the package, the shared folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Python workers on other machines get this package as a zip, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="codestrata-")) / "codestrata.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: UTC; AQE for run-time re-planning; the package on the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    _ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Input bytes of one CPU-bound task at most, as the optimizer estimates them from the files.
TASK_BYTES = 32 << 20


def cpu_tasks(df: DataFrame, least: int = 3) -> int:
    """Number of tasks for work bound by CPU: by the bytes read, but at least ``least`` a core and the session's shuffle partitions."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a source that does not know its size reports the largest number
    by_size = -(-size // TASK_BYTES) if size < 1 << 56 else 0
    return max(least * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), by_size)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only on one machine, as in tests, a temporary one is made where the session
    names none, and kept for the session; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("codestrata.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set("codestrata.shared.dir", found)
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/codestrata/{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> None:
    """Remove the tables this application has materialised; results read from them must be done with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table written in the shared folder.

    Unlike blocks held by executors the files outlive any executor; they are removed when the
    application ends, or before by ``clear_shared``.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)
