"""Session helpers: tables, how the package reaches executors, and working storage that every executor can see."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: bytes of a batch that goes to Python at once: with long texts both sides hold some MB, whatever the number of rows
BATCH_BYTES = 4 << 20
_DEFAULT_BATCH = str(64 << 20)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that they need no installation.

    Where the session has Spark's own bound for Arrow batches, it gets ``BATCH_BYTES``.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", _DEFAULT_BATCH).rstrip("b") == _DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId not in _sent:
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="docweave-zip-"), "docweave.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _sent.add(sc.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """These columns of the rows, dealt over all tasks by their hash.

    A row group can't be split and a table may be a single one, so work on texts right behind a scan may be all one task's.
    The number of tasks is fixed, as sizes after compression say little about the work.  A stream writes a file a task, so
    it gets two a core.
    """
    keys, spark = columns or rows.columns, rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    count = 2 * cores if rows.isStreaming else max(3 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(*keys).repartition(count, *keys)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where it is unset, a folder of our own on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new full path in the shared folder; what is written there goes when the application ends, or earlier by ``release``."""
    fs, p = _place(spark, f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex}")
    fs.deleteOnExit(p)
    return re.sub(r"^file:/+", "file:///", fs.makeQualified(p).toString())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there and a lost executor costs nothing behind it.

    The shuffle files of the writing job go as soon as it is done.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing refers to any more."""
    for t in tables:
        fs, p = _place(t.sparkSession, t._stored_at)
        fs.delete(p, True)
