"""Spark session and lineage helpers.

The library never creates its own cluster settings beyond what a test or the
bench needs: on a cluster the session comes configured, and
``spark.checkpoint.dir`` names the shared folder used to cut lineage.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "tessera", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster use the session you have."""
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("TESSERA_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; create a scratch one only when unset (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    The frame is persisted for the duration of the checkpoint so the plan runs
    once (an unpersisted RDD checkpoint computes it a second time to write it).
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Jobs run meanwhile hand at most ``rows`` rows at a time to Python and read as many at a time from parquet.

    Both defaults (10,000 and 4,096) hold a task's whole input at once where a row has
    kilobytes or more, in Spark's memory inside and outside the heap and in Python.
    """
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = [spark.conf.get(k) for k in keys]
    try:
        for key, value in zip(keys, before):
            spark.conf.set(key, str(min(rows, int(value)) if int(value) > 0 else rows))
        yield
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)


#: Writer options of tables with large rows: row groups of 16 MB, their size checked every 4 rows (not every 100); pages and dictionaries that are no large objects to the JVM.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size": str(256 << 10), "parquet.dictionary.page.size": str(256 << 10)}


#: No empty file that marks a finished job: the driver would start a process to set its mode, which for a moment shares all memory of its JVM.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def materialize(df: DataFrame, name: str, batch: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Columnar and compressed (cheaper than an RDD checkpoint of rows), computed
    once, lineage cut; the folder must be shared storage on a cluster.  ``batch``:
    rows that its Python steps and scans hold at a time (``small_batches``).
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    write = df.write.mode("overwrite").options(**UNMARKED | (options or {})).parquet
    if batch:
        with small_batches(spark, batch):
            write(path)
    else:
        write(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable on every executor (``addPyFile`` of a zip of the package), once per application.

    Python workers unpickle the pandas-UDF functions by module reference, so the
    package must be on their path wherever the driver was started.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import tessera

    pkg = os.path.dirname(os.path.abspath(tessera.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
