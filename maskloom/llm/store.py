"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from maskloom.session import ship

_LOCAL: dict[str, str] = {}
#: Rows that Parquet readers hand on at a time, and bytes that a writer holds before they go to the file. No result hangs on them.
READ_ROWS, WRITE_BYTES = 512, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local-mode session (tests) may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="maskloom-")
    return _LOCAL[app]


def prepare(spark: SparkSession, size: str = "2m") -> None:
    """Ship the package to the Python workers, bound the bytes of an Arrow batch and the rows that are read at a time.

    A bound is left alone if the session sets its own. Rows are whole documents; at Spark's default
    a batch of them takes 64 MB several times over, in the JVM's buffers and in each Python worker,
    and 4,096 texts read at a time are arrays of many MB, which grow the heap.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(key) == "4096":
        spark.conf.set(key, READ_ROWS)


def _path(df_or_spark, path: str):
    sc = df_or_spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


#: With it, the shuffle files of an execution leave the disks when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    The files go when the application's JVM ends, or with ``dropped``. The shuffle files of this write
    go when it ends, before the next step fills the disks; other executions keep theirs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskloom-{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.option("parquet.block.size", WRITE_BYTES).parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._maskloom_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` that nothing reads any more."""
    for df in tables:
        p, fs = _path(df.sparkSession, df._maskloom_path)
        fs.delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
