"""Tables between steps, and the small helpers that every operator shares."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A folder of our own is made only where the setting is missing, as in tests
    on one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="glyphstream-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that cut() wrote; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clear
        pass


def cut(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This ends the lineage: what follows neither recomputes df nor depends on
    shuffle files of a lost executor, and the planner knows the table's size.
    With tidy, Spark is told to delete the shuffle files that nothing needs any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if tidy:
        # Shuffle files go when the driver's collector finds their plans unused; left to itself, it may not run for half an hour.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() whose last reader is done."""
    for t in tables:
        remove(t.sparkSession, t._cut_path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Texts go to Python in batches of at most `rows` and about `size` bytes: the session's defaults of 10,000 rows or 64 MB are held several times over by a worker. Smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key, "64m").rstrip("bkmg") or 0) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(spark.conf.get(key, "64m")[-1], 1) <= size:
        spark.conf.set(key, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
