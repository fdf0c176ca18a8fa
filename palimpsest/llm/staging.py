"""Tables written between the stages of a job, in the folder that the cluster shares.

A written table cuts lineage: what comes after it never recomputes what came
before, and it survives the loss of executors.  The folder is the session's
``spark.checkpoint.dir``; only where that is unset, as in local tests, a folder
of this machine is used.

Tables that a job is done with are discarded at once; the others, which a result may
still be read from, are removed when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def folder(spark: SparkSession) -> str:
    """The shared folder, without a slash at its end."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        told = spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        told = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(told)
        told = spark.sparkContext.getCheckpointDir()
    return told.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as some jobs run; releases without such a setting go without."""
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
    except Exception as e:
        if "CANNOT_MODIFY" not in str(e):
            raise
        yield
        return
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, batch_rows: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and give back a frame that reads it.

    Shuffle files go when the write that made them ends.  ``batch_rows`` bounds the
    rows that go to a Python worker at once, for rows that hold whole sets.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    with ExitStack() as held:
        held.enter_context(setting(spark, _CLEANUP, "true"))
        if batch_rows:
            held.enter_context(setting(spark, _BATCH, str(batch_rows)))
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    fs, where = _located(spark, path)
    fs.deleteOnExit(where)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        fs, where = _located(table.sparkSession, table.staged_at)
        fs.delete(where, True)
