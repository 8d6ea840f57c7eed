"""Tables written to the shared checkpoint folder to cut lineage.

A written table survives the loss of executors, is read back with column
pruning, and keeps iterative plans short. The folder is the one the cluster
names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a new local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="traitloom-"))
    return context.getCheckpointDir().rstrip("/")


_JOB: ContextVar[str] = ContextVar("job", default="")


@contextmanager
def job_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, also if the job fails.

    What a job returns must not read them.
    """
    name = f"job-{uuid.uuid4().hex}"
    token = _JOB.set(f"{name}/")
    try:
        yield
    finally:
        _JOB.reset(token)
        _delete(spark, f"{_root(spark)}/{name}")


def _root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/traitloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other table uses."""
    return f"{_root(spark)}/{_JOB.get()}{label}-{uuid.uuid4().hex}"


def cut_measured(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` once; return the written table and aggregates taken on the way."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    written = Observation(f"{label}-{uuid.uuid4().hex}")
    columns = [column.alias(name) for name, column in metrics.items()]
    df.observe(written, F.count(F.lit(1)).alias("rows"), *columns).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), written.get


def cut(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Write ``df`` once and return the written table and its row count."""
    table, measured = cut_measured(df, label)
    return table, measured["rows"]


def cut_outside(df: DataFrame, label: str) -> DataFrame:
    """The same, in the application's folder, where the end of a job leaves it."""
    token = _JOB.set("")
    try:
        return cut(df, label)[0]
    finally:
        _JOB.reset(token)


def purge(spark: SparkSession) -> None:
    """Delete every scratch table of this application."""
    _delete(spark, _root(spark))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's JVM collects its garbage, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
