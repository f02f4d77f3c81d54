"""Sessions: settings that suit the operators, and this package on the Python workers' path."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package; a cluster has it installed or sent along."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    seen = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in seen.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, seen) if p)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may go without the setting."""
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(given)
    return spark.sparkContext.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table that is written meanwhile goes from the executors' disks as soon as it is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that readers take the columns they need.

    What was shuffled for it is of no use once it is written, and goes from the executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if shared_dir(spark).split(":", 1)[-1].lstrip("/") not in folder:
            raise ValueError("not in the shared folder")
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "lodestar") -> SparkSession:
    """A session on this machine, as tests and the bench use it."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {
        "spark.sql.shuffle.partitions": partitions,
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    return with_package(builder.getOrCreate())
