"""Stored tables: Parquet by repository; rows come, change and go by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str, repository: str | None = None) -> DataFrame:
    """A stored table, or one repository's partition of it."""
    rows = spark.read.parquet(path)
    return rows if repository is None else rows.where(F.col("repository_id") == repository)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("repository_id").parquet(path)


def replace_repositories(rows: DataFrame, path: str) -> None:
    """Write rows in place of what their repositories had; other repositories' files aren't touched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id").parquet(path)


def drop_repository(spark: SparkSession, path: str, repository: str) -> bool:
    """Remove one repository's partition from a table; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/repository_id={repository}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_everywhere(spark: SparkSession, root: str, repository: str, tables: tuple[str, ...] = ("files", "symbols", "relationships", "conversations", "messages", "vectors")) -> list[str]:
    """Remove a repository from every table; the names of those that had it."""
    return [t for t in tables if drop_repository(spark, f"{root}/{t}", repository)]
