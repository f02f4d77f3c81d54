"""How stored tables are laid out: runs of an order, and joins that a frequent key doesn't gather in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Rows that are broadcast, at most.
FEW = 100_000
#: Values that are written into a filter, so that files and row groups are skipped by it.
LISTED = 1_000


def few(df: DataFrame, bound: int = FEW) -> bool:
    """Whether a table has so few rows that it can be broadcast."""
    return df.limit(bound + 1).count() <= bound


def hinted(df: DataFrame, bound: int = FEW) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if few(df, bound) else df


def in_runs(rows: DataFrame, order: list[str], size: int, name: str = "runs") -> DataFrame:
    """rows with ``run``: range-sorted by ``order`` and cut into runs of ``size`` rows at most.

    What is grouped by a key and its run is bounded, however many rows a key has; a key with few
    rows is in one run, or in two where a run ends.
    """
    at = F.monotonically_increasing_id()
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("run", F.floor(at / size).cast("long")), name)


def join_unique(rows: DataFrame, table: DataFrame, key: str, often: int = 10_000, bound: int = FEW) -> DataFrame:
    """rows joined with the table's unique keys. Keys that ``often`` rows or more have are broadcast, if they
    are few; the others are shuffled. There are at most rows / often of them."""
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= often).select(key)
    hot = written(hot, "hot")
    if hot.isEmpty() or not few(hot, bound):
        return rows.join(table, key)
    mine = table.join(F.broadcast(hot), key, "left_semi")
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(table.join(F.broadcast(hot), key, "left_anti"), key)
    return rows.join(F.broadcast(mine), key).unionByName(rest)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
