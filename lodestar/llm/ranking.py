"""Places of rows in an order over the whole table, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import removed, written

#: Starts of groups in partitions that are broadcast, at most.
FEW_STARTS = 200_000


def ranked(rows: DataFrame, order: list[str], within: str, name: str = "ranked") -> DataFrame:
    """rows with ``pos``, their place from 0 in the order of their group, and ``size``, the rows of that group.

    ``within`` is a column without nulls; nulls come first in the columns of the order, ties go by the
    place in the input. Rows are kept as a table first, so that sampling for the range partitioning
    does not compute them again, and a tie-breaker of its own splits runs of equal rows over
    tasks. A row's place is its place in the partition and what the partitions before it hold of
    its group: a row for each partition and group, so that a hot group is spread like all others.
    """
    kept = written(rows.withColumn("_tie", F.monotonically_increasing_id()), name)
    sort = [F.col(c).asc_nulls_first() for c in (within, *order, "_tie")]
    placed = written(kept.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    removed(kept)
    part = F.shiftright("_at", 33)
    held = placed.groupBy(within, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(within, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(within)).alias("size"))
    few = starts.limit(FEW_STARTS + 1).count() <= FEW_STARTS
    out = placed.withColumn("_part", part).join(F.broadcast(starts) if few else starts, [within, "_part"])
    return out.withColumn("pos", F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_start")
