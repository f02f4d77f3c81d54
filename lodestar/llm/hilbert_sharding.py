"""Hilbert-curve ordering: rows near in several metadata dimensions meet in one shard.

Each dimension is quantised to ``bits`` levels, the levels give a position on the Hilbert
curve, the rows are range-sorted by it and the sorted order is cut into runs of equal length.
A shard so covers a compact box of every dimension, and file statistics prune on each of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stable, text_bytes

#: Levels of a dimension: 2 ** BITS.
BITS = 8


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of rows of levels (n x dims), each below 2 ** bits.

    Public transpose form of the curve (Skilling, 2004): undo the excess rotations from
    the highest bit down, Gray-encode, then interleave the bits of the dimensions.
    """
    x = levels.astype(np.int64).T.copy()
    dims = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    q = high
    while q > 1:
        gray ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= gray
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def hilbert_column(levels: list[Column], bits: int = BITS) -> Column:
    """The curve position as a column; levels are integer columns below 2 ** bits."""
    if len(levels) * bits > 62:
        raise ValueError("dimensions * bits must be at most 62")

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return index(*levels)


def numeric_level(column: Column, bits: int = BITS) -> Column:
    """A level that grows with the logarithm of a number: eight to each doubling; null and below 1: 0."""
    level = F.floor(F.log2(F.greatest(column.cast("double"), F.lit(1.0))) * 8)
    return F.least(F.coalesce(level, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def nominal_level(column: Column, bits: int = BITS) -> Column:
    """A level for a name: all rows of a name share it; null has level 0."""
    return F.when(column.isNull(), 0).otherwise(F.pmod(F.xxhash64(column), F.lit((1 << bits) - 1)) + 1).cast("int")


def document_levels(bits: int = BITS) -> list[Column]:
    """Dimensions of the documents table: language, source, size of the text."""
    return [nominal_level(F.col("lang"), bits), nominal_level(F.col("source"), bits), numeric_level(text_bytes("text"), bits)]


def place(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """rows, range-sorted by ``order``, with shard and slot: runs whose lengths differ by one at most.

    The sorted rows are kept once in the shared folder; what the driver sees is one count
    for each partition. ``order`` has to name a column that tells hot cells' rows apart,
    else equal cells could not be split over tasks.
    """
    spark = rows.sparkSession
    sort = [F.col(c).asc_nulls_first() for c in order]
    sorted_rows = stable(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_rows.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # one row a partition
    total, starts = 0, []
    for r in counts:
        starts.append((r["_part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    ranked = sorted_rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_start") + local)
    shard = F.expr(f"int((_rank * {shards}) div {max(total, 1)})")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")  # rank of the shard's first row
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).drop("_at", "_part", "_start", "_rank")


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = BITS, levels: list[Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    law is ``rows``: shards hold equal counts, at most one apart. Ties on the curve are
    ordered by doc_id, then by text; equal rows are interchangeable and each keeps a slot.
    A null text has size 1 and crc 0, a null doc_id sorts first, null lang or source have a
    level of their own, an empty table gives no rows, other columns are not read.
    """
    prepare(docs.sparkSession)
    levels = document_levels(bits) if levels is None else levels
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (text_bytes("text") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        hilbert_column(levels, bits).alias("curve"),
        F.xxhash64(text).alias("_tie"),
    )
    placed = place(rows, ["curve", "doc_id", "_tie"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 8, rows_a_file: int = 1_000_000, bits: int = BITS) -> None:
    """Write docs as Parquet under shard=N in curve order, so that row groups prune by every dimension.

    Rows are range-partitioned by the curve again, on their way to files; a shard is written
    by as many tasks as its rows need. A column of docs named shard is replaced.
    """
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"_curve": hilbert_column(document_levels(bits), bits), "_tie": F.xxhash64(text)})
    placed = place(keyed, ["_curve", "doc_id", "_tie"], shards).drop("_tie", "_curve", "slot")
    placed.write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)
