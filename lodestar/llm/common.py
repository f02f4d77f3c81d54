"""What the corpus operators share: table access, lineage cuts, safe column names."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, stable, with_package  # noqa: F401  operators take stable from here

#: ASCII white space of every contract in this package: [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
#: Byte table that lower-cases A-Z only; bytes of multi-byte characters stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows per Arrow batch on the way to Python, so that a batch of long texts stays small.
BATCH_ROWS = 512
#: Bytes per Arrow batch, the tighter bound where texts are long.
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and bytes, and let local Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return with_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, read by Spark alone."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this package in the shared folder, once nothing reads it any more."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError("not in the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever its case or extra columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """schema and more fields behind it, all nullable."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema] + [T.StructField(n, t, True) for n, t in fields])


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, text: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows with about ``size`` bytes in column ``text``, one row at least."""
    if not batch.num_rows:
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def attach(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with more columns behind it."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def count_limit(df: DataFrame, count: str, bound: int) -> tuple[int, bool]:
    """The least count, or nearly, that at most ``bound`` rows reach, and whether there are others.

    Limits are all counts up to 40 and a quarter apart from there on.
    """
    c = F.col(count)
    place = F.when(c < 40, c).otherwise(40 + F.floor(F.log(c / 40) / math.log(1.25))).cast("int")
    sizes = dict(df.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect())  # some two hundred rows at most
    upto, k = 0, 240
    while k > 0 and upto + sizes.get(k, 0) <= bound:
        upto += sizes.get(k, 0)
        k -= 1
    least = 0 if k == 0 and upto + sizes.get(0, 0) <= bound else k + 1 if k < 40 else math.ceil(40 * 1.25 ** (k + 1 - 40))
    return least, least > 0


def join_frequent(rows: DataFrame, table: DataFrame, keys: str | list[str], count: str, bound: int) -> DataFrame:
    """rows joined with table by its unique keys. Keys that many rows may have, by count, are broadcast,
    ``bound`` of them at most, so that no task gets all rows of one of them."""
    keys = [keys] if isinstance(keys, str) else keys
    least, others = count_limit(table, count, bound)
    often = F.broadcast(table.where(F.col(count) >= least))
    out = rows.join(often, keys)
    if not others:
        return out
    rest = rows.join(often.select(*keys), keys, "left_anti").join(table.where(F.col(count) < least), keys)
    return out.unionByName(rest)


def text_bytes(column: str) -> F.Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
