"""Files that arrive are indexed as they come; statuses are followed as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse_files, symbols_of
from ..operators.segments import SegmentedIndex
from ..session import removed, with_package, written
from ..sources.files import classified


def file_stream(spark: SparkSession, root: str, repository_id: str) -> DataFrame:
    """(repository_id, path, bytes) of files as they appear under root."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    relative = F.element_at(F.split(F.col("path"), F.lit(f"/?\\Q{base}\\E/"), 2), -1)
    return found.select(F.lit(repository_id).alias("repository_id"), relative.alias("path"), F.col("content").alias("bytes"))


def index_files(stream: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep a table of symbols under target up to date with the stream.

    A micro-batch writes the symbols of its own files and nothing else; of a file that comes again
    the newest batch counts. A batch that is run again writes the same folder anew.
    """
    with_package(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        symbols_of(parse_files(classified(batch))).drop("ordinal").write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def current_symbols(spark: SparkSession, target: str) -> DataFrame:
    """The symbols of every file as its newest batch has them."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy("repository_id", "file_path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["repository_id", "file_path", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, target: str) -> None:
    """Put what is current into the newest batch and delete the older ones; run between micro-batches.

    The newest batch is complete before anything goes, so a run that is lost loses nothing.
    """
    numbers = sorted(r["batch"] for r in spark.read.parquet(target).select("batch").distinct().collect())
    kept = written(current_symbols(spark, target), "symbols")
    kept.write.mode("overwrite").parquet(f"{target}/batch={numbers[-1]}")
    for n in numbers[:-1]:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={n}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    removed(kept)


def index_texts(stream: DataFrame, index: SegmentedIndex, checkpoint: str, id_col: str, text: str, repository: str, once: bool = False) -> StreamingQuery:
    """Keep a segmented index up to date with a stream of texts; a null text takes its document out.

    A micro-batch is a segment, and small segments are merged as they add up. Of a document that
    comes twice in a batch the row of the larger ``seq`` counts, if the stream has such a column. A batch that
    is run again replaces what it brought, so the index is the same as if it had run once.
    """
    with_package(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(id_col).isNotNull())
        if "seq" in rows.columns:
            rest = [c for c in rows.columns if c != id_col]
            rows = rows.groupBy(id_col).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select(id_col, *(F.col("_r")[c].alias(c) for c in rest))
        kept = written(rows.select(id_col, text, repository), "batch")
        index.insert_texts(kept.where(F.col(text).isNotNull()), id_col, text, repository)
        gone = kept.where(F.col(text).isNull()).select(F.col(id_col).alias("id"))
        if not gone.isEmpty():
            index.delete(gone)
        index.merge()
        removed(kept)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def status_stream(events: DataFrame, key: str, status: str, at: str, late: str = "10 minutes") -> DataFrame:
    """The last status of each key and hour, closed when events are later than ``late``."""
    hours = F.window(at, "1 hour")
    return events.withWatermark(at, late).groupBy(key, hours).agg(F.max_by(status, at).alias("status"), F.max(at).alias("since"), F.count("*").alias("events")).select(key, F.col("window.start").alias("hour"), "status", "since", "events")
