"""Listings, counters and states of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.secrets import redacted, secret_count
from ..schemas import BUSY, INDEX_STATUS


def of_repository(rows: DataFrame, repository: str) -> DataFrame:
    """Rows of one repository; on a partitioned table only its folder is read."""
    return rows.where(F.col("repository_id") == repository)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def name_match(symbols: DataFrame, name: str, limit: int = 20, column: str = "symbol_name", id_col: str = "id") -> DataFrame:
    """Symbols whose name holds ``name`` without case; % and _ in it are wild."""
    return symbols.where(F.ilike(column, F.lit(f"%{name}%"))).orderBy(column, id_col).limit(limit)


def histogram(files: DataFrame, by: list[str]) -> DataFrame:
    """Counts of files by language (null left out)."""
    return files.where(F.col(by[-1]).isNotNull()).groupBy(*by).agg(F.count("*").alias("files"))


def top_languages(files: DataFrame, repository: str, language: str, n: int = 3) -> DataFrame:
    """The n most frequent languages of each repository; ties by name."""
    counts = histogram(files, [repository, language])
    w = Window.partitionBy(repository).orderBy(F.desc("files"), language)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def latest_status(events: DataFrame, key: str, status: str, at: str, tie: str) -> DataFrame:
    """The last status of each key."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(at, tie)).alias("status"), F.max(at).alias("since"))


def progress(status: Column) -> Column:
    """Per cent of the way to READY by the eight steps; a failed run has none."""
    steps = INDEX_STATUS[:-1]
    place = F.array_position(F.array(*map(F.lit, steps)), status) - 1
    return F.when(status == "FAILED", -1).otherwise(F.least(F.round(place / 8 * 100), F.lit(100.0))).cast("int")


def redacted_symbols(symbols: DataFrame, column: str = "code") -> DataFrame:
    """symbols with secrets redacted, their count, and whether any was."""
    return symbols.withColumns({"secrets": secret_count(F.col(column)), column: redacted(F.col(column))}).withColumn("redacted", F.col("secrets") > 0)


def without_repository(rows: DataFrame, repository: str) -> DataFrame:
    return rows.where(F.col("repository_id") != repository)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new rows in place of those with their key."""
    return old.join(new, key, "left_anti").unionByName(new)


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order: what was there before stays."""
    rest = [c for c in rows.columns if c not in key]
    least = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return least.select(*key, *(F.col("_r")[c].alias(c) for c in rest)).select(*rows.columns)


def may_follow(status: Column, after: Column) -> Column:
    """Whether a run may go from a status to another: forward by the steps, to FAILED from any but READY,
    and back to QUEUED from READY and FAILED."""
    place = lambda c: F.array_position(F.array(*map(F.lit, INDEX_STATUS[:-1])), c)
    forward = (place(status) > 0) & (place(after) > place(status))
    return F.coalesce(forward | ((after == "FAILED") & ~status.isin("READY", "FAILED")) | ((after == "QUEUED") & status.isin("READY", "FAILED")), F.lit(False))


def with_status(repositories: DataFrame, changes: DataFrame, message_chars: int = 2000) -> DataFrame:
    """repositories after changes (id, status, detail, error): refused ones change nothing.

    A failure has its message, cut, and its end; READY has its end; any other status clears neither.
    """
    new = changes.select("id", F.col("status").alias("_s"), F.col("detail").alias("_d"), F.substring("error", 1, message_chars).alias("_e"))
    joined = repositories.join(new, "id", "left").withColumn("_ok", F.col("_s").isNotNull() & may_follow(F.col("status"), F.col("_s")))
    done = F.col("_ok") & F.col("_s").isin("READY", "FAILED")
    now = F.current_timestamp().cast("timestamp_ntz")
    return joined.withColumns(
        {
            "status": F.when(F.col("_ok"), F.col("_s")).otherwise(F.col("status")),
            "status_detail": F.when(F.col("_ok"), F.coalesce("_d", "status_detail")).otherwise(F.col("status_detail")),
            "error_message": F.when(F.col("_ok") & (F.col("_s") == "FAILED"), F.col("_e")).otherwise(F.col("error_message")),
            "indexing_finished_at": F.when(done, now).otherwise(F.col("indexing_finished_at")),
        }
    ).select(*repositories.columns)


def reindex(repositories: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """repositories with the wanted ones (id) reset to QUEUED, and (id, accepted, refusal) of these.

    A run that is under way is refused, and so is an uploaded archive, which has no source to read again.
    """
    asked = repositories.join(wanted.select("id").distinct(), "id", "left_semi")
    why = F.when(F.col("status").isin(BUSY), "is being indexed").when(F.coalesce("source_url", F.lit("")) == "", "has no source to read again")
    answer = asked.select("id", why.isNull().alias("accepted"), why.alias("refusal"))
    reset = {"status": F.lit("QUEUED"), "status_detail": F.lit("Reindexing queued"), "error_message": F.lit(None), "commit_sha": F.lit(None), "file_count": F.lit(0), "symbol_count": F.lit(0), "relationship_count": F.lit(0)}
    marked = repositories.join(answer.where("accepted").select("id", F.lit(True).alias("_r")), "id", "left")
    types = dict(repositories.dtypes)
    return marked.withColumns({c: F.when(F.col("_r"), v.cast(types[c])).otherwise(F.col(c)) for c, v in reset.items() if c in types}).select(*repositories.columns), answer


def ready(repositories: DataFrame) -> DataFrame:
    """Repositories that questions may be asked of."""
    return repositories.where("status = 'READY'")


def collection_info(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: how many vectors there are, and their least and largest number of dimensions."""
    return vectors.agg(F.count("*").alias("points"), F.min(F.size(vector)).alias("least_dimensions"), F.max(F.size(vector)).alias("dimensions"))


def point_id(symbol_id: Column) -> Column:
    """The point of a symbol in a store of vectors: its id without dashes, in small letters, dashed as 8-4-4-4-12."""
    plain = F.lower(F.regexp_replace(symbol_id, "[^0-9A-Fa-f]", ""))
    cut = lambda a, n: F.substring(plain, a, n)
    return F.when(F.length(plain) == 32, F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)))
