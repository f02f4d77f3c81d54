"""Source trees and archives as tables of files."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import paths
from ..functions.ids import file_id
from ..functions.secrets import secret_count
from ..session import with_package


def classified(files: DataFrame, config: EngineConfig = DEFAULT, extra_ignored: list[str] | None = None) -> DataFrame:
    """Files (repository_id, path, bytes) that a scan keeps, with what is known of each, in no order: contents are never sorted.

    Ignored paths and files over the size limit go, and binary ones unless they are
    configuration or documentation. Content is UTF-8 with bad bytes replaced; secrets and
    binaries have none.
    """
    path = F.col("path")
    known = files.withColumn("path", paths.normalized(path)).where(~paths.is_ignored(path, extra_ignored)).where(F.octet_length("bytes") <= config.max_file_bytes)
    known = known.withColumns({"language": paths.language(path), "classification": paths.classification(path), "is_binary": paths.is_binary(F.col("bytes")), "content_hash": F.sha2("bytes", 256), "size_bytes": F.octet_length("bytes")})
    known = known.where(~F.col("is_binary") | F.col("classification").isin("config", "documentation"))
    secret = (F.col("classification") == "secret") | paths.looks_secret(path)
    return (
        known.withColumns({"is_secret": secret, "id": file_id(F.col("repository_id"), path), "content": _decoded(secret)})
        .withColumn("secret_findings", F.coalesce(secret_count(F.col("content")), F.lit(0)))
        .drop("bytes")
    )


def listing(files: DataFrame) -> DataFrame:
    """Files in the order of their paths, without their contents."""
    return files.drop("content", "bytes").orderBy("repository_id", "path")


def _decoded(secret: F.Column) -> F.Column:
    @F.pandas_udf("string")
    def lossy(data: pd.Series, skip: pd.Series) -> pd.Series:
        return pd.Series([None if s or b is None else bytes(b).decode("utf-8", errors="replace") for b, s in zip(data, skip, strict=True)])

    return lossy(F.col("bytes"), secret | F.col("is_binary"))


def scan(spark: SparkSession, root: str, repository_id: str, config: EngineConfig = DEFAULT, extra_ignored: list[str] | None = None) -> DataFrame:
    """Files of a folder in any store that Spark reads. Size and path filters reach the listing.

    Spark's readers pass over names that begin with a dot or an underscore, which source trees
    have; these few are read one by one, up to the limits of a repository.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= config.max_file_bytes)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    relative = F.element_at(F.split(F.col("path"), F.lit(f"/?\\Q{base}\\E/"), 2), -1)
    seen = found.select(F.lit(repository_id).alias("repository_id"), relative.alias("path"), F.col("content").alias("bytes"))
    hidden = spark.createDataFrame([(repository_id, path, data) for path, data in _hidden(spark, root, config)], "repository_id string, path string, bytes binary")
    return classified(seen.union(hidden), config, extra_ignored)


def _hidden(spark: SparkSession, root: str, config: EngineConfig) -> Iterator[tuple[str, bytearray]]:
    """Files with a name or folder that Spark's readers pass over, ignored folders left out."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    left, files, folders = config.max_repository_bytes, 0, [(top, "")]
    while folders:
        folder, prefix = folders.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            path = f"{prefix}{name}"
            if status.isDirectory():
                if name not in paths.IGNORED_COMPONENTS:
                    folders.append((status.getPath(), f"{path}/"))
            elif any(part[0] in "._" for part in path.split("/")) and status.getLen() <= config.max_file_bytes:
                left, files = left - status.getLen(), files + 1
                if left < 0 or files > config.max_zip_files:
                    raise ValueError(f"{root} is over the limits of a repository")
                stream = fs.open(status.getPath())
                data = stream.readAllBytes()
                stream.close()
                yield path, bytearray(data)


def zip_members(archives: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(archive, path, bytes, error) of the members of archives (archive, content).

    An archive with too many members or bytes gives one row with an error. Members that would
    leave the archive's folder are skipped; a single folder around everything is taken off.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield pd.DataFrame(_members(r.archive, bytes(r.content), config), columns=["archive", "path", "bytes", "error"])

    with_package(archives.sparkSession)
    return archives.mapInPandas(run, "archive string, path string, bytes binary, error string")


def _members(archive: str, data: bytes, config: EngineConfig) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len(infos) > config.max_zip_files:
                return [(archive, None, None, "too many members")]
            if sum(i.file_size for i in infos) > config.max_repository_bytes:
                return [(archive, None, None, "too many bytes")]
            safe = [i for i in infos if not i.filename.startswith(("/", "\\")) and ":" not in i.filename[:2] and ".." not in i.filename.replace("\\", "/").split("/")]
            tops = {i.filename.split("/")[0] for i in safe}
            cut = len(tops.pop()) + 1 if len(tops) == 1 and all("/" in i.filename for i in safe) else 0
            out, left = [], config.max_repository_bytes
            for i in safe:
                with z.open(i) as member:
                    data = member.read(left + 1)  # what an archive says of its sizes isn't trusted
                left -= len(data)
                if left < 0:
                    return [(archive, None, None, "too many bytes")]
                out.append((archive, i.filename[cut:], data, None))
            return out
    except zipfile.BadZipFile:
        return [(archive, None, None, "no archive")]
    except (RuntimeError, NotImplementedError, EOFError, OSError, zlib.error) as e:  # encrypted, damaged or packed in an odd way
        return [(archive, None, None, f"unreadable: {type(e).__name__}")]


def zip_totals(members: DataFrame) -> DataFrame:
    """Members and bytes of each archive."""
    return members.groupBy("archive").agg(F.count("path").alias("members"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("total_bytes"))
