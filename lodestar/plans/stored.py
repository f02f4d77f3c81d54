"""Indexes of the driver's tables, built once for a session and a state of the input, and searched from then on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import adjacency, embeddings, grams, lexical, postings, segments, vector_index
from ..operators.layout import exists
from ..session import cleaned, shared_dir
from .bindings import edges, symbols
from .registry import read

_BUILT: dict[tuple, object] = {}


def _state(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> tuple:
    """What tells whether tables have changed: their files' bytes and times."""
    out = []
    for t in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = files.getContentSummary(at)
        out.append((t, found.getLength(), found.getFileCount(), files.getFileStatus(at).getModificationTime()))
    return tuple(out)


def once(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], build: Callable[[str], object]) -> object:
    """What ``build`` makes under a path of the shared folder; made again if a table has changed or the path is gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir, tables))
    path = f"{shared_dir(spark)}/{name}-{abs(hash(key)):x}"
    if key not in _BUILT or not exists(spark, path):
        with cleaned(spark):
            _BUILT[key] = build(path)
    return _BUILT[key]


def lexical_index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    """Tokens and statistics of documents."""

    def build(path: str) -> lexical.LexicalIndex:
        tokens = lexical.document_tokens(read(spark, sf_dir, "documents"), "doc_id", F.col("text"))
        tokens.write.mode("overwrite").parquet(f"{path}/documents")
        kept = spark.read.parquet(f"{path}/documents")
        corpus = lexical.corpus_statistics(kept)
        corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        lexical.term_statistics(kept, spark.read.parquet(f"{path}/corpus")).write.mode("overwrite").parquet(f"{path}/terms")
        return lexical.LexicalIndex.load(spark, path)

    return once(spark, sf_dir, "lexical", ("documents",), build)


def blocked_index(spark: SparkSession, sf_dir: str) -> postings.BlockedIndex:
    """Blocks of documents' texts, whose tokens are made on the way and not kept."""
    return once(spark, sf_dir, "blocked", ("documents",), lambda path: postings.build(lexical.document_tokens(read(spark, sf_dir, "documents"), "doc_id", F.col("text")), path))


def segmented_index(spark: SparkSession, sf_dir: str) -> segments.SegmentedIndex:
    """Documents by language as repositories, that came in five parts, of which one came twice, one language went and came again, and small segments were merged."""

    def build(path: str) -> segments.SegmentedIndex:
        docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
        index = segments.SegmentedIndex(spark, path)
        part = lambda n: docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == n)
        for n in range(5):
            index.insert_texts(part(n) if n else part(n).withColumn("text", F.lit("to be replaced")), "doc_id", "text", "lang")
        index.insert_texts(part(0), "doc_id", "text", "lang")
        index.invalidate("de")
        index.merge()
        index.insert_texts(docs.where("lang = 'de'"), "doc_id", "text", "lang")
        index.vacuum()
        return index

    return once(spark, sf_dir, "segments", ("documents",), build)


def vectors_index(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    return once(spark, sf_dir, "vectors", ("embeddings",), lambda path: vector_index.build(read(spark, sf_dir, "embeddings"), path, carry=["label"]))


def part_names(spark: SparkSession, sf_dir: str) -> grams.NameIndex:
    return once(spark, sf_dir, "part_names", ("part",), lambda path: grams.build(read(spark, sf_dir, "part"), path, "p_partkey", "p_name"))


def symbol_names(spark: SparkSession, sf_dir: str) -> grams.NameIndex:
    return once(spark, sf_dir, "symbol_names", ("documents",), lambda path: grams.build(symbols(spark, sf_dir), path))


def stored_graph(spark: SparkSession, sf_dir: str) -> adjacency.Adjacency:
    return once(spark, sf_dir, "graph", ("orders", "lineitem"), lambda path: adjacency.build(edges(spark, sf_dir), path))


def symbol_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector) of symbols, embedded once and stored once: a symbol's path is in its text, so no two texts are equal."""
    c = F.col
    text = tx.embedding_text(c("symbol_type"), c("qualified_name"), c("file_path"), c("documentation"), c("code"))

    def build(path: str) -> DataFrame:
        embeddings.of_rows(symbols(spark, sf_dir).select("id", text.alias("text")), "id", "text", embeddings.HashProvider()).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return once(spark, sf_dir, "symbol_vectors", ("documents",), build)
