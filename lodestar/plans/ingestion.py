"""A source tree from files to symbols, edges, vectors and postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.secrets import redacted
from ..functions.vectors import hash_embedding
from ..operators.lexical import LexicalIndex, build_index
from ..operators.parse import parse_files, symbols_of
from ..operators.relate import relationships
from ..sources.tables import replace_repositories

# The symbol types that are searched; imports alone are not.
INDEXED = ["file", "module", "class", "interface", "struct", "enum", "function", "method", "endpoint", "variable", "constant", "configuration", "test", "documentation", "type"]


@dataclass
class Repository:
    """Tables of an ingested repository, each lazy."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    vectors: DataFrame
    postings: LexicalIndex

    def counters(self) -> DataFrame:
        """One row of counts, and a line about them."""
        one = self.files.agg(F.count("*").alias("file_count")).crossJoin(self.symbols.agg(F.count("*").alias("symbol_count"))).crossJoin(self.edges.agg(F.count("*").alias("relationship_count")))
        return one.withColumn("detail", F.format_string("Indexed %d files, %d symbols, %d relationships", "file_count", "symbol_count", "relationship_count"))


def ingest(files: DataFrame, index_non_source: bool = True) -> Repository:
    """Tables of classified files. Secrets are redacted in code and documentation alike."""
    readable = files.where("content is not null")
    if not index_non_source:
        readable = readable.where("language is not null")
    parsed = parse_files(readable)
    found = symbols_of(parsed)
    clean = {c: redacted(F.col(c)) for c in ("code", "documentation")}
    symbols = found.withColumn("redacted", F.coalesce(clean["code"] != F.col("code"), F.lit(False)) | F.coalesce(clean["documentation"] != F.col("documentation"), F.lit(False))).withColumns(clean)
    searched = symbols.where(F.col("symbol_type").isin(INDEXED))
    c = F.col
    vectors = searched.select("id", "repository_id", "symbol_type", hash_embedding(tx.embedding_text(c("symbol_type"), c("qualified_name"), c("file_path"), c("documentation"), c("code"))).alias("vector"))
    text = tx.lexical_text(c("qualified_name"), c("symbol_name"), c("file_path"), c("documentation"), c("code"))
    return Repository(files, symbols, relationships(parsed, found), vectors, build_index(searched, "id", text))


def store(repository: Repository, root: str) -> dict[str, str]:
    """Write an ingested repository's tables under root, in place of what its repositories had; what failed, by table.

    Files and symbols are what everything else hangs on: if they can't be written, that is raised. Edges
    and vectors add to them: one that fails is left as it was, and the others are written.
    """
    errors = {}
    for name, rows, needed in (("files", repository.files.drop("content", "bytes"), True), ("symbols", repository.symbols, True), ("relationships", repository.edges, False), ("vectors", repository.vectors, False)):
        try:
            replace_repositories(rows, f"{root}/{name}")
        except Exception as e:  # whatever the rows or the store throw
            if needed:
                raise
            errors[name] = f"{type(e).__name__}: {e}".split("\n")[0][:500]
    return errors
