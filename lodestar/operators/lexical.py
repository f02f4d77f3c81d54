"""BM25: a table of tokens, corpus statistics once, then scores of the terms that are asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.text import tokenize
from ..session import written


#: Asked terms that are broadcast against the documents' tokens, at most.
FEW_TERMS = 100_000


@dataclass
class LexicalIndex:
    """documents: id, tokens. terms: term, df, idf. corpus: one row of n, avgdl."""

    documents: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, id, tf, dl) of all terms."""
        return postings(self.documents)

    def save(self, path: str) -> None:
        """Write the three tables; a later session reads them with ``load``."""
        for name in ("documents", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> LexicalIndex:
        return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("documents", "terms", "corpus")))


def document_tokens(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, tokens)."""
    return docs.select(F.col(id_col).alias("id"), tokenize(F.coalesce(text, F.lit(""))).alias("tokens"))


def postings(tokens: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, dl), of the asked terms (term) only if they are given: others never leave their row."""
    exploded = tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if asked is not None:
        few = asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS
        exploded = exploded.join(F.broadcast(asked) if few else asked, "term", "left_semi")
    return exploded.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_statistics(tokens: DataFrame) -> DataFrame:
    """One row: n documents and their mean length, from the lengths alone."""
    return tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def term_statistics(tokens: DataFrame, corpus: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(term, df, idf): a negative idf becomes epsilon times the mean over all terms. A term is counted
    once in each document and summed in tasks, so what is shuffled is terms, not postings."""
    counted = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return weighed_terms(counted, corpus, config)


def weighed_terms(counted: DataFrame, corpus: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(term, df, idf) of (term, df), in a corpus of n documents."""
    raw = counted.crossJoin(F.broadcast(corpus.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(config.bm25_epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def build_index(docs: DataFrame, id_col: str, text: Column, config: EngineConfig = DEFAULT) -> LexicalIndex:
    """Tokens and statistics of docs. Texts are read once, in one narrow pass: their tokens are kept
    as a table in the shared folder, and everything else comes from them."""
    tokens = written(document_tokens(docs, id_col, text), "tokens")
    corpus = corpus_statistics(tokens)
    return LexicalIndex(tokens, written(term_statistics(tokens, corpus, config), "terms"), corpus)


def score(index: LexicalIndex, query_terms: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, id, score) for query_terms (query_id, term); a repeated term counts again.

    Tokens meet the asked terms where they are, so that only matching ones are counted and weighed.
    """
    k1, b = config.bm25_k1, config.bm25_b
    wanted = query_terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighed = wanted.join(index.terms.select("term", "idf"), "term")
    hits = postings(index.documents, query_terms.select("term").distinct()).join(weighed, "term").crossJoin(F.broadcast(index.corpus.select("avgdl")))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))  # copies of a text tie whatever the order of sums


def top_k(scored: DataFrame, k: int, by: str = "query_id", order: str = "score", id_col: str = "id") -> DataFrame:
    """The k best of each query with their rank; ties by id. Ranks are cut before rows are sorted whole."""
    w = Window.partitionBy(by).orderBy(F.desc(order), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: LexicalIndex, query_terms: DataFrame, k: int = DEFAULT.lexical_top_k, config: EngineConfig = DEFAULT) -> DataFrame:
    """Positive scores only, the k best of each query."""
    return top_k(score(index, query_terms, config).where(F.col("score") > 0), k)
