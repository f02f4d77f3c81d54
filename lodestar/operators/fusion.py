"""Ranked lists joined into one, and the rules that order it again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT

# Symbol types that an intent prefers, best first.
TYPE_PREFERENCE = {
    "SYMBOL_LOOKUP": ["function", "method", "class"],
    "LOCATION": ["function", "method", "class", "endpoint"],
    "FLOW": ["endpoint", "method", "function"],
    "ARCHITECTURE": ["class", "module", "file"],
    "CONFIGURATION": ["configuration", "file"],
    "EXPLANATION": ["class", "function", "method"],
    "IMPACT": ["class", "function", "method"],
}


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = DEFAULT.rrf_k) -> DataFrame:
    """(query_id, id, score, seen): the sum of 1 / (k + rank) over lists of (query_id, id, rank).

    An id that a list repeats adds each time. seen is (list, rank) of its first place, which
    orders ties as they came. One shuffle, summed before it.
    """
    all_ = reduce(DataFrame.unionByName, (one.select("query_id", "id", "rank", F.lit(i).alias("list")) for i, one in enumerate(lists)))
    return all_.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))


def fused_ranking(lists: list[DataFrame], top: int, k: int = DEFAULT.rrf_k) -> DataFrame:
    """The ``top`` best of each query with their rank: score first, then first place, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "id")
    return reciprocal_rank_fusion(lists, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("seen")


def minmax(scored: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """scored with ``normalized``: 0 to 1 within each query; all 0 where scores don't differ."""
    ends = scored.groupBy(by).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    span = F.col("_high") - F.col("_low")
    return scored.join(ends, by).withColumn("normalized", (F.col(score) - F.col("_low")) / F.when(span == 0, 1.0).otherwise(span)).drop("_low", "_high")


def rerank_boost(exact: Column, terms: Column, intent: Column, name: Column, qualified: Column, kind: Column, has_doc: Column) -> Column:
    """What a candidate's names, type and documentation add to its score."""
    low_name, low_full = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(qualified, F.lit("")))
    some = F.coalesce(F.size(terms) > 0, F.lit(False))
    named = F.when(F.lower(exact) == low_name, 1.5).when(F.contains(low_full, F.lower(exact)), 0.8).otherwise(0.0)
    termed = F.when(some & F.forall(terms, lambda t: F.contains(low_full, F.lower(t))), 0.6).when(some & F.exists(terms, lambda t: F.contains(low_name, F.lower(t))), 0.3).otherwise(0.0)
    preferred = F.try_element_at(F.create_map(*(x for key, v in TYPE_PREFERENCE.items() for x in (F.lit(key), F.array(*map(F.lit, v))))), intent)
    place = F.coalesce(F.array_position(preferred, kind), F.lit(0))
    typed = F.when(place > 0, F.lit(0.4) - F.lit(0.05) * (place - 1)).otherwise(0.0)
    return F.coalesce(named, F.lit(0.0)) + termed + typed + F.when(has_doc, 0.1).otherwise(0.0)


def reranked(candidates: DataFrame, top: int = DEFAULT.rerank_top_k) -> DataFrame:
    """The ``top`` best of each query by score + boost, with rerank_score and rank; ties by rank, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "id")  # equal sums tie, however they were added
    return candidates.withColumn("rerank_score", F.col("score") + F.col("boost")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
