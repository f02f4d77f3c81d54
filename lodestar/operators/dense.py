"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.vectors import cosine
from ..session import written
from .lexical import top_k

#: Queries that are held against a batch of vectors at once, and bytes of queries that a pass takes.
QUERY_BLOCK, QUERY_BYTES = 1024, 64 << 20


def nearest(vectors: DataFrame, query: Column, k: int = DEFAULT.dense_top_k, id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """(id, score) of the k vectors nearest to one query; filters hold before the k are taken."""
    kept = vectors if where is None else vectors.where(where)
    return kept.select(F.col(id_col).alias("id"), cosine(F.col(vector), query).alias("score")).where("score >= 0").orderBy(F.desc("score"), "id").limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT.dense_top_k, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query (query_id, vector).

    Vectors are read once for each QUERY_BYTES of queries, usually once for all: a task holds
    them against its vectors in blocks, as matrix products, and keeps the k best of each query, so
    what is shuffled is partitions times queries times k rows. Null vectors and ids, and vectors
    of another length than the queries', are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null and vector is not null")
    size = asked.agg(F.sum(F.size("vector")) * 8).first()[0] or 0
    passes = max(1, -(-size // QUERY_BYTES))
    kind, id_kind = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["id"]
    found = rows.limit(0).select(F.lit(None).cast(kind).alias("query_id"), "id", F.lit(None).cast("double").alias("score"))
    for b in range(passes):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == b).toPandas()
        if held.empty:
            continue
        shared = spark.sparkContext.broadcast((held["query_id"].to_numpy(), _unit(np.stack(held["vector"].to_numpy()))))
        part = rows.mapInPandas(_best_of(shared, k), f"query_id {kind}, id {id_kind}, score double")
        if passes > 1:  # one pass at a time, and its queries go
            part = written(top_k(part, k).drop("rank"), "nearest")
            shared.destroy()
        found = found.union(part)
    return top_k(found, k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norms == 0, 1, norms)[:, None]


def _best_of(shared: Broadcast, k: int):
    """The k best vectors of a partition for each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit = shared.value
        best = (np.zeros(0, dtype=np.int64), None, np.zeros(0))
        for batch in batches:
            batch = batch[[len(x) == unit.shape[1] for x in batch["v"]]]
            if batch.empty:
                continue
            ids, v = np.asarray(batch["id"].tolist()), _unit(np.stack(batch["v"].to_numpy()))
            parts = [best] if best[1] is not None else []
            for at in range(0, len(unit), QUERY_BLOCK):
                scores = unit[at : at + QUERY_BLOCK] @ v.T
                least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(scores), -np.inf)
                q, j = np.nonzero((scores >= least[:, None]) & (scores >= 0))  # ties with the k-th stay for now
                parts.append((q + at, ids[j], scores[q, j]))
            q, i, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=np.int64)
            place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            best = (q[place < k], i[place < k], s[place < k])
        if best[1] is not None:
            yield pd.DataFrame({"query_id": names[best[0]], "id": best[1], "score": best[2]})

    return run
