"""An approximate index of vectors: inverted lists, product codes of what is left, exact scores at the end.

A coarse quantiser deals vectors into lists; a vector's difference to its list's centre is kept
as one byte for each group of dimensions. A search reads the codes of the lists that are
nearest to its questions, filters inside that scan, keeps the best by code in each task, and scores
these exactly from the stored vectors. Both tables are Parquet by list, so what isn't probed isn't
read, and a code is a small part of its vector. ``dense.nearest_batch`` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..session import removed, written
from .dense import QUERY_BYTES, _unit, nearest_batch
from .lexical import top_k

#: Rows that the quantisers are fitted on, at most, and rows that their first centres are drawn from.
SAMPLE, SEEDING = 65_536, 4_096
#: Rounds of fitting, codes of a group of dimensions, dimensions in a group.
ROUNDS, CODES, GROUP = 8, 256, 4
#: Share of true neighbours that probes are chosen for, and questions that it is measured with.
TARGET, TRIALS = 0.97, 256
#: Candidates by code for each result that is asked for.
KEEP = 8
#: Candidates of all questions of a pass, at most; they are broadcast.
CANDIDATES = 2_000_000
#: Rows of a file of a list, so that a list of any size is many files.
FILE_ROWS = 500_000


@dataclass
class VectorIndex:
    """Where an index is stored, its centres (lists x dims), its code books (groups x codes x dims of one) and how many lists a search probes."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def codes(self) -> DataFrame:
        """(id, code, what is carried, list)."""
        return self.spark.read.parquet(f"{self.path}/codes")

    @property
    def vectors(self) -> DataFrame:
        """(id, vector, what is carried, list)."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        made = spark.read.parquet(f"{path}/quantiser").first()
        dims, groups = made["dims"], made["groups"]
        centres = np.asarray(made["centres"]).reshape(-1, dims)
        return VectorIndex(spark, path, centres, np.asarray(made["books"]).reshape(groups, -1, dims // groups), made["probes"])


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding", carry: list[str] | None = None, lists: int | None = None, group: int = GROUP, config: EngineConfig = DEFAULT) -> VectorIndex:
    """Index all vectors under path; null ids and vectors, and vectors of another length than most, are left out.

    Quantisers are fitted on a bounded sample, the rows of least hash of their ids; every vector is
    then dealt to a list and coded in one pass. Lists default to the square root of the rows. Files are
    dealt out by list and id, so that a list with a third of all rows is as many tasks as it needs.
    """
    spark = vectors.sparkSession
    kept = carry or []
    rows = vectors.select(F.col(id_col).alias("id"), *kept, F.col(vector).cast("array<float>").alias("vector")).where("id is not null and vector is not null")
    n = rows.count()
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()  # a row for each length
    if sizes is None or not sizes["dims"]:
        raise ValueError("no vectors to index")
    dims = sizes["dims"]
    if dims % group:
        raise ValueError(f"{dims} dimensions are no multiple of {group}")
    rows = rows.where(F.size("vector") == dims)
    drawn = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * SAMPLE / n))
    sample = written(drawn.select("id", "vector"), "sample")
    first = sample.orderBy(F.xxhash64("id")).limit(SEEDING).select("vector").toPandas()  # bounded by SEEDING
    seeds = _unit(np.stack(first["vector"].to_numpy()).astype(np.float64))
    count = max(1, min(lists or config.vector_lists or round(n**0.5), len(seeds)))
    centres = fitted(sample, seeds[:count], lambda unit, shared: [(0, unit)])[0]
    left = lambda unit, shared: _groups(unit - shared[np.argmax(unit @ shared.T, axis=1)], group)
    seeds_left = np.stack([g for _, g in left(seeds, centres)])
    books = fitted(sample, seeds_left[:, : min(CODES, len(seeds))].reshape(-1, group), lambda unit, shared: left(unit, shared), centres, dims // group)
    index = VectorIndex(spark, path, centres, books, count)
    index.probes = _probes(np.stack(sample.orderBy(F.xxhash64("id").desc()).limit(SEEDING).toPandas()["vector"].to_numpy()).astype(np.float64), centres)
    index.probes = config.vector_probes or index.probes
    removed(sample)
    coded = rows.mapInPandas(_coded(spark.sparkContext.broadcast((centres, books)), kept), f"id {dict(rows.dtypes)['id']}, {''.join(f'`{c}` {dict(rows.dtypes)[c]}, ' for c in kept)}vector array<float>, code binary, list int")
    placed = written(coded.repartitionByRange("list", "id").sortWithinPartitions("list", "id"), "coded")
    for name, columns in (("codes", ["id", "code", *kept, "list"]), ("vectors", ["id", "vector", *kept, "list"])):
        placed.select(*columns).write.option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").partitionBy("list").parquet(f"{path}/{name}")
    removed(placed)
    shape = "dims int, groups int, probes int, centres array<double>, books array<double>"
    spark.createDataFrame([(dims, dims // group, index.probes, centres.ravel().tolist(), books.ravel().tolist())], shape).write.mode("overwrite").parquet(f"{path}/quantiser")
    return index


def _groups(rows: np.ndarray, group: int) -> list[tuple[int, np.ndarray]]:
    return [(g, rows[:, g * group : (g + 1) * group]) for g in range(rows.shape[1] // group)]


def fitted(sample: DataFrame, seeds: np.ndarray, parts: Callable, shared: np.ndarray | None = None, groups: int = 1) -> np.ndarray:
    """Centres (groups x k x dims) by rounds of k-means over the sample's vectors.

    A task adds up what it deals to each centre; sums and counts of tasks are added by Spark, so
    a round brings one row a centre to the driver. A centre that nothing is dealt to stays where it is.
    """
    k = len(seeds) // groups
    centres = seeds.reshape(groups, k, -1).copy()
    context = sample.sparkSession.sparkContext
    for _ in range(ROUNDS):
        known = context.broadcast((centres, shared))
        sums = sample.select("vector").mapInPandas(_sums(known, parts), "part int, centre int, n long, total array<double>")
        added = F.aggregate(F.collect_list("total"), F.array_repeat(F.lit(0.0), centres.shape[2]), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        for r in sums.groupBy("part", "centre").agg(F.sum("n").alias("n"), added.alias("total")).collect():  # one row a centre
            centres[r["part"], r["centre"]] = np.asarray(r["total"]) / r["n"]
        known.destroy()
        if groups == 1:
            centres[0] = _unit(centres[0])
    return centres


def _sums(known: Broadcast, parts: Callable):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, shared = known.value
        totals = np.zeros(centres.shape)
        counts = np.zeros(centres.shape[:2], dtype=np.int64)
        for batch in batches:
            if batch.empty:
                continue
            for g, rows in parts(_unit(np.stack(batch["vector"].to_numpy()).astype(np.float64)), shared):
                at = _nearest_code(rows, centres[g])
                np.add.at(totals[g], at, rows)
                counts[g] += np.bincount(at, minlength=len(counts[g]))
        g, c = np.nonzero(counts)
        yield pd.DataFrame({"part": g, "centre": c, "n": counts[g, c], "total": list(totals[g, c])})

    return of


def _nearest_code(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of least distance to each row."""
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


def _probes(vectors: np.ndarray, centres: np.ndarray, k: int = DEFAULT.dense_top_k) -> int:
    """The least number of lists that hold TARGET of the true neighbours of sampled vectors among the others."""
    unit = _unit(vectors)
    asked = unit[:TRIALS]
    best = np.argsort(-(asked @ unit.T), axis=1)[:, :k]
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # place of each list for each question
    at = np.take_along_axis(order, np.argmax(unit @ centres.T, axis=1)[best], axis=1)
    return int(np.quantile(at, TARGET, method="higher")) + 1


def _coded(known: Broadcast, kept: list[str]):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, books = known.value
        for batch in batches:
            if batch.empty:
                continue
            unit = _unit(np.stack(batch["vector"].to_numpy()).astype(np.float64))
            at = np.argmax(unit @ centres.T, axis=1)
            codes = np.stack([_nearest_code(rows, books[g]) for g, rows in _groups(unit - centres[at], books.shape[2])], axis=1).astype(np.uint8)
            yield batch[["id", *kept, "vector"]].assign(code=[c.tobytes() for c in codes], list=at)

    return of


def search(index: VectorIndex, queries: DataFrame, k: int = DEFAULT.dense_top_k, probes: int | None = None, keep: int = KEEP, where: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): about the k nearest of each query (query_id, vector), with exact cosines.

    A filter holds inside the scan of codes, before any k. Questions
    are split into passes by QUERY_BYTES and CANDIDATES. With all lists probed and ``keep`` times k rows or more than there are, no code
    can rule a row out: the lists' vectors that pass the filter are then scored where they are, as in the exact search.
    """
    spark, probes = index.spark, min(probes or index.probes, len(index.centres))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null").where(F.size("vector") == index.centres.shape[1])
    if probes == len(index.centres) and keep > KEEP and keep * k >= (index.codes if where is None else index.codes.where(where)).count():
        return nearest_batch(index.vectors if where is None else index.vectors.where(where), asked, k, "id", "vector")
    n = asked.count()
    passes = max(1, -(-n * index.centres.shape[1] * 8 // QUERY_BYTES), -(-n * keep * k // CANDIDATES))
    codes = index.codes if where is None else index.codes.where(where)
    kinds = dict(index.codes.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    found = codes.limit(0).select(F.lit(None).cast(kinds["query_id"]).alias("query_id"), "id", F.lit(None).cast("double").alias("score"))
    for b in range(passes):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == b).toPandas()  # QUERY_BYTES at most
        if held.empty:
            continue
        unit = _unit(np.stack(held["vector"].to_numpy()))
        near = np.argsort(-(unit @ index.centres.T), axis=1, kind="stable")[:, :probes]
        shared = spark.sparkContext.broadcast((held["query_id"].to_numpy(), unit, near, index.centres, index.books))
        some = codes.where(F.col("list").isin(np.unique(near).tolist())).select("id", "code", "list")
        first = written(top_k(some.mapInPandas(_by_code(shared, keep * k), f"query_id {kinds['query_id']}, id {kinds['id']}, list int, score double"), keep * k).select("query_id", "id", "list"), "candidates")
        lists = [r["list"] for r in first.select("list").distinct().collect()]  # not more than there are lists
        exact = index.vectors.where(F.col("list").isin(lists)).join(F.broadcast(first.select("query_id", "id")), "id").mapInPandas(_exact(shared), f"query_id {kinds['query_id']}, id {kinds['id']}, score double")  # keep times k rows a question
        found = found.union(written(top_k(exact, k).drop("rank"), "nearest"))
        shared.destroy()
        removed(first)
    return top_k(found, k)


def _by_code(shared: Broadcast, most: int):
    """The best of a partition for each question, by the products of questions with code books."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit, near, centres, books = shared.value
        groups, _, dims = books.shape
        tables = np.einsum("qgd,gcd->qgc", unit.reshape(len(unit), groups, dims), books)  # a product of each group and code
        coarse = unit @ centres.T
        best: dict[int, pd.DataFrame] = {}
        for batch in batches:
            for at, rows in batch.groupby("list"):
                code = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), groups)
                ids = rows["id"].to_numpy()
                for q in np.flatnonzero((near == at).any(axis=1)):
                    scores = coarse[q, at] + tables[q, np.arange(groups), code].sum(axis=1)
                    top = np.argpartition(-scores, most - 1)[:most] if len(scores) > most else np.arange(len(scores))
                    new = pd.DataFrame({"query_id": names[q], "id": ids[top], "list": at, "score": scores[top]})
                    old = best.get(q)
                    best[q] = new if old is None else pd.concat([old, new]).sort_values(["score", "id"], ascending=[False, True]).head(most)
        for rows in best.values():
            yield rows

    return of


def _exact(shared: Broadcast):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit = shared.value[:2]
        place = {name: i for i, name in enumerate(names)}
        for batch in batches:
            if batch.empty:
                continue
            scores = (_unit(np.stack(batch["vector"].to_numpy()).astype(np.float64)) * unit[[place[q] for q in batch["query_id"]]]).sum(axis=1)
            out = batch[["query_id", "id"]].assign(score=scores)
            yield out[out["score"] >= 0]

    return of
