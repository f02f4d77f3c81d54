"""A stored graph that a search reads as far as it goes.

The neighbours of a node are chunks of a Parquet table by bucket of the node; a hub has many
chunks in several files. A level of a search opens the buckets of its frontier, and of these only row groups that
can hold a node of it, so what is read follows the frontier and not the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import removed, written
from .graph import DEPENDENCY_TYPES
from .layout import LISTED, hinted, in_runs

#: Neighbours of a chunk, buckets of nodes.
CHUNK, BUCKETS = 1_024, 256


@dataclass
class Adjacency:
    """chunks: bucket, node, neighbours (other, relation_type, forward)."""

    chunks: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> Adjacency:
        return Adjacency(spark.read.parquet(path))


@dataclass
class Reached:
    """rows: root, id, level, the least of each. buckets: those that each level opened."""

    rows: DataFrame
    buckets: list[list[int]]


def _bucket(c: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def build(edges: DataFrame, path: str) -> Adjacency:
    """Store edges (src, dst, relation_type) under path, both ways, each once; edges without an end are left out."""
    spark = edges.sparkSession
    kept = edges.where("src is not null and dst is not null")
    ahead = kept.select(F.col("src").alias("node"), F.col("dst").alias("other"), "relation_type", F.lit(True).alias("forward"))
    back = kept.select(F.col("dst").alias("node"), F.col("src").alias("other"), "relation_type", F.lit(False).alias("forward"))
    arcs = in_runs(ahead.union(back).distinct(), ["node", "other"], CHUNK, "arcs")
    chunks = arcs.groupBy("node", "run").agg(F.collect_list(F.struct("other", "relation_type", "forward")).alias("neighbours")).withColumn("bucket", _bucket("node"))
    chunks.repartitionByRange("bucket", "node", "run").sortWithinPartitions("bucket", "node").drop("run").write.mode("overwrite").partitionBy("bucket").parquet(path)
    removed(arcs)
    return Adjacency.load(spark, path)


def step(graph: Adjacency, frontier: DataFrame, types: list[str] | None = None, forward: bool | None = None) -> tuple[DataFrame, list[int]]:
    """(root, id) next to a frontier (root, id), each once, and the buckets that are read for it."""
    buckets = sorted(r["b"] for r in frontier.select(_bucket("id").alias("b")).distinct().collect())  # not more than there are buckets
    rows = graph.chunks.where(F.col("bucket").isin(buckets))
    listed = frontier.select("id").distinct().limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        rows = rows.where(F.col("node").isin([r["id"] for r in listed]))
    wanted = lambda n: (F.lit(True) if types is None else n["relation_type"].isin(types)) & (F.lit(True) if forward is None else n["forward"] == F.lit(forward))
    near = rows.select(F.col("node").alias("id"), F.filter("neighbours", wanted).alias("neighbours")).join(hinted(frontier.select("root", "id")), "id")
    return near.select("root", F.explode("neighbours").alias("n")).select("root", F.col("n.other").alias("id")).distinct(), buckets


def reached(graph: Adjacency, roots: DataFrame, depth: int, types: list[str] | None = None, forward: bool | None = None) -> Reached:
    """All that is within ``depth`` steps of roots (root, id), level by level; each level is kept in the shared folder."""
    frontier = written(roots.select("root", "id").distinct().withColumn("level", F.lit(0)), "frontier")
    visited, buckets = frontier, []
    for level in range(1, depth + 1):
        near, opened = step(graph, frontier, types, forward)
        buckets.append(opened)
        frontier = written(near.join(visited.select("root", "id"), ["root", "id"], "left_anti").withColumn("level", F.lit(level)), "frontier")
        visited = visited.union(frontier)
        if frontier.isEmpty():
            break
    return Reached(visited, buckets)


def neighborhood(graph: Adjacency, seeds: DataFrame, depth: int = 2, limit: int = 24, types: list[str] | None = None) -> DataFrame:
    """(root, id, level), as ``graph.neighborhood`` has it from edges."""
    found = reached(graph, seeds, depth, types).rows.where("level > 0")
    w = Window.partitionBy("root").orderBy("level", "id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def impact(graph: Adjacency, node: str, depth: int = 3, limit: int = 30) -> DataFrame:
    """(id, level, kind), as ``graph.impact`` has it from edges."""
    spark = graph.chunks.sparkSession
    found = reached(graph, spark.range(1).select(F.lit(node).alias("root"), F.lit(node).alias("id")), depth, DEPENDENCY_TYPES, False).rows.where("level > 0").select("id", "level")
    direct = found.where("level = 1").withColumn("kind", F.lit("direct"))
    return direct.union(found.where("level > 1").orderBy("level", "id").limit(limit).withColumn("kind", F.lit("indirect")))
