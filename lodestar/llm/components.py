"""Connected components of a link table by alternating stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node it reaches.

    Every round a node's larger neighbours, then its smaller ones, are linked to the smallest
    neighbour it knows, until nothing changes; rounds grow with the logarithm of a component.
    A hot node's links are aggregated before they move and are joined as rows, never gathered.
    Self links keep a node, nulls are left out; an empty table gives no rows.
    """
    now = stable(links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    now = now.where("a <> b")
    while True:
        large = _star(now, both=True)
        after = stable(_star(large, both=False))
        if not _differ(now, after):
            break
        now = after
    return nodes.join(after.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Large star: each node links its larger neighbours to the least of all its neighbours and itself.
    Small star: each node links its smaller neighbours and itself to the least of them."""
    near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if both:
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _differ(x: DataFrame, y: DataFrame) -> bool:
    sums = [d.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64("a", "b", F.lit(1)).cast("decimal(38,0)")), F.lit(0)).alias("s")) for d in (x, y)]
    a, b = (s.first() for s in sums)
    return a != b
