"""The relationship graph: neighbours, bounded searches, impact and induced subgraphs.

Edges are (src, dst, relation_type, confidence) and nodes (id, ...). A search goes level by
level as a join with the edges and an anti-join with what is visited; depth is small and given. A graph
that is searched often is better stored as ``adjacency`` has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .layout import hinted

# Relations that make one symbol depend on another.
DEPENDENCY_TYPES = ["CALLS", "IMPORTS", "USES", "REFERENCES"]


def endpoints(relationships: DataFrame) -> DataFrame:
    """(src, dst, relation_type, confidence, seq): ids, names where an id is missing; both ends needed."""
    end = lambda i, n: F.coalesce(F.nullif(F.col(i), F.lit("")), F.nullif(F.col(n), F.lit("")))
    out = relationships.select(end("source_symbol_id", "source_name").alias("src"), end("target_symbol_id", "target_name").alias("dst"), "relation_type", "confidence", "seq")
    return out.where("src is not null and dst is not null")


def collapsed(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One edge for each ordered pair: the last in order."""
    last = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(F.max(F.struct(F.col(order).alias("_o"), *last)).alias("e")).select("src", "dst", *(F.col("e")[c].alias(c) for c in last))


def first_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One edge for each (src, dst, relation_type): the first in order."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "relation_type")]
    return edges.groupBy("src", "dst", "relation_type").agg(F.min(F.struct(F.col(order).alias("_o"), *rest)).alias("e")).select("src", "dst", "relation_type", *(F.col("e")[c].alias(c) for c in rest))


def phantom_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): edge ends that are no node."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return ends.join(nodes.select("id"), "id", "left_anti").distinct()


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count with phantoms, edge_count of distinct ordered pairs."""
    all_nodes = nodes.select("id").union(edges.select("src")).union(edges.select("dst")).distinct().agg(F.count("*").alias("node_count"))
    return all_nodes.crossJoin(edges.select("src", "dst").distinct().agg(F.count("*").alias("edge_count")))


def incoming(edges: DataFrame, node: str, types: list[str]) -> DataFrame:
    """(id): who points at the node with one of the relations (callers, dependents)."""
    return edges.where((F.col("dst") == node) & F.col("relation_type").isin(types)).select(F.col("src").alias("id")).distinct()


def outgoing(edges: DataFrame, node: str, types: list[str]) -> DataFrame:
    """(id): what the node points at with one of the relations (callees, dependencies)."""
    return edges.where((F.col("src") == node) & F.col("relation_type").isin(types)).select(F.col("dst").alias("id")).distinct()


def callers(edges: DataFrame, node: str) -> DataFrame:
    return incoming(edges, node, ["CALLS"])


def callees(edges: DataFrame, node: str) -> DataFrame:
    return outgoing(edges, node, ["CALLS"])


def dependents(edges: DataFrame, node: str, types: list[str] | None = None) -> DataFrame:
    return incoming(edges, node, types or DEPENDENCY_TYPES)


def dependencies(edges: DataFrame, node: str, types: list[str] | None = None) -> DataFrame:
    return outgoing(edges, node, types or DEPENDENCY_TYPES)


def levels(arcs: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, level) within depth steps of arcs (a, b) from roots (root, id); the least level of each.

    Each level is a table of its own in the shared folder, so plans don't grow with depth, and
    arcs meet a frontier before anything of them is shuffled: it is broadcast while it is small.
    """
    frontier = written(roots.select("root", "id").distinct().withColumn("level", F.lit(0)), "frontier")
    visited = frontier
    for level in range(1, depth + 1):
        step = arcs.join(hinted(frontier.select("root", "id")), F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct()
        frontier = written(step.join(visited.select("root", "id"), ["root", "id"], "left_anti").withColumn("level", F.lit(level)), "frontier")
        visited = visited.union(frontier)
        if frontier.isEmpty():
            break
    return visited


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions; an edge that is there twice is twice there."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = 24, types: list[str] | None = None) -> DataFrame:
    """(root, id, level) around each seed (root, id), the seed left out, ``limit`` nearest of each; ties by id."""
    kept = edges if types is None else edges.where(F.col("relation_type").isin(types))
    found = levels(undirected(kept), seeds, depth).where("level > 0")
    w = Window.partitionBy("root").orderBy("level", "id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def impact(edges: DataFrame, node: str, depth: int = 3, limit: int = 30) -> DataFrame:
    """(id, level, kind): all direct dependents, and ``limit`` at most of those behind them."""
    spark = edges.sparkSession
    back = edges.where(F.col("relation_type").isin(DEPENDENCY_TYPES)).select(F.col("dst").alias("a"), F.col("src").alias("b"))
    root = spark.range(1).select(F.lit(node).alias("root"), F.lit(node).alias("id"))
    found = levels(back, root, depth).where("level > 0").select("id", "level")
    direct = found.where("level = 1").withColumn("kind", F.lit("direct"))
    return direct.union(found.where("level > 1").orderBy("level", "id").limit(limit).withColumn("kind", F.lit("indirect")))


#: What an impact is and isn't.
IMPACT_NOTE = "This is what could be affected, as far as static relations show it; nothing here has to break."


def impact_report(edges: DataFrame, node: str, depth: int = 3, limit: int = 30) -> DataFrame:
    """One row: symbol_id, direct and indirect dependents in order, and a note; empty lists for a symbol that no edge has."""
    found = impact(edges, node, depth, limit)
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("level", "id")))), lambda x: x["id"]).alias(kind)
    return found.agg(listed("direct"), listed("indirect")).select(F.lit(node).alias("symbol_id"), "direct", "indirect", F.lit(IMPACT_NOTE).alias("note"))


def subgraph(edges: DataFrame, roots: DataFrame, depth: int = 2, limit: int = 60) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, level) within depth of any root (id), the ``limit`` nearest, and the edges between them."""
    arcs = undirected(edges)
    wanted = written(roots.select("id").distinct(), "roots")
    known = arcs.select(F.col("a").alias("id")).join(hinted(wanted), "id", "left_semi").distinct()
    found = levels(arcs, known.select(F.lit(0).alias("root"), "id"), depth)
    nodes = written(found.groupBy("id").agg(F.min("level").alias("level")).orderBy("level", "id").limit(limit), "nodes")
    inside = nodes.select("id")
    kept = edges.join(F.broadcast(inside.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(inside.withColumnRenamed("id", "dst")), "dst", "left_semi")  # at most ``limit`` ids
    return nodes, kept


def roots_by_name(nodes: DataFrame, name: str, n: int = 3) -> DataFrame:
    """(id): the first n nodes whose id or name holds ``name``, whatever its case."""
    low = F.lower(F.lit(name))
    held = F.contains(F.lower("id"), low)
    if "name" in nodes.columns:
        held = held | F.coalesce(F.contains(F.lower("name"), low), F.lit(False))
    return nodes.where(held).orderBy("id").limit(n).select("id")


def shown_nodes(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """ids (id) with name, symbol_type and file_path; a node that is no symbol has its id as name and the type external."""
    own = symbols.select("id", F.col("qualified_name").alias("_n"), F.col("symbol_type").alias("_t"), F.col("file_path").alias("_f"))
    return ids.join(own, "id", "left").select("id", F.coalesce("_n", F.col("id").cast("string")).alias("name"), F.coalesce("_t", F.lit("external")).alias("symbol_type"), F.coalesce("_f", F.lit("")).alias("file_path"))


def default_roots(nodes: DataFrame) -> DataFrame:
    """(id): the first ten classes, modules and files by id; without any, the first five nodes."""
    ranked = nodes.select("id", F.col("symbol_type").isin("class", "module", "file").alias("main"))
    main = ranked.where("main").orderBy("id").limit(10)
    other = ranked.where(~F.col("main")).orderBy("id").limit(5).withColumn("_has", F.lit(0))
    has = main.agg(F.count("*").alias("_n"))
    return main.select("id").union(other.crossJoin(F.broadcast(has)).where("_n = 0").select("id"))
