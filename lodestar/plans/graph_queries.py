"""The graph operators over customers, orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjacency, graph, relate
from . import stored
from .bindings import EDGES_SQL, NODES_SQL, edges, nodes
from .registry import query, read

ORDER, PART = "o7", "p7"
#: An order that calls parts in tables of every size.
CALLER = "o3"
_TYPES = "('CALLS', 'IMPORTS', 'USES', 'REFERENCES')"


@query(f"SELECT DISTINCT src AS id FROM {EDGES_SQL} WHERE dst = '{PART}' AND relation_type = 'CALLS'")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers(edges(spark, sf_dir), PART)


@query(f"SELECT DISTINCT dst AS id FROM {EDGES_SQL} WHERE src = '{CALLER}' AND relation_type = 'CALLS'")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callees(edges(spark, sf_dir), CALLER)


@query(f"SELECT DISTINCT src AS id FROM {EDGES_SQL} WHERE dst = '{PART}' AND relation_type IN {_TYPES}")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependents(edges(spark, sf_dir), PART)


@query(f"SELECT DISTINCT dst AS id FROM {EDGES_SQL} WHERE src = '{ORDER}' AND relation_type IN {_TYPES}")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies(edges(spark, sf_dir), ORDER)


def _levels_sql(arcs: str, roots: str, depth: int) -> str:
    out = f"arcs AS MATERIALIZED ({arcs}), l0 AS (SELECT id, 0 AS level FROM ({roots}))"
    for d in range(1, depth + 1):
        out += f", v{d - 1} AS ({' UNION ALL '.join(f'SELECT * FROM l{i}' for i in range(d))}), l{d} AS MATERIALIZED (SELECT DISTINCT b AS id, {d} AS level FROM l{d - 1} JOIN arcs ON id = a WHERE b NOT IN (SELECT id FROM v{d - 1}))"
    return out + f", reached AS ({' UNION ALL '.join(f'SELECT * FROM l{i}' for i in range(depth + 1))})"


_BOTH = f"SELECT src AS a, dst AS b FROM {EDGES_SQL} UNION SELECT dst, src FROM {EDGES_SQL}"


@query(f"WITH {_levels_sql(_BOTH, f'SELECT {ORDER!r} AS id', 2)} SELECT '{ORDER}' AS root, id, level FROM reached WHERE level > 0 ORDER BY level, id LIMIT 24")
def bfs_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.range(1).select(F.lit(ORDER).alias("root"), F.lit(ORDER).alias("id"))
    return graph.neighborhood(edges(spark, sf_dir), seeds)


@query(f"WITH {_levels_sql(_BOTH, f'SELECT {ORDER!r} AS id', 2)} SELECT '{ORDER}' AS root, id, level FROM reached WHERE level > 0 ORDER BY level, id LIMIT 24")
def bfs_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over stored neighbours: only buckets of the frontier are read."""
    seeds = spark.range(1).select(F.lit(ORDER).alias("root"), F.lit(ORDER).alias("id"))
    return adjacency.neighborhood(stored.stored_graph(spark, sf_dir), seeds)


_BACK = f"SELECT DISTINCT dst AS a, src AS b FROM {EDGES_SQL} WHERE relation_type IN {_TYPES}"


@query(
    f"""WITH {_levels_sql(_BACK, f'SELECT {PART!r} AS id', 3)}
SELECT id, level, 'direct' AS kind FROM reached WHERE level = 1 UNION ALL SELECT * FROM (SELECT id, level, 'indirect' FROM reached WHERE level > 1 ORDER BY level, id LIMIT 30)"""
)
def impact_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(edges(spark, sf_dir), PART)


@query(
    f"""WITH {_levels_sql(_BACK, f'SELECT {PART!r} AS id', 3)}
SELECT id, level, 'direct' AS kind FROM reached WHERE level = 1 UNION ALL SELECT * FROM (SELECT id, level, 'indirect' FROM reached WHERE level > 1 ORDER BY level, id LIMIT 30)"""
)
def impact_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.impact(stored.stored_graph(spark, sf_dir), PART)


@query(
    f"""WITH {_levels_sql(_BACK, f'SELECT {PART!r} AS id', 3)},
r AS (SELECT id, level FROM reached WHERE level = 1 UNION ALL SELECT * FROM (SELECT id, level FROM reached WHERE level > 1 ORDER BY level, id LIMIT 30))
SELECT symbol_id, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM r WHERE level = 1 AND symbol_id = '{PART}'), '') AS direct,
 coalesce((SELECT string_agg(id, ',' ORDER BY level, id) FROM r WHERE level > 1 AND symbol_id = '{PART}'), '') AS indirect, '{graph.IMPACT_NOTE}' AS note FROM (VALUES ('{PART}'), ('no such part')) v(symbol_id)"""
)
def impact_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a part's change could affect, and the same of a symbol that isn't there."""
    reports = [graph.impact_report(edges(spark, sf_dir), node) for node in (PART, "no such part")]
    return reports[0].union(reports[1]).select("symbol_id", F.array_join("direct", ",").alias("direct"), F.array_join("indirect", ",").alias("indirect"), "note")


_ROOTS = f"SELECT id FROM {NODES_SQL} WHERE symbol_type IN ('class', 'module', 'file') ORDER BY id LIMIT 10"


@query(_ROOTS)
def default_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.default_roots(nodes(spark, sf_dir))


@query(
    f"""WITH {_levels_sql(_BOTH, _ROOTS, 2)}, n AS (SELECT id FROM (SELECT id, min(level) AS level FROM reached GROUP BY id) ORDER BY level, id LIMIT 60)
SELECT DISTINCT src, dst, relation_type FROM {EDGES_SQL} WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)"""
)
def subgraph_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept = graph.subgraph(edges(spark, sf_dir), graph.default_roots(nodes(spark, sf_dir)))
    return kept.select("src", "dst", "relation_type").distinct()


@query(f"SELECT (SELECT count(*) FROM (SELECT id FROM {NODES_SQL} UNION SELECT src FROM {EDGES_SQL} UNION SELECT dst FROM {EDGES_SQL})) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM {EDGES_SQL})) AS edge_count")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"SELECT DISTINCT id FROM (SELECT src AS id FROM {EDGES_SQL} UNION ALL SELECT dst FROM {EDGES_SQL}) WHERE id NOT IN (SELECT id FROM {NODES_SQL})")
def phantom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.phantom_nodes(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"SELECT src, dst, relation_type, confidence, seq FROM {EDGES_SQL} QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC, relation_type DESC, confidence DESC) = 1")
def edge_collapse_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collapsed(edges(spark, sf_dir)).select("src", "dst", "relation_type", "confidence", "seq")


@query(f"SELECT src, dst, relation_type, confidence, seq FROM {EDGES_SQL} QUALIFY row_number() OVER (PARTITION BY src, dst, relation_type ORDER BY seq, confidence) = 1")
def edge_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_edges(edges(spark, sf_dir)).select("src", "dst", "relation_type", "confidence", "seq")


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(CAST(p.p_partkey AS VARCHAR), 'part ' || l_partkey) AS source_end, coalesce(CAST(s.s_suppkey AS VARCHAR), 'supplier ' || l_suppkey) AS target_end
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey"""
)
def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends by id where the name is known, by name elsewhere."""
    item = read(spark, sf_dir, "lineitem")
    parts = read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").cast("string").alias("source_symbol_id"))
    suppliers = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").cast("string").alias("target_symbol_id"))
    named = item.join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left").withColumns({"source_name": F.concat(F.lit("part "), F.col("l_partkey").cast("string")), "target_name": F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))})
    edge = named.select("*", F.lit("USES").alias("relation_type"), F.lit(1.0).alias("confidence"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return graph.endpoints(edge).select("seq.*", F.col("src").alias("source_end"), F.col("dst").alias("target_end"))


@query(
    """SELECT p.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN
(SELECT * FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) s ON p.user_id = s.user_id AND p.ts >= s.ts"""
)
def asof_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sign-up of the user at or before each purchase."""
    e = read(spark, sf_dir, "events")
    states = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("signup_id"), F.col("event_id").alias("tie"))
    return relate.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), states, ["user_id"], "ts", "since", "signup_id", "tie").select("event_id", "signup_id")


@query("SELECT o_orderkey, first_order FROM orders JOIN (SELECT o_custkey, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS first_order FROM orders GROUP BY o_custkey) USING (o_custkey)")
def first_symbol_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its customer's first one."""
    o = read(spark, sf_dir, "orders")
    first = relate.first_of(o, ["o_custkey"], "o_orderkey", F.struct("o_orderdate", "o_orderkey"), "first_order")
    return o.join(first, "o_custkey").select("o_orderkey", "first_order")


@query(f"SELECT id FROM {NODES_SQL} WHERE contains(lower(id), lower('P7')) ORDER BY id LIMIT 3")
def roots_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roots_by_name(nodes(spark, sf_dir), "P7")
