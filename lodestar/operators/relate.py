"""Relationships of symbols: what contains, imports, calls and routes to what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import edge_id
from ..schemas import EDGE_CONFIDENCE
from ..session import removed, written


def as_of(events: DataFrame, states: DataFrame, key: list[str], at: str, since: str, value: str, tie: str) -> DataFrame:
    """events with ``value`` of the latest state at or before each: backward as-of join without a range join.

    States and events are put in one order of key and time and range-partitioned by it, so a key with
    very many rows is split by time. Each split carries its last state, a prefix scan over a key's
    splits says what it starts with, and within a split states go on to events. Of states that begin
    together the first by ``tie`` counts; rows of null keys go together.
    """
    placed = _in_time(events, states, key, at, since, value, tie)
    splits = placed.groupBy(*key, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_row"))).alias("_value"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = splits.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), F.col("_part").alias("_p"), F.last("_value", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*key, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", F.last("_value", ignorenulls=True).over(inside)).where("_kind = 1")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)], F.col("_part") == F.col("_p"))
    met = own.join(begun.where("_carried is not null"), same, "left")
    return met.withColumn(value, F.coalesce("_own", "_carried")).select("_e.*", value)


def _in_time(events: DataFrame, states: DataFrame, key: list[str], at: str, since: str, value: str, tie: str) -> DataFrame:
    """(key, _kind, _value, _e, _row, _part): states and events in order of key and time, kept in the shared folder.

    Rows of one key and time are told apart by where they come from, so they can be split too.
    """
    kinds = dict(states.dtypes)
    opened = states.groupBy(*key, F.col(since).alias("_at")).agg(F.min_by(value, F.struct(tie)).alias("_value"))
    s = opened.select(*key, "_at", F.lit(0).alias("_kind"), "_value", F.lit(None).cast(events.select(F.struct(*events.columns)).schema[0].dataType).alias("_e"))
    e = events.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kinds[value]).alias("_value"), F.struct(*events.columns).alias("_e"))
    rows = written(s.unionByName(e).withColumn("_tie", F.monotonically_increasing_id()), "in_time")
    order = [*key, "_at", "_kind", "_tie"]
    out = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_row", F.monotonically_increasing_id()), "in_time")
    removed(rows)
    return out.withColumn("_part", F.shiftright("_row", 33))


def first_of(rows: DataFrame, by: list[str], value: str, order: Column, name: str) -> DataFrame:
    """(by, name): the value of each group's first row in order."""
    return rows.groupBy(*by).agg(F.min_by(value, order).alias(name))


def relationships(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges by name with the ids of both ends where a symbol has that qualified name.

    CONTAINS goes from a file to its symbols, IMPORTS from a file's first symbol, CALLS from the
    function or method that the call's line is in, ROUTES_TO from an endpoint to its handler.
    Of edges with the same names and type the first by file and line stays.
    """
    base = ["repository_id", "file_path"]
    contains = symbols.select(*base, F.col("start_line").alias("line"), F.col("file_path").alias("source_name"), F.col("qualified_name").alias("target_name"), F.lit("CONTAINS").alias("relation_type"))
    firsts = first_of(symbols, base, "qualified_name", F.col("ordinal"), "source_name")
    imports = parsed.select("repository_id", F.col("path").alias("file_path"), F.explode("imports").alias("i")).select(*base, F.col("i.line").alias("line"), F.col("i.module").alias("target_name"))
    imports = imports.join(firsts, base).select(*base, "line", "source_name", "target_name", F.lit("IMPORTS").alias("relation_type"))
    calls = parsed.select("repository_id", F.col("path").alias("file_path"), F.explode("calls").alias("c")).select(*base, F.col("c.line").alias("line"), F.col("c.callee").alias("target_name"))
    callers = symbols.where(F.col("symbol_type").isin("function", "method")).select(*base, "start_line", F.col("qualified_name").alias("source_name"), "ordinal")
    called = as_of(calls, callers, base, "line", "start_line", "source_name", "ordinal").where("source_name is not null").select(*base, "line", "source_name", "target_name", F.lit("CALLS").alias("relation_type"))
    routes = parsed.select("repository_id", F.col("path").alias("file_path"), F.explode("routes").alias("r")).where("r.handler is not null")
    routed = routes.select(*base, F.col("r.line").alias("line"), F.concat_ws(" ", "r.method", "r.path").alias("source_name"), F.col("r.handler").alias("target_name"), F.lit("ROUTES_TO").alias("relation_type"))
    every = contains.unionByName(imports).unionByName(called).unionByName(routed)
    order = F.struct("file_path", "line")
    edges = every.groupBy("repository_id", "source_name", "target_name", "relation_type").agg(F.min(order).alias("e")).select("*", F.col("e.file_path").alias("file_path"), F.col("e.line").alias("line")).drop("e")
    return resolved(edges, symbols)


def resolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with source_symbol_id, target_symbol_id (null where no symbol has the name), id, confidence, evidence."""
    names = symbols.groupBy("repository_id", "qualified_name").agg(F.max_by("id", F.struct("file_path", "start_line", "id")).alias("_id"))
    source = names.select("repository_id", F.col("qualified_name").alias("source_name"), F.col("_id").alias("source_symbol_id"))
    target = names.select("repository_id", F.col("qualified_name").alias("target_name"), F.col("_id").alias("target_symbol_id"))
    out = edges.join(source, ["repository_id", "source_name"], "left").join(target, ["repository_id", "target_name"], "left")
    return out.withColumns({"confidence": confidence(F.col("relation_type")), "evidence": F.concat_ws(":", "file_path", "line"), "id": edge_id(*(F.col(c) for c in ("repository_id", "source_name", "target_name", "relation_type")))})


def confidence(relation: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in EDGE_CONFIDENCE.items() for x in kv)), relation)
