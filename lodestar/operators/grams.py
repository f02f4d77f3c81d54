"""Names by pattern: the trigrams that a pattern's literal parts hold lead to the names that can match.

Posting lists of trigrams are stored in chunks by bucket of the trigram, names by bucket of their id. A
pattern opens the lists of its rarest trigrams, intersects them, and reads the names of what is left; these
are matched as ILIKE does. A pattern without three literal characters in a row is matched against all names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import removed, written
from .layout import LISTED, few, hinted, in_runs
from .lexical import top_k

#: Characters of a gram, ids of a chunk, buckets of grams and of names, lists that a pattern opens.
GRAM, CHUNK, BUCKETS, RAREST = 3, 4_096, 64, 4
#: Patterns without grams that are held against all names at once.
WILD = 1_000


@dataclass
class NameIndex:
    """lists: bucket, gram, ids. sizes: bucket, gram, n. names: bucket, id, name."""

    lists: DataFrame
    sizes: DataFrame
    names: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> NameIndex:
        return NameIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("lists", "sizes", "names")))


def grams(text: Column) -> Column:
    """Distinct grams of a text in small letters."""
    low = F.lower(text)
    every = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def pattern_grams(pattern: Column) -> Column:
    """Distinct grams that any match of an ILIKE pattern holds: those of what stands between its wildcards."""
    parts = F.regexp_extract_all(F.lower(pattern), F.lit(r"(?:\\.|[^%_\\])+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: grams(F.regexp_replace(p, r"\\(.)", "$1")))))


def containing(text: Column) -> Column:
    """The pattern of names that hold a text, none of whose characters is wild."""
    return F.concat(F.lit("%"), F.regexp_replace(text, r"([%_\\])", r"\\$1"), F.lit("%"))


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def build(symbols: DataFrame, path: str, id_col: str = "id", name: str = "symbol_name") -> NameIndex:
    """Index names under path; rows without id or name are left out. ids are unique."""
    spark = symbols.sparkSession
    rows = written(symbols.select(F.col(id_col).alias("id"), F.col(name).cast("string").alias("name")).where("id is not null and name is not null"), "names")
    rows.withColumn("bucket", _bucket("id")).repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/names")
    runs = in_runs(rows.select(F.explode(grams(F.col("name"))).alias("gram"), "id"), ["gram", "id"], CHUNK, "grams")
    lists = written(runs.groupBy("gram", "run").agg(F.collect_list("id").alias("ids")).drop("run").withColumn("bucket", _bucket("gram")), "lists")
    lists.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
    sizes = lists.groupBy("bucket", "gram").agg(F.sum(F.size("ids")).alias("n"))
    sizes.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/sizes")
    for df in (rows, runs, lists):
        removed(df)
    return NameIndex.load(spark, path)


def _opened(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a stored table that have one of the keys: only their buckets are read, and where
    they are few, only row groups that can hold them."""
    buckets = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # not more than there are buckets
    some = table.where(F.col("bucket").isin(buckets))
    listed = keys.select(key).distinct().limit(LISTED + 1).collect()
    return some.where(F.col(key).isin([r[0] for r in listed])) if len(listed) <= LISTED else some


def candidates(index: NameIndex, patterns: DataFrame) -> DataFrame:
    """(query_id, id) of names that have the rarest grams of a pattern (query_id, gram), kept in the shared folder."""
    asked = written(patterns.withColumn("bucket", _bucket("gram")), "asked")
    sizes = _opened(index.sizes, asked, "gram").select("gram", "n")
    known = asked.join(sizes, "gram", "left").select("query_id", "gram", "bucket", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = written(top_k(known.withColumn("rarity", -F.col("n")), RAREST, order="rarity", id_col="gram").select("query_id", "gram", "bucket", "n"), "rarest")
    needed = rarest.groupBy("query_id").agg(F.count("*").alias("needed"), F.min("n").alias("least")).where("least > 0").select("query_id", "needed")
    lists = _opened(index.lists, rarest, "gram").select("gram", "ids")
    found = lists.join(hinted(rarest.select("query_id", "gram")), "gram").select("query_id", F.explode("ids").alias("id"))
    return written(found.groupBy("query_id", "id").agg(F.count("*").alias("met")).join(hinted(needed), "query_id").where("met = needed").select("query_id", "id"), "candidates")


def matching(index: NameIndex, patterns: DataFrame) -> DataFrame:
    """(query_id, id, name) of all names that each ILIKE pattern (query_id, pattern) matches; null patterns match none."""
    asked = written(patterns.where("pattern is not null").select("query_id", "pattern", pattern_grams(F.col("pattern")).alias("grams")), "patterns")
    narrow, wild = asked.where(F.size("grams") > 0), asked.where(F.size("grams") == 0)
    met = candidates(index, narrow.select("query_id", F.explode("grams").alias("gram")))
    names = _opened(index.names, met.select("id", _bucket("id").alias("bucket")), "id").select("id", "name")
    small = few(met)
    found = (names.join(F.broadcast(met), "id") if small else names.join(met, "id")).join(hinted(narrow.select("query_id", "pattern")), "query_id").where(F.expr("name ilike pattern")).select("query_id", "id", "name")
    n = wild.count()
    for b in range(-(-n // WILD)):  # a stated set of patterns against all names, in blocks
        part = wild.select("query_id", "pattern").where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // WILD))) == b)
        found = found.unionByName(index.names.select("id", "name").join(F.broadcast(part), F.expr("name ilike pattern")).select("query_id", "id", "name"))
    return found
