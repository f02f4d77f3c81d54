"""How the driver's tables stand for the engine's: documents are symbols, parts are names, orders are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import read

EXTENSIONS = [".py", ".ts", ".java", ".md", ".yml", ".sql", ".png", ".pem", ".lock", ".tar.gz", "", ".rs"]
FOLDERS = ["src", "tests", "node_modules", "docs", "build", ".github"]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols: the source is the repository, the language one of code."""
    d = read(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("function", "class", "method", "file"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.substring(F.regexp_extract("text", r"^\S+", 0), 1, 40)
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("repository_id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"),
        F.col("lang").alias("language"), kind.alias("symbol_type"), name.alias("symbol_name"), F.concat_ws(".", "source", name).alias("qualified_name"), F.col("text").alias("code"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("About "), name)).alias("documentation"),
        F.lit(1).alias("start_line"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("end_line"),
    )


SYMBOLS_SQL = """(SELECT doc_id AS id, source AS repository_id, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, lang AS language,
  (['function','class','method','file'])[CAST(doc_id % 4 AS INT) + 1] AS symbol_type, left(regexp_extract(text, '^\\S+'), 40) AS symbol_name,
  source || '.' || left(regexp_extract(text, '^\\S+'), 40) AS qualified_name, text AS code,
  CASE WHEN doc_id % 3 = 0 THEN 'About ' || left(regexp_extract(text, '^\\S+'), 40) END AS documentation, 1 AS start_line, length(text) - length(replace(text, chr(10), '')) + 1 AS end_line FROM documents)"""


def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document calls the next one and imports that of twice its id, where they are; seq is the order of insertion."""
    ids = read(spark, sf_dir, "documents").select("doc_id")
    known = ids.select(F.col("doc_id").alias("dst"))
    next_ = ids.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"), F.lit("CALLS").alias("relation_type"))
    twice = ids.where("doc_id > 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") * 2).alias("dst"), F.lit("IMPORTS").alias("relation_type"))
    return next_.union(twice).join(known, "dst", "left_semi").select("src", "dst", "relation_type", F.lit(0.9).alias("confidence"), F.col("src").alias("seq"))


SYMBOL_EDGES_SQL = """(SELECT * FROM (SELECT doc_id AS src, doc_id + 1 AS dst FROM documents UNION ALL SELECT doc_id, doc_id * 2 FROM documents WHERE doc_id > 0) WHERE dst IN (SELECT doc_id FROM documents))"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for every document, over all folders and suffixes."""
    d = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.floor(F.col("doc_id") / len(EXTENSIONS)) % len(FOLDERS) + 1).cast("int"))
    name = F.when(F.col("doc_id") % 17 == 0, ".env").when(F.col("doc_id") % 19 == 0, "README").when(F.col("doc_id") % 23 == 0, "Dockerfile").otherwise(F.concat(F.lit("File_"), F.col("doc_id").cast("string"), ext))
    return d.select("doc_id", F.concat_ws("/", folder, "source", name).alias("path"))


PATHS_SQL = f"""(SELECT doc_id, ({FOLDERS!r})[CAST((doc_id // {len(EXTENSIONS)}) % {len(FOLDERS)} AS INT) + 1] || '/' || source || '/' ||
  CASE WHEN doc_id % 17 = 0 THEN '.env' WHEN doc_id % 19 = 0 THEN 'README' WHEN doc_id % 23 = 0 THEN 'Dockerfile' ELSE 'File_' || doc_id || ({EXTENSIONS!r})[CAST(doc_id % {len(EXTENSIONS)} AS INT) + 1] END AS path FROM documents)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers call orders, orders use parts, parts reference suppliers; seq is the order of insertion."""
    o, item = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    flags = F.when(F.col("l_returnflag") == "A", "IMPORTS").when(F.col("l_returnflag") == "R", "USES").otherwise("CALLS")
    a = o.select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"), F.when(F.col("o_orderpriority") == "1-URGENT", "CALLS").otherwise("REFERENCES").alias("relation_type"), F.lit(0.9).alias("confidence"), F.col("o_orderkey").alias("seq"))
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    b = item.select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst"), flags.alias("relation_type"), F.col("l_discount").alias("confidence"), line.alias("seq"))
    c = item.select(node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst"), F.lit("CONTAINS").alias("relation_type"), F.col("l_tax").alias("confidence"), line.alias("seq"))
    return a.union(b).union(c)


EDGES_SQL = """(SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, CASE WHEN o_orderpriority = '1-URGENT' THEN 'CALLS' ELSE 'REFERENCES' END AS relation_type, CAST(0.9 AS DOUBLE) AS confidence, o_orderkey AS seq FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, CASE l_returnflag WHEN 'A' THEN 'IMPORTS' WHEN 'R' THEN 'USES' ELSE 'CALLS' END, l_discount, l_orderkey * 8 + l_linenumber FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'CONTAINS', l_tax, l_orderkey * 8 + l_linenumber FROM lineitem)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and parts are nodes; suppliers are left out, so edges to them lead to phantoms."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    return (
        read(spark, sf_dir, "customer").select(node("c", "c_custkey"), F.lit("class").alias("symbol_type"))
        .union(read(spark, sf_dir, "orders").select(node("o", "o_orderkey"), F.lit("function")))
        .union(read(spark, sf_dir, "part").select(node("p", "p_partkey"), F.lower("p_type")))
    )


NODES_SQL = "(SELECT 'c' || c_custkey AS id, 'class' AS symbol_type FROM customer UNION ALL SELECT 'o' || o_orderkey, 'function' FROM orders UNION ALL SELECT 'p' || p_partkey, lower(p_type) FROM part)"

QUESTIONS = [
    (1, "Where is AuthService.login implemented?"), (2, "Trace the login flow from controller to database step by step"), (3, "What would break if I change `TokenManager`?"),
    (4, 'Explain "parse_config" and the .env settings'), (5, "Which files depend on OrderRepository?"), (6, "hello"), (7, "Compare version one vs version two"), (8, "what is the configuration of payment"),
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal questions, the benchmark's texts and what users say in conversations."""
    fixed = spark.createDataFrame(QUESTIONS, "k long, text string").select(F.concat(F.lit("q"), F.col("k").cast("string")).alias("query_id"), "text")
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text")
    said = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text")
    return fixed.union(items).union(said)


_LITERAL = ", ".join("('q{}', '{}')".format(k, t.replace("'", "''")) for k, t in QUESTIONS)
QUESTIONS_SQL = f"(SELECT * FROM (VALUES {_LITERAL}) v(query_id, text) UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user')"


def tokens_sql(text: str) -> str:
    """The tokenizer for an engine whose patterns can't look ahead: a blank parts capitals from a
    capitalised word, and capitals that a letter beyond ASCII follows stand alone."""
    token = r"""CASE WHEN NOT regexp_matches(t, '[^\x00-\x7F]$') THEN [lower(t)] WHEN regexp_matches(t, '[\p{L}\p{N}]$') THEN list_filter(string_split(lower(left(t, length(t) - 1)), ''), lambda c: c <> '') ELSE [lower(left(t, length(t) - 1))] END"""
    part = rf"""flatten(list_transform(regexp_extract_all(regexp_replace(p, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Za-z][a-z]+|[A-Z]+[^\x00-\x7F]?|[0-9]+'), lambda t: {token}))"""
    all_ = rf"""flatten(list_transform(regexp_split_to_array({text}, '[\s_/.\-]+'), lambda p: {part}))"""
    return f"(CASE WHEN len({all_}) = 0 THEN [lower({text})] ELSE {all_} END)"
