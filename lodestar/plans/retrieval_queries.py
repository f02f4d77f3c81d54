"""Lexical, dense and hybrid retrieval over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import catalog, dense, fusion, grams, lexical, postings, vector_index
from . import search, stored
from .bindings import QUESTIONS_SQL, SYMBOL_EDGES_SQL, SYMBOLS_SQL, questions, symbol_edges, symbols, tokens_sql
from .registry import query, read

FLAGSHIP = "the schachber que zyxwvut"
#: What the hybrid plan asks.
HYBRID = "Where is the schachber que implementation of small"

_TOKENS = f"tok AS MATERIALIZED (SELECT doc_id AS id, {tokens_sql('text')} AS tokens FROM documents)"
_BM25 = f"""{_TOKENS},
post AS MATERIALIZED (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, corpus GROUP BY term),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_SCORED = """scored AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM (SELECT query_id, term, count(*) AS times FROM asked GROUP BY ALL) JOIN terms USING (term) JOIN post USING (term), corpus GROUP BY query_id, id)"""
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    return stored.lexical_index(spark, sf_dir)


def _terms(spark: SparkSession, text: str, name: str = "q") -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("query_id"), F.explode(tx.tokenize(F.lit(text))).alias("term"))


@query(f"WITH {_TOKENS} SELECT id AS doc_id, CAST(len(tokens) AS INT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tok")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.tokenize(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TOKENS} SELECT id AS doc_id, CAST(len(tokens) AS INT) AS dl FROM tok")
def bm25_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_tokens(_docs(spark, sf_dir), "doc_id", F.col("text")).select(F.col("id").alias("doc_id"), F.size("tokens").alias("dl"))


@query(f"WITH {_BM25}, asked AS (SELECT 'q' AS query_id, unnest({FLAGSHIP.split()!r}) AS term), {_SCORED} SELECT id AS doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM {_RANKED} WHERE rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(_index(spark, sf_dir), _terms(spark, FLAGSHIP))
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {_BM25}, q AS (SELECT item_id AS query_id, lower(trim(text)) AS raw, {tokens_sql("text")} AS t FROM benchmark),
asked AS (SELECT query_id, unnest(CASE WHEN list_contains(t, raw) THEN t ELSE list_prepend(raw, t) END) AS term FROM q), {_SCORED}
SELECT query_id, id AS doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM {_RANKED} WHERE rank <= 20"""
)
def bm25_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.query_tokens(F.col("text"))).alias("term"))
    return lexical.search(_index(spark, sf_dir), asked).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


_ASKED_SQL = f"""q AS (SELECT item_id AS query_id, lower(trim(text)) AS raw, {tokens_sql("text")} AS t FROM benchmark),
asked AS (SELECT query_id, unnest(CASE WHEN list_contains(t, raw) THEN t ELSE list_prepend(raw, t) END) AS term FROM q)"""
_BATCH_SQL = f"WITH {_BM25}, {_ASKED_SQL}, {_SCORED} SELECT query_id, id AS doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM {_RANKED} WHERE rank <= 20"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.query_tokens(F.col("text"))).alias("term"))


@query(_BATCH_SQL)
def bm25_topk_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's questions over blocked postings, of which those that can't reach the first twenty stay closed."""
    found = postings.search(stored.blocked_index(spark, sf_dir), _asked(spark, sf_dir)).rows
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(_BATCH_SQL)
def bm25_topk_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over an index that grew by insertions, deletions and a merge."""
    found = postings.search(stored.segmented_index(spark, sf_dir).view(), _asked(spark, sf_dir)).rows
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def segmented_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that are sums over segments and what is gone from them."""
    return stored.segmented_index(spark, sf_dir).view().terms.select("term", "df", F.round("idf", 6).alias("idf"))


_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


def _nearest(spark: SparkSession, sf_dir: str, where: F.Column | None) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    found = dense.nearest(vectors.crossJoin(F.broadcast(one)), F.col("q"), where=where)  # one row on the other side
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0 ORDER BY {_COS} DESC, vec_id LIMIT 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, None)


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 2, 3) AND {_COS} >= 0 ORDER BY {_COS} DESC, vec_id LIMIT 20")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, F.col("label").isin(1, 2, 3))


@query(
    f"""SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE score >= 0) WHERE rank <= 20"""
)
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector asks all of them."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.nearest_batch(vectors, asked).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query()
def dense_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector asks the inverted lists; held against the exact search in tests."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index.search(stored.vectors_index(spark, sf_dir), asked).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(
    f"""SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.label IN (1, 2, 3)) WHERE score >= 0) WHERE rank <= 20"""
)
def dense_topk_indexed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among three labels, all lists probed and all that pass scored exactly: the exact search by way of the index."""
    vectors, index = read(spark, sf_dir, "embeddings"), stored.vectors_index(spark, sf_dir)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    kept = F.col("label").isin(1, 2, 3)
    every = -(-max(1, index.codes.where(kept).count()) // 20)
    found = vector_index.search(index, asked, probes=len(index.centres), keep=every, where=kept)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(
    """WITH d AS (SELECT item_id, sha256(text) AS h FROM benchmark), s AS (SELECT item_id, seed, sha256(unhex(h) || unhex(lpad(printf('%x', seed), 8, '0'))) AS h FROM d, range(48) r(seed)),
w AS (SELECT item_id, seed * 8 + i AS p, CAST('0x' || substr(h, i * 8 + 1, 8) AS BIGINT) AS n FROM s, range(8) r(i)),
v AS (SELECT item_id, p, CAST(CASE WHEN n >= 2147483648 THEN n - 4294967296 ELSE n END AS DOUBLE) AS n FROM w), l AS (SELECT item_id, sqrt(sum(n * n)) AS l, count(*) AS dims FROM v GROUP BY item_id)
SELECT v.item_id, CAST(dims AS INT) AS dims, round(sum(n * n) / any_value(l * l), 6) AS norm, round(max(CASE WHEN p = 0 THEN n / l END), 9) AS first_number, round(max(CASE WHEN p = 383 THEN n / l END), 9) AS last_number FROM v JOIN l USING (item_id) GROUP BY v.item_id, dims"""
)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "benchmark").select("item_id", vx.hash_embedding(F.col("text")).alias("e"))
    return e.select("item_id", F.size("e").alias("dims"), F.round(vx.dot(F.col("e"), F.col("e")), 6).alias("norm"), F.round(F.get("e", F.lit(0)), 9).alias("first_number"), F.round(F.get("e", F.lit(383)), 9).alias("last_number"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re_ _i%' ORDER BY p_name, p_partkey LIMIT 20")
def symbol_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.name_match(read(spark, sf_dir, "part"), "re_ _i", column="p_name", id_col="p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('L wId'))")
def node_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lower(F.lit("L wId")))).select("p_partkey", "p_name")


_PATTERNS = ["re_ _i", "L wId", "%", "a", "%re%in%", "__e", "zzz", "d w_d", ""]
_PATTERN_ROWS = ", ".join(f"('{i}', '%{p}%')" for i, p in enumerate(_PATTERNS))


@query(f"SELECT query_id, p_partkey, p_name FROM part, (VALUES {_PATTERN_ROWS}) v(query_id, pattern) WHERE p_name ILIKE pattern")
def names_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names that patterns match, by trigrams where a pattern has some."""
    patterns = spark.sql(f"SELECT * FROM VALUES {_PATTERN_ROWS} AS v(query_id, pattern)")
    return grams.matching(stored.part_names(spark, sf_dir), patterns).select("query_id", F.col("id").alias("p_partkey"), F.col("name").alias("p_name"))


_LISTS = f"""bm AS (SELECT id, CAST(rank AS INT) AS rank, 0 AS list FROM {_RANKED} WHERE rank <= 20),
longest AS (SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INT) AS rank, 1 AS list FROM documents QUALIFY rank <= 20),
named AS (SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS rank, 2 AS list FROM documents WHERE text ILIKE '%the%' QUALIFY rank <= 20),
fused AS (SELECT id, sum(1 / (60.0::DOUBLE + rank)) AS score, min(list * 1000 + rank) AS seen FROM (SELECT * FROM bm UNION ALL SELECT * FROM longest UNION ALL SELECT * FROM named) GROUP BY id)"""
_FUSED = f"WITH {_BM25}, asked AS (SELECT 'q' AS query_id, unnest({FLAGSHIP.split()!r}) AS term), {_SCORED}, {_LISTS}"


def _lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    d = read(spark, sf_dir, "documents")
    long_ = d.select(F.lit("q").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    named = d.where(F.ilike("text", F.lit("%the%"))).select(F.lit("q").alias("query_id"), F.col("doc_id").alias("id"), F.lit(1.0).alias("score"))
    best = lambda x: x.orderBy(F.desc("score"), "id").limit(20)  # noqa: E731  sorted within tasks first, so that no task gets all rows
    return [lexical.search(_index(spark, sf_dir), _terms(spark, FLAGSHIP)), lexical.top_k(best(long_), 20), lexical.top_k(best(named), 20)]


@query(f"{_FUSED} SELECT id AS doc_id, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, seen, id) AS INT) AS rank FROM fused QUALIFY rank <= 20")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused_ranking(_lists(spark, sf_dir), 20).select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


@query(f"{_FUSED} SELECT id AS doc_id, round((score - min(score) OVER ()) / CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE max(score) OVER () - min(score) OVER () END, 6) AS normalized FROM fused")
def rrf_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(_lists(spark, sf_dir))
    return fusion.minmax(fused).select(F.col("id").alias("doc_id"), F.round("normalized", 6).alias("normalized"))


_BOOST = """CASE WHEN lower('small ring') = lower(name) THEN 1.5 WHEN contains(lower(full_name), 'small ring') THEN 0.8 ELSE 0 END
 + CASE WHEN contains(lower(full_name), 'small') AND contains(lower(full_name), 'gear') THEN 0.6 WHEN contains(lower(name), 'small') OR contains(lower(name), 'gear') THEN 0.3 ELSE 0 END
 + CASE kind WHEN 'function' THEN 0.4 WHEN 'method' THEN 0.35 WHEN 'class' THEN 0.3 WHEN 'endpoint' THEN 0.25 ELSE 0 END + CASE WHEN doc THEN 0.1 ELSE 0 END"""


@query(
    f"""SELECT p_partkey, round(CAST({_BOOST} AS DOUBLE), 6) AS boost FROM (SELECT p_partkey, p_name AS name, p_brand || '.' || p_name AS full_name, p_size % 2 = 0 AS doc,
CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'STANDARD' THEN 'method' WHEN 'LARGE' THEN 'class' WHEN 'SMALL' THEN 'endpoint' ELSE 'file' END AS kind FROM part)"""
)
def rerank_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "ECONOMY", "function").when(F.col("p_type") == "STANDARD", "method").when(F.col("p_type") == "LARGE", "class").when(F.col("p_type") == "SMALL", "endpoint").otherwise("file")
    boost = fusion.rerank_boost(F.lit("small ring"), F.array(F.lit("small"), F.lit("gear")), F.lit("LOCATION"), F.col("p_name"), F.concat_ws(".", "p_brand", "p_name"), kind, F.col("p_size") % 2 == 0)
    return read(spark, sf_dir, "part").select("p_partkey", F.round(boost, 6).alias("boost"))


_HYBRID_TERMS = ["schachber", "que", "implementation", "small"]
#: The question and the first five of its widened terms, the last of which is the question itself.
_WIDE = f"{HYBRID} {' '.join(_HYBRID_TERMS)} {HYBRID.lower()}".lower()


def _hash_numbers(name: str, rows: str) -> str:
    """CTE of (id, p, n): the numbers of the hash embedding of rows (id, t), not yet of length one."""
    return f"""{name} AS MATERIALIZED (SELECT id, p, CAST(CASE WHEN n >= 2147483648 THEN n - 4294967296 ELSE n END AS DOUBLE) AS n FROM (SELECT id, seed * 8 + i AS p, CAST('0x' || substr(h, i * 8 + 1, 8) AS BIGINT) AS n
 FROM (SELECT id, seed, sha256(unhex(h) || unhex(lpad(printf('%x', seed), 8, '0'))) AS h FROM (SELECT id, sha256(t) AS h FROM ({rows})), range(48) r(seed)), range(8) q(i)))"""


_EMBEDDED = f"SELECT id, concat_ws(chr(10), symbol_type || ': ' || qualified_name, 'file: ' || file_path, left(documentation, 500), left(code, 1200)) AS t FROM {SYMBOLS_SQL}"
_HYBRID_SQL = f"""WITH RECURSIVE {_BM25}, asked AS (SELECT 'q' AS query_id, unnest({[_WIDE, *_WIDE.split()]!r}) AS term), {_SCORED},
{_hash_numbers("of_symbol", _EMBEDDED)}, {_hash_numbers("of_question", f"SELECT 0 AS id, '{HYBRID}' AS t")},
dn AS (SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank, 0 AS list FROM (SELECT s.id, sum(s.n * q.n) / (sqrt(sum(s.n * s.n)) * sqrt(sum(q.n * q.n))) AS score FROM of_symbol s JOIN of_question q USING (p) GROUP BY s.id) WHERE score >= 0 QUALIFY rank <= 20),
bm AS (SELECT id, CAST(rank AS INT) AS rank, 1 AS list FROM {_RANKED} WHERE rank <= 20),
sym AS (SELECT id, CAST(row_number() OVER (ORDER BY symbol_name, id) AS INT) AS rank, 2 AS list FROM {SYMBOLS_SQL} WHERE symbol_name ILIKE '%schachber%' QUALIFY rank <= 20),
fused AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, seen, id) AS place FROM (SELECT id, sum(1 / (60.0::DOUBLE + rank)) AS score, min(list * 1000 + rank) AS seen FROM (SELECT * FROM dn UNION ALL SELECT * FROM bm UNION ALL SELECT * FROM sym) GROUP BY id)),
top AS (SELECT f.id, f.score, s.*, lower(symbol_name) AS n, lower(qualified_name) AS f FROM fused f JOIN {SYMBOLS_SQL} s USING (id)),
boosted AS (SELECT *, score + CASE WHEN {" AND ".join(f"contains(f, '{t}')" for t in _HYBRID_TERMS)} THEN 0.6 WHEN {" OR ".join(f"contains(n, '{t}')" for t in _HYBRID_TERMS)} THEN 0.3 ELSE 0 END
 + CASE symbol_type WHEN 'function' THEN 0.4 WHEN 'method' THEN 0.35 WHEN 'class' THEN 0.3 ELSE 0 END + CASE WHEN length(documentation) > 0 THEN 0.1 ELSE 0 END AS rerank_score FROM top),
best AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(rerank_score, 9) DESC, id) AS rank FROM boosted QUALIFY rank <= 12)"""
_AROUND_SQL = f"""arcs AS MATERIALIZED (SELECT src AS a, dst AS b FROM {SYMBOL_EDGES_SQL} UNION SELECT dst, src FROM {SYMBOL_EDGES_SQL}),
l1 AS (SELECT DISTINCT place AS seed, id, b FROM fused JOIN arcs ON id = a WHERE place <= 5), l2 AS (SELECT DISTINCT l1.seed, l1.id, arcs.b FROM l1 JOIN arcs ON l1.b = a WHERE NOT EXISTS (SELECT 1 FROM l1 x WHERE x.seed = l1.seed AND x.b = arcs.b)),
near AS (SELECT seed, level, b FROM (SELECT seed, id, b, 1 AS level FROM l1 UNION ALL SELECT seed, id, b, 2 FROM l2) WHERE b <> id QUALIFY row_number() OVER (PARTITION BY seed ORDER BY level, b) <= 4),
around AS (SELECT b AS id, row_number() OVER (ORDER BY first_at) AS rank FROM (SELECT b, min({{'s': seed, 'l': level, 'b': b}}) AS first_at FROM near WHERE b NOT IN (SELECT id FROM fused WHERE place <= 12) GROUP BY b))"""


def hybrid(spark: SparkSession, sf_dir: str, question: str = HYBRID) -> search.Retrieval:
    """One question through all stages."""
    syms = symbols(spark, sf_dir)
    asked = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(question).alias("text"))
    return search.retrieve(asked, syms, lambda: stored.blocked_index(spark, sf_dir), lambda: stored.symbol_vectors(spark, sf_dir), symbol_edges(spark, sf_dir), names=lambda: stored.symbol_names(spark, sf_dir))


@query(f"{_HYBRID_SQL} SELECT id AS doc_id, round(rerank_score, 6) AS rerank_score, CAST(rank AS INT) AS rank FROM best")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense, lexical and name search, fused and reranked."""
    return hybrid(spark, sf_dir).candidates.select(F.col("id").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(f"{_HYBRID_SQL} SELECT id AS doc_id, CAST(rank AS INT) AS rank FROM best WHERE rank <= 8 AND language IN ('de', 'en') AND symbol_type IN ('function', 'class', 'method')")
def search_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight, and of these those of a language and type: fewer than eight may be left."""
    return hybrid(spark, sf_dir).candidates.where("rank <= 8").where(F.col("language").isin("de", "en") & F.col("symbol_type").isin("function", "class", "method")).select(F.col("id").alias("doc_id"), "rank")


@query(f"{_HYBRID_SQL}, {_AROUND_SQL} SELECT id AS doc_id, CAST(rank AS INT) AS rank FROM around")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the first five results."""
    return hybrid(spark, sf_dir).neighbors.select(F.col("id").alias("doc_id"), "rank")


@query(f"{_HYBRID_SQL} SELECT id AS doc_id, file_path, CAST(start_line AS INT) AS start_line, round(rerank_score, 6) AS score FROM best")
def hybrid_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the results cite; every document is a place of its own."""
    return hybrid(spark, sf_dir).citations().select(F.col("symbol_id").alias("doc_id"), "file_path", "start_line", F.round("score", 6).alias("score"))


@query(
    f"""{_HYBRID_SQL}, {_AROUND_SQL} SELECT * FROM (SELECT 'dense' AS stage, count(*) AS hits FROM dn UNION ALL SELECT 'lexical', count(*) FROM bm UNION ALL SELECT 'names', count(*) FROM sym
UNION ALL SELECT 'fused', count(*) FROM fused UNION ALL SELECT 'reranked', count(*) FROM best UNION ALL SELECT 'graph', count(*) FROM around)"""
)
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).stats().select("stage", "hits")


@query(f"{_HYBRID_SQL} SELECT 'Retrieved evidence:' || chr(10) || string_agg('• ' || qualified_name || ' @ ' || file_path || ':' || start_line, chr(10) ORDER BY rank) AS answer, 'CONFIRMED' AS confidence FROM best WHERE rank <= 8")
def answer_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).answers().select("answer", "confidence")


_SHOWN = "'Location: ' || file_path || ':' || start_line || '-' || end_line, CASE WHEN coalesce(language, '') <> '' THEN 'Language: ' || language END, CASE WHEN length(documentation) > 0 THEN 'Documentation: ' || left(documentation, 300) END"
_HEAD = f"'REPOSITORY: tables' || chr(10) || 'QUESTION: {HYBRID}' || chr(10) || 'DETECTED_INTENT: LOCATION' || chr(10)"


@query(
    f"""{_HYBRID_SQL}, {_AROUND_SQL},
one AS (SELECT rank, qualified_name, file_path, start_line, end_line, concat_ws(chr(10), '--- ' || upper(symbol_type) || ': ' || qualified_name || ' ---', {_SHOWN}, CASE WHEN length(code) > 0 THEN '```' || coalesce(language, '') || chr(10) || left(code, 600) || chr(10) || '```' END) AS b FROM best),
fold AS (SELECT CAST(0 AS BIGINT) AS rank, length({_HEAD}) + 24 AS used, CAST(NULL AS VARCHAR) AS b UNION ALL SELECT one.rank, CASE WHEN used + length(one.b) < 24000 THEN used + length(one.b) ELSE used END, CASE WHEN used + length(one.b) < 24000 THEN one.b END FROM fold JOIN one ON one.rank = fold.rank + 1),
more AS (SELECT rank, b, (SELECT max(used) FROM fold) + 23 + sum(length(b)) OVER (ORDER BY rank) AS used FROM (SELECT a.rank, concat_ws(chr(10), '--- ' || upper(symbol_type) || ': ' || qualified_name || ' ---', {_SHOWN}) AS b FROM around a JOIN {SYMBOLS_SQL} s USING (id)))
SELECT md5(concat_ws(chr(10) || chr(10), {_HEAD}, '=== PRIMARY EVIDENCE ===', (SELECT string_agg(b, chr(10) || chr(10) ORDER BY rank) FROM fold), CASE WHEN (SELECT count(*) FROM more WHERE used < 24000) > 0 THEN '=== RELATED CONTEXT ===' END,
 (SELECT string_agg(b, chr(10) || chr(10) ORDER BY rank) FROM more WHERE used < 24000), '=== SOURCE REFERENCES ===', (SELECT string_agg('• ' || qualified_name || ' @ ' || file_path || ':' || start_line || '-' || end_line, chr(10) || chr(10) ORDER BY rank) FROM one))) AS context_md5"""
)
def context_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence within the budget, what is around it, and where it stands."""
    return hybrid(spark, sf_dir).assembled("tables").select(F.md5("context").alias("context_md5"))


def _rule_sql() -> str:
    from ..functions.text import INTENT_RULES

    rows = []
    for i, (name, patterns) in enumerate(INTENT_RULES):
        hits = " + ".join(f"CAST(regexp_matches(t, '{p}') AS INT)" for p in patterns)
        rows.append(f"{{'h': {hits}, 'o': -{i}, 'i': '{name}'}}")
    return f"list_max([{', '.join(rows)}])"


_NO_DOTALL = "replace(lower(trim(text)), chr(10), ' | ')"


@query(f"SELECT query_id, CASE WHEN b.h = 0 THEN 'GENERAL_CODEBASE_QA' ELSE b.i END AS intent, round(CAST(CASE WHEN b.h = 0 THEN 0.4 ELSE least(0.4 + 0.2 * b.h, 0.95) END AS DOUBLE), 6) AS confidence FROM (SELECT query_id, {_rule_sql()} AS b FROM (SELECT query_id, lower(trim(text)) AS t FROM {QUESTIONS_SQL}))")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, sure = tx.intent(F.col("text"))
    return questions(spark, sf_dir).select("query_id", name.alias("intent"), F.round(sure, 6).alias("confidence"))


@query(f"SELECT query_id, {' OR '.join(f'regexp_matches(t, {p!r})' for p in tx.MULTI_HOP)} AS multi_hop FROM (SELECT query_id, lower(trim(text)) AS t FROM {QUESTIONS_SQL})")
def multi_hop_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", tx.multi_hop(F.col("text")).alias("multi_hop"))


_EXACT = r"""coalesce(nullif(regexp_extract(text, '`([A-Za-z_][\w.]*)`', 1), ''), nullif(regexp_extract(text, '"([A-Za-z_][\w.]*)"', 1), ''), nullif(regexp_extract(text, '\b([A-Z][A-Za-z0-9]*(?:\.[a-z][A-Za-z0-9]*)+)\b', 1), ''), nullif(regexp_extract(text, '\b([A-Z][A-Za-z]{3,}(?:Service|Controller|Repository|Handler|Manager))\b', 1), ''))"""
_WORDS = rf"""list_filter(regexp_extract_all(text, '[A-Za-z_]\w*'), lambda w: length(w) > 2 AND lower(w) NOT IN ({", ".join(map(repr, tx.STOP_WORDS))}))"""
_ALL_TERMS = f"list_concat(CASE WHEN {_EXACT} IS NULL THEN [] ELSE [{_EXACT}] END, {_WORDS})"
_KEEP_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_TERM_LIST = f"list_slice({_KEEP_FIRST.format(_ALL_TERMS)}, 1, 10)"


@query(f"SELECT query_id, {_EXACT} AS exact_symbol FROM {QUESTIONS_SQL}")
def exact_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", tx.exact_symbol(F.col("text")).alias("exact_symbol"))


@query(f"SELECT query_id, array_to_string({_TERM_LIST}, ',') AS terms FROM {QUESTIONS_SQL}")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", F.array_join(tx.search_terms(F.col("text")), ",").alias("terms"))


_MORE = ", ".join(f"CASE WHEN contains(low, '{base}') THEN {words!r} ELSE [] END" for base, words in tx.SYNONYMS.items())


@query(f"SELECT query_id, md5(array_to_string(list_slice({_KEEP_FIRST.format('a')}, 1, 20), ',')) AS expanded_md5 FROM (SELECT query_id, list_concat(terms, {_MORE}, [low]) AS a FROM (SELECT query_id, {_TERM_LIST} AS terms, lower(trim(text)) AS low FROM {QUESTIONS_SQL}))")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tx.expanded_terms(F.col("text"), tx.search_terms(F.col("text")))
    return questions(spark, sf_dir).select("query_id", F.md5(F.array_join(e, ",")).alias("expanded_md5"))
