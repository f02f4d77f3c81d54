"""Listings, counters, paths, secrets, context and measures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, paths, secrets
from ..functions import text as tx
from ..operators import catalog, context, evaluate, parse, relate, status
from ..schemas import INDEX_STATUS
from .bindings import PATHS_SQL, SYMBOLS_SQL, symbols
from .bindings import paths as path_rows
from .registry import query, read


@query(f"SELECT id, file_path FROM {SYMBOLS_SQL} WHERE repository_id = 'src3' AND language = 'en' ORDER BY file_path LIMIT 200 OFFSET 5")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.of_repository(symbols(spark, sf_dir), "src3").where("language = 'en'")
    return catalog.page(rows, [F.col("file_path")], 5, 200).select("id", "file_path")


@query(f"SELECT id, file_path, CAST(end_line AS INT) AS end_line FROM {SYMBOLS_SQL} WHERE repository_id = 'src3' AND symbol_type = 'file' ORDER BY file_path, start_line, id LIMIT 100")
def list_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.of_repository(symbols(spark, sf_dir), "src3").where("symbol_type = 'file'")
    return catalog.page(rows, [F.col("file_path"), F.col("start_line"), F.col("id")], 0, 100).select("id", "file_path", "end_line")


@query(f"SELECT id, qualified_name FROM {SYMBOLS_SQL} WHERE id = 42 AND repository_id = (SELECT source FROM documents WHERE doc_id = 42)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = read(spark, sf_dir, "documents").where("doc_id = 42").select(F.col("source").alias("repository_id"))
    return symbols(spark, sf_dir).where("id = 42").join(owner, "repository_id", "left_semi").select("id", "qualified_name")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def repos_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(read(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 0, 50).select("o_orderkey", "o_orderdate")


@query("SELECT source AS repository_id, lang AS language, count(*) AS files FROM documents WHERE lang IS NOT NULL GROUP BY ALL")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(symbols(spark, sf_dir), ["repository_id", "language"])


@query("SELECT source AS repository_id, count(*) AS symbols, count(DISTINCT lang) AS languages, CAST(sum(n_chars) AS BIGINT) AS chars, 'Indexed ' || count(*) || ' symbols' AS detail FROM documents GROUP BY source")
def repo_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("repository_id"))
    n = F.count("*")
    return d.agg(n.alias("symbols"), F.countDistinct("lang").alias("languages"), F.sum("n_chars").alias("chars"), F.format_string("Indexed %d symbols", n).alias("detail"))


@query("SELECT repository_id, language, files, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY files DESC, language) AS INT) AS place FROM (SELECT source AS repository_id, lang AS language, count(*) AS files FROM documents WHERE lang IS NOT NULL GROUP BY ALL) QUALIFY place <= 3")
def top3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top_languages(symbols(spark, sf_dir), "repository_id", "language")


@query("SELECT l_orderkey AS file, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS symbols FROM lineitem GROUP BY l_orderkey")
def group_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct("l_linenumber", "l_partkey")
    shown = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.array_join(shown, ",").alias("symbols"))


_HISTORY = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 10 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) <= 4)"


@query(f"SELECT conv_id, turn, role FROM {_HISTORY}")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.history(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query(f"SELECT conv_id, string_agg(upper(role) || ': ' || left(text, 500), chr(10) ORDER BY turn) AS history FROM {_HISTORY} GROUP BY conv_id")
def history_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = context.history(read(spark, sf_dir, "conversations")).select("conv_id", F.struct("turn", context.history_line(F.col("role"), F.col("text")).alias("line")).alias("x"))
    return line.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("history"))


@query("SELECT c.conv_id, turns, turn, text FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 50) c JOIN conversations m ON c.conv_id = m.conv_id AND m.role = 'assistant'")
def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty conversations with what was answered in them."""
    m = read(spark, sf_dir, "conversations")
    newest = m.groupBy("conv_id").agg(F.count("*").alias("turns")).orderBy(F.desc("conv_id")).limit(50)
    return m.where("role = 'assistant'").join(newest, "conv_id").select("conv_id", "turns", "turn", "text")


_STATUS = "CASE event_type WHEN 'click' THEN 'CLONING' WHEN 'view' THEN 'PARSING' WHEN 'signup' THEN 'BUILDING_GRAPH' WHEN 'purchase' THEN 'READY' ELSE 'FAILED' END"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "CLONING").when(F.col("event_type") == "view", "PARSING").when(F.col("event_type") == "signup", "BUILDING_GRAPH").when(F.col("event_type") == "purchase", "READY").otherwise("FAILED")
    return catalog.latest_status(read(spark, sf_dir, "events").withColumn("state", status), "user_id", "state", "ts", "event_id")


_LATEST = f"(SELECT user_id, arg_max({_STATUS}, {{'t': ts, 'e': event_id}}) AS status, max(ts) AS since FROM events GROUP BY user_id)"


@query(f"SELECT user_id, status, since FROM {_LATEST}")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


@query(f"SELECT user_id, CAST(CASE status WHEN 'CLONING' THEN 13 WHEN 'PARSING' THEN 38 WHEN 'BUILDING_GRAPH' THEN 63 WHEN 'READY' THEN 100 ELSE -1 END AS INT) AS percent FROM {_LATEST}")
def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select("user_id", catalog.progress(F.col("status")).alias("percent"))


_SCHEME, _HOST, _PATH = (f"regexp_extract(trim(url), '{p}', 1)" for p in (r"^([A-Za-z][A-Za-z0-9+.-]*)://", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"))


@query(
    f"""SELECT page_id, CASE WHEN lower({_SCHEME}) IN ('https', 'http', 'git') AND {_HOST} <> '' AND {_PATH} <> '' AND NOT contains({_HOST}, '@')
 AND (lower({_HOST}) IN ({", ".join(map(repr, paths.URL_HOSTS))}) OR lower({_HOST}) LIKE '%.github.com' OR lower({_SCHEME}) = 'https') THEN rtrim(trim(url), '/') END AS valid_url FROM pages"""
)
def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", paths.valid_url(F.col("url")).alias("valid_url"))


@query(r"SELECT page_id, regexp_replace(string_split(rtrim(url, '/'), '/')[-1], '\.git$', '') AS name FROM pages")
def repo_name_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", paths.repository_name(F.col("url")).alias("name"))


@query("SELECT page_id, 'https://github.com/owner' || page_id || '/name/archive/refs/heads/main.zip' AS archive FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 2 = 1")
def github_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.format_string("https://github.com/owner%d/name.git", "page_id")
    return read(spark, sf_dir, "pages").select("page_id", paths.github_archive(F.when(F.col("page_id") % 2 == 0, mine).otherwise(F.col("url")), F.lit("main")).alias("archive"))


def _in_sql(values: list[str]) -> str:
    return "(" + ", ".join(map(repr, values)) + ")"


_NAME, _END = "lower(string_split(path, '/')[-1])", r"lower(regexp_extract(string_split(path, '/')[-1], '[^.](\.[^.]+)$', 1))"


@query(
    f"""SELECT doc_id, CASE WHEN {_NAME} IN ('.env', '.env.local') OR {_NAME} LIKE '%.pem' OR {_NAME} LIKE '%.key' THEN 'secret' WHEN contains(lower(path), 'test') THEN 'test' WHEN {_END} IN {_in_sql(list(paths.LANGUAGES))} THEN 'source'
 WHEN {_NAME} IN {_in_sql(paths.KEEP_NAMES)} OR {_END} IN {_in_sql(paths.KEEP_SUFFIXES)} THEN CASE WHEN {_NAME} IN {_in_sql(paths.CONFIG_NAMES)} OR {_END} IN {_in_sql(paths.CONFIG_SUFFIXES)} THEN 'config' ELSE 'documentation' END ELSE 'other' END AS classification FROM {PATHS_SQL}"""
)
def classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_rows(spark, sf_dir).select("doc_id", paths.classification(F.col("path")).alias("classification"))


@query(f"SELECT doc_id, CASE {' '.join(f'WHEN {_END} = {k!r} THEN {v!r}' for k, v in paths.LANGUAGES.items())} END AS language FROM {PATHS_SQL}")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_rows(spark, sf_dir).select("doc_id", paths.language(F.col("path")).alias("language"))


@query(
    f"""SELECT doc_id, CASE WHEN list_has_any(string_split(path, '/'), {paths.IGNORED_COMPONENTS!r}) THEN true WHEN {_NAME} IN {_in_sql(paths.KEEP_NAMES)} OR {_END} IN {_in_sql(paths.KEEP_SUFFIXES)} THEN false
 WHEN {_END} IN {_in_sql(paths.IGNORED_SUFFIXES)} THEN true WHEN {_NAME} LIKE '.%' AND {_NAME} NOT IN {_in_sql(paths.DOT_KEPT)} THEN NOT ({_END} IN {_in_sql(list(paths.LANGUAGES))} OR {_NAME} IN ('.env', '.env.local')) ELSE false END AS ignored FROM {PATHS_SQL}"""
)
def ignore_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_rows(spark, sf_dir).select("doc_id", paths.is_ignored(F.col("path")).alias("ignored"))


_MEMBER = f"(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '/' || path WHEN doc_id % 7 = 0 THEN 'a/../' || path WHEN doc_id % 11 = 0 THEN replace(path, '/', chr(92)) ELSE path END AS path FROM {PATHS_SQL})"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = F.col("path"), F.col("doc_id")
    return path_rows(spark, sf_dir).withColumn("path", F.when(i % 5 == 0, F.concat(F.lit("/"), p)).when(i % 7 == 0, F.concat(F.lit("a/../"), p)).when(i % 11 == 0, F.replace(p, F.lit("/"), F.lit("\\"))).otherwise(p))


@query(f"SELECT doc_id, NOT starts_with(replace(path, chr(92), '/'), '/') AND NOT list_contains(string_split(replace(path, chr(92), '/'), '/'), '..') AS safe FROM {_MEMBER}")
def zip_member_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("doc_id", paths.safe_member(F.col("path")).alias("safe"))


@query(f"SELECT doc_id, CASE WHEN p = '' AND NOT starts_with(path, '/') THEN '.' ELSE p END AS path FROM (SELECT doc_id, path, array_to_string(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS p FROM (SELECT doc_id, './' || path || '//x/./y' AS path FROM {_MEMBER} UNION ALL SELECT -1 - doc_id, path FROM {_MEMBER}))")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member names as they are, and with parts around them that a normal path doesn't have."""
    m = _members(spark, sf_dir).select("doc_id", "path")
    odd = m.select("doc_id", F.concat(F.lit("./"), "path", F.lit("//x/./y")).alias("path"))
    return odd.union(m.select(-1 - F.col("doc_id"), "path")).select("doc_id", paths.normalized(F.col("path")).alias("path"))


#: Made-up secrets of every kind behind documents' texts, each of its document's id alone.
_SEEDED_SQL = """(SELECT doc_id, coalesce(text, '') || ' ' || (['api_key = ' || lpad(CAST(doc_id AS VARCHAR), 12, 'x'), 'sk-' || lpad(CAST(doc_id AS VARCHAR), 20, 'x'), 'AKIA' || lpad(CAST(doc_id AS VARCHAR), 16, '0'),
 'eyJ' || lpad(CAST(doc_id AS VARCHAR), 10, 'x') || '.' || lpad(CAST(doc_id AS VARCHAR), 10, 'y') || '.' || lpad(CAST(doc_id AS VARCHAR), 10, 'z'), '-----BEGIN RSA ' || 'PRIVATE KEY-----', 'none'])[CAST(doc_id % 6 AS INT) + 1] AS text FROM documents)"""


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda n, c: F.lpad(F.col("doc_id").cast("string"), n, c)
    kinds = F.array(
        F.concat(F.lit("api_key = "), own(12, "x")), F.concat(F.lit("sk-"), own(20, "x")), F.concat(F.lit("AKIA"), own(16, "0")),
        F.concat(F.lit("eyJ"), own(10, "x"), F.lit("."), own(10, "y"), F.lit("."), own(10, "z")), F.concat(F.lit("-----BEGIN RSA "), F.lit("PRIVATE KEY-----")), F.lit("none"),
    )
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.get(kinds, (F.col("doc_id") % 6).cast("int"))).alias("text"))


@query(f"SELECT doc_id, {', '.join(f'CAST(len(regexp_extract_all(text, {p.replace(chr(39), chr(39) * 2).join((chr(39), chr(39)))})) AS INT) AS {n}' for n, p in secrets.PATTERNS.items())} FROM {_SEEDED_SQL}")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_counts(F.col("text"))
    return _seeded(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in found.items()))


def _redact_sql() -> str:
    out = "text"
    for p in secrets.PATTERNS.values():
        quoted = p.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{secrets.MARKER}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_redact_sql()}) AS redacted_md5, {_redact_sql()} <> text AS redacted FROM {_SEEDED_SQL}")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.redacted(F.col("text"))
    return _seeded(spark, sf_dir).select("doc_id", F.md5(out).alias("redacted_md5"), (out != F.col("text")).alias("redacted"))


_WORDS_OF_DOUBT = ["", " INSUFFICIENT evidence here", " It was Not Found", " This is Inferred", " Likely so"]


@query(
    f"""SELECT conv_id, turn, CASE WHEN contains(t, 'insufficient evidence') OR contains(t, 'not found') THEN 'NOT_FOUND' WHEN contains(t, 'inferred') OR contains(t, 'likely') THEN 'INFERRED' ELSE 'CONFIRMED' END AS grade
FROM (SELECT conv_id, turn, lower(text || ({_WORDS_OF_DOUBT!r})[CAST((conv_id + turn) % 5 AS INT) + 1]) AS t FROM conversations)"""
)
def evidence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with words of doubt behind four of five turns."""
    said = F.concat("text", F.get(F.array(*map(F.lit, _WORDS_OF_DOUBT)), ((F.col("conv_id") + F.col("turn")) % 5).cast("int")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.evidence_grade(said).alias("grade"))


@query("SELECT event_id, CAST(props->>'k' AS INT) AS k, CAST(json_object('k', CAST(props->>'k' AS INT)) AS VARCHAR) AS again FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map read from JSON and written again; what is no JSON is an empty map."""
    m = F.coalesce(F.from_json("props", "map<string,int>"), F.create_map().cast("map<string,int>"))
    return read(spark, sf_dir, "events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.to_json(m).alias("again"))


@query(f"SELECT id, md5(concat_ws(chr(10), symbol_type || ': ' || qualified_name, 'file: ' || file_path, left(code, 1200))) AS text_md5 FROM {SYMBOLS_SQL}")
def symbol_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.embedding_text(F.col("symbol_type"), F.col("qualified_name"), F.col("file_path"), F.lit(None).cast("string"), F.col("code"))
    return symbols(spark, sf_dir).select("id", F.md5(t).alias("text_md5"))


@query(f"SELECT id, md5(qualified_name || ' ' || symbol_name || ' ' || file_path || '  ' || left(code, 400)) AS text_md5 FROM {SYMBOLS_SQL}")
def bm25_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.lexical_text(F.col("qualified_name"), F.col("symbol_name"), F.col("file_path"), F.lit(None).cast("string"), F.col("code"))
    return symbols(spark, sf_dir).select("id", F.md5(t).alias("text_md5"))


_SHA = f"sha1(unhex('{ids.URL_NAMESPACE}') || encode(repository_id || '|' || file_path || '|' || symbol_type || '|' || qualified_name || '|' || start_line || '|' || end_line))"


@query(f"SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT id, {_SHA} AS h FROM {SYMBOLS_SQL})")
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return symbols(spark, sf_dir).select("id", ids.symbol_id(c("repository_id"), c("file_path"), c("symbol_type"), c("qualified_name"), c("start_line"), c("end_line")).alias("uuid"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY md5(text)")
def dedupe_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each content."""
    rows = read(spark, sf_dir, "documents").select(F.md5("text").alias("h"), "doc_id")
    return catalog.first_of_each(rows, ["h"], ["doc_id"]).select("doc_id", "h")


@query("SELECT count(*) AS rows, count(DISTINCT source) AS repositories FROM documents WHERE source = 'src5'")
def isolation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.of_repository(symbols(spark, sf_dir), "src5").agg(F.count("*").alias("rows"), F.countDistinct("repository_id").alias("repositories"))


@query("SELECT source AS repository_id, count(*) AS rows FROM documents WHERE source <> 'src5' GROUP BY source")
def delete_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.without_repository(symbols(spark, sf_dir), "src5").groupBy("repository_id").agg(F.count("*").alias("rows"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 10 FROM embeddings WHERE vec_id % 3 = 0")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third point comes again with another label."""
    old = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return catalog.upserted(old, old.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 10), ["vec_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_orderkey, l_partkey ORDER BY l_linenumber) = 1")
def citations_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("file_path"), F.col("l_partkey").alias("start_line"), "l_linenumber")
    kept = context.citations(rows, "l_returnflag", ["l_linenumber"])
    return kept.select(F.col("file_path").alias("l_orderkey"), "l_linenumber", F.col("start_line").alias("l_partkey"))


_BUDGET = "(SELECT doc_id, source || '/' || lang AS repository_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS rank, n_chars FROM documents)"


def _budget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source", "lang").orderBy("n_chars", "doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("repository_id"), F.row_number().over(w).alias("rank"), "n_chars").where("rank <= 12")


@query(f"SELECT doc_id, repository_id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(n_chars) OVER (PARTITION BY repository_id ORDER BY rank) AS running FROM {_BUDGET} WHERE rank <= 12) WHERE running < 4000")
def context_budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the first twelve of each language and source until one doesn't fit."""
    return context.until_overflow(_budget_rows(spark, sf_dir), "repository_id", "rank", "n_chars", 4000).select("doc_id", "repository_id", "running")


@query(
    f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, 1000 + (doc_id * 7919) % 3000 AS size FROM {_BUDGET} WHERE rank <= 12), f AS (SELECT repository_id, rank, doc_id, size < 9000 AS kept, CASE WHEN size < 9000 THEN size ELSE 0 END AS used FROM b WHERE rank = 1
UNION ALL SELECT b.repository_id, b.rank, b.doc_id, f.used + b.size < 9000, CASE WHEN f.used + b.size < 9000 THEN f.used + b.size ELSE f.used END FROM f JOIN b ON b.repository_id = f.repository_id AND b.rank = f.rank + 1)
SELECT doc_id, repository_id FROM f WHERE kept"""
)
def context_budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that fit, those that don't passed over."""
    rows = _budget_rows(spark, sf_dir).withColumn("size", F.lit(1000) + (F.col("doc_id") * 7919) % 3000)
    return context.within_budget(rows, "repository_id", "rank", "size", 9000).select("doc_id", "repository_id")


_EVAL = """(SELECT d.lang AS category, d.source AS question, coalesce(list(CAST(l.doc_id AS VARCHAR) ORDER BY l.doc_id) FILTER (WHERE l.quality = 1 AND l.toxic = 0), []) AS expected,
 list(CAST(d.doc_id AS VARCHAR) ORDER BY n_chars DESC, d.doc_id) FILTER (WHERE n <= 15) AS retrieved FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM documents) d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang, d.source)"""
_HIT = "contains(lower(r), lower(e))"
_MEASURES = f"""(SELECT category, question, CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(list_distinct(expected), lambda e: list_bool_or(list_transform(retrieved[1:10], lambda r: {_HIT})))) / len(expected)::DOUBLE END AS recall_at_k,
 CASE WHEN len(retrieved) = 0 THEN 0.0::DOUBLE ELSE coalesce(len(list_filter(retrieved[1:10], lambda r: list_bool_or(list_transform(expected, lambda e: {_HIT})))), 0) / len(retrieved[1:10])::DOUBLE END AS precision_at_k,
 CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE coalesce(1.0::DOUBLE / list_position(list_transform(retrieved, lambda r: coalesce(list_bool_or(list_transform(expected, lambda e: {_HIT})), false)), true), 0) END AS mrr,
 CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(expected, lambda e: list_bool_or(list_transform(retrieved[1:5], lambda r: {_HIT})))) / len(expected)::DOUBLE END AS citation_accuracy FROM {_EVAL})"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each language and source: its good documents, all of them, should be its longest."""
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = d.select("doc_id", "lang", "source", F.row_number().over(w).alias("n")).where("n <= 15")
    found = ranked.groupBy("lang", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_id"))), lambda x: x["doc_id"].cast("string")).alias("retrieved"))
    good = d.join(labels.where("quality = 1 AND toxic = 0").select("doc_id"), "doc_id", "left_semi").select("lang", "source", F.col("doc_id").cast("string").alias("name"))
    rows = evaluate.per_question_rows(found, good, ["lang", "source"])
    return rows.withColumns({"category": F.col("lang"), "question": F.col("source"), "latency_ms": F.lit(1.0), "error": F.when(F.col("source") == "src7", "late")})


def _measure(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _measured(spark, sf_dir).select("category", "question", F.round(name, 6).alias(name))

    run.__name__ = name
    return query(f"SELECT category, question, round({name}, 6) AS {name} FROM {_MEASURES}")(run)


recall_at_k, precision_at_k, mrr, citation_accuracy = map(_measure, ("recall_at_k", "precision_at_k", "mrr", "citation_accuracy"))


@query(f"SELECT count(*) AS questions, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(mrr), 6) AS mrr, round(avg(citation_accuracy), 6) AS citation_accuracy, 1.0::DOUBLE AS latency_ms, round(avg(CASE WHEN question = 'src7' THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_rate FROM {_MEASURES}")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.report(_measured(spark, sf_dir))
    return r.select("questions", *(F.round(c, 6).alias(c) for c in r.columns if c != "questions"))


@query(f"SELECT category, count(*) AS questions, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr, round(avg(citation_accuracy), 6) AS citation_accuracy FROM {_MEASURES} GROUP BY category")
def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.report_by_category(_measured(spark, sf_dir))
    return r.select("category", "questions", *(F.round(c, 6).alias(c) for c in ("recall_at_k", "mrr", "citation_accuracy")))


_NOW = "2024-01-20 12:00:00"
_AGO = f"(epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts)) / 60000000.0"


@query(f"SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS ago FROM (SELECT event_id, CAST(floor({_AGO}) AS BIGINT) AS m FROM events)")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago each event was at a given time."""
    return read(spark, sf_dir, "events").select("event_id", tx.relative_time(F.col("ts"), F.lit(_NOW)).alias("ago"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0) ELSE CAST(n AS VARCHAR) END AS n FROM (SELECT o_orderkey, o_orderkey * 100 + 1 AS n FROM orders)")
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * 100 + 1
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.compact_number(n).alias("n"))


STEP_OF = {"signup": "QUEUED", "view": "SCANNING", "click": "PARSING", "purchase": "READY", "error": "FAILED"}
_STEP_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEP_OF.items()) + " END"
_PLACE = f"list_position({[s for s in INDEX_STATUS if s != 'FAILED']!r}, {{}})"
_FOLLOWS = f"""CASE step WHEN 'QUEUED' THEN now IN ('', 'READY', 'FAILED') WHEN 'FAILED' THEN now NOT IN ('', 'READY', 'FAILED') ELSE coalesce({_PLACE.format("step")} > nullif({_PLACE.format("now")}, 0), false) END"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a run, an event a change of its status."""
    step = F.create_map(*(F.lit(x) for kv in STEP_OF.items() for x in kv))
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.try_element_at(step, F.col("event_type")).alias("step"))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, ts, {_STEP_SQL} AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w(user_id, event_id, ts, n, before, step, held) AS (
  SELECT user_id, event_id, ts, n, '', step, step = 'QUEUED' FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, ts, n, now, step, {_FOLLOWS} FROM (SELECT e.*, CASE WHEN w.held THEN w.step ELSE w.before END AS now FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)),
h AS (SELECT user_id, event_id, step, ts, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY n), (SELECT max(ts) FROM events)) AS next FROM w WHERE held)
SELECT user_id, event_id, ts AS at, before, step AS after, CASE WHEN held THEN 'held' ELSE 'refused' END AS kind FROM w
UNION ALL SELECT user_id, event_id, ts + INTERVAL 1 DAY, step, step, 'stuck' FROM h WHERE step NOT IN ('READY', 'FAILED') AND ts + INTERVAL 1 DAY < next"""
)
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events change the status of their run, which are refused, and which runs are stuck for a day."""
    found = status.changes(run_events(spark, sf_dir), "user_id", "step", "ts", "event_id")
    return found.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "at", "before", "after", "kind")


_REPLICATES = 200
_BOOT = f"""WITH m AS MATERIALIZED (SELECT category, category || '/' || question AS question, recall_at_k, mrr, citation_accuracy FROM {_MEASURES}),
r AS (SELECT *, (CAST('0x' || left(sha256('7:' || b || ':' || question), 8) AS BIGINT) + 0.5) / 4294967296 AS u FROM m, (SELECT unnest(range(1, {_REPLICATES + 1})) AS b)),
w AS (SELECT *, CASE {" ".join(f"WHEN u <= {evaluate.POISSON[k]!r} THEN {k}" for k in range(len(evaluate.POISSON)))} ELSE {len(evaluate.POISSON)} END AS w FROM r),
s AS (SELECT category, measure, b, sum(w * value) / nullif(sum(w), 0) AS mean FROM (SELECT category, b, w, unnest(['recall_at_k', 'mrr', 'citation_accuracy']) AS measure, unnest([recall_at_k, mrr, citation_accuracy]) AS value FROM w) GROUP BY ALL),
l AS (SELECT category, measure, list_sort(list(mean) FILTER (WHERE mean IS NOT NULL)) AS means FROM s GROUP BY ALL),
p AS (SELECT category, measure, avg(value) AS mean FROM (SELECT category, unnest(['recall_at_k', 'mrr', 'citation_accuracy']) AS measure, unnest([recall_at_k, mrr, citation_accuracy]) AS value FROM m) GROUP BY ALL)
SELECT category, measure, round(mean, 6) AS mean, round(means[CAST(floor(0.025 * (len(means) - 1)) AS INT) + 1], 6) AS low, round(means[CAST(ceil(0.975 * (len(means) - 1)) AS INT) + 1], 6) AS high FROM p JOIN l USING (category, measure)"""


@query(_BOOT)
def eval_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the measures by category with intervals of 95 per cent."""
    m = _measured(spark, sf_dir).withColumn("question", F.concat_ws("/", "lang", "source"))
    found = evaluate.bootstrap(m, ["recall_at_k", "mrr", "citation_accuracy"], "question", "category", _REPLICATES, 7)
    return found.select("category", "measure", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


SOURCES = [
    ("demo", "src/auth.py", "python", 'import os\nfrom db.users import find\n\nclass Auth:\n    """Checks users."""\n\n    def login(self, name):\n        return find(name.strip())\n\n    def logout(self):\n        self.login("x")\n\n@router.get("/health")\ndef health():\n    return Auth().login("probe")\n'),
    ("demo", "src/broken.py", "python", "class Open:\n    def run(self):\n        pass\n\ndef unfinished(\n"),
    ("demo", "src/app.ts", "typescript", "import { x } from 'lib';\nexport class App {\n  start() { return x; }\n}\nexport async function main() {\n  new App();\n}\n"),
    ("demo", "src/Main.java", "java", 'public class Main {\n  @GetMapping("/all")\n  public String all() {\n    return "";\n  }\n}\n'),
    ("demo", "src/main.go", "go", "package main\n\nfunc main() {\n\tif true {\n\t}\n}\n"),
    ("demo", "src/util.c", "c", "int add(int a, int b) {\n  return a + b;\n}\n"),
    ("demo", "README.md", None, "# Grüße\nnothing to see\n"),
]


#: A source for each document, of one language or another: (language, suffix, text with the document's id as #).
_SHAPES = [
    ("python", "py", "class Doc#:\n    def run(self):\n        return helper_#()\n"),
    ("typescript", "ts", "export class Doc# {\n  start() { return x; }\n}\n"),
    ("java", "java", 'public class Doc# {\n  @GetMapping("/d#")\n  public String all() {\n    return "";\n  }\n}\n'),
    ("go", "go", "package main\n\nfunc main#() {\n\tif true {\n\t}\n}\n"),
    ("c", "c", "int add#(int a, int b) {\n  return a + b;\n}\n"),
]
#: What each shape holds, as _SYMBOLS and _EDGES have it; a plus is as many columns as the id has digits.
_SHAPE_SYMBOLS = [
    (0, "class", "Doc#", 1, 3, 0, "24+", None), (0, "method", "Doc#.run", 2, 3, 4, "24+", "Doc#"), (1, "class", "Doc#", 1, 3, 7, "1", None), (1, "method", "Doc#.start", 2, 2, 2, "23", "Doc#"),
    (2, "class", "Doc#", 1, 6, 0, "1", None), (2, "endpoint", "GET /d#", 3, 5, 2, "3", "Doc#.all"), (2, "method", "Doc#.all", 3, 5, 2, "3", "Doc#"), (3, "function", "main#", 3, 6, 0, "1", None), (4, "function", "add#", 1, 3, 0, "1", None),
]
_SHAPE_EDGES = [
    *((k, "src/d#." + _SHAPES[k][1], name, "CONTAINS", 1.0, 0, 1, line) for k, _, name, line, *_ in _SHAPE_SYMBOLS),
    (0, "Doc#.run", "helper_#", "CALLS", 0.55, 1, 0, 3), (2, "GET /d#", "Doc#.all", "ROUTES_TO", 1.0, 1, 1, 2),
]


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal sources, and one for every document."""
    pick = lambda i: F.get(F.array(*(F.lit(s[i]) for s in _SHAPES)), (F.col("doc_id") % len(_SHAPES)).cast("int"))
    own = F.col("doc_id").cast("string")
    made = read(spark, sf_dir, "documents").select(F.lit("documents").alias("repository_id"), F.concat(F.lit("src/d"), own, F.lit("."), pick(1)).alias("path"), pick(0).alias("language"), F.replace(pick(2), F.lit("#"), own).alias("content"))
    return parse.parse_files(spark.createDataFrame(SOURCES, "repository_id string, path string, language string, content string").unionByName(made))


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else f"{x}::INT"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"


#: What the literal sources hold, read by eye: type, name, lines, columns, parent and documentation.
_SYMBOLS = [
    ('README.md', 'file', 'README.md', 1, 2, 0, 14, None, None),
    ('src/Main.java', 'class', 'Main', 1, 6, 0, 1, None, None),
    ('src/Main.java', 'endpoint', 'GET /all', 3, 5, 2, 3, 'Main.all', None),
    ('src/Main.java', 'method', 'Main.all', 3, 5, 2, 3, 'Main', None),
    ('src/app.ts', 'class', 'App', 2, 4, 7, 1, None, None),
    ('src/app.ts', 'method', 'App.start', 3, 3, 2, 23, 'App', None),
    ('src/app.ts', 'function', 'main', 5, 7, 13, 1, None, None),
    ('src/auth.py', 'class', 'Auth', 4, 11, 0, 23, None, 'Checks users.'),
    ('src/auth.py', 'method', 'Auth.login', 7, 8, 4, 33, 'Auth', None),
    ('src/auth.py', 'method', 'Auth.logout', 10, 11, 4, 23, 'Auth', None),
    ('src/auth.py', 'endpoint', 'GET /health', 14, 15, 0, 32, 'health', None),
    ('src/auth.py', 'function', 'health', 14, 15, 0, 32, None, None),
    ('src/broken.py', 'class', 'Open', 1, 4, 0, 0, None, None),
    ('src/broken.py', 'method', 'Open.run', 2, 4, 4, 0, 'Open', None),
    ('src/broken.py', 'function', 'unfinished', 5, 5, 0, 15, None, None),
    ('src/main.go', 'function', 'main', 3, 6, 0, 1, None, None),
    ('src/util.c', 'function', 'add', 1, 3, 0, 1, None, None),
]
_EDGES = [
    ('App', 'lib', 'IMPORTS', 0.9, 1, 0, 'src/app.ts:1'),
    ('Auth', 'db.users', 'IMPORTS', 0.9, 1, 0, 'src/auth.py:2'),
    ('Auth', 'os', 'IMPORTS', 0.9, 1, 0, 'src/auth.py:1'),
    ('Auth.login', 'find', 'CALLS', 0.55, 1, 0, 'src/auth.py:8'),
    ('Auth.login', 'strip', 'CALLS', 0.55, 1, 0, 'src/auth.py:8'),
    ('Auth.logout', 'login', 'CALLS', 0.55, 1, 0, 'src/auth.py:11'),
    ('GET /all', 'Main.all', 'ROUTES_TO', 1.0, 1, 1, 'src/Main.java:2'),
    ('GET /health', 'health', 'ROUTES_TO', 1.0, 1, 1, 'src/auth.py:14'),
    ('README.md', 'README.md', 'CONTAINS', 1.0, 1, 1, 'README.md:1'),
    ('health', 'Auth', 'CALLS', 0.55, 1, 1, 'src/auth.py:15'),
    ('health', 'login', 'CALLS', 0.55, 1, 0, 'src/auth.py:15'),
    ('src/Main.java', 'GET /all', 'CONTAINS', 1.0, 0, 1, 'src/Main.java:3'),
    ('src/Main.java', 'Main', 'CONTAINS', 1.0, 0, 1, 'src/Main.java:1'),
    ('src/Main.java', 'Main.all', 'CONTAINS', 1.0, 0, 1, 'src/Main.java:3'),
    ('src/app.ts', 'App', 'CONTAINS', 1.0, 0, 1, 'src/app.ts:2'),
    ('src/app.ts', 'App.start', 'CONTAINS', 1.0, 0, 1, 'src/app.ts:3'),
    ('src/app.ts', 'main', 'CONTAINS', 1.0, 0, 1, 'src/app.ts:5'),
    ('src/auth.py', 'Auth', 'CONTAINS', 1.0, 0, 1, 'src/auth.py:4'),
    ('src/auth.py', 'Auth.login', 'CONTAINS', 1.0, 0, 1, 'src/auth.py:7'),
    ('src/auth.py', 'Auth.logout', 'CONTAINS', 1.0, 0, 1, 'src/auth.py:10'),
    ('src/auth.py', 'GET /health', 'CONTAINS', 1.0, 0, 1, 'src/auth.py:14'),
    ('src/auth.py', 'health', 'CONTAINS', 1.0, 0, 1, 'src/auth.py:14'),
    ('src/broken.py', 'Open', 'CONTAINS', 1.0, 0, 1, 'src/broken.py:1'),
    ('src/broken.py', 'Open.run', 'CONTAINS', 1.0, 0, 1, 'src/broken.py:2'),
    ('src/broken.py', 'unfinished', 'CONTAINS', 1.0, 0, 1, 'src/broken.py:5'),
    ('src/main.go', 'main', 'CONTAINS', 1.0, 0, 1, 'src/main.go:3'),
    ('src/util.c', 'add', 'CONTAINS', 1.0, 0, 1, 'src/util.c:1'),
]


_OWN = "replace({}, '#', CAST(doc_id AS VARCHAR))"
_SUFFIX = f"({[s[1] for s in _SHAPES]!r})[CAST(doc_id % {len(_SHAPES)} AS INT) + 1]"


@query(
    f"""{_values("file_path, symbol_type, qualified_name, start_line, end_line, start_column, end_column, parent_symbol, documentation", _SYMBOLS)} UNION ALL
SELECT 'src/d' || doc_id || '.' || {_SUFFIX}, kind, {_OWN.format("name")}, a, b, c, CAST(replace(d, '+', '') AS INT) + CASE WHEN contains(d, '+') THEN length(CAST(doc_id AS VARCHAR)) ELSE 0 END, {_OWN.format("parent")}, NULL
FROM documents JOIN ({_values("k, kind, name, a, b, c, d, parent", _SHAPE_SYMBOLS)}) ON k = doc_id % {len(_SHAPES)}"""
)
def parse_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the literal sources and of one for every document."""
    return parse.symbols_of(_parsed(spark, sf_dir)).select("file_path", "symbol_type", "qualified_name", "start_line", "end_line", "start_column", "end_column", "parent_symbol", "documentation")


@query(
    f"""{_values("source_name, target_name, relation_type, confidence, source_known, target_known, evidence", _EDGES)} UNION ALL
SELECT {_OWN.format("one_end")}, {_OWN.format("other_end")}, relation, confidence, source_known, target_known, 'src/d' || doc_id || '.' || {_SUFFIX} || ':' || line
FROM documents JOIN ({_values("k, one_end, other_end, relation, confidence, source_known, target_known, line", _SHAPE_EDGES)}) ON k = doc_id % {len(_SHAPES)}"""
)
def code_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the sources' symbols, and whether each end is one."""
    parsed = _parsed(spark, sf_dir)
    edges = relate.relationships(parsed, parse.symbols_of(parsed))
    known = lambda c: F.col(c).isNotNull().cast("int")
    return edges.select("source_name", "target_name", "relation_type", "confidence", known("source_symbol_id").alias("source_known"), known("target_symbol_id").alias("target_known"), "evidence")


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) SELECT doc_id, count(*) AS lines, CAST(min(CASE WHEN n > 1 THEN n END) AS INT) AS second, md5(string_agg(CASE WHEN n BETWEEN 2 AND 4 THEN line END, chr(10) ORDER BY n)) AS slice_md5 FROM l GROUP BY doc_id")
def symbol_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines two to four of each document."""
    lines = F.split("text", "\n")
    part = F.slice(lines, 2, 3)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), F.when(F.size(lines) > 1, 2).alias("second"), F.when(F.size(part) > 0, F.md5(F.array_join(part, "\n"))).alias("slice_md5"))


@query("SELECT p_partkey, CASE WHEN length(n) > 12 THEN left(n, 9) || '…' ELSE n END AS label FROM (SELECT p_partkey, p_brand || ' ' || p_name AS n FROM part)")
def label_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = tx.short_label(F.concat_ws(" ", "p_brand", "p_name"), 12)
    return read(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
