"""The numbered queries, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .best_fit_packing import best_fit_packing
from .common import table
from .decontamination import contamination
from .hilbert_sharding import hilbert_shards
from .importance import resampled
from .license_scan import BASE, DIGITS, LEAST, RARE, SLACK, TEMPLATES, Index, license_scan
from .line_dedup import line_dedup
from .merkle_manifest import verified_documents
from .pii_surrogates import private_documents
from .quality_rules import judged
from .simhash import near_duplicates
from .suffix_tree_lm import suffix_tree_scores
from .token_counts import token_counts
from .token_matrix import packed_ids


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in documents."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents under a suffix tree trained on six sevenths of them."""
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; a deployment passes its own secret key."""
    return private_documents(table(spark, sf_dir, "documents"), b"key of the published query")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight runs of the Hilbert curve."""
    return hilbert_shards(table(spark, sf_dir, "documents"))


def op3_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packed id matrices."""
    return packed_ids(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that ten or more of them hold."""
    return line_dedup(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed limits and robust outliers for every document."""
    return judged(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and folded roots of documents, of which a seventh is tampered with."""
    return verified_documents(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in documents."""
    return license_scan(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of documents, drawn towards the words of the benchmark."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of this package."""
    return {f.__name__: f for f in (op1_decontamination, op2_token_counts, op3_token_matrix, op4_line_dedup, op5_simhash_near_dedup, op6_suffix_tree_lm, op7_pii_surrogates, op8_best_fit_packing, op9_hilbert_sharding, op10_quality_rules, op11_merkle_manifest, op12_license_scan, op13_importance_resampling)}


#: Words and windows as the contract has them; a window of an item is found by its words.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), g AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram FROM g
), sizes AS (
  SELECT DISTINCT n FROM windows
), dg AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT dg.doc_id, dg.p, dg.n, windows.item_id
  FROM (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram FROM dg) dg JOIN windows USING (n, gram)
), hit_words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


#: Lines are keyed by what is left between white space, with A-Z in lower case.
OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), e AS (
  SELECT r, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d
), k AS (
  SELECT r, doc_id, line, p, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM e
), common AS (
  SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (k) GROUP BY r
"""


#: CRC-32 of a text's bytes, from a table that its polynomial gives.
CRC_TABLE_SQL = f"""crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS crc FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, (c & 1) * {0xEDB88320})) AS c FROM (SELECT unnest(range(256)) AS n)))"""


def _crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text, where ``crc`` is the table's list."""
    byte_list = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {byte_list}), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"


def _leaf_sql(more: str = "") -> str:
    """A leaf of documents, with more added to n_chars."""
    part = lambda v: f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')"
    return f"sha256({' || '.join(part(f'CAST({c}{more if c == "n_chars" else ""} AS VARCHAR)') for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))})"


#: Levels go up by recursion; a proof's siblings and a tampered leaf's fold go up along them.
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL}, d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS lang, {_leaf_sql()} AS leaf, {_leaf_sql(" + 1")} AS other,
    n_chars IS NOT NULL AND coalesce({_crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS tampered
  FROM documents, crc_table
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), low(level, lang, pos, h, n) AS (
  SELECT 0, lang, pos, leaf, n FROM o
  UNION ALL SELECT level + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY level, lang, pos // 2
), sub AS (
  SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high(level, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM sub
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2
), top AS (
  SELECT h AS root, level AS height FROM high WHERE n = 1
), own AS (
  SELECT r, lang, level, pos >> level AS i FROM (SELECT o.r, o.lang, o.pos, unnest(range(sub.height)) AS level FROM o JOIN sub USING (lang))
), crown AS (
  SELECT r, height, level, pos >> level AS i FROM (SELECT o.r, sub.height, sub.pos, unnest(range(top.height)) AS level FROM o JOIN sub USING (lang) CROSS JOIN top)
), steps AS (
  SELECT own.r, own.level, low.pos > own.i AS is_right, low.h FROM own LEFT JOIN low ON low.level = own.level AND low.lang = own.lang AND low.pos = xor(own.i, 1)
  UNION ALL SELECT crown.r, crown.height + crown.level, high.pos > crown.i, high.h FROM crown LEFT JOIN high ON high.level = crown.level AND high.pos = xor(crown.i, 1)
), walk(r, level, h) AS (
  SELECT r, 0, CASE WHEN tampered THEN other ELSE leaf END FROM o
  UNION ALL SELECT r, walk.level + 1, sha256(CASE WHEN s.h IS NULL THEN walk.h WHEN s.is_right THEN walk.h || s.h ELSE s.h || walk.h END) FROM walk JOIN steps s USING (r, level)
), proofs AS (
  SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256, count(*) AS height FROM steps GROUP BY r
)
SELECT o.doc_id, o.leaf, sub.subroot, top.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, walk.h AS folded_root, walk.h = top.root AS verified
FROM o JOIN sub USING (lang) CROSS JOIN top LEFT JOIN proofs USING (r) JOIN walk ON walk.r = o.r AND walk.level = coalesce(proofs.height, 0)
"""


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op12_sql() -> str:
    """The method in relational steps over the same templates."""
    index = Index(TEMPLATES)
    literal = lambda v: str(v) if isinstance(v, (int, list)) else f"'{v}'"
    values = lambda rows: ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"""
WITH posting(template, word, place) AS (VALUES {values(index.postings())}),
phrase(k, words, template, place) AS (VALUES {values([(k, w, t, p) for k, (w, t, p) in enumerate(index.phrases)])}),
template(template, label, needed) AS (VALUES {values([(i, t.label, len(t.keys)) for i, t in enumerate(TEMPLATES)])}),
base(k, label) AS (VALUES {values(list(enumerate(BASE.values())))}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
occ AS MATERIALIZED (SELECT r, word, p FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d) WHERE word IN {tuple(index.vocabulary)!r}),
starts AS MATERIALIZED (SELECT r, k, template, p, place FROM occ JOIN phrase ON word = words[1] JOIN d USING (r) WHERE list_slice(w, p + 1, p + len(words)) = words),
df AS (SELECT word, count(DISTINCT r) AS df FROM occ GROUP BY word),
weight AS (SELECT template, word, coalesce(df, 0) AS df, ln(1 + (SELECT count(*) FROM d) / greatest(coalesce(df, 0), 1)) AS idf FROM (SELECT DISTINCT template, word FROM posting) LEFT JOIN df USING (word)),
ranks AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY template ORDER BY df, word) AS rank FROM weight),
total AS (SELECT template, sum(idf) AS total FROM ranks WHERE rank <= {RARE} GROUP BY template),
picked AS (SELECT r, template, word, idf FROM (SELECT DISTINCT r, word FROM occ) JOIN ranks USING (word) QUALIFY row_number() OVER (PARTITION BY r, template ORDER BY rank) <= {RARE}),
hit AS (SELECT DISTINCT r, template, word, idf, unnest([f, f + 1]) AS win FROM (SELECT r, template, word, idf, CAST(floor((p - place) / {SLACK}.0) AS BIGINT) AS f FROM occ JOIN picked USING (r, word) JOIN posting USING (template, word))),
cover AS (SELECT r, template, win, sum(idf) AS got FROM hit GROUP BY ALL),
key AS (SELECT r, template, win, count(DISTINCT k) AS n FROM (SELECT r, template, k, unnest([f, f + 1]) AS win FROM (SELECT r, template, k, CAST(floor((p - place) / {SLACK}.0) AS BIGINT) AS f FROM starts WHERE template >= 0)) GROUP BY ALL),
found AS (SELECT r, label, least(round(got / total, {DIGITS}), 1) AS coverage FROM cover JOIN total USING (template) JOIN key USING (r, template, win) JOIN template USING (template) WHERE n = needed),
kept AS (SELECT * FROM found WHERE coverage >= {LEAST}),
b AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM starts JOIN base USING (k) WHERE template < 0 GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM kept UNION ALL SELECT r, label FROM starts JOIN base USING (k) WHERE template < 0) GROUP BY r),
m AS (SELECT r, max(coverage) AS score FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN m USING (r)
"""


OP13_SQL = f"""
WITH {CRC_TABLE_SQL}, d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
i AS MATERIALIZED (SELECT {_words_sql("text")} AS w FROM benchmark),
feature AS MATERIALIZED (SELECT word, {_crc_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM d UNION ALL SELECT w FROM i)), crc_table),
counts AS MATERIALIZED (SELECT r, bucket, count(*) AS c FROM (SELECT r, unnest(w) AS word FROM d) JOIN feature USING (word) GROUP BY ALL),
corpus AS (SELECT bucket, sum(c) AS s FROM counts GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM i) JOIN feature USING (word) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + CAST(1 AS DOUBLE)) * ((SELECT sum(s) FROM corpus) + 10000) / ((s + CAST(1 AS DOUBLE)) * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)))) AS BIGINT) AS gain FROM corpus LEFT JOIN target USING (bucket)),
weights AS (SELECT r, CAST(sum(c) AS BIGINT) AS n_features, CAST(floor(CAST(sum(c * gain) AS DOUBLE) / sum(c)) AS BIGINT) AS weight FROM counts JOIN gains USING (bucket) GROUP BY r),
scores AS (SELECT d.r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM drawn) * 10 // 100 THEN rank END AS rank FROM scores LEFT JOIN drawn USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can say what a query returns."""
    return {"op1_decontamination": OP1_SQL, "op4_line_dedup": OP4_SQL, "op11_merkle_manifest": OP11_SQL, "op12_license_scan": _op12_sql(), "op13_importance_resampling": OP13_SQL}
