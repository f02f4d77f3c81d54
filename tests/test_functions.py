"""Column functions against examples and plain Python."""

import hashlib
import math
import re
import struct
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import ids, paths, secrets
from lodestar.functions import text as tx
from lodestar.functions import vectors as vx


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def many(spark, make, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", make(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_tokenize_splits_identifiers(spark):
    got = many(spark, tx.tokenize, ["getUserById", "parse_http_response", "JWTService v2", "HTTPServer2Go", "é", "x"])
    assert got == [["get", "user", "by", "id"], ["parse", "http", "response"], ["jwt", "service", "2"], ["http", "server", "2", "go"], ["é"], ["x"]]


def test_tokenize_equals_python(spark):
    word = re.compile(r"[a-zA-Z][a-z]+|[A-Z]+(?=[A-Z][a-z]|[0-9]|\b)|[A-Z][a-z]*|[0-9]+")

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet="abXYZ09 _/.-éÉ\n,", min_size=1, max_size=24), min_size=40, max_size=40))
    def check(texts):
        want = [[t.lower() for p in re.split(r"[\s_/.\-]+", x) for t in word.findall(p)] or [x.lower()] for x in texts]
        assert many(spark, tx.tokenize, texts) == want

    check()


def test_exact_symbol_precedence(spark):
    got = many(spark, tx.exact_symbol, ["see `a.b` or \"c\"", 'see "c" or D.e', "call Auth.login now", "the OrderService class", "JWTS nothing", "find it"])
    assert got == ["a.b", "c", "Auth.login", "OrderService", None, None]


def test_intent_and_confidence(spark):
    q = spark.createDataFrame([("Where is login defined?",), ("Trace the flow from a to b",), ("what breaks if i change x",), ("hello",)], "x string")
    name, sure = tx.intent(F.col("x"))
    got = [(r[0], round(r[1], 2)) for r in q.select(name, sure).collect()]
    assert got == [("LOCATION", 0.6), ("FLOW", 0.95), ("IMPACT", 0.8), ("GENERAL_CODEBASE_QA", 0.4)]


def test_terms_and_expansion(spark):
    assert one(spark, tx.search_terms(F.lit("Where is the `pay_all` function for user User user"))) == ["pay_all", "user", "User"]
    terms = one(spark, tx.expanded_terms(F.lit("login now"), tx.search_terms(F.lit("login now"))))
    assert terms[:3] == ["login", "now", "authenticate"] and terms[-1] == "login now"


def test_hash_embedding(spark):
    def plain(text):
        d = hashlib.sha256(text.encode()).digest()
        raw = [n for s in range(48) for n in struct.unpack(">8i", hashlib.sha256(d + s.to_bytes(4, "big")).digest())]
        size = math.sqrt(sum(n * n for n in raw))
        return [n / size for n in raw]

    for text, got in zip(["", "abc", "größe"], many(spark, vx.hash_embedding, ["", "abc", "größe"]), strict=True):
        assert len(got) == 384 and max(abs(a - b) for a, b in zip(got, plain(text), strict=True)) < 1e-12


def test_uuid5_equals_python(spark):
    assert many(spark, ids.uuid5, ["r|a.py|class|A|1|2", "ü"]) == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("r|a.py|class|A|1|2", "ü")]


def test_path_rules(spark):
    at = ["node_modules/a.js", "src/__pycache__/x.pyc", "dist/a", "src/app.py", "README.md", "package.json", "a/logo.png", "yarn.lock", "a/x.lock", ".env", ".secret", ".gitignore", "", "src/latest.py"]
    assert many(spark, paths.is_ignored, at) == [True, True, True, False, False, False, True, False, True, False, True, False, True, False]
    assert many(spark, paths.language, ["a.py", "b.TS", "c.java", "d.md", "e"]) == ["python", "typescript", "java", None, None]
    assert many(spark, paths.classification, [".env", "tests/x.py", "src/a.py", "a/pyproject.toml", "README.md", "k.pem", "a.bin", "latest.py"]) == ["secret", "test", "source", "config", "documentation", "secret", "other", "test"]
    assert many(spark, paths.safe_member, ["a/b.py", "../x", "/abs", "a/../b", "C:/x", "a..b"]) == [True, False, False, False, False, True]


def test_urls(spark):
    at = ["https://github.com/a/b/", "http://github.com/a/b", "http://other.org/a", "https://other.org/a", "https://u:p@github.com/a", "ftp://github.com/a", "https://github.com"]
    assert many(spark, paths.valid_url, at) == ["https://github.com/a/b", "http://github.com/a/b", None, "https://other.org/a", None, None, None]
    assert many(spark, paths.repository_name, ["https://github.com/a/b.git", "https://x.org/y/"]) == ["b", "y"]
    assert many(spark, lambda u: paths.github_archive(u, F.lit("dev")), ["https://github.com/a/b.git", "https://x.org/a/b"]) == ["https://github.com/a/b/archive/refs/heads/dev.zip", None]


def test_secrets(spark):
    text = 'api_key = "abcd1234efgh5678"\nAKIA' + "A" * 16 + "\n-----BEGIN RSA PRIVATE KEY-----"
    assert one(spark, secrets.secret_count(F.lit(text))) == 3
    assert one(spark, secrets.secret_count(F.lit("def add(a, b): return a + b"))) == 0
    out = one(spark, secrets.redacted(F.lit(text)))
    assert "abcd1234" not in out and secrets.MARKER in out


def test_cosine_of_zero_vector(spark):
    assert one(spark, vx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_settings_from_file_and_environment(tmp_path):
    import json

    import pytest

    from lodestar.config import EngineConfig

    (tmp_path / "s.json").write_text(json.dumps({"rrf_k": 10, "bm25_b": 0.5}))
    got = EngineConfig.load(str(tmp_path / "s.json"), {"LODESTAR_RRF_K": "20", "LODESTAR_INDEX_NON_SOURCE": "no", "HOME": "/"})
    assert (got.rrf_k, got.bm25_b, got.index_non_source, got.dense_top_k) == (20, 0.5, False, 20)
    with pytest.raises(ValueError):
        EngineConfig.load(None, {"LODESTAR_NOTHING": "1"})
