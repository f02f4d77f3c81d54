import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import same, tables
from lodestar.llm import importance as I
from lodestar.llm.queries import op13_importance_resampling, oracle_sql

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def features(text, run):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)]


def drawn(docs, target, buckets=10_000, run=1, seed=2024, per_cent=10, least=20):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, run):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(r["text"] for r in docs), counts(target)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (sum(s) + buckets) / ((float(s[b]) + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for r in docs:
        f = features(r["text"], run)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        rows.append([r["doc_id"], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(r["text"]))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: per_cent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_sql_and_plain_python(spark, sf, docs):
    same(op13_importance_resampling(spark, sf), tables(sf), oracle_sql()["op13_importance_resampling"])
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = drawn([r.asDict() for r in docs.collect()], target)
    assert rows(op13_importance_resampling(spark, sf)) == want
    assert sum(r[4] is not None for r in want) > 10


def test_longer_runs_fewer_buckets_and_odd_rows(spark, odd):
    target = spark.createDataFrame([("same text twice",), (None,), ("word x",)], "text string")
    got = rows(I.resampled(odd, target, per_cent=60, least_words=2, buckets=97, run=3, seed=7))
    assert got == drawn([r.asDict() for r in odd.collect()], ["same text twice", None, "word x"], 97, 3, 7, 60, 2)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert I.resampled(empty, none).count() == 0
    assert rows(I.resampled(docs, none)) == drawn([r.asDict() for r in docs.collect()], [])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", "B b", "ü", "x1", "-", "\n"]), max_size=30), st.integers(1, 4), st.integers(1, 9))
def test_pieces_count_like_the_whole(parts, run, piece):
    text = " ".join(parts)
    n, found = I.bucket_counts(text.encode(), 1000, run, piece)
    want = {}
    for f in features(text, run):
        b = zlib.crc32(f.encode()) % 1000
        want[b] = want.get(b, 0) + 1
    assert (n, found) == (len(words(text)), want)


def test_matrix_has_the_counts(docs):
    m = I.CountMatrix.of(docs, "doc_id", "text", 50)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    total = np.zeros(50, dtype=int)
    for b in m.blocks.collect():
        assert b["starts"][-1] == len(b["buckets"]) == len(b["counts"]) and len(b["starts"]) == len(b["ids"]) + 1
        for i, doc_id in enumerate(b["ids"]):
            at = slice(b["starts"][i], b["starts"][i + 1])
            own = dict(zip(b["buckets"][at], b["counts"][at], strict=True))
            assert own == I.bucket_counts((texts.pop(doc_id) or "").encode(), 50)[1]
            for k, v in own.items():
                total[k] += v
    assert not texts and (m.column_sums() == total).all()


def test_drawn_documents_are_nearer_to_the_target(spark):
    rows_ = [(i, " ".join(["apple pear plum"] * 10 if i % 2 else ["iron zinc lead"] * 10)) for i in range(400)]
    target = spark.createDataFrame([("apple pear",), ("plum apple",)] * 500, "text string")
    got = I.resampled(spark.createDataFrame(rows_, "doc_id long, text string"), target, buckets=64).where("rank is not null").collect()
    assert len(got) == 40 and all(r["doc_id"] % 2 for r in got)
