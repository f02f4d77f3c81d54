import collections
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import suffix_tree_lm as M
from lodestar.llm.common import LOWER


def tree(texts, depth, least, gain):
    """The whole method in plain Python: the root's distribution, those of the nodes by context, and counts."""
    uni = collections.Counter(w for t in texts for w in t)
    total, distinct = sum(uni.values()), len(uni)
    root = lambda w: (uni[w] + 1) / (total + distinct + 1)

    def fit(counts, parent):
        n, kept = sum(counts.values()), {w: c for w, c in counts.items() if c >= least}
        if not kept:
            return None
        q = {w: parent(w) for w in kept}
        rest = n - sum(kept.values())
        g = sum(c * math.log(c / n / q[w]) for w, c in kept.items()) + (rest * math.log(rest / n / max(1 - sum(q.values()), 1e-12)) if rest else 0)
        if g < gain * len(kept):
            return None
        lam = (rest + M.DISCOUNT * len(kept)) / n
        return lambda w: (kept[w] - M.DISCOUNT) / n + lam * q[w] if w in kept else lam * parent(w)

    nodes, tried = {(): root}, {()}
    for d in range(1, depth + 1):
        next_ = collections.defaultdict(collections.Counter)
        for t in texts:
            for i in range(d, len(t)):
                next_[tuple(t[i - d : i])][t[i]] += 1
        now = {c: n for c, n in next_.items() if sum(n.values()) >= least and c[:-1] in tried and c[1:] in nodes}
        nodes |= {c: f for c, n in now.items() if (f := fit(n, nodes[c[1:]]))}
        tried = set(now)
    return nodes, uni, total


def longest(nodes, past, depth):
    """The distribution of the longest suffix of the past that is a node."""
    for d in range(1, min(depth, len(past)) + 1):
        if tuple(past[-d:]) not in nodes:
            return nodes[tuple(past[len(past) - d + 1 :])]
    return nodes[tuple(past[len(past) - min(depth, len(past)) :])]


@pytest.mark.parametrize(
    "depth,least,gain,limits",
    [(4, 2, 0.5, {}), (4, 2, 0.5, {"head": 50, "often": 20, "filter_words": 64, "model_head": 100, "piece": 40}), (2, 4, 1.0, {"often": 1}), (M.DEPTH, M.LEAST, M.GAIN, {"model_head": 30})],
)
def test_scores_equal_brute_force(docs, depth, least, gain, limits):
    rows = docs.select("doc_id", "text").collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    tokens = [[*r["text"].encode().translate(LOWER).split(), b"\n"] for r in rows]
    nodes, uni, total = tree([t for t, h in zip(tokens, held, strict=True) if not h], depth, least, gain)
    assert max(map(len, nodes)) >= min(depth, 3)
    limits = dict(limits)
    filter_words = limits.get("filter_words", M.FILTER_WORDS)
    model_head, piece = limits.pop("model_head", M.MODEL_HEAD), limits.pop("piece", M.PIECE_KEYS)
    made = M.train(docs.where(~M.is_held_out(F.col("doc_id"))), depth, least, gain, **limits)
    assert made.model.where("depth = 1").count() > 0 and made.model.count() >= len(nodes) - 1
    got = {r["doc_id"]: r for r in M.score(docs, made, model_head, filter_words, piece).collect()}
    for r, t, h in zip(rows, tokens, held, strict=True):
        g = got[r["doc_id"]]
        assert g["held_out"] == h and g["n_tokens"] == len(t) and g["n_known"] == sum(uni[w] > 0 for w in t) and g["train_tokens"] == total
        assert abs(g["base_score"] - sum(math.log10(nodes[()](w)) for w in t)) < 1e-6
        assert abs(g["score"] - sum(math.log10(longest(nodes, t[max(0, i - depth) : i], depth)(w)) for i, w in enumerate(t))) < 1e-3


def test_many_reducers_count_the_same(docs, monkeypatch):
    pairs = lambda t, c: (np.zeros(len(t), dtype=np.uint64), t)
    blocks = sorted(map(tuple, M.counted(docs, pairs, 5, 2).collect()))
    monkeypatch.setattr(M, "REDUCERS", 4)
    assert sorted(map(tuple, M.counted(docs, pairs, 5, 2).collect())) == blocks and blocks


class Steps:
    """Takes a DataFrame's place and keeps the functions that are given to it."""

    def __init__(self):
        self.functions = []

    def __getattr__(self, name):
        return lambda *args: (self.functions.extend(a for a in args if callable(a)), self)[1]


def test_a_task_that_counts_sends_small_batches_and_holds_little():
    words = np.random.default_rng(1).integers(0, 1 << 40, size=(48, 25_000))
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, w)) for w in words.tolist()])], names=["text"])
    steps = Steps()
    M.counted(steps, lambda t, c: (t, t + np.uint64(1)), 200, 1)
    send, _ = steps.functions
    sent, largest = 0, 0
    tracemalloc.start()
    for batch in send(iter([texts])):
        sent += sum(len(x) for x in batch.column(3).to_pylist()) // 4
        largest = max(largest, batch.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == len(np.unique(words)) + 2  # ends once in each of two flushes
    assert largest < 4 << 20 and peak < 90 << 20


def test_blocks_hold_each_key_once_in_small_batches():
    keys = np.random.default_rng(1).integers(0, 2**63, size=1 << 18, dtype=np.uint64) * np.uint64(2)
    schema = pa.schema([(c, t) for c, t in (("r", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("numbers", pa.binary()))])
    got = list(M._blocks(1, 7, 6, schema, keys, np.arange(1 << 18, dtype=np.uint32), np.ones(1 << 18, dtype=np.uint32)))
    assert 1 < len(got) <= 4 and sum(b.num_rows for b in got) == 64 and max(b.nbytes for b in got) < 2 << 20
    for b in got:
        for r, k, o in zip(*(b.column(c).to_pylist() for c in ("r", "keys", "owners")), strict=True):
            at = np.frombuffer(o, dtype=np.uint32)
            assert (np.frombuffer(k, dtype=np.uint64) == keys[at]).all() and (keys[at] >> np.uint64(58) == r).all()


def test_table_and_filter():
    keys = np.random.default_rng(1).integers(0, 2**63, size=5000, dtype=np.uint64) * np.uint64(2)
    table = M.Table(keys[:3000], np.arange(3000))
    at, there = table.find(keys)
    assert there[:3000].all() and not there[3000:].any() and (table.values[at[:3000]] == np.arange(3000)).all()
    assert not M.Table(keys[:0], np.arange(0)).find(keys)[1].any()
    words = np.zeros(1 << 10, dtype=np.uint64)
    np.bitwise_or.at(words, *M.KeyFilter.places(keys[:3000], np.uint64(54)))
    assert M.KeyFilter(words).has(keys[:3000]).all() and M.KeyFilter(words).has(keys[3000:]).mean() < 0.1


def test_distribution_sums_to_one(docs):
    texts = [[*r["text"].encode().translate(LOWER).split(), b"\n"] for r in docs.collect()]
    nodes, uni, _ = tree(texts, 3, 2, 0.5)
    for c in [(), *(next(c for c in nodes if len(c) == d) for d in (1, 2, 3))]:
        assert abs(sum(nodes[c](w) for w in uni) + nodes[c](b"never seen") - 1) < 1e-9


def test_it_predicts_held_out_texts_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = M.suffix_tree_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_odd_rows(odd, empty):
    got = M.suffix_tree_scores(odd)
    assert got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["n_tokens"] == 1 and by[4]["n_tokens"] == 60001 and by[2]["score"] == by[2]["base_score"]
    assert M.suffix_tree_scores(empty).count() == 0
    made = M.train(empty)
    assert {r["n_known"] for r in M.score(odd, made).collect()} == {0}


def test_word_hashes_tell_words_apart():
    words = sorted({b"w" * n for n in range(1, 200)} | {b"a" * n + b"b" for n in range(200)} | {str(i).encode() for i in range(20000)} | {"é漢".encode() * n for n in range(1, 40)})
    at, h = M.word_hashes(b" \t".join(words) + b"\n")
    assert len(set(h.tolist())) == len(words) == len(at)
    assert all(M.word_hashes(w + b"\x0b")[1][0] == x for w, x in list(zip(words, h, strict=True))[::97])
    assert not len(M.word_hashes(b"\r\n")[0])


def test_tokens_and_contexts():
    t, n = M.tokens_of([b"A b", None, b""])
    assert n.tolist() == [3, 1, 1] and (t[[2, 3, 4]] == M.END).all()
    (one, first), (two, second) = M.keys_of(t, n, 2)
    assert first.tolist() == [False, True, True, False, False] and second.tolist() == [False, False, True, False, False]
    assert one[2] == t[1] and two[2] == M.mix(t[:1], t[1:2])[0]
    assert np.unique(M.mix(np.arange(100, dtype=np.uint64).repeat(100), np.tile(np.arange(100, dtype=np.uint64), 100))).size == 10000
