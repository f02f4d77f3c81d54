import random

import numpy as np
import pytest

from lodestar.llm import near_copies as N


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "_").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def copies(spark):
    """Originals of their own words, each with copies of more and more edits, a large group, and exact copies."""
    rng = random.Random(3)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 400))]
        rows += [" ".join(edited(base, n, rng)) for n in (0, 0, 1, 1, 2, 3, 5, 8, 60)]
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows += [" ".join(edited(base, 2, rng)) for _ in range(150)] + [" ".join(base).upper()] * 20
    order = list(range(len(rows)))
    rng.shuffle(order)
    return {i: rows[k] for i, k in enumerate(order)}


def test_who_stays_and_who_goes(spark, copies, monkeypatch):
    docs = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in copies.items()}
    kept = {r["doc_id"] for r in N.keep_one(docs).collect()}
    for i in set(sets) - kept:  # nothing goes but for a near copy that stays
        assert any(alike(sets[i], sets[j]) for j in kept)
    both = [(i, j) for i in kept for j in kept if i < j and alike(sets[i], sets[j])]
    pairs = sum(alike(sets[i], sets[j]) for i in sets for j in sets if i < j)
    assert pairs > 10000 and len(both) <= 0.01 * len(kept)
    greedy = []
    for i in sorted(sets):
        if not any(alike(sets[i], sets[j]) for j in greedy):
            greedy.append(i)
    assert len(kept.symmetric_difference(greedy)) <= 0.02 * len(greedy)
    monkeypatch.setattr(N, "PART_ROWS", 7)
    monkeypatch.setattr(N, "LEADERS", 1)
    monkeypatch.setattr(N, "MOST_LEADERS", 2)
    monkeypatch.setattr(N, "FEW", 3)
    monkeypatch.setattr(N, "FEW_SHINGLES", 500)
    assert {r["doc_id"] for r in N.keep_one(docs, block=16).collect()} == kept


def test_tables_of_the_driver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: shingles(r["text"]) for r in docs.select("doc_id", "text").collect()}
    kept = {r["doc_id"] for r in N.keep_one(docs).collect()}
    by = {}
    for i in sorted(rows):
        for s in rows[i]:
            by.setdefault(s, []).append(i)
    seen = {(a, b) for ids in by.values() for a in ids[:40] for b in ids[:40] if a < b}
    near = {p for p in seen if alike(rows[p[0]], rows[p[1]])}
    for i in set(rows) - kept:
        assert any(alike(rows[i], rows[j]) for j in kept if j < i)
    assert sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)


def test_odd_rows(spark, odd, empty):
    out = N.keep_one(odd)
    got = out.collect()
    assert out.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in got)
    assert ids == ["1", "4", "5", "6", "8", "9", "None"]  # 1 stands for all without words, 6 for its copies
    assert N.keep_one(empty).count() == 0


def test_shingles():
    assert len(N.shingle_set(b"a b c")) == 1 and len(N.shingle_set(b"a B c d e f")) == 2 and len(N.shingle_set(None)) == 0
    assert (N.shingle_set(b"A b  c d e f") == N.shingle_set(b"a b c d\ne f")).all()
    assert N.prints_of(b" \n") == (0, 0, 0) and N.prints_of(b"A b") == N.prints_of(b"a  b")
    assert np.array_equal(N._windows([b"a", b"b"], 5), N._windows([b"a", b"b"], 3))
