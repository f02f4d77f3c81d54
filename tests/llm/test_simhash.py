import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import components as C
from lodestar.llm import simhash as S


def plain(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(bits, radius=3):
    parent = list(range(len(bits)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if bin(bits[i] ^ bits[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(bits))]


def test_fingerprints(docs):
    for text in [None, "", "one", "One two", "a b c", "a b c a b c", *(r["text"] for r in docs.limit(20).collect())]:
        assert S.fingerprint(text.encode() if text is not None else None) == plain(text)


def test_spark_hashes_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=3))
def test_every_pair_within_the_radius_collides(bits):
    change = sum({1 << b for b in bits})
    masks = [m & (2**64 - 1) for m in S.covering_masks(3)]
    assert len(masks) == 15 and any(change & m == 0 for m in masks)


def test_components_equal_brute_force(docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        bits = [plain(r["text"]) for r in rows]
        root = roots(bits)
        least = {}
        for r, k in zip(rows, root, strict=True):
            if r["doc_id"] is not None:
                least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
        want = sorted((str(r["doc_id"]), f"{b:016x}", str(least.get(k))) for r, b, k in zip(rows, bits, root, strict=True))
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in S.near_duplicates(df).collect()) == want


@pytest.mark.parametrize("block", [4096, 8])
def test_links_connect_what_pairs_connect(spark, block):
    random.seed(5)
    centers = [random.getrandbits(64) for _ in range(12)]
    bits = sorted({c ^ sum({1 << random.randrange(64) for _ in range(random.randrange(4))}) for c in centers for _ in range(25)})
    signed = [int(np.uint64(b).view(np.int64)) for b in bits]
    prints = spark.createDataFrame([(b,) for b in signed], "fp long")
    got = {r["node"]: r["root"] for r in C.components(S.fingerprint_links(prints, 3, block)).collect()}
    root = roots(bits)
    groups, want = {}, {}
    for s, k in zip(signed, root, strict=True):
        groups.setdefault(k, []).append(s)
    for members in groups.values():
        for m in members:
            want[m] = min(members)
    assert {s: got.get(s, s) for s in signed} == want


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (2000, 2000), (None, 3)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(80)} == {1000} and got[2000] == 2000
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(empty):
    assert S.near_duplicates(empty).count() == 0


def test_masks_of_parts_cover():
    random.seed(2)
    masks = [m & (2**64 - 1) for m in S.covering_masks(9, 2)]
    assert len(masks) == 62
    for _ in range(3000):
        bits = sum(1 << i for i in random.sample(range(64), 9))
        assert any(not m & bits for m in masks)
