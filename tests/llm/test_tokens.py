import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import best_fit_packing as P
from lodestar.llm import byte_bpe as B
from lodestar.llm import token_counts as C
from lodestar.llm import token_matrix as M


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=C.default_model())


def test_counts_equal_the_library(docs, odd, empty, piece):
    for df in (docs, odd):
        want = sorted((r["doc_id"] or -1, len(piece.encode(r["text"] or ""))) for r in df.collect())
        got = C.token_counts(df).collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert C.token_counts(empty).count() == 0
    assert sorted(r["n_bytes"] for r in C.token_counts(odd).where("text is null" if False else "n_bytes = 0").collect()) == [0, 0, 0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é▁ \n\t<>/s　", max_size=60))
def test_split_pieces_count_the_same(text):
    model, safe = C.sentencepiece_model(C.default_model())
    assert safe
    assert C.count_tokens([text], C.default_model(), piece_chars=3) == [len(model.encode(text))]


def test_ids_equal_the_json_library_over_every_code_point():
    tk, ranks, json = B.exact(B.default_json()), B.default_ranks(), B.default_json()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} b{chr(c)}.  {chr(c)}" for c in points[at : at + 50_000]]
        for t, e in zip(texts, tk.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert B.ranked(ranks).encode(t, allowed_special="all") == e.ids
    for t in ("x <|endoftext|>y", " " * 9000 + "x", "a" * 3000, "", None):
        assert B.encode(t, ranks, json).tolist() == (tk.encode(t, add_special_tokens=False).ids if t else [])


def odd_texts(n, seed):
    """Mixtures of words, blanks, marks, special strings, scripts and long runs."""
    import random

    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "\t\t", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "[MASK]", "naïve", "漢字", "😀", "e\u0301", "\u200b", "\ufeff", "\u00a0", "don't", "1234567", "3.14", "ＦＵＬＬ", "a" * 40, "-" * 30, "é" * 20, "\x00", "\r\n", "ﬁ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_odd_mixtures_count_and_encode_as_the_libraries_do():
    texts = odd_texts(3000, 11)
    model, _ = C.sentencepiece_model(C.default_model())
    assert C.count_tokens(texts, C.default_model(), piece_chars=20) == [len(x) for x in model.encode(texts)]
    ranks, json = B.default_ranks(), B.default_json()
    tk = B.exact(json)
    for t, e in zip(texts, tk.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert B.encode(t, ranks, json).tolist() == e.ids


def test_matrix_of_other_ids(spark):
    rows = M.packed_ids(spark.createDataFrame([("a", "x y"), (None, "z")], "doc_id string, text string")).collect()
    assert sorted(map(str, (d for r in rows for d in r["doc_ids"]))) == ["None", "a"]


def ids_of(df, end):
    tk = B.exact(B.default_json())
    return sorted(([*tk.encode(r["text"] or "", add_special_tokens=False).ids, end] for r in df.collect()), key=str)


def test_matrix_round_trip(docs, odd, empty):
    for df in (docs, odd):
        rows = M.packed_ids(df.repartition(3), window_tokens=50_000).collect()
        grid, parts = M.matrix([r["ids"] for r in rows]), []
        for r, line in zip(rows, grid, strict=True):
            cu = r["cu_seqlens"]
            assert cu[-1] == r["n_tokens"] <= 2048 and r["position_resets"] == cu[:-1] and (line[cu[-1] :] == B.END_ID).all()
            assert M.position_ids(cu)[cu[:-1]].sum() == 0
            parts += [(d, s, line[a:b].tolist()) for d, s, a, b in zip(r["doc_ids"], r["starts"], cu, cu[1:], strict=False)]
        assert len({r["sequence_id"] for r in rows}) == len(rows)
        want = ids_of(df, B.END_ID)
        assert sum(len(p[2]) for p in parts) == sum(map(len, want))
        unique = [r for r in df.collect() if r["doc_id"] is not None and r["doc_id"] != 6]
        for r in unique:
            mine = [x for d, _, p in sorted((x for x in parts if x[0] == r["doc_id"]), key=lambda x: x[1]) for x in p]
            assert mine[:-1] == B.encode(r["text"], B.default_ranks(), B.default_json()).tolist() and mine[-1] == B.END_ID
    assert M.packed_ids(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_both_best_fits_agree(sizes):
    fall = sorted(sizes, reverse=True)
    tree, bits = M.best_fit_decreasing(fall, 20), P.best_fit(fall, 20)
    for bins in (tree, bits):
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(fall[i] for i in b) <= 20 for b in bins)
    assert sorted(sum(fall[i] for i in b) for b in tree) == sorted(sum(fall[i] for i in b) for b in bits)


def check_packing(df, rows, width=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= width
    for r in df.collect():
        if r["doc_id"] is None or r["doc_id"] == 6:
            continue
        ids = np.append(B.encode(r["text"], B.default_ranks(), B.default_json()), 0).astype("<u4")
        own = sorted(by_doc[r["doc_id"]], key=lambda p: p["piece"])
        assert [p["piece"] for p in own] == list(range(len(own))) and sum(p["length"] for p in own) == len(ids)
        assert all(p["length"] == width for p in own[1:]) and (len(own) == 1 or len(ids) > width)
        at = 0
        for p in own:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
    return len(by_seq)


def test_packing(docs, odd, empty):
    for df in (docs.repartition(5), odd):
        rows = P.best_fit_packing(df).collect()
        n = check_packing(df, rows)
        assert n <= sum(r["length"] for r in rows) / 2048 * 1.02 + 1
    assert P.best_fit_packing(empty).count() == 0


def test_rounds_stay_spread_out(spark):
    from pyspark.sql import functions as F

    pieces = spark.range(3000, numPartitions=24).select(F.col("id").alias("uid"), (F.pmod(F.xxhash64("id"), F.lit(60)) + 41).alias("length"))
    out = P.pack(pieces, width=100, slack=0, fan_in=2, task_items=50).join(pieces, "uid").collect()
    assert len({r["uid"] for r in out}) == 3000
    fill = {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 100
