import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import hilbert_sharding as H
from lodestar.llm import quality_rules as Q


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_neighbours_in_turn(dims, bits):
    grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    at = H.hilbert_index(grid, bits)
    assert sorted(at) == list(range(1 << bits * dims))
    path = grid[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, df):
    source = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == source
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(k, [])) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)


def test_shards(docs, odd, empty):
    for df in (docs, odd, docs.limit(3)):
        check_shards(H.hilbert_shards(df).collect(), df)
    assert H.hilbert_shards(empty).count() == 0


def test_written_shards_prune(spark, docs, tmp_path):
    H.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert back.groupBy("shard").agg(F.countDistinct("lang").alias("n")).agg(F.avg("n")).first()[0] < docs.select("lang").distinct().count()


def plain_repeats(words, k=8):
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + k)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
def test_repeats_equal_brute_force(words):
    assert Q.repeated_words(words) == plain_repeats(words)


def test_statistics():
    text = "Ünï # a|b\nsame\n \nsame\nSame <x>"
    assert Q.text_statistics(text.encode()) == (7, len("".join(text.split())), 4, 1, 0)
    assert Q.text_statistics(None) == Q.text_statistics(b"") == (0, 0, 0, 0, 0)


def test_outliers_go_and_the_bulk_stays(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), size=rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(int(rng.integers(40, 200))), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "###$$$" for _ in range(60)), "en", "s") for i in range(20)]
    short = [(2000, "few words", "en", "s"), (2001, "one two three four five six seven eight " * 10, "en", "s")]
    got = {r["doc_id"]: r for r in Q.judged(spark.createDataFrame(rows + junk + short, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(300)) and not any(got[1000 + i]["kept"] for i in range(20))
    assert got[2000]["base_failed"] and got[2001]["base_failed"] and not got[2001]["kept"] and not got[1000]["base_failed"]


def test_outliers_of_every_statistic_go(spark):
    rng = np.random.default_rng(5)
    word = lambda n=None: "".join(rng.choice(list("abcdefghij"), size=n or rng.integers(2, 9)))
    words = lambda n, k=None: [word(k) for _ in range(n)]
    rows = [(i, " ".join(words(int(rng.integers(40, 200)))), "en", "s") for i in range(300)]
    same, passage = " ".join(words(3)), words(27)
    odd = {
        "n_words": " ".join(words(20_000)),
        "word_chars": " ".join(words(100, 12)),
        "n_symbols": " ".join(w + "#" * (i % 2) for i, w in enumerate(words(100))),
        "n_dup_lines": "\n".join(x for _ in range(15) for x in (same, " ".join(words(5)))),
        "n_repeat_words": " ".join([*words(50), *passage, *words(50), *passage, *words(46)]),
    }
    planted = [(1000 + i, text, "en", "s") for i, text in enumerate(odd.values())]
    got = {r["doc_id"]: r for r in Q.judged(spark.createDataFrame(rows + planted, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(300))
    assert {name: (got[1000 + i]["base_failed"], got[1000 + i]["kept"]) for i, name in enumerate(odd)} == dict.fromkeys(odd, (False, False))


def test_small_groups_are_pooled(spark):
    rows = spark.createDataFrame([(f"p{i % 7}", "en" if i % 7 < 6 else None) for i in range(70)], "_pair string, lang string")
    pools = {r["_pair"]: r["_group"] for r in Q._group_keys(rows, "_pair", F.col("lang"), 20).collect()}
    assert {pools[f"p{i}"] for i in range(6)} == {"language en"} and pools["p6"] is None
    assert {r["_group"] for r in Q._group_keys(rows, "_pair", F.col("lang"), 70).collect()} == {"all"}


def mcd(x, starts=60):
    """A plain search: random starts, concentration steps until the determinant stops falling."""
    rng = np.random.default_rng(1)
    h, best = int(np.ceil(Q.SUPPORT * len(x))), None
    for _ in range(starts):
        at = rng.choice(len(x), 6, replace=False)
        last = np.inf
        while True:
            cov = np.cov(x[at].T, bias=True) * Q.CONSISTENCY * 0.999
            cov[range(5), range(5)] = np.maximum(np.diag(cov) / 0.999, np.square(Q.FLOORS))
            det, mean = np.linalg.slogdet(cov)[1], x[at].mean(axis=0)
            if len(at) == h and det >= last - 1e-9:
                break
            last = det if len(at) == h else np.inf
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            at = np.argsort(d, kind="stable")[:h]
        if best is None or det < best[0]:
            best = det, mean, cov
    _, mean, cov = best
    d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
    return d / max(np.median(d) / Q.CHI2_MEDIAN, 1.0)


def test_estimates_reject_what_a_plain_search_rejects(spark):
    rng = np.random.default_rng(2)
    tables = {}
    for g, bad in (("a", 0), ("b", 80), ("c", 240)):
        mixed = rng.normal(0, 1, (1000 - bad, 5)) @ np.array([[1.0, 0.5, 0, 0, 0], [0, 0.8, 0.2, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0.3, 0.1, 0], [0, 0, 0, 0, 0.2]]) + 3
        tables[g] = np.concatenate([mixed, rng.normal(0, 0.3, (bad, 5)) + rng.choice([9, -4], (bad, 1))])
    rows = [(g, *map(float, x)) for g, xs in tables.items() for x in xs]
    vectors = spark.createDataFrame(rows, "k string, " + ", ".join(f"x{i} double" for i in range(5)))
    estimates = {r["k"]: r for r in Q.estimate(vectors, "k").collect()}
    for g, xs in tables.items():
        e, d = estimates[g], xs - [estimates[g][f"m{i}"] for i in range(5)]
        inverse = np.array([[e[f"v{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
        got, want = np.einsum("ni,ij,nj->n", d, inverse, d) / e["scale"], mcd(xs)
        assert ((got > Q.CUTOFF) != (want > Q.CUTOFF)).mean() <= 0.005
        assert (got > Q.CUTOFF)[len(xs) - {"a": 0, "b": 80, "c": 240}[g] :].all()


def test_chi_square():
    assert abs(Q.chi_square(Q.CHI2_MEDIAN, 5) - 0.5) < 1e-4 and abs(1 - Q.chi_square(Q.CUTOFF, 5) - 1e-6) < 1e-7


def test_kept_without_few(docs, monkeypatch):
    few = sorted(r["doc_id"] for r in Q.keep_good(docs).collect())
    monkeypatch.setattr(Q, "FEW_ROWS", 0)
    assert sorted(r["doc_id"] for r in Q.keep_good(docs).collect()) == few == sorted(r["doc_id"] for r in Q.judged(docs).where("kept").collect())


def test_odd_rows(odd, empty):
    got = Q.judged(odd)
    assert got.count() == odd.count() and got.where("doc_id = 1").first()["base_failed"]
    assert Q.judged(empty).count() == 0
    out = Q.keep_good(odd)
    assert out.columns == odd.columns and out.count() == Q.judged(odd).where("kept").count()
    assert Q.keep_good(empty).count() == 0


def test_pipeline_equals_its_stages_in_plain_python(spark, sf, docs):
    import corpus_pipeline
    from test_decontamination import brute
    from test_near_copies import alike, shingles
    from test_tokens import check_packing

    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = {r["doc_id"] for r in Q.judged(docs).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for t in texts.values():
        for k in {key(x) for x in t.split("\n")}:
            held[k] = held.get(k, 0) + 1
    texts = {i: "\n".join(x for x in t.split("\n") if not key(x) or held[key(x)] < 10) for i, t in texts.items()}
    lined, stays = texts, {}
    for i in sorted(texts):  # the first of near copies
        own = shingles(texts[i])
        if not any(alike(own, s) for s in stays.values()):
            stays[i] = own
    texts = {i: texts[i] for i in stays}
    hits = {i: brute(t, items, 13) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    rows = corpus_pipeline.run(spark, sf).collect()
    got = {r["doc_id"] for r in rows}
    assert len(got.symmetric_difference(texts)) <= 0.01 * len(texts)  # fingerprints find nearly all near copies
    check_packing(spark.createDataFrame([(i, lined[i]) for i in got], "doc_id long, text string"), rows)


def test_stages_keep_columns(spark, sf, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
