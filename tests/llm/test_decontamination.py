import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from compare import same, tables
from lodestar.llm import decontamination as D
from lodestar.llm.queries import op1_decontamination, oracle_sql

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, n):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(n, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(name)
    return len(w), len(hit), found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_automaton_equals_brute_force(items, text, window):
    named = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    machine = D.ItemAutomaton([(n, t.encode()) for n, t in named], window)
    spans, found = machine.stream(D.fold(" ".join(text).encode()).split())
    _, hit, want = brute(" ".join(text), named, window)
    assert sum(e - s for s, e in spans) == hit and found == want
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_query_equals_sql(spark, sf):
    same(op1_decontamination(spark, sf), tables(sf), oracle_sql()["op1_decontamination"])


def test_blocks_give_the_same(spark, sf, docs, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, D.contamination(docs, items).collect()))
    assert sorted(map(tuple, D.contamination(docs, items, block_bytes=1500).collect())) == one
    monkeypatch.setattr(D, "FEW_NUMBERS", -1)
    assert sorted(map(tuple, D.contamination(docs, items, block_bytes=1500).collect())) == one
    plan = D.contamination(docs, items, block_bytes=1500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # no block's automaton is in another's action


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "same text"), (2, None), (3, ""), (None, "漢字"), (1, "same text"), (4, " ".join(["word"] * 20))], "item_id long, text string")
    got = D.contamination(odd, items)
    assert got.count() == odd.count()
    by = {r["doc_id"]: r.asDict() for r in got.collect()}
    assert by[1]["n_words"] == 0 and by[1]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not by[1]["contaminated"]
    assert (by[6]["n_words"], by[6]["n_hit"], by[6]["contaminated"]) == (4, 2, True)
    assert by[4]["n_hit"] == 60000 and by[8]["n_items"] == 1
    assert D.contamination(empty, items).count() == 0
    assert D.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0


def test_removal(spark, odd):
    random.seed(3)
    filler = " ".join(f"w{random.randrange(10**6)}" for _ in range(100))
    docs = spark.createDataFrame([(1, f"{filler} Alpha, beta gamma! {filler}", 7), (2, "alpha beta gamma", 7), (3, filler, 7)], "doc_id long, text string, N_WORDS int")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items).collect()}
    assert set(kept) == {1, 3} and kept[1] == f"{filler} Alpha, beta gamma! {filler}"
    cut = D.decontaminate(docs, items, max_span=3)
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()}[1] == f"{filler} ! {filler}"
    assert D.decontaminate(odd, items).count() == odd.count()
