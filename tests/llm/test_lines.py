import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import same, tables
from lodestar.llm import line_dedup as L
from lodestar.llm.queries import op4_line_dedup, oracle_sql


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 10**9), min_size=1, max_size=400), st.data())
def test_cuckoo_filter_never_loses_a_key(numbers, data):
    keys = [hashlib.md5(str(n).encode()).digest() for n in sorted(numbers)]
    f = L.CuckooFilter.of(L.halves(keys))
    gone = set(data.draw(st.lists(st.sampled_from(keys), unique=True)))
    if gone:
        f.delete(L.halves(sorted(gone)))
    left = [k for k in keys if k not in gone]
    if left:
        assert L.CuckooFilter.from_bytes(f.to_bytes()).contains(L.halves(left)).all()
    assert (f.table != 0).sum() == len(left)


def test_full_filter_says_so():
    f = L.CuckooFilter(4)
    assert not f.insert(L.halves([hashlib.md5(str(n).encode()).digest() for n in range(64)]))


def test_few_false_positives():
    key = lambda n: hashlib.md5(str(n).encode()).digest()
    f = L.CuckooFilter(2000)
    f.insert(L.halves([key(n) for n in range(2000)]))
    assert np.mean(f.contains(L.halves([key(n) for n in range(5000, 25000)]))) < 0.001


def test_query_equals_sql(spark, sf):
    same(op4_line_dedup(spark, sf), tables(sf), oracle_sql()["op4_line_dedup"])


def kept(df):
    return sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect())


def test_without_filters_the_same(docs):
    index = L.LineIndex.build(docs, threshold=3)
    filters = index.broadcast_filters()
    assert L.common_lines(docs, index, None).count() == L.common_lines(docs, index, filters).count() > 0
    size = index.filters.agg({"data": "max"}).count() and len(index.filters.first()["data"])
    rows = []
    for bound in (L.BROADCAST_BYTES, size, -1):  # all broadcast, filters alone, nothing
        out, names = L._cut(docs.select("doc_id", "text"), index, bound)
        rows.append(sorted(map(tuple, out.select("doc_id", *names).collect())))
    assert rows[0] == rows[1] == rows[2] and any(r[2] for r in rows[0])
    assert index.broadcast_common(size) is None or index.common().count() * 16 <= size


def test_narrow_cut_moves_no_text(docs):
    plan = L._cut(docs.select("doc_id", "text"), L.LineIndex.build(docs, threshold=3))[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_insertions_and_deletions_can_be_undone(docs):
    a, b = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    whole, part = L.LineIndex.build(docs, threshold=3), L.LineIndex.build(a, threshold=3, shard_keys=4)
    grown = part.inserted(b)
    back = grown.deleted(b)
    for x, y in ((grown, whole), (back, part)):
        assert sorted(map(tuple, x.counts.collect())) == sorted(map(tuple, y.counts.collect()))
        assert kept(L.line_dedup(docs, x)) == kept(L.line_dedup(docs, y))
    assert back.filters.agg({"keys": "sum"}).first()[0] == part.filters.agg({"keys": "sum"}).first()[0]
    nothing = part.deleted(a)
    assert nothing.counts.count() == 0 and L.line_dedup(docs, nothing).where("n_dropped > 0").count() == 0


def test_saved_index_goes_on(spark, docs, tmp_path):
    part = L.LineIndex.build(docs.where("doc_id % 3 <> 0"), threshold=3, shard_keys=4)
    part.save(str(tmp_path / "index"))
    loaded = L.LineIndex.load(spark, str(tmp_path / "index"))
    assert (loaded.shards, loaded.threshold, loaded.min_chars, loaded.shard_keys) == (part.shards, 3, part.min_chars, 4)
    b = docs.where("doc_id % 3 = 0")
    assert kept(L.line_dedup(docs, loaded.inserted(b))) == kept(L.line_dedup(docs, L.LineIndex.build(docs, threshold=3)))


def test_what_was_never_inserted_is_not_deleted(spark, docs):
    index = L.LineIndex.build(docs.limit(0), threshold=2)
    with pytest.raises(ValueError):
        index.deleted(docs)


def test_odd_rows(spark, odd, empty):
    index = L.LineIndex.build(odd, threshold=3)
    got = {r["doc_id"]: r.asDict() for r in L.line_dedup(odd, index).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1]["n_lines"] == 1 and got[1]["n_dropped"] == 0 and got[1]["kept_sha256"] == nothing
    assert got[6]["n_dropped"] == 1 and got[6]["kept_sha256"] == nothing and got[3]["n_lines"] == 3
    assert got[8]["n_lines"] == 4 and got[8]["n_dropped"] == 0
    out = L.drop_common_lines(odd, index)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r["text"] for r in out.where("doc_id = 1").collect()} == {None} and {r["text"] for r in out.where("doc_id = 6").collect()} == {""}
    assert L.line_dedup(empty).count() == 0 and L.line_dedup(odd, L.LineIndex.build(empty)).count() == odd.count()


def test_long_lines_and_code_points(spark):
    d = spark.createDataFrame([(i, "😀\nab\n\n" + "y" * 100000) for i in range(3)], "doc_id long, text string")
    index = L.LineIndex.build(d, threshold=3, min_chars=2)
    assert {r["n_dropped"] for r in L.line_dedup(d, index).collect()} == {2}
