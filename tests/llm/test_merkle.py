import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import same, tables
from lodestar.llm import merkle_manifest as M
from lodestar.llm.queries import op11_merkle_manifest, oracle_sql
from lodestar.llm.ranking import ranked


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return h("".join(map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))


def tree(leaves, arity=2):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def proof(levels, i, arity=2):
    out = []
    for level in levels[:-1]:
        at = i // arity * arity
        run = level[at : at + arity]
        out.append(("".join(run[: i - at]), "".join(run[i - at + 1 :])))
        i //= arity
    return out


def wanted(rows):
    names = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {n: sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)), leaf(r, 1)) for r in rows if r["lang"] == n) for n in names}
    trees = {n: tree([k[2] for k, _ in g]) for n, g in groups.items()}
    crown = tree([trees[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, ((known, doc_id, own), other) in enumerate(groups[n]):
            steps = proof(trees[n], i) + proof(crown, k)
            at = other if known and zlib.crc32(str(doc_id).encode()) % 7 == 0 else own
            for left, right in steps:
                at = h(left + at + right)
            out.append((doc_id if known else None, own, trees[n][-1][0], crown[-1][0], h("".join(a + b for a, b in steps)), at, at == crown[-1][0]))
    return sorted(out, key=str)


def test_query_equals_sql_and_plain_python(spark, sf, docs):
    same(op11_merkle_manifest(spark, sf), tables(sf), oracle_sql()["op11_merkle_manifest"])
    assert sorted(map(tuple, op11_merkle_manifest(spark, sf).collect()), key=str) == wanted([r.asDict() for r in docs.collect()])


def test_odd_rows(odd):
    got = sorted(map(tuple, M.verified_documents(odd).collect()), key=str)
    assert got == wanted([r.asDict() for r in odd.collect()])
    twins = [r for r in got if r[0] == 6]
    assert len(twins) == 2 and twins[0][1] == twins[1][1]


def test_empty_table_and_lone_leaf(odd, empty):
    assert M.verified_documents(empty).count() == 0
    one = odd.where("doc_id = 7")
    assert sorted(map(tuple, M.verified_documents(one).collect())) == wanted([r.asDict() for r in one.collect()])


@pytest.mark.parametrize("n,arity,levels", [(1, 2, 2), (3, 2, 6), (9, 2, 2), (9, 3, 1), (70, 2, 6)])
def test_blocks_of_any_shape_give_the_same_tree(spark, n, arity, levels):
    rows = spark.range(n).selectExpr("'g' AS g", "id")
    built = M.manifest(rows, "g", ["id"], M.digest(F.col("id").cast("string")), {"id": F.col("id")}, arity, levels)
    levels_ = tree([h(str(i)) for i in range(n)], arity)
    found = {r["id"]: r for r in built.paths().select("*", M.siblings(F.col("path")).alias("s"), M.folded(F.col("digest"), F.col("path")).alias("f")).collect()}
    assert set(found) == set(range(n))
    for i, r in found.items():
        assert r["pos"] == i and r["root"] == levels_[-1][0] == r["f"] and r["s"] == "".join(a + b for a, b in proof(levels_, i, arity))
    assert [r["root"] for r in built.root().collect()] == [levels_[-1][0]]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=3), st.none() | st.text(max_size=3)), max_size=4))
def test_fields_never_run_together(pairs):
    texts = ["".join(map(field, p)) for p in pairs]
    assert len(set(texts)) == len(set(pairs))


def test_saved_and_loaded(spark, docs, tmp_path):
    built = M.manifest(docs, "lang", ["doc_id"], M.record([F.col("doc_id"), F.col("text")]), {"doc_id": F.col("doc_id")})
    built.save(str(tmp_path / "m"))
    again = M.Manifest.load(spark, str(tmp_path / "m"))
    assert sorted(map(str, again.paths().collect())) == sorted(map(str, built.paths().collect()))
    assert again.roots().count() == docs.select("lang").distinct().count()


def test_any_changed_field_is_seen(docs):
    built = M.manifest(docs, "lang", ["doc_id"], M.record([F.col("doc_id"), F.col("source")]), {"other": M.record([F.col("doc_id"), F.concat("source", F.lit("x"))])})
    r = built.paths().agg(F.count_if(M.folded(F.col("other"), F.col("path")) == F.col("root")).alias("n"), F.count_if(M.folded(F.col("digest"), F.col("path")) == F.col("root")).alias("m")).first()
    assert (r["n"], r["m"]) == (0, docs.count())


def test_places_over_several_partitions(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'a' ELSE 'b' END AS g", "CASE WHEN id % 5 > 0 THEN id % 7 END AS v", "id")
    got = ranked(rows, ["v"], "g").collect()
    for g in "ab":
        mine = sorted((r["pos"], r["v"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and {r["size"] for r in got if r["g"] == g} == {len(mine)}
        assert [v for _, v in mine] == sorted((v for _, v in mine), key=lambda v: (v is not None, v or 0))
