"""Stored indexes against what they stand for: exact search, a rebuild, a scan, all edges."""

import os
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize
from lodestar.functions.vectors import hash_embedding
from lodestar.operators import adjacency, dense, embeddings, grams, graph, layout, lexical, postings, relate, segments, vector_index


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_read(df):
    """Files that a scan opened."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


# -- vectors


def recall(got, want):
    return len({(r["query_id"], r["id"]) for r in got} & {(r["query_id"], r["id"]) for r in want}) / len(want)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


@pytest.fixture(scope="module")
def vector_lists(vectors, tmp_path_factory):
    return vector_index.build(vectors, str(tmp_path_factory.mktemp("v") / "index"), carry=["label"])


def test_lists_find_nearly_all_true_neighbours(spark, vectors, vector_lists):
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = {(r["query_id"], r["id"]): r["score"] for r in dense.nearest_batch(vectors, asked).collect()}
    again = vector_index.VectorIndex.load(spark, vector_lists.path)
    got = vector_index.search(again, asked).collect()
    assert recall(got, dense.nearest_batch(vectors, asked).collect()) >= 0.9
    assert all(abs(r["score"] - want[r["query_id"], r["id"]]) < 1e-6 for r in got if (r["query_id"], r["id"]) in want)
    assert sum(vector_lists.codes.groupBy("list").count().toPandas()["count"]) == vectors.count()


def test_all_lists_and_candidates_are_the_exact_search(vectors, vector_lists):
    asked = vectors.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vector_index.search(vector_lists, asked, 10, probes=10_000, keep=200, where=F.col("label") == 3)
    want = dense.nearest_batch(vectors.where("label = 3"), asked, 10)
    assert [(r["query_id"], r["id"], r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == [(r["query_id"], r["id"], r["rank"]) for r in want.orderBy("query_id", "rank").collect()]


def test_the_exact_search_by_way_of_lists_moves_no_candidates(spark, vectors, vector_lists):
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    where = F.col("label").isin(1, 2, 3)
    every = vectors.where(where).count()
    before = rows_shuffled(spark)
    got = ranked(vector_index.search(vector_lists, asked, probes=len(vector_lists.centres), keep=every, where=where))
    moved = rows_shuffled(spark) - before
    assert got == ranked(dense.nearest_batch(vectors.where(where), asked)) and len(got) == 200 * 20
    assert moved < 200 * every


def test_few_lists_are_read_where_vectors_have_neighbourhoods(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    made = centres[rng.integers(40, size=8_000)] + rng.normal(size=(8_000, 32)) * 0.15
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)] + [(None, made[0].tolist()), (9_000, None), (9_001, [1.0, 2.0])], "vec_id long, embedding array<double>")
    index = vector_index.build(df, str(tmp_path / "index"), lists=40)
    assert index.vectors.count() == 8_000
    size = lambda table, lists: sum(os.path.getsize(os.path.join(d, f)) for at in lists for d, _, fs in os.walk(f"{index.path}/{table}/list={at}") for f in fs)
    asked = df.where("vec_id in (1, 2, 3)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert recall(vector_index.search(index, asked).collect(), dense.nearest_batch(df, asked).collect()) >= 0.9
    for q in range(1, 4):
        unit = made[q] / np.linalg.norm(made[q])
        near = np.argsort(-(index.centres @ unit))[: index.probes]
        assert size("codes", near) + size("vectors", near) < 0.2 * size("vectors", range(40))


# -- postings and segments


@pytest.fixture(scope="module")
def texts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def questions(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.explode(tokenize(F.col("text"))).alias("term"))


def ranked(df):
    return rows(df.select("query_id", "id", F.round("score", 6), "rank"))


@pytest.mark.parametrize("k,size", [(20, 128), (1, 4), (3, 16)])
def test_blocks_give_what_all_postings_give(spark, texts, questions, tmp_path, monkeypatch, k, size):
    monkeypatch.setattr(postings, "RANGE", size)
    index = lexical.build_index(texts, "doc_id", F.col("text"))
    found = postings.search(postings.build(index.documents, str(tmp_path / "b")), questions, k)
    assert ranked(found.rows) == ranked(lexical.search(index, questions, k))
    every = {r["query_id"]: r["count"] for r in lexical.score(index, questions).groupBy("query_id").count().collect()}
    effort = {r["query_id"]: r for r in found.effort.collect()}
    assert all(effort[q]["documents_scored"] <= n for q, n in every.items())
    if k == 1:
        assert sum(r["ranges_scored"] for r in effort.values()) < 0.8 * sum(r["ranges"] for r in effort.values())


def test_blocks_are_bounded_for_a_term_of_all_documents(spark):
    tokens = spark.range(5_000).select("id", F.array(F.lit("the"), F.col("id").cast("string")).alias("tokens"))
    blocks = postings.blocks(tokens, postings.ranges_of(5_000)).where("term = 'the'").select(F.size("postings").alias("n")).toPandas()["n"]
    assert blocks.sum() == 5_000 and blocks.max() < 2 * postings.RANGE


def rows_shuffled(spark):
    """Rows that all stages of the session have shuffled so far."""
    every = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(every.apply(i).shuffleWriteRecords() for i in range(every.size()))


def test_postings_are_not_shuffled_for_an_index(spark, tmp_path):
    words = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(60)).cast("string")))
    spark.range(0, 3_000, 1, 3).select("id", words.alias("tokens")).write.parquet(str(tmp_path / "tokens"))
    tokens = spark.read.parquet(str(tmp_path / "tokens"))
    before = rows_shuffled(spark)
    index = postings.build(tokens, str(tmp_path / "b"))
    assert index.blocks.agg(F.sum(F.size("postings"))).first()[0] > 60_000
    assert rows_shuffled(spark) - before < 20_000


def test_no_pairs_of_questions_and_documents_are_shuffled(spark, tmp_path):
    tokens = spark.range(2_000).select("id", F.array(F.lit("the"), F.lit("of"), F.concat(F.lit("w"), (F.col("id") % 50).cast("string"))).alias("tokens"))
    index = postings.build(tokens, str(tmp_path / "b"))
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("the"), F.lit("of"), F.concat(F.lit("w"), F.col("id").cast("string")))).alias("term"))
    before = rows_shuffled(spark)
    found = postings.search(index, asked, 5)
    assert found.rows.count() == 200 and rows_shuffled(spark) - before < 40 * 2_000 / 4


def test_repeated_and_null_ids_in_blocks(spark, tmp_path):
    made = [(1, "a b b"), (1, "a b b"), (2, "a c"), (2, "a"), (None, "c d"), *((i, f"a x{i} e") for i in range(3, 400))]
    tokens = spark.createDataFrame([(i, t.split()) for i, t in made], "id long, tokens array<string>")
    asked = spark.createDataFrame([("q", t) for t in ("b", "c", "d", "x7")], "query_id string, term string")
    index = postings.build(tokens, str(tmp_path / "b"))
    post = tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    avgdl = sum(len(t.split()) for _, t in made) / len(made)
    worth = F.col("idf") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / avgdl))
    want = post.join(asked, "term").join(index.terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(worth), 6).alias("score"))
    assert rows(postings.search(index, asked).rows.select("query_id", "id", F.round("score", 6).alias("score"))) == rows(want) and want.count() == 4
    assert index.terms.where("term = 'b'").first()["df"] == 1 and index.corpus.first()["n"] == len(made)


def rebuilt(docs):
    return lexical.build_index(docs, "doc_id", F.col("text"))


def check_equals_rebuild(index, docs, questions):
    want, view = rebuilt(docs), index.view()
    assert ranked(postings.search(view, questions).rows) == ranked(lexical.search(want, questions))
    assert rows(view.terms.select("term", "df", F.round("idf", 9))) == rows(want.terms.select("term", "df", F.round("idf", 9)))


def test_segments_equal_a_rebuild_after_every_change(spark, texts, questions, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        index.view()
    index.delete(texts.select(F.col("doc_id").alias("id")))
    quarter = lambda n: texts.where(F.col("doc_id") % 4 == n)
    for n in range(4):
        index.insert_texts(quarter(n), "doc_id", "text", "lang")
    index.delete(texts.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))
    left = texts.where("doc_id % 3 <> 0")
    changed = left.where("doc_id % 5 = 1").withColumn("text", F.concat(F.lit("zyx changed "), F.coalesce("text", F.lit(""))))
    index.insert_texts(changed, "doc_id", "text", "lang")
    left = left.where("doc_id % 5 <> 1").union(changed)
    check_equals_rebuild(index, left, questions)
    before = {s.name for s in index.state()[1]}
    assert index.merge() and len(index.state()[1]) < len(before)
    check_equals_rebuild(index, left, questions)
    assert len(index.vacuum()) >= 4 and index.vacuum() == []
    index.invalidate("en")
    check_equals_rebuild(index, left.where("lang <> 'en' or lang is null"), questions)
    assert index.documents().where("repository_id = 'en'").count() == 0
    index.insert_texts(texts.limit(0), "doc_id", "text", "lang")
    version, _ = index.state()
    assert version == 9


def test_no_tokens_move_for_documents_that_come(spark, tmp_path):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", i), F.lit(40)).cast("string"))))
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"))
    index = segments.SegmentedIndex(spark, str(tmp_path / "s"))
    index.insert_texts(docs.where("doc_id < 3000"), "doc_id", "text", "lang")
    before = rows_shuffled(spark)
    twice = docs.where("doc_id >= 2990").union(docs.where("doc_id = 2995"))  # ten take their place, one comes twice
    index.insert_texts(docs.where("doc_id >= 2990"), "doc_id", "text", "lang")
    assert rows_shuffled(spark) - before < 5_000
    index.insert_texts(twice, "doc_id", "text", "lang")
    assert index.documents().count() == 4_000 and [s.live for s in index.state()[1]] == [2_990, 1_010]


# -- names


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    words = ["Login", "auth", "Service", "_id", "100%", "a\\b", "Ünï", "ΑΣ", "x", "token manager", ""]
    pick = random.Random(3)
    made = [(i, "".join(pick.choice(words) for _ in range(pick.randint(0, 4)))) for i in range(600)] + [(None, "Login"), (1_000, None)]
    df = spark.createDataFrame(made, "id long, symbol_name string")
    return df, grams.build(df, str(tmp_path_factory.mktemp("n") / "names"))


def test_patterns_match_as_a_scan_does(spark, names):
    df, index = names
    pick, parts = random.Random(5), ["%", "_", "log", "auth", "SERV", "\\%", "\\_", "\\\\", "to", "ünï", "ας", "ken m", "e", "zzzz"]
    patterns = [(i, "".join(pick.choice(parts) for _ in range(pick.randint(0, 5)))) for i in range(120)] + [(500, None), (501, "%Login%"), (502, "login")]
    asked = spark.createDataFrame(patterns, "query_id long, pattern string")
    want = df.where("id is not null").join(asked, F.expr("symbol_name ilike pattern")).select("query_id", "id", F.col("symbol_name").alias("name"))
    got = rows(grams.matching(index, asked))
    assert got == rows(want) and len({r[0] for r in got}) > 20


def test_texts_that_are_contained(spark, names):
    df, index = names
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["0%A", "_ID", "\\B", "TOKEN", "nothing", "e"])], "query_id long, text string")
    want = df.where("id is not null").join(asked, F.contains(F.lower("symbol_name"), F.lower("text"))).select("query_id", "id", F.col("symbol_name").alias("name"))
    assert rows(grams.matching(index, asked.select("query_id", grams.containing(F.col("text")).alias("pattern")))) == rows(want)


def test_a_pattern_opens_few_lists(names):
    _, index = names
    spark = index.lists.sparkSession
    asked = spark.createDataFrame([(1, "ken")], "query_id long, gram string").withColumn("bucket", grams._bucket("gram"))
    opened = grams._opened(index.lists, asked, "gram")
    assert 0 < files_read(opened) <= files_read(index.lists) / 4 and [r["gram"] for r in opened.collect()] == ["ken"]


# -- graph


@pytest.fixture(scope="module")
def random_edges(spark):
    pick = random.Random(11)
    made = {(f"n{pick.randrange(300)}", f"n{pick.randrange(300)}", pick.choice(["CALLS", "IMPORTS", "CONTAINS"])) for _ in range(350)}
    made |= {("hub", f"m{i}", "CALLS") for i in range(3_000)} | {("m7", "far", "USES"), ("far", "farther", "USES")}
    return spark.createDataFrame(sorted(made), "src string, dst string, relation_type string")


@pytest.fixture(scope="module")
def stored_graph(random_edges, tmp_path_factory):
    return adjacency.build(random_edges, str(tmp_path_factory.mktemp("g") / "graph"))


@pytest.mark.parametrize("depth,types", [(1, None), (3, None), (2, ["CALLS", "IMPORTS"])])
def test_stored_neighbours_are_those_of_edges(spark, random_edges, stored_graph, depth, types):
    seeds = spark.createDataFrame([("a", "n1"), ("b", "n2"), ("c", "hub"), ("d", "nowhere"), ("e", "n1")], "root string, id string")
    assert rows(adjacency.neighborhood(stored_graph, seeds, depth, 50, types)) == rows(graph.neighborhood(random_edges, seeds, depth, 50, types))


def test_stored_impact_is_that_of_edges(random_edges, stored_graph):
    for node in ("farther", "m7", "n5"):
        assert rows(adjacency.impact(stored_graph, node)) == rows(graph.impact(random_edges, node))


def test_reads_follow_the_frontier(spark, stored_graph):
    seeds = spark.createDataFrame([("r", "farther")], "root string, id string")
    found = adjacency.reached(stored_graph, seeds, 2)
    assert [len(b) for b in found.buckets] == [1, 1] and rows(found.rows) == [("r", "far", 1), ("r", "farther", 0), ("r", "m7", 2)]
    _, opened = adjacency.step(stored_graph, seeds)
    assert files_read(stored_graph.chunks.where(F.col("bucket").isin(opened))) < files_read(stored_graph.chunks) / 20


def test_a_hub_is_many_chunks(stored_graph):
    sizes = stored_graph.chunks.where("node = 'hub'").select(F.size("neighbours").alias("n")).toPandas()["n"]
    assert sizes.sum() == 3_000 and sizes.max() <= adjacency.CHUNK and len(sizes) >= 3


# -- as-of


def test_as_of_equals_a_search_of_each_row(spark):
    pick = random.Random(2)
    states = [(pick.choice(["a", "a", "a", "b", None]), pick.randrange(60), pick.randrange(1000), i) for i in range(200)]
    events = [(pick.choice(["a", "a", "a", "b", "c", None]), pick.randrange(60), i) for i in range(400)]
    s = spark.createDataFrame(states, "k string, since long, v long, tie long").repartition(6)
    e = spark.createDataFrame(events, "k string, at long, id long").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that one key is in several splits
    try:
        got = {r["id"]: r["v"] for r in relate.as_of(e, s, ["k"], "at", "since", "v", "tie").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    first = {}
    for k, since, v, tie in sorted(states, key=lambda r: -r[3]):
        first[k, since] = v
    for k, at, i in events:
        known = [t for (kk, t) in first if kk == k and t <= at]
        assert got[i] == (first[k, max(known)] if known else None)


def test_as_of_deals_one_key_over_tasks(spark):
    e = spark.range(40_000).select(F.lit("u").alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("at"), "id")
    s = spark.range(500).select(F.lit("u").alias("k"), (F.col("id") % 50).alias("since"), F.col("id").alias("v"), F.col("id").alias("tie"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = relate._in_time(e, s, ["k"], "at", "since", "v", "tie")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) > 2 and max(sizes) <= 2 * statistics.median(sizes)


# -- embeddings


def test_a_text_is_embedded_once(spark, tmp_path):
    class Counting(embeddings.HashProvider):
        name = "counting"

        def embed(self, texts):
            if len(texts) > 256 or (len(texts) > 1 and sum(len(t.encode()) for t in texts) > 1 << 20):
                raise ValueError("too much at once")
            return super().embed(texts)

    table = embeddings.VectorTable(spark, str(tmp_path), Counting())
    made = [(i, t) for i, t in enumerate(["one", "two", "two", None, "", "ü" * 700_000, "y" * 900_000, *("same" for _ in range(600)), *map(str, range(600))])]
    df = spark.createDataFrame(made, "id long, text string")
    assert table.fill(df, "text") == len({t or "" for _, t in made}) and table.fill(df, "text") == 0
    assert table.fill(df.union(spark.createDataFrame([(9_999, "new")], df.schema)), "text") == 1
    got = {r["id"]: r["vector"] for r in table.vectors(df, "id", "text").collect()}
    want = {r["id"]: r["v"] for r in df.where("id < 8").select("id", hash_embedding(F.col("text")).alias("v")).collect()}
    assert len(got) == len(made) and all(np.allclose(got[i], v) for i, v in want.items())


def test_a_provider_that_gives_too_few_is_refused(spark, tmp_path):
    class Short(embeddings.HashProvider):
        name = "short"

        def embed(self, texts):
            return np.zeros((len(texts), 3))

    with pytest.raises(Exception, match="gave"):
        embeddings.VectorTable(spark, str(tmp_path), Short()).fill(spark.createDataFrame([("a",)], "text string"), "text")


def test_symbols_are_embedded_where_they_are(spark, sf, tmp_path):
    from lodestar.plans import bindings, search, stored

    at = str(tmp_path / "tables")
    os.symlink(sf, at)
    before = rows_shuffled(spark)
    got = stored.symbol_vectors(spark, at)
    assert rows_shuffled(spark) == before
    symbols = bindings.symbols(spark, sf)
    want = {r["id"]: r["vector"] for r in search.symbol_vectors(symbols).collect()}
    found = {r["id"]: r["vector"] for r in got.collect()}
    assert len(found) == symbols.count() and all(np.allclose(found[i], v) for i, v in want.items())
    files = {os.path.dirname(f) for f in got.inputFiles()}
    assert len(files) == 1 and not any(os.path.isdir(e.path) for e in os.scandir(files.pop().removeprefix("file:")))


def test_join_of_a_frequent_key(spark):
    left = spark.range(1_000).select("id", F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    right = spark.createDataFrame([("hot", 1), ("950", 2), ("none", 3)], "key string, v int")
    assert rows(layout.join_unique(left, right, "key", often=100)) == rows(left.join(right, "key"))


# -- plans and failures


@pytest.mark.parametrize("name", ["bfs_neighborhood", "graph_expansion", "context_assembled", "subgraph_induced", "hybrid_search"])
def test_plans_stay_small(spark, sf, name):
    from lodestar.plans import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan", plan)) <= 12


def test_a_stage_that_fails_leaves_the_others(spark):
    from lodestar.plans import search

    made = [(f"s{i}", "r", f"f{i}.py", "python", "function", name, f"m.{name}", f"def {name}(): pass", None, 1, 2) for i, name in enumerate(["login", "logout", "parse"])]
    symbols = spark.createDataFrame(made, "id string, repository_id string, file_path string, language string, symbol_type string, symbol_name string, qualified_name string, code string, documentation string, start_line int, end_line int")
    asked = spark.createDataFrame([("q", "where is login implemented")], "query_id string, text string")
    edges = spark.createDataFrame([("s0", "s2", "CALLS")], "src string, dst string, relation_type string")
    found = search.retrieve(asked, symbols, lambda: lexical.LexicalIndex.load(spark, "/nowhere/at/all"), search.symbol_vectors(symbols), lambda: edges.select("missing"))
    assert [r["stage"] for r in found.errors().orderBy("stage").collect()] == ["graph", "lexical"]
    hits = {r["stage"]: r["hits"] for r in found.stats().collect()}
    assert hits["lexical"] == hits["graph"] == 0 and hits["names"] > 0 and hits["reranked"] > 0
    assert search.retrieve(asked, symbols, None, None, edges).errors().count() == 0
