"""Runs by their statuses, in a batch and as they arrive; reports with intervals; small things for display."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.config import EngineConfig
from lodestar.functions import text as tx
from lodestar.operators import embeddings, evaluate, graph, status
from lodestar.plans.ingestion import Repository, store
from lodestar.schemas import INDEX_STATUS
from lodestar.streaming.status import watched

START = datetime(2024, 1, 1)
COLUMNS = "run string, status string, at timestamp_ntz, seq long"


def made(n=400, seed=4):
    pick = random.Random(seed)
    steps = [*INDEX_STATUS, "QUEUED", "QUEUED", "READY", "nonsense", None]
    out = [(pick.choice(["a", "a", "a", "a", "b", "c", "d"]), pick.choice(steps), START + timedelta(minutes=pick.randrange(20_000), microseconds=pick.randrange(1000)), i) for i in range(n)]
    return [*out, (None, "QUEUED", START, n), ("e", "QUEUED", None, n + 1)]


def walked(rows, limit, end):
    """The fold over plain lists: (run, seq, at, before, after, kind)."""
    out, runs = [], {}
    for run, to, at, seq in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[3])):
        to = to or ""
        now, since, by = runs.get(run, ("", None, None))
        if not status.follows(now, to):
            out.append((run, seq, at, now, to, "refused"))
            continue
        if since is not None and now not in status.RESTING and since + limit < at:
            out.append((run, by, since + limit, now, now, "stuck"))
        out.append((run, seq, at, now, to, "held"))
        runs[run] = (to, at, seq)
    out += [(run, by, since + limit, now, now, "stuck") for run, (now, since, by) in runs.items() if since is not None and now not in status.RESTING and since + limit < end]
    return sorted(out, key=str)


def plain(df, key="key"):
    return sorted(((r[key], r["tie"], r["at"], r["before"], r["after"], r["kind"]) for r in df.collect()), key=str)


def test_follows():
    assert status.follows("", "QUEUED") and status.follows("QUEUED", "READY") and status.follows("PARSING", "FAILED") and status.follows("FAILED", "QUEUED")
    assert not any(status.follows(*p) for p in [("", "READY"), ("READY", "FAILED"), ("PARSING", "SCANNING"), ("PARSING", "PARSING"), ("QUEUED", "nonsense"), ("FAILED", "READY"), ("", "FAILED")])


def test_changes_equal_a_fold_though_runs_are_split(spark):
    rows = made()
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = plain(status.changes(spark.createDataFrame(rows, COLUMNS).repartition(5), "run", "status", "at", "seq", "6 hours"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = walked(rows, timedelta(hours=6), max(r[2] for r in rows if r[0] is not None and r[2] is not None))
    assert got == want and {r[5] for r in got} == {"held", "refused", "stuck"}
    assert status.changes(spark.createDataFrame([], COLUMNS), "run", "status", "at", "seq").count() == 0


def test_stream_says_what_the_fold_says(spark, tmp_path):
    rows = [r for r in made(150, 9) if r[2] is not None]
    rows.append(("z", "QUEUED", START + timedelta(days=30), 9_000))  # moves the watermark past all limits before it
    ordered = sorted(rows, key=lambda r: (r[2], r[3]))
    for i in range(3):  # three micro-batches in order of time
        part = ordered[len(ordered) * i // 3 : len(ordered) * (i + 1) // 3]
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = watched(stream, "run", "status", "at", "seq", timedelta(hours=6))
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = plain(spark.read.parquet(str(tmp_path / "out")), "run")
    assert got == walked(rows, timedelta(hours=6), START + timedelta(days=30) - timedelta(minutes=10))
    assert "stuck" in {r[5] for r in got} and "refused" in {r[5] for r in got}


# -- intervals


def measured(spark, shift=0.0, n=60):
    pick = random.Random(1)
    rows = [(f"q{i}", "odd" if i % 2 else "even", min(1.0, pick.random() + shift), pick.random(), float(i % 3 == 0)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "question string, category string, recall_at_k double, mrr double, citation_accuracy double")


def replicate_means(rows, at, seed, replicates):
    import hashlib

    out = []
    for b in range(1, replicates + 1):
        total = weight = 0.0
        for r in rows:
            u = (int(hashlib.sha256(f"{seed}:{b}:{r[0]}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
            w = next((k for k, upto in enumerate(evaluate.POISSON) if u <= upto), len(evaluate.POISSON))
            total, weight = total + w * r[at], weight + w
        if weight:
            out.append(total / weight)
    return sorted(out)


def test_intervals_equal_plain_replicates(spark):
    rows, df = measured(spark)
    got = {(r["category"], r["measure"]): r for r in evaluate.bootstrap(df, ["recall_at_k", "mrr"], "question", "category", 100, 5).collect()}
    for category in ("odd", "even"):
        for at, measure in ((2, "recall_at_k"), (3, "mrr")):
            mine = [r for r in rows if r[1] == category]
            means = replicate_means(mine, at, 5, 100)
            r = got[category, measure]
            assert math.isclose(r["low"], means[math.floor(0.025 * (len(means) - 1))], rel_tol=1e-9) and math.isclose(r["high"], means[math.ceil(0.975 * (len(means) - 1))], rel_tol=1e-9)
            assert math.isclose(r["mean"], sum(x[at] for x in mine) / len(mine), rel_tol=1e-9) and r["low"] < r["mean"] < r["high"]


def test_pairs_cancel_what_is_hard_for_both(spark):
    _, better = measured(spark, 0.1)
    _, worse = measured(spark)
    r = evaluate.compared(better, worse, ["recall_at_k", "mrr"], "question", "category", 200).where("measure = 'recall_at_k' and category = 'odd'").first()
    alone = evaluate.bootstrap(worse, ["recall_at_k"], "question", "category", 200).where("category = 'odd'").first()
    assert 0 < r["low"] <= r["mean"] <= r["high"] <= 0.1 + 1e-9 and r["above"] == 1.0 and r["high"] - r["low"] < alone["high"] - alone["low"]
    same = evaluate.compared(worse, worse, ["mrr"], "question", "category", 50).collect()
    assert all(x["mean"] == x["low"] == x["high"] == x["above"] == 0 for x in same)


def test_targets_and_labelled_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text("\n".join(json.dumps(x) for x in [{"question": "where is login", "expected_symbols": ["login"], "category": "location"}, {"question": "what is this"}, {"notes": "no question"}]))
    rows = evaluate.labelled(spark, str(tmp_path / "q.json"))
    assert [(r["question"], r["expected_symbols"], r["expected_files"], r["category"]) for r in rows.orderBy("question").collect()] == [("what is this", [], [], "other"), ("where is login", ["login"], [], "location")]
    answered = rows.withColumns({"retrieved_symbols": F.array(F.lit("auth.login")), "retrieved_files": F.array(F.lit("src/a.py"))})
    got = {r["measure"]: r for r in evaluate.against_targets(evaluate.per_question(answered), "question", 50).collect()}
    assert {m: r["target"] for m, r in got.items()} == evaluate.TARGETS and all(r["met"] and r["mean"] == 1.0 for r in got.values())


def test_report_is_written(spark, tmp_path):
    _, df = measured(spark)
    evaluate.write_report(df.withColumns({"precision_at_k": F.lit(0.5), "latency_ms": F.lit(2.0), "error": F.lit(None).cast("string")}), str(tmp_path / "report"))
    r = spark.read.json(str(tmp_path / "report")).first()
    assert r["questions"] == 60 and r["precision_at_k"] == 0.5 and r["error_rate"] == 0.0


# -- display, settings, writes that fail


def test_times_and_numbers(spark):
    now = datetime(2024, 1, 2, 12)
    rows = [(now - timedelta(seconds=59), "just now"), (now + timedelta(hours=1), "just now"), (now - timedelta(minutes=59, seconds=59), "59m ago"), (now - timedelta(hours=23, minutes=59), "23h ago"), (now - timedelta(hours=49), "2d ago"), (None, None)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", tx.relative_time(F.col("at"), F.lit(now)).alias("got")).collect())
    numbers = spark.createDataFrame([(0, "0"), (999, "999"), (1_500, "1.5K"), (2_000_000, "2.0M"), (1_234_567_890, "1234.6M")], "n long, want string")
    assert all(r["got"] == r["want"] for r in numbers.select("want", tx.compact_number(F.col("n")).alias("got")).collect())


def test_impact_report_of_known_and_unknown_symbols(spark):
    edges = spark.createDataFrame([("b", "a", "CALLS"), ("c", "b", "USES"), ("d", "a", "CONTAINS")], "src string, dst string, relation_type string")
    known, unknown = graph.impact_report(edges, "a").first(), graph.impact_report(edges, "nowhere").first()
    assert (known["direct"], known["indirect"], known["note"]) == (["b"], ["c"], graph.IMPACT_NOTE)
    assert (unknown["symbol_id"], unknown["direct"], unknown["indirect"]) == ("nowhere", [], [])


def test_settings_of_texts_and_providers(spark, tmp_path):
    config = EngineConfig.load(environment={"LODESTAR_EMBEDDING_PROVIDER": "sha256", "LODESTAR_EMBEDDING_BATCH_TEXTS": "2", "LODESTAR_STUCK_AFTER": "2 hours"})
    assert (config.embedding_batch_texts, config.stuck_after) == (2, "2 hours")
    table = embeddings.VectorTable(spark, str(tmp_path), config=config)
    assert table.fill(spark.createDataFrame([(str(i),) for i in range(5)], "text string"), "text") == 5
    with pytest.raises(ValueError, match="no provider"):
        embeddings.provider_of(EngineConfig(embedding_provider="none such"))


def test_edges_that_fail_leave_the_rest(spark, tmp_path):
    files = spark.createDataFrame([("r", "a.py", "x = 1")], "repository_id string, path string, content string")
    symbols = spark.createDataFrame([("r", "s1")], "repository_id string, id string")
    vectors = symbols.withColumn("vector", F.array(F.lit(1.0)))
    bad = symbols.withColumn("confidence", F.raise_error(F.lit("edge store is down")).cast("double"))
    errors = store(Repository(files, symbols, bad, vectors, None), str(tmp_path))
    assert list(errors) == ["relationships"] and spark.read.parquet(str(tmp_path / "vectors")).count() == 1 == spark.read.parquet(str(tmp_path / "symbols")).count()
    with pytest.raises(Exception, match="down"):
        store(Repository(files, bad, symbols, vectors, None), str(tmp_path / "other"))
