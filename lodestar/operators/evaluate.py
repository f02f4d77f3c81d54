"""How good a ranking is: recall, precision, reciprocal rank and citations, for each question and over all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT


def _in(found: Column, wanted: Column) -> Column:
    return F.contains(F.lower(found), F.lower(wanted))


def recall_at_k(expected: Column, retrieved: Column, k: int) -> Column:
    """Distinct expected names inside one of the first k retrieved, over the length of the list; none expected: 1."""
    top = F.slice(retrieved, 1, k)
    hits = F.size(F.filter(F.array_distinct(expected), lambda e: F.exists(top, lambda r: _in(r, e))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.size(expected))


def precision_at_k(expected: Column, retrieved: Column, k: int) -> Column:
    """Share of the first k retrieved that hold an expected name; nothing retrieved: 0."""
    top = F.slice(retrieved, 1, k) if k else F.array().cast("array<string>")
    hits = F.size(F.filter(top, lambda r: F.exists(expected, lambda e: _in(r, e))))
    return F.when(F.size(top) == 0, 0.0).otherwise(hits / F.size(top))


def reciprocal_rank(expected: Column, retrieved: Column) -> Column:
    """One over the first place that holds an expected name; none expected: 1, none found: 0."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(retrieved), F.lit(1))), lambda i: F.exists(expected, lambda e: _in(F.get(retrieved, i - 1), e)))
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.coalesce(1 / F.get(places, F.lit(0)), F.lit(0.0)))


def citation_accuracy(expected: Column, cited: Column) -> Column:
    """Share of expected files inside a cited path; none expected: 1."""
    hits = F.size(F.filter(expected, lambda e: F.exists(cited, lambda c: _in(c, e))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.size(expected))


def per_question(results: DataFrame, k: int = 10) -> DataFrame:
    """results with the four measures. They have expected_symbols, retrieved_symbols, expected_files, retrieved_files."""
    e, r = F.col("expected_symbols"), F.col("retrieved_symbols")
    return results.withColumns({"recall_at_k": recall_at_k(e, r, k), "precision_at_k": precision_at_k(e, r, k), "mrr": reciprocal_rank(e, r), "citation_accuracy": citation_accuracy(F.col("expected_files"), F.col("retrieved_files"))})


def per_question_rows(retrieved: DataFrame, expected: DataFrame, by: list[str], k: int = 10, cited: int = 5, few: int = 50_000) -> DataFrame:
    """The four measures where expected names are rows (by, name), any number of a question.

    retrieved has a row for each question: by, and ``retrieved``, at most 62 names in order. Expected
    names meet that list where they are and are summed in tasks, so a question with very many is
    spread; the first ``cited`` retrieved are what is cited.
    """
    lists = retrieved.select(*by, "retrieved")
    beside = F.broadcast(lists) if lists.limit(few + 1).count() <= few else lists
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size("retrieved"), F.lit(1))), lambda i: F.coalesce(_in(F.get("retrieved", i - 1), F.col("name")), F.lit(False)))
    met = expected.join(beside, by).select(*by, "name", places.alias("places"))
    first = F.coalesce(F.get("places", F.lit(0)), F.lit(99))
    bits = F.aggregate("places", F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    sums = met.groupBy(*by).agg(
        F.count("*").alias("_n"), F.countDistinct(F.when(first <= k, F.col("name"))).alias("_found"), F.bit_or(bits).alias("_bits"), F.min(first).alias("_first"), F.sum((first <= cited).cast("long")).alias("_cited")
    )
    size = F.least(F.size("retrieved"), F.lit(k))
    some = F.col("_n").isNotNull()
    inside = F.bit_count(F.coalesce("_bits", F.lit(0).cast("long")).bitwiseAND(F.lit((1 << (k + 1)) - 2)))
    return retrieved.join(sums, by, "left").withColumns(
        {
            "recall_at_k": F.when(some, F.col("_found") / F.col("_n")).otherwise(1.0),
            "precision_at_k": F.when(size > 0, inside / size).otherwise(0.0),
            "mrr": F.when(~some, 1.0).when(F.col("_first") < 99, 1 / F.col("_first")).otherwise(0.0),
            "citation_accuracy": F.when(some, F.col("_cited") / F.col("_n")).otherwise(1.0),
        }
    ).drop("_n", "_found", "_bits", "_first", "_cited")


def report(measured: DataFrame) -> DataFrame:
    """One row of means, and the share of questions with an error."""
    return measured.agg(F.count("*").alias("questions"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("precision_at_k").alias("precision_at_k"), F.avg("mrr").alias("mrr"), F.avg("citation_accuracy").alias("citation_accuracy"), F.avg("latency_ms").alias("latency_ms"), F.avg(F.col("error").isNotNull().cast("double")).alias("error_rate"))


def report_by_category(measured: DataFrame) -> DataFrame:
    """A row for each category, in its order."""
    return measured.groupBy("category").agg(F.count("*").alias("questions"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("mrr").alias("mrr"), F.avg("citation_accuracy").alias("citation_accuracy")).orderBy("category")


# What a retrieval should reach.
TARGETS = {"recall_at_k": 0.70, "mrr": 0.60, "citation_accuracy": 0.65}
#: A table of labelled questions.
LABELLED = "question string, intent string, expected_symbols array<string>, expected_files array<string>, category string, notes string"
#: Chances that a weight of mean one is at most 0, 1, 2 and so on; beyond the last it is as good as certain.
POISSON = [round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)), 12) for k in range(8)]


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions from JSON lines; lists that are missing are empty, a category that is missing is ``other``."""
    none = F.array().cast("array<string>")
    return spark.read.schema(LABELLED).json(path).where("question is not null").withColumns({"expected_symbols": F.coalesce("expected_symbols", none), "expected_files": F.coalesce("expected_files", none), "category": F.coalesce("category", F.lit("other"))})


def replicate_weight(question: Column, replicate: Column, seed: int) -> Column:
    """How often a question is in a replicate: a Poisson number of mean one that seed, replicate and question decide."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), question), 256), 1, 8), 16, 10).cast("double")
    u = (h + 0.5) / 4294967296.0
    out = F.when(u <= POISSON[0], 0)
    for k, upto in enumerate(POISSON[1:], 1):
        out = out.when(u <= upto, k)
    return out.otherwise(len(POISSON))


def _replicates(measured: DataFrame, measures: list[str], question: str, by: list[str], replicates: int, seed: int) -> DataFrame:
    """(by, measure, replicate, mean): weighted means of every replicate in one pass. Sums meet in tasks first, so a
    category of any size moves a row for each replicate and task."""
    rows = measured.select(*by, F.col(question).alias("_q"), *measures, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("_w", replicate_weight(F.col("_q"), F.col("replicate"), seed))
    sums = rows.groupBy(*by, "replicate").agg(F.sum("_w").alias("_n"), *(F.sum(F.col("_w") * F.col(m)).alias(m) for m in measures))
    long = sums.select(*by, "replicate", "_n", F.explode(F.create_map(*(x for m in measures for x in (F.lit(m), F.col(m))))).alias("measure", "total"))
    return long.where("_n > 0").select(*by, "measure", "replicate", (F.col("total") / F.col("_n")).alias("mean"))


def _interval(means: Column, level: float) -> tuple[Column, Column]:
    """The bounds of sorted replicate means, the outer neighbours of where they fall."""
    tail, last = (1 - level) / 2, F.size(means) - 1
    return F.get(means, F.floor(F.lit(tail) * last).cast("int")), F.get(means, F.ceil(F.lit(1 - tail) * last).cast("int"))


def bootstrap(measured: DataFrame, measures: list[str], question: str, by: str, replicates: int = DEFAULT.report_replicates, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(by, measure, mean, low, high): means of a category and intervals of them by the Poisson bootstrap."""
    means = _replicates(measured, measures, question, [by], replicates, seed).groupBy(by, "measure").agg(F.sort_array(F.collect_list("mean")).alias("means"))  # one number a replicate
    plain = measured.groupBy(by).agg(*(F.avg(m).alias(m) for m in measures)).select(by, F.explode(F.create_map(*(x for m in measures for x in (F.lit(m), F.col(m))))).alias("measure", "mean"))
    low, high = _interval(F.col("means"), level)
    return plain.join(means, [by, "measure"], "left").select(by, "measure", "mean", low.alias("low"), high.alias("high"))


def compared(one: DataFrame, other: DataFrame, measures: list[str], question: str, by: str, replicates: int = DEFAULT.report_replicates, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(by, measure, mean, low, high, above): the difference between two rankings of the same questions, and in how many
    replicates the first is above. Both get the same weights, so what is hard for both cancels out."""
    pair = one.select(by, F.col(question), *(F.col(m).alias(f"_{m}") for m in measures)).join(other.select(by, F.col(question), *measures), [by, question])
    gaps = pair.select(by, question, *((F.col(f"_{m}") - F.col(m)).alias(m) for m in measures))
    found = bootstrap(gaps, measures, question, by, replicates, seed, level)
    above = _replicates(gaps, measures, question, [by], replicates, seed).groupBy(by, "measure").agg(F.avg((F.col("mean") > 0).cast("double")).alias("above"))
    return found.join(above, [by, "measure"], "left")


def against_targets(measured: DataFrame, question: str, replicates: int = DEFAULT.report_replicates, seed: int = 7) -> DataFrame:
    """(measure, mean, low, high, target, met): all questions together against TARGETS; met if the whole interval reaches it."""
    found = bootstrap(measured.withColumn("_all", F.lit("all")), list(TARGETS), question, "_all", replicates, seed)
    target = F.element_at(F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv)), F.col("measure"))
    return found.select("measure", "mean", "low", "high", target.alias("target"), (F.col("low") >= target).alias("met"))


def write_report(measured: DataFrame, path: str) -> None:
    """The report as JSON files."""
    report(measured).write.mode("overwrite").json(path)
