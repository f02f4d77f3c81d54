"""Evidence for an answer: blocks within a budget, citations, and the history of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.secrets import MARKER
from ..session import written


def block(name: Column, path: Column, start: Column, end: Column, kind: Column, language: Column, doc: Column, code: Column, with_code: bool = True) -> Column:
    """What is said of a symbol: head, place, language, documentation and, if nothing in it is redacted, code."""
    none = F.lit(None).cast("string")
    shown = F.lit(with_code) & (F.coalesce(F.length(code), F.lit(0)) > 0) & ~F.contains(code, F.lit(MARKER[:-1]))
    lang = F.coalesce(language, F.lit(""))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("--- "), F.upper(F.coalesce(kind, F.lit("?"))), F.lit(": "), F.coalesce(F.nullif(name, F.lit("")), F.lit("?")), F.lit(" ---")),
        F.concat(F.lit("Location: "), F.coalesce(path, F.lit("?")), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")),
        F.when(lang != "", F.concat(F.lit("Language: "), lang)).otherwise(none),
        F.when(F.coalesce(F.length(doc), F.lit(0)) > 0, F.concat(F.lit("Documentation: "), F.substring(doc, 1, 300))).otherwise(none),
        F.when(shown, F.concat_ws("\n", F.concat(F.lit("```"), lang), F.substring(code, 1, 2000), F.lit("```"))).otherwise(none),
    )


def within_budget(rows: DataFrame, by: str, order: str, size: str, budget: int = DEFAULT.context_chars, used: int = 0) -> DataFrame:
    """rows that fit one after another, larger ones passed over: kept while used + their size < budget.

    The fold runs over one ordered array for each group, which ranking has bounded before.
    """
    items = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("items"))
    start = F.struct(F.lit(used).cast("long").alias("used"), F.array().cast(f"array<{dict(rows.dtypes)[order]}>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["s"] < budget, F.struct((a["used"] + x["s"]).alias("used"), F.concat(a["kept"], F.array(x["o"])).alias("kept"))).otherwise(a)
    chosen = items.select(by, F.explode(F.aggregate("items", start, step)["kept"]).alias(order))
    return rows.join(chosen, [by, order])


def until_overflow(rows: DataFrame, by: str, order: str, size: str, budget: int = DEFAULT.context_chars) -> DataFrame:
    """rows up to the first that doesn't fit, with their running total."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") < budget)


def citations(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows without those whose (file_path, start_line) an earlier row of the group has."""
    w = Window.partitionBy(by, "file_path", "start_line").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def history(messages: DataFrame, conversation: str = "conv_id", order: str = "turn", first: int = 10, last: int = 4) -> DataFrame:
    """The last four of the first ten messages of each conversation."""
    up = Window.partitionBy(conversation).orderBy(order)
    early = messages.withColumn("_n", F.row_number().over(up)).where(F.col("_n") <= first)
    down = Window.partitionBy(conversation).orderBy(F.desc("_n"))
    return early.withColumn("_m", F.row_number().over(down)).where(F.col("_m") <= last).drop("_n", "_m")


def history_line(role: Column, content: Column) -> Column:
    return F.concat(F.upper(role), F.lit(": "), F.substring(content, 1, 500))


def assembled(questions: DataFrame, primary: DataFrame, related: DataFrame, repository: str, budget: int = DEFAULT.context_chars) -> DataFrame:
    """(query_id, context) for questions (query_id, text, intent).

    primary and related have query_id, rank and the columns of ``block``. Primary blocks that
    fit are taken, then related ones without code up to the first that doesn't; references to
    all primary rows follow. Parts are joined by blank lines, which count for nothing.
    """
    cols = [F.col(c) for c in ("qualified_name", "file_path", "start_line", "end_line", "symbol_type", "language", "documentation")]
    first = primary.withColumn("block", block(*cols, F.col("code_snippet"))).withColumn("size", F.length("block"))
    head = F.concat(F.lit(f"REPOSITORY: {repository}\nQUESTION: "), F.col("text"), F.lit("\nDETECTED_INTENT: "), F.col("intent"), F.lit("\n"))
    title = "=== PRIMARY EVIDENCE ==="
    sized = first.join(questions.select("query_id", F.length(head).alias("_h")), "query_id").withColumn("order", F.col("rank"))
    opening = sized.select("query_id", F.lit(0).alias("order"), (F.col("_h") + len(title)).alias("size"), F.lit("").alias("block")).distinct()
    kept = within_budget(opening.union(sized.select("query_id", "order", "size", "block")), "query_id", "order", "size", budget)
    text = written(kept.where("order > 0").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("order", "block"))).alias("p"), F.sum("size").alias("_p")), "primary")  # read twice
    refs = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("• "), F.coalesce("qualified_name", F.lit("?")), F.lit(" @ "), F.coalesce("file_path", F.lit("?")), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("ref")))).alias("r"))
    near = related.withColumn("block", block(*cols, F.lit(None).cast("string"), with_code=False)).withColumn("size", F.length("block"))
    used = opening.select("query_id", F.col("size").alias("_open")).join(text.select("query_id", "_p"), "query_id", "left").select("query_id", (F.col("_open") + F.coalesce("_p", F.lit(0)) + len("=== RELATED CONTEXT ===")).alias("_used"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = near.join(used, "query_id").withColumn("_run", F.sum("size").over(w)).where(F.col("_used") + F.col("_run") < budget)
    more = fits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("n"))
    all_ = questions.join(text, "query_id", "left").join(more, "query_id", "left").join(refs, "query_id", "left")
    lines = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "\n\n")
    part = lambda c, t, f: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}\n\n"), lines(F.col(c), f)))
    return all_.select("query_id", F.concat_ws("\n\n", head, part("p", title, "block"), part("n", "=== RELATED CONTEXT ===", "block"), part("r", "=== SOURCE REFERENCES ===", "ref")).alias("context"))
