"""Batches: what is left to do, summaries, sums, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rangealg import ranges_to_lines

CASE = ["difficulty", "language", "repository", "post_id", "run_id"]


def pending(cases: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Cases without an output; a limit is applied before this, so that it counts finished ones too."""
    return cases.join(done.select(*on).distinct(), on, "left_anti")


def resumed(cases: DataFrame, done: DataFrame, previous: DataFrame, on: list[str], metrics: list[str], parallel: bool = False) -> DataFrame:
    """Finished cases as items: status, and figures of this output or else of the item of an earlier batch.

    An output that is no success is ``skipped``; the parallel runner calls each ``success``.
    """
    old = previous.select(*on, *[F.col(m).alias(f"old_{m}") for m in metrics])
    status = F.lit("success") if parallel else F.when(F.col("status") == "success", F.lit("success")).otherwise(F.lit("skipped"))
    return cases.join(done, on).join(old, on, "left").select(*on, status.alias("status"), *[F.coalesce(m, f"old_{m}").alias(m) for m in metrics])


def as_int(value: Column) -> Column:
    """A count from text, thousands commas allowed; null for what is none."""
    return F.regexp_replace(value, ",", "").try_cast("long")


def batch_summary(items: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counters, sums and the final status of the items of a batch."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = items.groupBy(*by).agg(F.count("*").alias("total"), n("success").alias("processed"), n("skipped").alias("skipped"), n("failed").alias("failed"), n("pending").alias("pending"), F.sum("tokens").alias("tokens"), F.round(F.sum("seconds"), 3).alias("seconds"))
    return out.withColumn("final_status", F.when(F.col("failed") > 0, "partial_failure").otherwise("success"))


def call_stats(calls: DataFrame, by: list[str]) -> DataFrame:
    """Model calls of each run: number, seconds, tokens (null if no call told any)."""
    return calls.groupBy(*by).agg(F.count("*").alias("llm_call_count"), F.round(F.sum("elapsed_seconds"), 3).alias("llm_elapsed_seconds"), F.sum(as_int(F.col("total_tokens"))).alias("total_tokens"), F.max(as_int(F.col("total_tokens")).isNotNull()).alias("token_count_available"))


def composition(cases: DataFrame, rows: str, columns: str) -> DataFrame:
    """Numbers by both columns, with totals."""
    return cases.cube(rows, columns).agg(F.count("*").alias("n"))


def line_scores(found: DataFrame, labelled: DataFrame, key: str | list[str] = "file") -> DataFrame:
    """Line-level precision, recall and F1 of each key, over the unions of both range sets."""
    keys = [key] if isinstance(key, str) else key

    def lines(ranges: DataFrame) -> DataFrame:
        return ranges.select(*keys, F.explode(F.sequence("start", "end")).alias("line_no")).distinct()

    both = lines(found).withColumn("p", F.lit(True)).join(lines(labelled).withColumn("t", F.lit(True)), [*keys, "line_no"], "full")
    out = both.groupBy(*keys).agg(F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("p") & F.col("t").isNull()).alias("fp"), F.count_if(F.col("t") & F.col("p").isNull()).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def extraction_stats(lines: DataFrame, chosen: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """total_log_lines of each run, total_error_blocks (``chosen`` lines in blocks) and pruned_blocks, those with a range left."""
    count = lambda rows, name: rows.groupBy(*by).agg(F.countDistinct("block_id").alias(name))
    out = lines.groupBy(*by).agg(F.count("*").alias("total_log_lines")).join(count(chosen, "total_error_blocks"), by, "left").join(count(ranges, "pruned_blocks"), by, "left")
    return out.fillna(0, ["total_error_blocks", "pruned_blocks"])


def react_stats(calls: DataFrame, by: list[str]) -> DataFrame:
    """Tool calls (tool, window, found) of each run: expansions, modifications and windows in which something was found."""
    return calls.groupBy(*by).agg(F.count_if(F.col("tool") == "expand").alias("expansions"), F.count_if(F.col("tool") == "modify").alias("modifications"), F.countDistinct(F.when(F.col("found"), F.col("window"))).alias("windows_with_errors"))


def averaged(scores: DataFrame) -> DataFrame:
    """Micro and macro averages of line_scores() rows: one row for each kind."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    total = scores.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    micro = F.struct(F.lit("micro").alias("kind"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    macro = F.struct(F.lit("macro").alias("kind"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    return total.select("n", F.inline(F.array(micro, macro)))
