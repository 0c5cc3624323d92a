"""From a folder of cases to summaries, statistics and scores."""

from __future__ import annotations

import logging
import time
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batch
from ..operators.batch import CASE
from ..sources import cases, sinks
from .config import Config
from .methods import chosen_lines, chosen_method, error_ranges, window_ranges

log = logging.getLogger("loglattice")
RUN = [*CASE, "file_name"]


def prepared(lines: DataFrame) -> DataFrame:
    """Lines of cases with ``file`` (a key of the whole case and log), text and us."""
    return lines.select(F.concat_ws("/", *RUN).alias("file"), *RUN, F.col("line_no").cast("long").alias("line_no"), T.preprocessed(F.col("raw")).alias("text"), T.stamp_micros(F.col("raw")).alias("us"))


def checked(lines: DataFrame) -> DataFrame:
    """``lines``, if they have what the methods need."""
    missing = {"file", "line_no", "text", "us"} - set(lines.columns)
    if missing:
        raise ValueError(f"lines lack {sorted(missing)}")
    return lines


def parsed(lines: DataFrame, config: Config = Config(), method: int | None = None) -> DataFrame:
    """A summary for each log: method_used, extracted_errors (block, error_ranges) and statistics.

    The method is the rule's for each log, or ``method`` for all. A log without a range has
    an empty list and is a success, too. ``lines`` has file, line_no, text and us.
    """
    lines = checked(lines).select("file", "line_no", "text", "us")
    methods = chosen_method(lines) if method is None else lines.select("file").distinct().withColumn("method", F.lit(method))
    first, second = (lines.join(methods.filter(F.col("method") == m).select("file"), "file", "left_semi") for m in (1, 2))
    pair = F.array("start", "end")
    chosen = chosen_lines(first, config.judgment.cutoff)
    bounds = chosen.groupBy("file", "block_id").agg(F.array(F.min("line_no"), F.max("line_no")).alias("block"))
    found = error_ranges(first, config.pruning, config.judgment.cutoff)
    own = found.groupBy("file", "block_id").agg(F.sort_array(F.collect_list(pair)).alias("error_ranges"))
    ones = bounds.join(own, ["file", "block_id"], "left").select("file", "block", F.coalesce("error_ranges", F.array(F.col("block"))).alias("error_ranges"))
    size = config.windows.size
    twos = window_ranges(second, config.pruning, size, max(1, int(size * (1 - config.windows.file_overlap)))).select("file", pair.alias("block"), F.array(pair).alias("error_ranges"))
    errors = ones.union(twos).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "error_ranges"))).alias("extracted_errors"))
    totals = lines.groupBy("file").agg(F.count("*").alias("total_log_lines"))
    none = F.array().cast("array<struct<block:array<bigint>,error_ranges:array<array<bigint>>>>")
    out = totals.join(methods, "file").join(errors, "file", "left").withColumn("extracted_errors", F.coalesce("extracted_errors", none))
    stats = F.struct("total_log_lines", F.size("extracted_errors").cast("long").alias("total_error_blocks"), F.size(F.filter("extracted_errors", lambda x: F.size(x["error_ranges"]) > 0)).cast("long").alias("pruned_blocks"))
    return out.select("file", F.lit("success").alias("status"), F.col("method").cast("int").alias("method_used"), "extracted_errors", stats.alias("statistics"))


def earlier(spark: SparkSession, path: str) -> DataFrame | None:
    """Summaries that a batch has left at ``path``; None without any that can be read."""
    try:
        found = spark.read.json(f"{path}/summaries")
    except AnalysisException:
        return None
    return found if set(RUN) <= set(found.columns) else None


def parse_bench(spark: SparkSession, root: str, out: str, config: Config = Config(), method: int | None = None, limit: int | None = None, resume: bool = False, **filters: str | None) -> dict:
    """Parse the logs of ``root`` into ``out``/summaries, a JSON object a log, and ``out``/batch; gives the batch's figures.

    With ``resume``, logs that have a summary in ``out`` are skipped and theirs stay.
    """
    began, started = time.time(), datetime.now(timezone.utc)
    logs = cases.discover(spark, root, limit, **filters).select(*RUN)
    lines = cases.log_lines(spark, root, **filters)
    if limit is not None:
        lines = lines.join(logs, RUN, "left_semi")
    done = earlier(spark, out) if resume else None
    if done is not None:
        lines = lines.join(done.select(*RUN).distinct(), RUN, "left_anti")
    lines = prepared(lines)
    keys = lines.select("file", *RUN).distinct()
    found = parsed(lines, config, method).join(keys, "file").drop("file")
    spent = F.struct(F.lit(started.isoformat()).alias("started_at"), F.lit(0).alias("llm_call_count"), F.lit(0.0).alias("llm_elapsed_seconds"), F.lit(0).cast("long").alias("total_tokens"), F.lit(False).alias("token_count_available"))
    found.withColumn("run_statistics", spent).write.mode("append" if done is not None else "overwrite").json(f"{out}/summaries")
    every = logs.join(spark.read.json(f"{out}/summaries").select(*RUN, "status"), RUN, "left")
    old = done.select(*RUN, F.lit(True).alias("old")) if done is not None else logs.limit(0).withColumn("old", F.lit(True))
    items = every.join(old, RUN, "left").withColumn("status", F.when(F.col("old"), F.lit("skipped")).otherwise(F.coalesce("status", F.lit("pending")))).withColumns({"tokens": F.lit(0).cast("long"), "seconds": F.lit(0.0)})
    summary = batch.batch_summary(items).drop("seconds").withColumns({"raw_data_dir": F.lit(root), "output_root": F.lit(out), "started_at": F.lit(started.isoformat()), "completed_at": F.lit(datetime.now(timezone.utc).isoformat()), "elapsed_seconds": F.lit(round(time.time() - began, 3))})
    sinks.write_batch(summary, f"{out}/batch")
    figures = spark.read.json(f"{out}/batch").first().asDict()
    log.info("%s of %s logs parsed", figures["processed"], figures["total"])
    return figures


def evaluated(spark: SparkSession, out: str, review: str, **filters: str | None) -> tuple[DataFrame, DataFrame]:
    """Line scores of each labelled case, and their micro and macro averages; a case without a summary has found nothing."""
    labelled = cases.labels(spark, review, **filters)
    done = earlier(spark, out)
    if done is None:
        raise ValueError(f"no summaries in {out}")
    found = done.select(*CASE, F.explode("extracted_errors").alias("x")).select(*CASE, F.explode("x.error_ranges").alias("r")).select(*CASE, F.col("r")[0].cast("int").alias("start"), F.col("r")[1].cast("int").alias("end"))
    known = found.join(labelled.select(*CASE).distinct(), CASE, "left_semi")
    scores = batch.line_scores(known, labelled, CASE)
    return scores, batch.averaged(scores)
