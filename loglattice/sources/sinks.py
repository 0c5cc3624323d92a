"""Outputs of runs and batches. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import CASE

ITEMS = "difficulty string, language string, repository string, post_id string, run_id string, log_file string, status string, total_tokens bigint, elapsed_seconds double, written_at string"


def output_name(file_name: Column) -> Column:
    """A log's output folder: its name without the ending that all logs share."""
    return F.regexp_replace(F.regexp_replace(file_name, r"\.txt$", ""), "~whole_log$", "")


def summaries(found: DataFrame, by: list[str] = CASE) -> DataFrame:
    """One row for each case: its ranges as an array of [start, end], in order."""
    pairs = F.sort_array(F.collect_list(F.array("start", "end")))
    return found.groupBy(*by).agg(pairs.alias("error_ranges")).withColumn("status", F.lit("success"))


def write_summaries(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_batch(summary: DataFrame, path: str) -> None:
    """A batch summary is one row, so one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def previous_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of an earlier batch, the last for each log file; none where there is no readable one."""
    try:
        rows = spark.read.schema(ITEMS).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], ITEMS)
    last = rows.filter("log_file is not null").groupBy("log_file").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "log_file"]), "written_at").alias("x"))
    return last.select("log_file", "x.*")
