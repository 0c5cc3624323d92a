"""Blocks of logs that are still being written: an extra that the batch operators do not need.

Sessions by a fixed gap stand in for the adaptive threshold, which needs a file's rolling
statistics in line order; a watermark bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.predicates import any_of


def sessions(lines: DataFrame, gap: str = "30 seconds", late: str = "10 minutes", key: str = "file") -> DataFrame:
    """start, end, n_lines, n_errors of each stretch of lines (key, ts, text) without a gap."""
    hard = F.col("text").rlike(any_of([p for p, _ in P.P0], True))
    grouped = lines.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n_lines"), F.count_if(hard).alias("n_errors")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_lines", "n_errors")
