"""The two extraction methods, put together from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks, decide, prune, rangealg, ranges, segment, windows
from ..operators.prune import Settings


def judged_blocks(lines: DataFrame, key: str = "file") -> DataFrame:
    """Blocks with ``error``: our rule is that a block with a hard anchor has one."""
    marked = prune.anchored(segment.in_blocks(lines, key=key))
    return marked.groupBy(key, "block_id").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end"), F.max(F.col("p0").isNotNull()).alias("error"))


def chosen_lines(lines: DataFrame, cutoff: int = 10, key: str = "file") -> DataFrame:
    """Lines, with block_id and p0, of the blocks that hold a hit and an error and that judgment reaches.

    Judgment goes from the last block with a hit back and ends after ``cutoff`` clean ones
    in a row once there was an error. A block is judged at its last line, so that windows
    over a file do for it and lines are dealt once.
    """
    block, back = Window.partitionBy(key, "block_id"), Window.partitionBy(key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    found = prune.anchored(segment.in_blocks(blocks.hits(lines, key=key), key=key))
    found = found.withColumns({"_error": F.max(F.col("p0").isNotNull()).over(block), "_hit": F.max("hit").over(block), "_end": F.max("line_no").over(block)})
    judged = F.col("_hit") & (F.col("line_no") == F.col("_end"))
    found = found.withColumn("_clean", F.count_if(judged & ~F.col("_error")).over(back))
    run = F.col("_clean") - F.last(F.when(judged & F.col("_error"), F.col("_clean")), True).over(back)
    found = found.withColumn("_stop", F.when(judged & (run >= cutoff), F.col("line_no")))
    found = found.withColumn("_stop", F.max("_stop").over(Window.partitionBy(key)))
    kept = found.filter(F.col("_error") & F.col("_hit") & (F.col("_stop").isNull() | (F.col("_end") >= F.col("_stop"))))
    return kept.drop("_error", "_hit", "_end", "_clean", "_stop")


def error_ranges(lines: DataFrame, settings: Settings = Settings(), cutoff: int = 10, key: str = "file") -> DataFrame:
    """Method 1 without a model: key, block_id, start, end of what stays of blocks that hold an error.

    Segmentation, keyword filter, judgment by rule from the last block back with its early
    stop, and simple pruning of each block that remains.
    """
    part = [key, "block_id"]
    return prune.relevant_ranges(prune.simple_pruned(chosen_lines(lines, cutoff, key), settings, part), part)


def method_two(lines: DataFrame, size: int = 300, step: int = 270, key: str = "file") -> DataFrame:
    """Method 2 up to the question for each window: windows over the ranges between markers."""
    found = ranges.log_ranges(lines, key=key).select(key, "start", "end").distinct()
    return windows.windows(found, size, step).select(key, "start", "end", "w_start", "w_end")


def window_ranges(lines: DataFrame, settings: Settings = Settings(), size: int = 300, step: int = 270, key: str = "file") -> DataFrame:
    """Method 2 without a model: key, start, end of what windows find, merged.

    Our rule for a window: its hard lines, if one of them is an anchor. What an earlier
    window found is not found again, since ranges that touch are merged.
    """
    hard = prune.hard_protected(lines.select(key, "line_no", "text"), settings, key)
    asked = method_two(lines, size, step, key)
    held = rangealg.overlapping(
        rangealg.lines_to_ranges(hard.filter("hard"), key).select(key, F.col("start").alias("a_start"), F.col("end").alias("a_end")),
        asked.select(key, F.col("w_start").alias("b_start"), F.col("w_end").alias("b_end")),
        key,
    )
    found = held.select(key, F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))
    return rangealg.merged(found, key)


def chosen_method(lines: DataFrame, key: str = "file") -> DataFrame:
    """key, method of each file by rule: 1 where a keyword or a hard anchor was found, else 2."""
    found = prune.anchored(blocks.hits(lines, key=key))
    return found.groupBy(key).agg(decide.rule_method(F.count_if("hit"), F.count("p0")).cast("int").alias("method"))
