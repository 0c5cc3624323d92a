"""Adaptive segmentation of logs by gaps between time stamps.

Inputs have the key column, line_no, text and us (microseconds, null without a stamp). All
flags are columns made in windows over a file, so lines are read and dealt once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_indented

FILE = "file"


def gaps(lines: DataFrame, key: str = FILE) -> DataFrame:
    """Lines with gap_us to the stamped line before; null on lines without a stamp and on the first with one."""
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("gap_us", F.col("us") - F.last("us", True).over(before))


def intervals(lines: DataFrame, key: str = FILE) -> DataFrame:
    """Stamped lines with gap_us, which the first one lacks."""
    return gaps(lines, key).filter("gap_us is not null")


def measured(lines: DataFrame, window: int = 50, key: str = FILE) -> DataFrame:
    """gaps() lines with n, sum_us and sum_sq of the last ``window`` gaps, this one included; exact integers.

    Gaps are numbered, and the frame is over their numbers, which lines without a gap share.
    """
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    frame = Window.partitionBy(key).orderBy("_gap").rangeBetween(1 - window, 0)
    x = F.col("gap_us").cast("decimal(16,0)")
    out = gaps(lines, key).withColumn("_gap", F.count("gap_us").over(upto))
    return out.withColumns({
        "n": F.count("gap_us").over(frame),
        "sum_us": F.sum("gap_us").over(frame),
        "sum_sq": F.sum((x * x).cast("decimal(28,0)")).over(frame).cast("decimal(38,0)"),
    }).drop("_gap")


def rolling(lines: DataFrame, window: int = 50, key: str = FILE) -> DataFrame:
    """intervals() with the statistics of ``measured``."""
    return measured(lines, window, key).filter("gap_us is not null")


def guarded(lines: DataFrame, key: str = FILE, reach: int = 3) -> DataFrame:
    """Lines with ``guarded``: all lines up to ``reach`` away begin with white space."""
    frame = Window.partitionBy(key).orderBy("line_no").rowsBetween(-reach, reach)
    return lines.withColumn("indented", is_indented(F.col("text"))).withColumn("guarded", F.min("indented").over(frame))


def flagged(lines: DataFrame, k: int = 3, window: int = 50, least_us: int = 10_000, key: str = FILE) -> DataFrame:
    """measured() lines with ``split``: whether a line begins a block, by a gap over the rolling mean plus ``k`` sample deviations.

    Compared without division or roots. Gap and threshold are ``least_us`` at least, and a
    line in the midst of indented ones does not split.
    """
    n = F.col("n").cast("decimal(4,0)")
    spread = (n * F.col("sum_sq") - F.col("sum_us").cast("decimal(16,0)") * F.col("sum_us").cast("decimal(16,0)")).cast("decimal(33,0)")

    def above(x):
        d = (n * x.cast("decimal(12,0)") - F.col("sum_us").cast("decimal(16,0)")).cast("decimal(16,0)")
        return (d > 0) & ((d * d).cast("decimal(33,0)") * (n - 1) > F.lit(k * k).cast("decimal(4,0)") * n * spread)

    wide = (F.col("n") >= 2) & (F.col("gap_us") >= least_us) & above(F.col("gap_us")) & ~above(F.lit(least_us))
    return guarded(measured(lines, window, key), key).withColumn("split", F.coalesce(wide & ~F.col("guarded"), F.lit(False))).drop("indented", "guarded")


def split_points(lines: DataFrame, k: int = 3, window: int = 50, least_us: int = 10_000, key: str = FILE) -> DataFrame:
    """The lines that begin a block."""
    return flagged(lines, k, window, least_us, key).filter("split").select(key, "line_no", "gap_us", "n", "sum_us")


def in_blocks(lines: DataFrame, splits: DataFrame | None = None, key: str = FILE, **settings: int) -> DataFrame:
    """Lines with block_id (from 0). Lines outside the stamped part of a file belong to no block.

    Without ``splits`` (lines that begin a block, by any rule), blocks begin where
    ``flagged`` says so, in the same pass. A file without stamps is one block.
    """
    order, whole = Window.partitionBy(key).orderBy("line_no"), Window.partitionBy(key)
    if splits is None:
        marked = flagged(lines, key=key, **settings).select(*lines.columns, "split")
    else:
        marked = lines.join(splits.select(key, "line_no", F.lit(True).alias("split")), [key, "line_no"], "left")
    stamped = F.when(F.col("us").isNotNull(), F.col("line_no"))
    marked = marked.withColumns({"_lo": F.min(stamped).over(whole), "_hi": F.max(stamped).over(whole), "block_id": F.sum(F.coalesce("split", F.lit(False)).cast("int")).over(order)})
    return marked.filter(F.col("_lo").isNull() | F.col("line_no").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "split")


def segments(lines: DataFrame, splits: DataFrame | None = None, key: str = FILE) -> DataFrame:
    """Blocks: block_id, start, end of each file, and timestamp_success: whether the file has stamps."""
    return in_blocks(lines, splits, key).groupBy(key, "block_id").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end"), (F.count("us") > 0).alias("timestamp_success"))


def segment_stats(lines: DataFrame, key: str = FILE) -> DataFrame:
    """Gaps and blocks of each file that has gaps."""
    found = flagged(lines, key=key).filter("gap_us is not null").groupBy(key)
    stats = found.agg(F.count("*").alias("n_gaps"), F.sum("gap_us").alias("sum_us"), F.max("gap_us").alias("max_us"), F.min("gap_us").alias("min_us"), F.count_if("split").alias("n_splits"))
    return stats.withColumn("n_blocks", F.col("n_splits") + 1)
