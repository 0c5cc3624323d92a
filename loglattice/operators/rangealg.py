"""Algebra of inclusive line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

FILE = "file"


def listed(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def merged(ranges: DataFrame, key: str = FILE) -> DataFrame:
    """Ranges united where they overlap or touch."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.col("reach") + 1, 1).otherwise(0)).over(order)
    return ranges.withColumn("reach", reach).withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def lines_to_ranges(lines: DataFrame, key: str | list[str] = FILE) -> DataFrame:
    """Runs of consecutive line numbers (distinct) as ranges."""
    keys = listed(key)
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))
    return lines.select(*keys, "line_no").distinct().withColumn("island", island).groupBy(*keys, "island").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end")).drop("island")


def ranges_to_lines(ranges: DataFrame, key: str = FILE) -> DataFrame:
    return ranges.select(key, F.explode(F.sequence("start", "end")).alias("line_no")).distinct()


def kept_ranges(blocks: DataFrame, deleted: DataFrame, key: str = FILE) -> DataFrame:
    """Ranges of lines of the blocks that are not among ``deleted`` (key, line_no)."""
    return lines_to_ranges(ranges_to_lines(blocks, key).join(deleted, [key, "line_no"], "left_anti"), key)


def overlapping(a: DataFrame, b: DataFrame, key: str = FILE, cell: int = 1024) -> DataFrame:
    """Rows of ``a`` (a_start, a_end) with those of ``b`` (b_start, b_end) that they overlap, one row for each pair.

    They meet by cells of ``cell`` lines, in the first that both reach.
    """
    parts = lambda rows, x: rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f"{x}_start") / cell), F.floor(F.col(f"{x}_end") / cell))))
    met = parts(a, "a").join(parts(b, "b"), [key, "_cell"]).filter("a_start <= b_end and b_start <= a_end")
    return met.filter(F.col("_cell") == F.floor(F.greatest("a_start", "b_start") / cell)).drop("_cell")


def subtracted(blocks: DataFrame, ranges: DataFrame, key: str = FILE) -> DataFrame:
    """Each block (start, end) without the ranges, as b_start, b_end, start, end; no line is listed.

    What is left begins at the block's start or after a merged range, and ends where the
    next merged range begins, or with the block.
    """
    united = merged(ranges, key)
    order = Window.partitionBy(key).orderBy("start")
    gaps = united.select(key, (F.col("end") + 1).alias("start"), (F.lead("start").over(order) - 1).alias("end"))
    first = united.groupBy(key).agg((F.min("start") - 1).alias("head"), F.max("end").alias("last"))
    b = blocks.select(key, F.col("start").alias("b_start"), F.col("end").alias("b_end")).join(first, key, "left")
    # Before the first range and after the last there is one piece at most; only gaps between ranges are looked up.
    head = b.filter("head is null or b_start <= head").select(key, "b_start", "b_end", F.col("b_start").alias("start"), F.least("b_end", "head").alias("end"))
    tail = b.filter("b_end > last").select(key, "b_start", "b_end", F.greatest(F.col("b_start"), F.col("last") + 1).alias("start"), F.col("b_end").alias("end"))
    inner = gaps.filter("end is not null").select(key, F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    between = overlapping(inner, b.select(key, "b_start", "b_end"), key).select(key, "b_start", "b_end", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))
    return head.union(tail).union(between)


def trimmed_against(new: Column, previous: Column) -> Column:
    """A new range (struct s, e) trimmed by earlier ones, in their order; null if nothing is left.

    Inside an earlier one: gone. Reaching out of one on one side: cut to what is outside.
    Around one: as it is. Later ones see the cut range.
    """

    def step(x: Column, p: Column) -> Column:
        inside = (p["s"] <= x["s"]) & (x["e"] <= p["e"])
        right = (p["s"] <= x["s"]) & (x["s"] <= p["e"]) & (p["e"] < x["e"])
        left = (x["s"] < p["s"]) & (p["s"] <= x["e"]) & (x["e"] <= p["e"])
        s, e = F.when(right, p["e"] + 1).otherwise(x["s"]), F.when(left, p["s"] - 1).otherwise(x["e"])
        return F.when(x["gone"], x).when(inside, F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(True).alias("gone"))).otherwise(F.struct(s.alias("s"), e.alias("e"), F.lit(False).alias("gone")))

    first = F.struct(new["s"].alias("s"), new["e"].alias("e"), F.lit(False).alias("gone"))
    return F.aggregate(previous, first, step, lambda x: F.when(~x["gone"] & (x["s"] <= x["e"]), F.struct(x["s"].alias("s"), x["e"].alias("e"))))


def not_contained(ranges: DataFrame, existing: DataFrame, key: str = FILE) -> DataFrame:
    """Ranges that no existing one wholly contains.

    A range is contained if, of the existing ones that start no later, some one ends no
    earlier: a running maximum over both, so that no pairs are made.
    """
    both = ranges.select(key, "start", "end", F.lit(1).alias("new")).union(existing.select(key, "start", "end", F.lit(0).alias("new")))
    order = Window.partitionBy(key).orderBy("start", "new").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("new") == 0, F.col("end"))).over(order)
    return both.withColumn("reach", reach).filter("new = 1 and (reach is null or reach < `end`)").select(key, "start", "end")


def repeated(lines: DataFrame, hard: str | None = None, least: int = 3, key: str | list[str] = FILE) -> DataFrame:
    """Lines with ``repeated``: inside a run of ``least`` or more equal, not blank lines, its first and last left out. A hard line breaks a run."""
    keys = listed(key)
    order = Window.partitionBy(*keys).orderBy("line_no")
    marked = lines.withColumn("_body", trimmed(F.col("text"))).withColumn("_stop", (F.col(hard) if hard else F.lit(False)) | (F.col("_body") == ""))
    new = F.col("_stop") | F.coalesce(F.lag("_stop").over(order), F.lit(True)) | (F.col("_body") != F.lag("_body").over(order))
    runs = marked.withColumn("_run", F.sum(new.cast("int")).over(order))
    within = Window.partitionBy(*keys, "_run")
    counted = runs.withColumns({"_nth": F.row_number().over(within.orderBy("line_no")), "_of": F.count("*").over(within)})
    inside = ~F.col("_stop") & (F.col("_of") >= least) & (F.col("_nth") > 1) & (F.col("_nth") < F.col("_of"))
    return counted.withColumn("repeated", inside).drop("_body", "_stop", "_run", "_nth", "_of")


def duplicate_runs(lines: DataFrame, hard: str | None = None, least: int = 3, key: str | list[str] = FILE) -> DataFrame:
    """The lines that ``repeated`` marks."""
    return repeated(lines, hard, least, key).filter("repeated").select(*listed(key), "line_no")
