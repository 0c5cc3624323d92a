"""Ranges of a log between step markers and error markers, by as-of lookups in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import EXIT_MARK, GROUP_MARK
from ..functions.predicates import is_cleanup_mark, is_end_mark, is_error_mark, is_group_mark

FILE = "file"


def _line(flag: Column) -> Column:
    return F.when(flag, F.col("line_no"))


def _before(key: str, to: int):
    return Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, to)


def _after(key: str, to: int):
    """What follows, read backwards: a frame to the end would be read anew for each row."""
    return Window.partitionBy(key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, to)


def _start(key: str) -> Column:
    return F.coalesce(F.last(_line(is_group_mark(F.col("text"))), True).over(_before(key, -1)), F.lit(1)).cast("long")


def _end(key: str) -> Column:
    mark = _line(is_group_mark(F.col("text")) | is_cleanup_mark(F.col("text")))
    total = F.max("line_no").over(Window.partitionBy(key))
    return F.when(F.col("text").startswith(EXIT_MARK), F.col("line_no")).otherwise(F.coalesce(F.last(mark, True).over(_after(key, -1)) - 1, total)).cast("long")


def error_starts(lines: DataFrame, key: str = FILE) -> DataFrame:
    """Error markers with start: the nearest group marker strictly before, else line 1."""
    return lines.withColumn("start", _start(key)).filter(is_error_mark(F.col("text"))).select(key, F.col("line_no").alias("error_line"), "start")


def error_ends(lines: DataFrame, key: str = FILE) -> DataFrame:
    """Error markers with end: itself if it tells the exit code, else the line before the next group or cleanup marker, else the last line."""
    return lines.withColumn("end", _end(key)).filter(is_error_mark(F.col("text"))).select(key, F.col("line_no").alias("error_line"), "end")


def with_named(lines: DataFrame, steps: DataFrame | None, key: str = FILE) -> DataFrame:
    """Lines with ``named``: group markers that name one of ``steps`` (name), those of the same file where steps have the key.

    The steps of a file are one row of few names, so lines meet them by the key alone;
    steps without the key are one row for all files.
    """
    if steps is None:
        return lines.withColumn("named", F.lit(False))
    prefix = F.concat(F.lit(GROUP_MARK), F.regexp_replace("name", "^(?i)run ", ""))
    of = [key] if key in steps.columns else []
    listed = steps.filter("name <> ''").groupBy(*of).agg(F.collect_set(prefix).alias("_named"))
    met = lines.join(listed, key, "left") if of else lines.crossJoin(F.broadcast(listed))
    named = is_group_mark(F.col("text")) & F.exists(F.coalesce("_named", F.array().cast("array<string>")), lambda p: F.col("text").startswith(p))
    return met.withColumn("named", named).drop("_named")


def step_starts(lines: DataFrame, steps: DataFrame, key: str = FILE) -> DataFrame:
    """Error markers with step_start: the last group marker up to them that names one of ``steps``."""
    found = with_named(lines, steps, key).withColumn("step_start", F.last(_line(F.col("named")), True).over(_before(key, 0)))
    return found.filter(is_error_mark(F.col("text"))).select(key, F.col("line_no").alias("error_line"), "step_start")


def log_ranges(lines: DataFrame, steps: DataFrame | None = None, key: str = FILE) -> DataFrame:
    """start, end, workflow_end (the first end-of-group marker inside, null without one) and seq of each range.

    A range is made for each start, up to the end of its last error marker; ``seq`` is the
    order in which its starts first appear. A file without error markers is one range: from
    the last named step to the cleanup marker, if a step is named, else all of it, which
    has no workflow. All is found in windows over a file, in one pass.
    """
    text, error = F.col("text"), F.col("_error")
    out = with_named(lines.select(key, "line_no", "text"), steps, key)
    out = out.withColumns({"_error": is_error_mark(text), "_mark": F.last(_line(is_end_mark(text)), True).over(_after(key, 0)), "_clean": F.last(_line(is_cleanup_mark(text)), True).over(_after(key, 0)), "end": _end(key)})
    place = F.struct("line_no", F.col("_mark").alias("mark"), F.col("_clean").alias("clean"))
    top = F.struct(F.lit(1).cast("long").alias("line_no"), F.min(_line(is_end_mark(text))).over(Window.partitionBy(key)).alias("mark"), F.lit(None).cast("long").alias("clean"))
    named = F.last(F.when(F.col("named"), place), True).over(_before(key, 0))
    group = F.last(F.when(is_group_mark(text), place), True).over(_before(key, -1))
    typed = lambda c: c.cast("struct<line_no:bigint,mark:bigint,clean:bigint>")
    out = out.withColumns({"_some": F.max(error).over(Window.partitionBy(key)), "_from": F.coalesce(typed(named), typed(group), typed(top)), "_named": typed(named)})
    # Error markers by their start; all lines of a file without any, which tell of the last step that is named.
    rows = out.filter(error | ~F.col("_some")).withColumn("start", F.when(F.col("_some"), F.col("_from.line_no")).otherwise(F.lit(0)))
    found = rows.groupBy(key, "start").agg(F.min("line_no").alias("first"), F.max_by("end", "line_no").alias("end"), F.first("_from").alias("_from"), F.max("_named").alias("_named"), F.max("line_no").alias("n"))
    step, whole = F.col("_named"), F.col("start") == 0
    found = found.select(
        key,
        "first",
        F.when(~whole, F.col("start")).otherwise(F.coalesce(step["line_no"], F.lit(1))).cast("long").alias("start"),
        F.when(~whole, F.col("end")).when(step.isNull(), F.col("n")).otherwise(F.coalesce(step["clean"], F.col("n"))).cast("long").alias("end"),
        F.when(~whole, F.col("_from.mark")).otherwise(step["mark"]).cast("long").alias("mark"),
    )
    seq = F.row_number().over(Window.partitionBy(key).orderBy("first")).cast("long")
    return found.select(key, "start", "end", F.when(F.col("mark") <= F.col("end"), F.col("mark")).alias("workflow_end"), seq.alias("seq"))
