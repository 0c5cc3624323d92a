"""Overlapping windows over line numbers, their budget, and votes on deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = "file"


def stride(size: int, overlap: float) -> int:
    return max(1, int(size * (1 - overlap)))


def window_count(length: Column, size: int = 300, step: int = 210) -> Column:
    return F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / step) + 1).cast("long")


def windows(blocks: DataFrame, size: int = 300, step: int = 210) -> DataFrame:
    """A row for each window of each block (start, end): w_start, w_end; the last ends with the block."""
    n = window_count(F.col("end") - F.col("start") + 1, size, step)
    out = blocks.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return out.withColumns({"w_start": F.col("start") + F.col("w") * step, "w_end": F.least(F.col("end"), F.col("start") + F.col("w") * step + size - 1)})


def over_budget(blocks: DataFrame, size: int = 300, step: int = 210, max_windows: int = 20, max_lines: int = 5000) -> DataFrame:
    """Blocks with n_lines, n_windows and keep_whole: too many windows or lines to ask about."""
    n = F.col("end") - F.col("start") + 1
    return blocks.withColumns({"n_lines": n, "n_windows": window_count(n, size, step)}).withColumn("keep_whole", (F.col("n_windows") > max_windows) | (F.col("n_lines") > max_lines))


def memberships(lines: DataFrame, size: int = 300, step: int = 210) -> DataFrame:
    """Lines (line_no, start, end of their block) times the windows that hold them, by arithmetic and without a join."""
    offset = F.col("line_no") - F.col("start")
    n = window_count(F.col("end") - F.col("start") + 1, size, step)
    last = F.least(F.floor(offset / step), n - 1)
    first = F.greatest(F.ceil((offset - size + 1) / step), F.lit(0))
    return lines.withColumn("w", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def votes(members: DataFrame, deletions: DataFrame, failed: DataFrame | None = None, key: str = FILE) -> DataFrame:
    """key, line_no of lines that every covering window deletes.

    ``deletions`` has key, start, w, line_no; ``failed`` has key, start, w of windows whose
    answer is missing: they delete nothing.
    """
    marked = members.join(deletions.select(key, "start", "w", "line_no", F.lit(True).alias("gone")), [key, "start", "w", "line_no"], "left")
    gone = F.coalesce("gone", F.lit(False))
    if failed is not None:
        marked = marked.join(failed.select(key, "start", "w", F.lit(True).alias("lost")), [key, "start", "w"], "left")
        gone = gone & F.col("lost").isNull()
    return marked.groupBy(key, "line_no").agg(F.min(gone).alias("gone")).filter("gone").select(key, "line_no")


def file_windows(files: DataFrame, blocks: DataFrame | None = None, size: int = 300, step: int = 270, most: int = 10_000, key: str = FILE) -> DataFrame:
    """w_start, w_end of windows over whole files (key, n_lines); a window that would touch a block is skipped, and the next one begins after that block.

    Blocks are those of one file, in an array; the fold over it is within a row.
    """
    if blocks is None:
        out = files.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.least(window_count(F.col("n_lines"), size, step), F.lit(most)) - 1))).filter("n_lines > 0")
        return out.select(key, (F.col("w") * step + 1).alias("w_start"), F.least(F.col("n_lines"), F.col("w") * step + size).alias("w_end"))
    listed = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e")))).alias("blocks"))
    rows = files.join(listed, key, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    # Each step makes a window or passes a block, so this many are enough.
    turns = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n_lines") / step) + F.size("blocks") + 1)
    state = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def turn(s: Column, _: Column) -> Column:
        end = F.least(F.col("n_lines"), s["at"] + size - 1)
        met = F.filter("blocks", lambda b: (b["s"] <= end) & (b["e"] >= s["at"]))
        made = F.struct(F.when(end == F.col("n_lines"), F.col("n_lines") + 1).otherwise(s["at"] + step).cast("long").alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("s"), end.alias("e")))).alias("out"))
        passed = F.struct((met[0]["e"] + 1).cast("long").alias("at"), s["out"].alias("out"))
        return F.when((s["at"] > F.col("n_lines")) | (F.size(s["out"]) >= most), s).when(F.size(met) > 0, passed).otherwise(made)

    found = rows.withColumn("x", F.explode(F.aggregate(turns, state, turn, lambda s: s["out"])))
    return found.select(key, F.col("x.s").alias("w_start"), F.col("x.e").alias("w_end"))


def stretched(windows_: DataFrame, forward: int = 1, backward: int = 3, size: int = 300) -> DataFrame:
    """Windows with the bounds that one forward and ``backward`` backward extensions reach; the window itself is their base each time."""
    return windows_.withColumns({"f_end": F.least(F.col("n_lines"), F.col("w_end") + F.lit(size * min(forward, 1))), "b_start": F.greatest(F.lit(1), F.col("w_start") - F.lit(size if backward else 0))})
