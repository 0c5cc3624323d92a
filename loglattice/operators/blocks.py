"""Blocks with matches, reverse judgment and early stop, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.predicates import has_keyword, is_red
from ..functions.text import excerpt

FILE = "file"


def hits(lines: DataFrame, critical=tuple(P.CRITICAL_KEYWORDS), warning=tuple(P.WARNING_KEYWORDS), fewer_than: int = 2, key: str = FILE) -> DataFrame:
    """Lines with ``hit``: a critical keyword or red text; warnings count where a file has fewer than ``fewer_than`` hits."""
    whole = Window.partitionBy(key)
    first = has_keyword(F.col("text"), list(critical)) | is_red(F.col("text"))
    marked = lines.withColumns({"first": first, "warned": has_keyword(F.col("text"), list(warning))})
    marked = marked.withColumn("fallback", F.count_if("first").over(whole) < fewer_than)
    return marked.withColumn("hit", F.col("first") | (F.col("fallback") & F.col("warned")))


def blocks_with_hits(blocked: DataFrame, key: str = FILE) -> DataFrame:
    """Blocks that hold a hit; ``blocked`` has block_id and hit on lines, so no join is needed."""
    return blocked.groupBy(key, "block_id").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end"), F.count_if("hit").alias("n_hits")).filter("n_hits > 0")


def judged(blocks: DataFrame, key: str = FILE) -> DataFrame:
    """Blocks with their place from the end (seq), errors found up to them and clean blocks in a row before and with them."""
    back = Window.partitionBy(key).orderBy(F.desc("start"))
    run = Window.partitionBy(key, "errors").orderBy(F.desc("start"))
    out = blocks.withColumns({"seq": F.row_number().over(back), "errors": F.sum(F.col("error").cast("int")).over(back)})
    return out.withColumn("clean_run", F.sum((~F.col("error")).cast("int")).over(run))


def stops(judged_blocks: DataFrame, cutoff: int = 10, key: str = FILE) -> DataFrame:
    """The place where each file's traversal stops: ``cutoff`` clean blocks in a row after an error; null if nowhere."""
    return judged_blocks.groupBy(key).agg(F.min(F.when((F.col("clean_run") >= cutoff) & (F.col("errors") > 0), F.col("seq"))).alias("stop_seq"), F.count("*").alias("n_blocks"))


def visited(judged_blocks: DataFrame, cutoff: int = 10, key: str = FILE) -> DataFrame:
    """Blocks that the traversal reaches before or at its stop."""
    return judged_blocks.join(stops(judged_blocks, cutoff, key).select(key, "stop_seq"), key).filter("stop_seq is null or seq <= stop_seq")


def soft_checks(judged_blocks: DataFrame, over: int = 5) -> DataFrame:
    """Blocks after which a decision to stop is asked for: an even number of clean ones, more than ``over``."""
    return judged_blocks.filter((~F.col("error")) & (F.col("clean_run") > over) & (F.col("clean_run") % 2 == 0))


def expansion_limits(blocks: DataFrame, total: int = 10, key: str = FILE) -> DataFrame:
    """max_down and max_up of each block: clean blocks among the next three, counted past the end of the list."""
    order = Window.partitionBy(key).orderBy("start")
    nexts = [F.lead("error", i).over(order) for i in (1, 2, 3)]
    down = F.when(nexts[0].isNull(), 1).when(nexts[0], 0).when(nexts[1].isNull(), 2).when(nexts[1], 1).when(nexts[2].isNull(), 3).when(nexts[2], 2).otherwise(3)
    return blocks.withColumn("max_down", down).withColumn("max_up", F.lit(total) - F.col("max_down"))


def expanded(blocks: DataFrame, up: str = "up", down: str = "down", most: int = 10, key: str = FILE, verified: str | None = None) -> DataFrame:
    """Blocks with exp_start and exp_end: from ``up`` blocks before to ``down`` after (each at most ``most``), as far as there are any.

    A block that the column ``verified`` marks stops the way of others towards and past it.
    """
    order = Window.partitionBy(key).orderBy("start")
    wall = F.col(verified) if verified else F.lit(False)
    before = F.last(F.when(wall, F.col("_at")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(F.when(wall, F.col("_at")), True).over(Window.partitionBy(key).orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1))
    out = blocks.withColumn("_at", F.row_number().over(order))
    starts = F.array(F.col("start"), *[F.lag("start", i).over(order) for i in range(1, most + 1)])
    ends = F.array(F.col("end"), *[F.lead("end", i).over(order) for i in range(1, most + 1)])
    out = out.withColumns({"_starts": F.array_compact(starts), "_ends": F.array_compact(ends), "_lo": before, "_hi": after})
    steps_up = F.least(F.col(up), F.lit(most), F.size("_starts") - 1, F.col("_at") - F.col("_lo") - 1).cast("int")
    steps_down = F.least(F.col(down), F.lit(most), F.size("_ends") - 1, F.col("_hi") - F.col("_at") - 1).cast("int")
    return out.withColumns({"exp_start": F.element_at("_starts", steps_up + 1), "exp_end": F.element_at("_ends", steps_down + 1)}).drop("_at", "_starts", "_ends", "_lo", "_hi")


def judgment_stats(lines: DataFrame, visited_blocks: DataFrame, planned_blocks: DataFrame, key: str = FILE) -> DataFrame:
    """Blocks of each file: all (``lines`` in blocks), planned and visited, and the visited ones in the order of the visit."""
    total = lines.groupBy(key).agg(F.countDistinct("block_id").alias("total_blocks"))
    planned = planned_blocks.groupBy(key).agg(F.count("*").alias("planned_blocks"))
    seen = visited_blocks.groupBy(key).agg(F.count("*").alias("visited_blocks"), F.transform(F.sort_array(F.collect_list(F.struct("start", "end")), False), lambda x: F.array(x["start"], x["end"])).alias("visited_detail"))
    none = F.array().cast("array<array<bigint>>")
    return total.join(planned, key, "left").join(seen, key, "left").select(key, "total_blocks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("planned_blocks", "visited_blocks")], F.coalesce("visited_detail", none).alias("visited_detail"))


def recent_excerpt(blocks: DataFrame, last: int = 6, most: int = 120_000, least: int = 8_000, key: str = FILE) -> DataFrame:
    """The last ``last`` blocks (start, text) of each file, each cut to its share of ``most`` characters, ``least`` at least."""
    ranked = blocks.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("start")))).filter(F.col("_nth") <= last)
    listed = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("_blocks"))
    share = F.greatest(F.lit(least), F.floor(F.lit(most) / F.size("_blocks"))).cast("int")
    return listed.select(key, F.array_join(F.transform("_blocks", lambda b: excerpt(b["text"], share)), "\n\n").alias("excerpt"))


def expansion_score(n: str = "n"):
    """What is left of 100 points after ``n`` expansions of ten points each."""
    return F.lit(100) - 10 * F.col(n)


def neighbours(blocks: DataFrame, key: str = FILE) -> DataFrame:
    """Block text beside that of the block before and after."""
    order = Window.partitionBy(key).orderBy("start")
    return blocks.withColumns({"before": F.lag("text").over(order), "after": F.lead("text").over(order)})
