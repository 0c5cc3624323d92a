"""Search with context, snippets, samples and cursors over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE = "file"


def search(lines: DataFrame, keyword: str, context: int = 2, first: int = 10, key: str = FILE) -> DataFrame:
    """line_no, total, context of the first matches of each file, any case; the match is marked in its context."""
    order = Window.partitionBy(key).orderBy("line_no")
    names = [f"_{i}" for i in range(-context, context + 1) if i]
    around = {f"_{i}": F.lag("text", -i).over(order) if i < 0 else F.lead("text", i).over(order) for i in range(-context, context + 1) if i}
    marked = lines.withColumns(around).filter(F.lower("text").contains(keyword.lower()))
    ranked = marked.withColumns({"nth": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy(key))}).filter(F.col("nth") <= first)
    shown = [F.concat(F.lit("    "), F.col(x)) for x in names]
    shown.insert(context, F.concat(F.lit(">>> "), F.col("text")))
    return ranked.select(key, "line_no", "total", F.concat_ws("\n", *shown).alias("context"))


def head_tail(lines: DataFrame, head: int, tail: int, key: str = FILE) -> DataFrame:
    """The first and last lines of each file, joined, in one text."""
    n = F.max("line_no").over(Window.partitionBy(key))
    some = lines.withColumn("n", n).filter((F.col("line_no") <= head) | (F.col("line_no") > F.col("n") - tail))
    return some.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("snippet"))


def sampled_ends(rows: DataFrame, most: int = 300, key: str = FILE) -> DataFrame:
    """All rows of a file with at most ``most``; of others the first and the last half of ``most``."""
    order = Window.partitionBy(key).orderBy("line_no")
    ranked = rows.withColumns({"nth": F.row_number().over(order), "of": F.count("*").over(Window.partitionBy(key))})
    return ranked.filter((F.col("of") <= most) | (F.col("nth") <= most // 2) | (F.col("nth") > F.col("of") - (most - most // 2))).drop("nth", "of")


def ranked(rows: DataFrame, key: str = FILE, by: str = "line_no") -> DataFrame:
    """Rows with ``nth``, their place in each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(by)))


def latest(rows: DataFrame, by: str, most: int, key: str = FILE) -> DataFrame:
    """The ``most`` last rows of each key, last first, with their rank."""
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by))))
    return ranked.filter(F.col("nth") <= most)


def next_lines(lines: DataFrame, cursor: int, count: int, tail: bool = False, key: str = FILE) -> DataFrame:
    """The ``count`` lines after the ``cursor`` already read from the head, or before those read from the tail."""
    if not tail:
        return lines.filter(F.col("line_no").between(cursor + 1, cursor + count))
    left = F.max("line_no").over(Window.partitionBy(key)) - cursor
    return lines.withColumn("_left", left).filter((F.col("line_no") <= F.col("_left")) & (F.col("line_no") > F.col("_left") - count)).drop("_left")


def extracted(lines: DataFrame, ranges: DataFrame, key: str = FILE, cell: int = 1024) -> DataFrame:
    """Lines of each range, clamped to its file, as one text. Lines meet ranges by cells of ``cell`` lines, not by whole files."""
    reach = F.sequence(F.floor(F.greatest(F.lit(1), F.col("start")) / cell), F.floor(F.greatest(F.lit(1), F.col("end")) / cell))
    cells = ranges.select(key, "start", "end", F.explode(reach).alias("cell"))
    picked = lines.select(key, "line_no", "text", F.floor(F.col("line_no") / cell).alias("cell")).join(cells, [key, "cell"]).filter(F.col("line_no").between(F.col("start"), F.col("end")))
    return picked.groupBy(key, "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("content"))


def block_texts(blocked: DataFrame, key: str = FILE) -> DataFrame:
    """Blocks with their text."""
    return blocked.groupBy(key, "block_id").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def corrected(extractions: DataFrame, corrections: DataFrame, key: str = FILE) -> DataFrame:
    """Extractions (key, id, start, end) with ``ranges`` and ``version``: those of the last valid correction, else their own as version 0.

    Corrections (key, id, version, answer) are an append-only record; an answer is a JSON
    array of [start, end] in order. One that is not is kept in the record and changes nothing.
    """
    read = F.from_json("answer", "array<array<bigint>>", {"mode": "PERMISSIVE"})
    good = F.col("_ranges").isNotNull() & (F.size("_ranges") > 0) & F.forall("_ranges", lambda r: F.coalesce((F.size(r) == 2) & (r[0] >= 1) & (r[0] <= r[1]), F.lit(False)))
    last = corrections.withColumn("_ranges", read).filter(good).groupBy(key, "id").agg(F.max_by("_ranges", "version").alias("_ranges"), F.max("version").alias("_version"))
    own = F.array(F.array(F.col("start").cast("long"), F.col("end").cast("long")))
    return extractions.join(last, [key, "id"], "left").select(key, "id", F.coalesce("_ranges", own).alias("ranges"), F.coalesce("_version", F.lit(0)).cast("long").alias("version"))
