"""Log lines made from an events table, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import micros

#: Line of each event type and event_id mod 4; N stands for event_id mod 101. Fixed values.
BODIES = {
    "click": ["Downloading... N%", "[INFO] step ok", "[INFO] step ok", "(N/100)"],
    "view": ["##[group]Run step N", "", "----------", "Welcome to runner"],
    "signup": ["##[endgroup]", "npm notice update", "    at frame (app.js:1:2)", "Post job cleanup."],
    "purchase": ["##[warning]slow", "Warning: old api", "value N", "\u001b[31mred text \u001b[0m"],
    "error": ["##[error]Process completed with exit code 1.", "Traceback (most recent call last):", "ValueError: bad N", "src/a.c:1:2: error: N"],
}


def body() -> Column:
    """The text of an event; event types that the table lacks give an empty line."""
    n = (F.col("event_id") % 101).cast("string")
    out = None
    for kind, texts in BODIES.items():
        for i, text in enumerate(texts):
            parts = [F.lit(x) for x in text.split("N")] if " N" in text or "(N" in text else [F.lit(text)]
            value = F.concat(parts[0], n, parts[1]) if len(parts) == 2 else parts[0]
            cond = (F.col("event_type") == kind) & (F.col("event_id") % 4 == i)
            out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(""))


def event_log(events: DataFrame) -> DataFrame:
    """file, line_no, us, event_id, text (bare) and raw (with a time stamp)."""
    order = Window.partitionBy("file").orderBy("ts", "event_id")
    rows = events.withColumn("file", (F.col("user_id") % 10).cast("long"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z '")
    return rows.select("file", F.row_number().over(order).cast("long").alias("line_no"), micros(F.col("ts")).alias("us"), "event_id", body().alias("text"), F.concat(stamp, body()).alias("raw"))
