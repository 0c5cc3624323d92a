"""Column functions that clean log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on the patterns from here to STAMP_ANYWHERE.
#: White space of any kind, as Python's strip() takes it.
WHITE = "[\\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Everything that ends a line for Python's splitlines(), CR LF as one.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
SGR = "\u001b\\[[0-9;]*m"
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z ?"
ESCAPE = "\u001b(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
STAMP_ANYWHERE = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+)Z"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def line_array(text: Column) -> Column:
    """The lines of a text, without an empty one after a final line end."""
    lines = F.split(text, LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def without_colours(text: Column) -> Column:
    return F.regexp_replace(text, SGR, "")


def without_stamp(text: Column) -> Column:
    return F.regexp_replace(text, STAMP, "")


def preprocessed(text: Column) -> Column:
    """Colours, then the leading time stamp, then trailing white space go."""
    return F.regexp_replace(without_stamp(without_colours(text)), f"{WHITE}+$", "")


def without_escapes(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, "")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def overwritten(text: Column) -> Column:
    """What a terminal shows after carriage returns: the last part that is not blank; a text of blank parts stays as it is."""
    parts = F.filter(F.split(text, "\r"), lambda x: trimmed(x) != "")
    return F.when(text.contains("\r") & (F.size(parts) > 0), F.element_at(parts, -1)).otherwise(text)


def pruning_text(text: Column, strip_stamp: bool = False) -> Column:
    """Text that pruning looks at; the leading stamp stays unless ``strip_stamp``."""
    clean = without_controls(without_escapes(text))
    return without_stamp(clean) if strip_stamp else clean


def pruning_lines(content: Column, start: Column | int = 1, strip_stamp: bool = False) -> Column:
    """Array of (line_no, text) of a block's content as pruning looks at it; the first line has number ``start``."""
    lines = F.split(unix_newlines(content), "\n", -1)
    clean = lambda x: pruning_text(x, strip_stamp)
    first = start if isinstance(start, Column) else F.lit(start)
    return F.transform(lines, lambda x, i: F.struct((first + i).cast("long").alias("line_no"), overwritten(clean(x)).alias("text")))


def truncated(text: Column, limit: int = 10_000, keep: int = 29) -> Column:
    return F.when(F.length(text) > limit, F.substring(text, 1, keep)).otherwise(text)


def shortened(text: Column, limit: int = 300) -> Column:
    """At most ``limit`` characters, with dots where some are missing."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def excerpt(text: Column, limit: int | Column) -> Column:
    """A third of ``limit`` from the head and the rest from the tail, with a note between."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    head = F.floor(limit / 3).cast("int")
    tail = limit - head
    note = F.concat(F.lit("\n... ["), (F.length(text) - limit).cast("string"), F.lit(" characters omitted] ...\n"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, F.lit(1), head), note, F.right(text, tail))).otherwise(text)


def micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a time stamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp.cast("timestamp_ntz"))


def stamp_micros(text: Column) -> Column:
    """Microseconds of the first time stamp in a line, six digits of its fraction; null without a valid one."""
    found = F.regexp_extract(text, STAMP_ANYWHERE, 1)
    whole = F.concat(F.substring(found, 1, 19), F.lit("."), F.rpad(F.substring(found, 21, 6), 6, "0"))
    return F.when(found != "", micros(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))))
