"""Anchors, protection, safe pruning, critic rules and the final merge.

All work is done in windows over a file's lines, on boolean columns; lines need the key,
line_no and text (already cleaned for pruning).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import predicates as is_
from .rangealg import lines_to_ranges, listed, repeated

FILE = "file"


@dataclass(frozen=True)
class Settings:
    k_before: int = 20
    k_after: int = 50
    soft_window: int = 20
    far: int = 20
    near: int = 2
    stack_reach: int = 99
    trace_reach: int = 49


def anchored(lines: DataFrame) -> DataFrame:
    """Lines with p0 and p1: the index of the first hard pattern, and of the first soft one where no hard one is."""
    found = lines.withColumn("p0", is_.first_type(F.col("text"), P.P0))
    return found.withColumn("p1", F.when(F.col("p0").isNull(), is_.first_type(F.col("text"), P.P1)))


def _last(flag: Column, key: str | list[str]) -> Column:
    """The last line strictly before with the flag; 0 if none."""
    before = Window.partitionBy(*listed(key)).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(F.when(flag, F.col("line_no")), True).over(before), F.lit(0))


def _next(flag: Column, key: str | list[str]) -> Column:
    """The first line strictly after with the flag; null if none. Read backwards, since a frame to the end is read anew for each row."""
    after = Window.partitionBy(*listed(key)).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(flag, F.col("line_no")), True).over(after)


def hard_protected(lines: DataFrame, settings: Settings = Settings(), key: str | list[str] = FILE) -> DataFrame:
    """anchored() lines with ``hard``: anchors, what continues them, bodies of tracebacks, and located errors.

    A scan down from an anchor reaches a line if no stopper lies between; the nearest anchor
    before the line is the one for which that is easiest, so two as-of lookups decide.
    """
    text = F.col("text")
    out = lines if "p0" in lines.columns else anchored(lines)
    stack, blank = is_.is_stack(text), is_.is_blank(text)
    indented = text.rlike("^(?:    |\t)")
    goes_on = stack | (~blank & ~is_.is_new_error(text) & indented)
    stops = ~stack & ~blank & (is_.is_new_error(text) | ~indented)
    one_space = text.rlike("^ ") & ~text.rlike("^  ")
    in_trace = stack | is_.has_exception(text) | (~blank & ~one_space & text.rlike(r"\w+(?:Error|Exception):"))
    trace_stops = ~stack & ~is_.has_exception(text) & ~blank & one_space
    flags = {"_anchor": F.col("p0").isNotNull(), "_trace": F.coalesce(is_.type_name(F.col("p0"), P.P0) == "traceback", F.lit(False)), "_stop": stops, "_tstop": trace_stops, "_on": goes_on, "_body": in_trace}
    out = out.withColumns(flags)
    out = out.withColumns({"_a": _last(F.col("_anchor"), key), "_s": _last(F.col("_stop"), key), "_t": _last(F.col("_trace"), key), "_ts": _last(F.col("_tstop"), key)})
    no = F.col("line_no")
    follows = F.col("_on") & (F.col("_a") > 0) & (F.col("_a") >= F.col("_s")) & (no - F.col("_a") <= settings.stack_reach)
    body = F.col("_body") & (F.col("_t") > 0) & (F.col("_t") >= F.col("_ts")) & (no - F.col("_t") <= settings.trace_reach)
    located = is_.has_location(text) & is_.is_error_related(text)
    return out.withColumn("hard", F.col("_anchor") | follows | body | located).drop(*flags, "_a", "_s", "_t", "_ts")


def soft_protected(lines: DataFrame, settings: Settings = Settings(), key: str | list[str] = FILE) -> DataFrame:
    """hard_protected() lines with ``soft``: around hard anchors, commands, around soft anchors; never hard ones."""
    out = lines if "hard" in lines.columns else hard_protected(lines, settings, key)
    order = Window.partitionBy(*listed(key)).orderBy("line_no")
    near_hard = F.max(F.col("p0").isNotNull()).over(order.rowsBetween(-settings.k_after, settings.k_before))
    half = settings.soft_window // 2
    near_soft = F.max(F.col("p1").isNotNull()).over(order.rowsBetween(-half, half))
    return out.withColumn("_near", near_hard | near_soft | is_.is_command(F.col("text"))).withColumn("soft", ~F.col("hard") & F.col("_near")).drop("_near")


def distance_to_hard(lines: DataFrame, key: str | list[str] = FILE) -> DataFrame:
    """Lines with ``apart``: how far the nearest hard line is, 0 for one itself, null without any."""
    no = F.col("line_no")
    before, after = _last(F.col("hard"), key), _next(F.col("hard"), key)
    nearest = F.least(F.when(before > 0, no - before), after - no)
    return lines.withColumn("apart", F.when(F.col("hard"), F.lit(0)).otherwise(nearest).cast("long"))


def safe_deletions(lines: DataFrame, settings: Settings = Settings(), key: str | list[str] = FILE) -> DataFrame:
    """distance_to_hard() lines with blank_sep, progress, telemetry, repeated and ``safe``, their union without hard lines."""
    out = distance_to_hard(lines, key)
    text = F.col("text")
    clear = lambda d: F.col("apart").isNull() | (F.col("apart") > d)
    hard = F.col("hard")
    out = out.withColumns({"blank_sep": ~hard & is_.is_separator(text) & clear(settings.near), "progress": ~hard & is_.is_progress(text) & clear(settings.far), "telemetry": ~hard & is_.is_telemetry(text) & clear(settings.far)})
    return repeated(out, "hard", key=key).withColumn("safe", ~hard & (F.col("blank_sep") | F.col("progress") | F.col("telemetry") | F.col("repeated")))


def critic_rules(lines: DataFrame, deleted: str = "deleted", key: str | list[str] = FILE) -> DataFrame:
    """Lines with ``restored``: deleted hard lines, and deleted soft ones of a file none of whose remaining lines tells of an error."""
    left = F.max(is_.has_critic_word(F.col("text")) & ~F.col(deleted)).over(Window.partitionBy(*listed(key)))
    return lines.withColumn("_left", left).withColumn("restored", F.col(deleted) & (F.col("hard") | (~F.col("_left") & F.col("soft")))).drop("_left")


def merged_deletions(lines: DataFrame) -> DataFrame:
    """Lines with ``gone``: safe or proposed, not restored, not hard."""
    return lines.withColumn("gone", (F.col("safe") | F.col("proposed")) & ~F.col("restored") & ~F.col("hard"))


def simple_pruned(lines: DataFrame, settings: Settings = Settings(), key: str | list[str] = FILE) -> DataFrame:
    """The model-free pipeline on one block for each key: lines with ``gone``; a block without anchors keeps all its lines."""
    out = safe_deletions(soft_protected(hard_protected(anchored(lines), settings, key), settings, key), settings, key)
    some = F.max(F.col("p0").isNotNull() | F.col("p1").isNotNull()).over(Window.partitionBy(*listed(key)))
    return out.withColumn("_some", some).withColumn("gone", F.col("safe") & ~F.col("hard") & F.col("_some")).drop("_some")


def proposals(lines: DataFrame, answers: DataFrame, key: str | list[str] = FILE) -> DataFrame:
    """Lines with ``proposed``: in ``answers`` (key, line_no), from a model or a table, and not hard."""
    asked = answers.select(*listed(key), "line_no", F.lit(True).alias("asked")).distinct()
    return lines.join(asked, [*listed(key), "line_no"], "left").withColumn("proposed", F.coalesce("asked", F.lit(False)) & ~F.col("hard")).drop("asked")


def prune_stats(lines: DataFrame, key: str | list[str] = FILE) -> DataFrame:
    return lines.groupBy(*listed(key)).agg(
        F.count("*").alias("n_lines"),
        F.count_if("safe").alias("n_safe"),
        F.count_if("hard").alias("n_hard"),
        F.count_if("soft").alias("n_soft"),
        F.count_if("gone").alias("n_gone"),
        F.count_if(F.col("p0").isNotNull()).alias("n_p0"),
        F.count_if(F.col("p1").isNotNull()).alias("n_p1"),
    )


def irrelevant_ranges(lines: DataFrame, key: str | list[str] = FILE) -> DataFrame:
    return lines_to_ranges(lines.filter("gone"), key)


def relevant_ranges(lines: DataFrame, key: str | list[str] = FILE) -> DataFrame:
    return lines_to_ranges(lines.filter("not gone"), key)


def asked_anchors(lines: DataFrame, answers: DataFrame, fewer_than: int = 3, shown: int = 200, most: int = 20, key: str | list[str] = FILE) -> DataFrame:
    """anchored() lines with ``asked``: those a model names (``answers``: key, line_no, nth) where a key has under ``fewer_than`` hard anchors.

    Only the first ``shown`` lines without an anchor are shown to it, and of its answer the
    first ``most`` numbers count; numbers that are none of the key's, or anchors, do not.
    """
    keys = listed(key)
    named = answers.filter(F.col("nth") <= most).select(*keys, "line_no", F.lit(True).alias("_named")).distinct()
    free = F.col("p0").isNull() & F.col("p1").isNull()
    few = F.count("p0").over(Window.partitionBy(*keys)) < fewer_than
    out = lines.join(named, [*keys, "line_no"], "left")
    out = out.withColumns({"_few": few, "_nth": F.count_if(free).over(Window.partitionBy(*keys).orderBy("line_no"))})
    return out.withColumns({"asked": F.col("_few") & free & F.coalesce("_named", F.lit(False)), "shown": F.col("_few") & free & (F.col("_nth") <= shown)}).drop("_few", "_nth", "_named")


def strict_candidates(lines: DataFrame, reach: int = 50, key: str | list[str] = FILE) -> DataFrame:
    """hard_protected() lines with ``strict``: what a strict proposer may delete, blank lines, separators and bare percentages beyond ``reach`` lines of an anchor."""
    near = F.max(F.col("p0").isNotNull()).over(Window.partitionBy(*listed(key)).orderBy("line_no").rowsBetween(-reach, reach))
    text = F.col("text")
    return lines.withColumn("_near", near).withColumn("strict", ~F.col("hard") & ~F.col("_near") & (is_.is_separator(text) | text.rlike(r"^\s*\d+%\s*$"))).drop("_near")


CORE = ("message", "exit_code", "command", "exception")


def core_mismatch(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Whether a record of causes lost a core field: one that was missing before never counts."""
    out = F.lit(False)
    for name in CORE:
        out = out | (before[name].isNotNull() & ~before[name].eqNullSafe(after[name]))
    return out


def restored_by_evidence(lines: DataFrame, answers: DataFrame, deleted: str = "deleted", key: str | list[str] = FILE) -> DataFrame:
    """Lines with ``by_evidence``: deleted ones that a model's check of the rest wants back (``answers``: key, line_no)."""
    wanted = answers.select(*listed(key), "line_no", F.lit(True).alias("_back")).distinct()
    return lines.join(wanted, [*listed(key), "line_no"], "left").withColumn("by_evidence", F.col(deleted) & F.coalesce("_back", F.lit(False))).drop("_back")


def restored_by_cause(lines: DataFrame, causes: DataFrame, deleted: str = "deleted", key: str | list[str] = FILE) -> DataFrame:
    """Lines with ``by_cause``: deleted ones that mention the cause, where the cause read from what is left lost a core field.

    ``causes`` has a row for each key: message, exit_code, command, exception as read from
    the whole text, and as left_... from what is left. Empty text is a missing field.
    """
    told = {c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)) for c in CORE}
    left = {c: F.when(F.trim(F.col(f"left_{c}").cast("string")) != "", F.col(f"left_{c}")) for c in CORE}
    lost = causes.filter(core_mismatch(told, left)).select(*listed(key), F.struct(*[told[c].cast("string").alias(c) for c in CORE]).alias("_cause"))
    text, cause = F.col("text"), F.col("_cause")
    code = F.lower(text).contains(F.concat(F.lit("exit code "), cause["exit_code"])) | F.lower(text).contains(F.concat(F.lit("exitcode="), cause["exit_code"]))
    says = F.coalesce(code, F.lit(False))
    for name in ("message", "command", "exception"):
        says = says | F.coalesce(text.contains(cause[name]), F.lit(False))
    return lines.join(lost, listed(key), "left").withColumn("by_cause", F.col(deleted) & says).drop("_cause")


def written_out(lines: DataFrame, deleted: bool = False, key: str | list[str] = FILE) -> DataFrame:
    """What is left of each key as ``content``, and with ``deleted`` what went as ``deleted_content``, as numbered lines."""
    shown = lambda flag: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(flag, F.struct("line_no", F.format_string("[%d] %s", "line_no", "text").alias("t"))))), lambda x: x["t"]), "\n")
    columns = [shown(~F.col("gone")).alias("content"), *([shown(F.col("gone")).alias("deleted_content")] if deleted else [])]
    return lines.groupBy(*listed(key)).agg(*columns)
