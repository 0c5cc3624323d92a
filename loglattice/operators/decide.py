"""Parsing of answers into decisions, and rules that stand in for a model.

A decision comes as a table keyed like the lines it is about. ``ask`` fills such a table
with any function from text to text; the default rules need none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import trimmed

RANGE = "array<struct<s:bigint,e:bigint>>"


def parsed_ranges(answer: Column, start: Column, end: Column, bounded: bool = True) -> Column:
    """Ranges named as #a-b#; #ALL# is the whole block, and #NONE# (or NO_ERROR, unbounded) is none.

    With ``bounded``, ranges that leave the block are dropped; ranges out of order always are.
    """
    upper = F.upper(answer)
    none = upper.contains("#NONE#") if bounded else upper.contains("NO_ERROR")
    whole = upper.contains("#ALL#")
    a = F.regexp_extract_all(answer, F.lit(r"#(\d+)-(\d+)#"), F.lit(1))
    b = F.regexp_extract_all(answer, F.lit(r"#(\d+)-(\d+)#"), F.lit(2))
    found = F.zip_with(a, b, lambda x, y: F.struct(x.cast("long").alias("s"), y.cast("long").alias("e")))
    ok = F.filter(found, lambda r: (r["s"] <= r["e"]) & ((r["s"] >= start) & (r["e"] <= end) if bounded else F.lit(True)))
    all_ = F.array(F.struct(start.cast("long").alias("s"), end.cast("long").alias("e")))
    empty = F.array().cast(RANGE)
    return F.when(whole, all_).when(none, empty).otherwise(ok) if bounded else F.when(none, empty).when(whole, all_).otherwise(ok)


def _first_form(answer: Column, forms: list[str]) -> Column:
    """The first group of the first of ``forms`` that the answer has; null without any."""
    return F.coalesce(*[F.when(answer.rlike(x), F.regexp_extract(answer, x, 1)) for x in forms])


def _whole(value: Column) -> Column:
    """A JSON number or truth value as a whole number, cut towards zero."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long")).when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).otherwise(F.try_variant_get(value, "$", "double").cast("long"))


def parsed_deletions(answer: Column) -> Column:
    """Distinct line numbers of a {"delete": [...]} answer, fenced or not; null if there is no such list.

    Entries are numbers (true is 1) or objects with a number, or text that spells one, as
    line_no. Other entries are passed over; an object whose line_no is no number ends the list.
    """
    items = F.try_variant_get(F.try_parse_json(_first_form(answer, P.DELETE_FORMS)), "$.delete", "array<variant>")
    kind = lambda x: F.schema_of_variant(x)
    named = lambda x: kind(x).startswith("OBJECT") & kind(x).rlike(r"[<, ]line_no:")
    inner = lambda x: F.try_variant_get(x, "$.line_no", "variant")
    number = lambda x: kind(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    spelled = lambda x: F.when(kind(inner(x)) == "STRING", trimmed(F.try_variant_get(inner(x), "$", "string")).try_cast("long")).when(number(inner(x)), _whole(inner(x)))
    read = F.transform(items, lambda x: F.struct(F.when(named(x), spelled(x)).when(number(x), _whole(x)).alias("n"), named(x).alias("named")))
    bad = F.array_position(F.transform(read, lambda r: r["named"] & r["n"].isNull()), True)
    kept = F.when(bad > 0, F.slice(read, F.lit(1), F.greatest(bad.cast("int") - 1, F.lit(0)))).otherwise(read)
    return F.array_distinct(F.filter(F.transform(kept, lambda r: r["n"]), lambda n: n.isNotNull()))


def parsed_restores(answer: Column) -> Column:
    """Line numbers of a {"restore": [...]} answer."""
    found = F.regexp_extract(answer, r'\{[\s\S]*"restore"[\s\S]*\}', 0)
    return F.from_json(F.get_json_object(F.when(found != "", found), "$.restore"), "array<bigint>")


def parsed_method(answer: Column, default: int | None = 1) -> Column:
    """1 or 2: METHOD, a colon and a digit, else METHOD, white space and a digit, else the digit that one of the last five lines consists of, else ``default``."""
    named = _first_form(answer, [f"(?i){x}" for x in P.METHOD_FORMS])
    tail = F.slice(F.reverse(F.split(trimmed(answer), "\n")), 1, 5)
    alone = F.filter(F.transform(tail, trimmed), lambda x: x.isin("1", "2"))
    return F.coalesce(named.cast("long"), F.when(F.size(alone) > 0, alone[0].cast("long")), F.lit(default).cast("long"))


def parsed_more(answer: Column) -> Column:
    """position (HEAD or TAIL) and lines that an answer asks for; null if it asks for none."""
    return F.when(answer.rlike(P.MORE_FORM), F.struct(F.regexp_extract(answer, P.MORE_FORM, 1).alias("position"), F.regexp_extract(answer, P.MORE_FORM, 2).cast("long").alias("lines")))


def parsed_judgment(answer: Column) -> Column:
    """True for CONTAINS_ERROR, false for NO_ERROR, null where neither is said; the first wins over the second."""
    upper = F.upper(answer)
    return F.when(upper.contains("CONTAINS_ERROR"), F.lit(True)).when(upper.contains("NO_ERROR"), F.lit(False))


def parsed_stop(answer: Column) -> Column:
    """Whether an answer says to stop; any other answer, or none, says to go on."""
    return F.coalesce(F.upper(answer).contains(P.STOP_WORD), F.lit(False))


def rule_method(hits: Column, anchors: Column) -> Column:
    """The rule for a method: blocks (1) where a keyword or anchor was found, else ranges (2)."""
    return F.when((hits > 0) | (anchors > 0), F.lit(1)).otherwise(F.lit(2))


def ask(rows: DataFrame, prompt: str, answer: str, model: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """``rows`` with the model's answer to column ``prompt``; null where it failed ``attempts`` times.

    The one place where Python runs on executors: a call over the network dwarfs it.
    """
    import pandas as pd

    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            for _ in range(attempts):
                try:
                    return model(text or "")
                except PermissionError:
                    raise
                except Exception:  # noqa: BLE001  a model may fail in any way; the answer is then missing
                    continue
            return None

        return texts.map(one)

    return rows.withColumn(answer, call(F.col(prompt)))
