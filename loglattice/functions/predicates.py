"""Column predicates over log lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import trimmed


def any_of(regexes: list[str], either_case: bool = False) -> str:
    """One alternation of all patterns; Java's engine tries them at each place in order."""
    return ("(?i)" if either_case else "") + "|".join(f"(?:{x})" for x in regexes)


def keyword_pattern(keywords: list[str]) -> str:
    """Lower-cased whole words, with or without 's."""
    return r"\b(?:" + "|".join(re.escape(k.lower()) for k in keywords) + r")(?:'s)?\b" if keywords else "(?!)"


def has_keyword(text: Column, keywords: list[str]) -> Column:
    return F.lower(text).rlike(keyword_pattern(keywords)) if keywords else F.lit(False)


def is_red(text: Column) -> Column:
    return text.rlike("\u001b\\[(?:" + "|".join(P.RED) + ")m")


def is_indented(text: Column) -> Column:
    return text.rlike("^[ \t]")


def is_error_mark(text: Column) -> Column:
    return text.startswith(P.ERROR_MARK)


def is_group_mark(text: Column) -> Column:
    return text.startswith(P.GROUP_MARK)


def is_end_mark(text: Column) -> Column:
    return text.startswith(P.END_MARK)


def is_cleanup_mark(text: Column) -> Column:
    return text.contains(P.CLEANUP_MARK)


def is_stack(text: Column) -> Column:
    return text.rlike(any_of(P.STACK))


def is_command(text: Column) -> Column:
    return text.rlike(any_of(P.COMMAND))


def has_location(text: Column) -> Column:
    return text.rlike(any_of(P.LOCATION))


def is_error_related(text: Column) -> Column:
    return text.rlike(any_of(P.ERROR_WORDS, True))


def has_exception(text: Column) -> Column:
    return text.rlike(any_of(P.EXCEPTION_SIGNS))


def is_new_error(text: Column) -> Column:
    return text.rlike(any_of(P.NEW_ERROR))


def has_critic_word(text: Column) -> Column:
    return text.rlike(any_of(P.CRITIC_WORDS, True))


def is_blank(text: Column) -> Column:
    return trimmed(text) == ""


def is_separator(text: Column) -> Column:
    return is_blank(text) | trimmed(text).rlike(any_of(P.SEPARATOR))


def is_progress(text: Column) -> Column:
    return text.rlike(any_of(P.PROGRESS))


def is_telemetry(text: Column) -> Column:
    return text.rlike(any_of(P.TELEMETRY))


def first_type(text: Column, listed: list[tuple[str, str]], chunk: int = 8) -> Column:
    """Index (from 1) of the first pattern of the list that the line has; null if none.

    One alternation settles the many lines without any. Then the alternations of ``chunk``
    patterns are tried in order, and the patterns of the first that the line has.
    """

    def tried(first: int, some: list[tuple[str, str]]) -> Column:
        return F.coalesce(*[F.when(text.rlike("(?i)" + x), F.lit(i)) for i, (x, _) in enumerate(some, first)])

    parts = [(i, listed[i : i + chunk]) for i in range(0, len(listed), chunk)]
    one = reduce(lambda done, x: done.when(text.rlike(any_of([p for p, _ in x[1]], True)), tried(x[0] + 1, x[1])), parts[1:], F.when(text.rlike(any_of([p for p, _ in parts[0][1]], True)), tried(1, parts[0][1])))
    return F.when(text.rlike(any_of([p for p, _ in listed], True)), one)


def type_name(index: Column, listed: list[tuple[str, str]]) -> Column:
    return F.get(F.array(*[F.lit(t) for _, t in listed]), index - 1)  # element_at would read the last one where the index is null


def valid_range(start: Column, end: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Ends in order and, where bounds are given, inside them."""
    ok = start <= end
    return ok if lo is None else ok & (start >= lo) & (end <= hi)
