"""Native text functions: matches with offsets, context windows and word tests. All are Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<value:string,start:int,end:int>>"
NUMBERED = "array<struct<k:int,value:string,start:int,end:int>>"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is worked out once, however often f names it: the optimizer copies a column into every place that
    names it, but not a lambda's argument."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def hits_and_gaps(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and what split() leaves between them: what placed() takes."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern as array<struct<value,start,end>>, from the left, 0-based and end exclusive.

    Null text has no matches. Where each row is searched once only, bind hits_and_gaps() to columns and use placed().
    """
    return placed(*hits_and_gaps(text, pattern))


def placed(hits: Column, gaps: Column, k: int | None = None) -> Column:
    """Matches with their offsets, which follow from the gaps between them, so that no Python runs; with the number k of
    their pattern, if one is given."""
    sizes = F.zip_with(hits, gaps, lambda h, g: F.length(h) + F.length(g))  # the last gap has no match: null, and not used
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda e, n: F.array_append(e, F.element_at(e, -1) + n))
    number, kind = ([], MATCHES) if k is None else ([F.lit(k).alias("k")], NUMBERED)
    each = bound(ends, lambda e: F.transform(hits, lambda h, i: F.struct(*number, h.alias("value"), (F.get(e, i + 1) - F.length(h)).alias("start"), F.get(e, i + 1).alias("end"))))
    return F.coalesce(F.when(gaps.isNotNull(), each), F.array().cast(kind))


def context(text: Column, start: Column, end: Column, width: int | Column = 50) -> Column:
    """The text from `width` characters before start to as many after end."""
    first = F.greatest(start - width, F.lit(0))
    return F.substring(text, first + 1, F.least(F.length(text), end + width) - first)


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words, also inside other words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_of(text: Column, words: Sequence[str]) -> Column:
    """How many of the words a text holds."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bonus(condition: Column, amount: float) -> Column:
    return F.when(condition, amount).otherwise(0.0)


def trimmed_lines(text: Column) -> Column:
    """Lines without outer white space, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def redact(text: Column, patterns: Sequence[str], mark: str = "[REDACTED]") -> Column:
    """Every match of the patterns, one after the other, replaced by a mark."""
    return reduce(lambda t, p: F.regexp_replace(t, p, mark), patterns, text)
