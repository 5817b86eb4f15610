"""Dates from text: a closed list of formats, years from 1900 to the year after `as_of`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pattern that a whole string must match, and the format that it is read by.
MONTH_FIRST = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
]
STRICT = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
]
SHORT_YEAR = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})$"


def parse_date(text: Column, formats: Sequence[tuple[str, str]] = MONTH_FIRST) -> Column:
    """The date by the first format that fits, or null. Two-digit years up to 68 are of this century."""
    tried = [F.when(text.rlike(p), F.try_to_date(text, f)) for p, f in formats]
    year = F.regexp_extract(text, SHORT_YEAR, 3).try_cast("int")
    full = F.concat_ws("/", F.regexp_extract(text, SHORT_YEAR, 1), F.regexp_extract(text, SHORT_YEAR, 2), (year + F.when(year <= 68, 2000).otherwise(1900)).cast("string"))
    return F.coalesce(*tried, F.when(text.rlike(SHORT_YEAR), F.try_to_date(full, "M/d/yyyy")))


def standard_date(text: Column, as_of: Column) -> Column:
    """parse_date() if its year is from 1900 to the year after as_of."""
    found = parse_date(F.trim(text))
    return F.when((F.year(found) >= 1900) & (F.year(found) <= F.year(as_of) + 1), found)


def age_years(birth: Column, as_of: Column) -> Column:
    """Days between, over 365.25."""
    return F.datediff(as_of, birth) / 365.25


def full_years(birth: Column, as_of: Column) -> Column:
    """Birthdays so far."""
    before = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(as_of) - F.year(birth) - before.cast("int")
