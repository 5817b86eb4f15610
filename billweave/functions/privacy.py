"""Masks and tokens for personal data: deterministic Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def name_token(x: Column) -> Column:
    return F.concat(F.lit("Patient_"), F.lpad((_number(x) % 10000).cast("string"), 4, "0"))


def id_token(x: Column) -> Column:
    return F.concat(F.lit("ID_"), F.lpad((_number(x) % 100000).cast("string"), 5, "0"))


def mask_address(x: Column) -> Column:
    """Words that begin with digits become XXX; of longer words three letters stay."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\d"), "XXX").when(F.length(w) > 3, F.concat(F.substring(w, 1, 3), F.lit("***"))).otherwise(w)), " ")


def mask_phone(x: Column) -> Column:
    """The area code stays if there are ten digits."""
    digits = F.regexp_replace(x, r"[^0-9]", "")
    return F.when(x.isNull(), None).when(F.length(digits) >= 10, F.concat(F.lit("("), F.substring(digits, 1, 3), F.lit(") XXX-XXXX"))).otherwise("XXX-XXXX")


def shift_days(key: Column) -> Column:
    """-30 to 30, the same for all dates of one key, so that intervals survive."""
    return (_number(key) % 61 - 30).cast("int")


def shift_date(x: Column, key: Column) -> Column:
    return F.date_add(x, shift_days(key))
