"""Confidence scores of detections, texts and records: Column expressions, rounded only by callers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from billweave.functions import constants as C
from billweave.functions.text import bonus, clamp, count_of, has_any


# near is what stands around a value, in lower case: 30 characters for amounts, dates and names, else 50. It is best a column
# that is worked out before, since every word is looked for in it.


def cpt(value: Column, near: Column) -> Column:
    n = value.try_cast("int")
    kind = F.when(n.between(99200, 99499), 0.1).when(n.between(10000, 69999), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), 0.8 + bonus(has_any(near, C.PROCEDURE_WORDS), 0.1) + kind)


def icd(value: Column, near: Column) -> Column:
    return F.least(F.lit(1.0), 0.8 + bonus(has_any(near, C.DIAGNOSIS_WORDS), 0.1) + bonus(value.contains("."), 0.05))


def money(value: Column, near: Column) -> Column:
    return F.least(F.lit(1.0), 0.7 + bonus(has_any(near, C.MONEY_WORDS), 0.2) + bonus(value.contains("$") & value.contains("."), 0.1))


def npi(value: Column, near: Column) -> Column:
    return F.least(F.lit(1.0), 0.6 + bonus(has_any(near, C.PROVIDER_WORDS), 0.3) + bonus(is_npi(value), 0.1))


def date(value: Column, near: Column, before: Column, early: Column, parseable: Column) -> Column:
    """before: the 20 characters before it, in lower case; early: in the first fifth of the text."""
    plain = value.rlike(r"^\d{1,2}/\d{1,2}/\d{4}") | value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}")
    score = 0.7 + bonus(has_any(near, C.DATE_WORDS), 0.2) + bonus(has_any(before, C.DATE_LABELS), 0.15) + bonus(plain, 0.1) + bonus(parseable, 0.05)
    score = score - bonus(near.contains("$") | near.contains("amount"), 0.1) + bonus(early, 0.05)
    return F.least(F.lit(1.0), score)


def name(value: Column, near: Column) -> Column:
    words = F.size(F.split(value, r"\s+"))
    score = 0.5 + bonus(has_any(near, C.NAME_PREFIXES), 0.3) + bonus(has_any(F.lower(value), C.NAME_SUFFIXES), 0.2)
    return F.least(F.lit(1.0), score + F.when(words == 2, 0.1).when(words >= 3, 0.05).otherwise(0.0))


def address(value: Column) -> Column:
    score = 0.6 + bonus(has_any(F.upper(value), C.STATES), 0.2) + bonus(value.rlike(r"\d{5}(?:-\d{4})?"), 0.1) + bonus(has_any(F.lower(value), C.STREETS), 0.1)
    return F.least(F.lit(1.0), score)


def is_npi(value: Column) -> Column:
    """Ten digits whose Luhn sum, behind the issuer's prefix, is right."""
    return value.rlike(r"^\d{10}$") & F.call_function("luhn_check", F.concat(F.lit("80840"), value))


def ocr_indicators(text: Column) -> Column:
    """From words of the domain, marks of structure and length."""
    stripped = F.length(F.trim(text))
    score = 0.7 + F.least(F.lit(0.2), 0.03 * count_of(F.lower(text), C.OCR_INDICATORS)) + bonus(has_any(text, C.OCR_MARKERS), 0.05)
    return F.when(F.coalesce(stripped, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(0.95), score * F.when(stripped < 50, 0.8).otherwise(1.0)))


def ocr_length(text: Column) -> Column:
    """From length and marks of layout."""
    score = 0.6 + F.least(F.lit(0.3), F.length(text) / 1000) + F.least(F.lit(0.1), 0.02 * count_of(text, C.LAYOUT_INDICATORS))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(0.95), score))


def text_quality(text: Column, model_confidence: Column, consistency: Column, expected: int = 100) -> Column:
    """struct<text_quality, structural_quality, length_score, total>; noise is runs of characters outside printable ASCII."""
    stripped = F.trim(text)
    many = F.length(stripped)
    noise = F.regexp_count(stripped, F.lit(r"[^\x20-\x7E\n]+")) / F.greatest(many, F.lit(1))
    quality = clamp(0.5 + F.least(F.lit(0.3), 0.05 * F.regexp_count(stripped, F.lit(C.MEDICAL_TERMS))) + bonus(many > expected, 0.2) - 0.5 * noise)
    structure = F.least(F.lit(1.0), 0.1 * F.regexp_count(stripped, F.lit(C.STRUCTURE_MARKS)))
    length = clamp(0.5 + 0.5 * F.least(F.lit(1.0), many / expected))
    empty = F.coalesce(many, F.lit(0)) == 0
    parts = [F.when(empty, 0.0).otherwise(x) for x in (quality, structure, length)]
    total = 0.3 * parts[0] + 0.2 * parts[1] + 0.25 * consistency + 0.1 * parts[2] + 0.15 * model_confidence
    return F.struct(*(x.alias(n) for n, x in zip(("text_quality", "structural_quality", "length_score", "total"), (*parts, total))))


def overall(ocr: Column, extraction: Column, ocr_weight: float = 0.3) -> Column:
    return ocr_weight * ocr + (1 - ocr_weight) * extraction


def schema_coverage(fields: Sequence[Column], total: int) -> Column:
    """Share of filled fields, less for small schemas; null, '', 0 and false count as empty."""
    filled = sum((F.coalesce(_filled(x), F.lit(False)).cast("int") for x in fields), F.lit(0))
    return filled / total * min(1.0, total / 10 * 0.5 + 0.5)


def _filled(x: Column) -> Column:
    text = x.cast("string")
    return x.isNotNull() & ~text.isin("", "0", "0.0", "0.00", "false", "[]", "{}")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes struct<x1,y1,x2,y2>."""
    width = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    shared = width * height
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def estimated_tokens(width: Column, height: Column, rate: float, density: Column) -> Column:
    """At least 100; density null counts as one half."""
    return F.greatest(F.lit(100), F.floor(width * height * rate * F.coalesce(density, F.lit(0.5))).cast("int"))
