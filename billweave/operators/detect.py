"""Detectors: a text gives rows (doc_id, field_type, value, confidence, start, end, context).

Every detector is a native generator: matches with offsets, a filter, a score. The union keeps a fixed order of types.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.functions import constants as C
from billweave.functions import scores
from billweave.functions.dates import standard_date
from billweave.functions.text import context, has_any, placed

COLUMNS = ["doc_id", "field_type", "value", "confidence", "start", "end", "context"]
# The patterns of dates.
DATE_PATTERNS = [
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{1,2}/\d{1,2}/\d{2}\b", r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2}, \d{4}\b", r"\b\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4}\b",
]

STREET = r"(?i)\d+\s+[A-Za-z\s]+(?:" + "|".join(C.STREETS) + r")\b"
TOWN = r"(?s)^.*?[A-Za-z\s]+,?\s+(?:" + "|".join(C.STATES) + r")\s+\d{5}(?:-\d{4})?"


#: Words (in lower case) of which a text must hold one for a pattern to match at all; others are searched without asking.
NEEDED = {
    C.EMAIL: ["@"], C.MONEY[0]: ["$"], C.MONEY[2]: ["$"], C.REPEATED_FIELDS[3]: ["account"], C.REPEATED_FIELDS[4]: ["date:"], C.PATIENT_IDS[2]: ["account"], C.PATIENT_NAMES[1]: ["last", "first"],
    **{p: [p[-6] * 10] for p in C.SEPARATORS}, **{p: ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"] for p in DATE_PATTERNS[3:]},
}


def found(texts: DataFrame, pattern: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, text, value, start and end of every match."""
    return found_any(texts, [pattern], keys).drop("k")


def searched(texts: DataFrame, groups: dict[str, Sequence[str]], least: dict[str, int] | None = None, on: dict[str, Column] | None = None, first: dict[str, int] | None = None) -> DataFrame:
    """texts with a column for each group of patterns: an array of k (the pattern's number, from the group's first on), value,
    start and end of every match. Each pattern is searched once, from one pass over the texts, and again for the gaps only where it matches.
    Patterns with fewer matches than the group's least have none; a group is searched only where its condition holds."""
    numbered = [(name, k, p) for name, patterns in groups.items() for k, p in enumerate(patterns)]

    def hits(name: str, p: str) -> Column:
        every = F.regexp_extract_all("text", F.lit(p), F.lit(0))
        tests = ([has_any(F.col("text_"), NEEDED[p])] if p in NEEDED else []) + ([on[name]] if on and name in on else [])
        return F.when(reduce(lambda a, b: a & b, tests), every) if tests else every

    def each(name: str, k: int) -> Column:
        return placed(F.col(f"{name}_hits{k}"), F.col(f"{name}_gaps{k}"), (first or {}).get(name, 0) + k)

    got = texts.withColumn("text_", F.lower("text")) if any(p in NEEDED for *_, p in numbered) else texts
    got = got.select("*", *(hits(name, p).alias(f"{name}_hits{k}") for name, k, p in numbered))
    enough = {name: (least or {}).get(name, 1) for name in groups}
    got = got.select("*", *(F.when(F.size(f"{name}_hits{k}") >= enough[name], F.split("text", p, -1)).alias(f"{name}_gaps{k}") for name, k, p in numbered))
    return got.select(*texts.columns, *((F.concat(*(each(name, k) for k in range(len(patterns)))) if len(patterns) > 1 else each(name, 0)).alias(name) for name, patterns in groups.items()))


def found_any(texts: DataFrame, patterns: Sequence[str], keys: tuple[str, ...] = ("doc_id",), least: int = 1) -> DataFrame:
    """keys, text, k (the pattern's number), value, start and end of every match of each pattern that has `least` in the
    text. The outer form keeps the optimizer from asking before, by another search, whether there will be rows."""
    return searched(texts.select(*keys, "text"), {"hits": patterns}, {"hits": least}).select(*keys, "text", F.inline_outer("hits")).where("k is not null")


@dataclass(frozen=True)
class Detector:
    """Patterns, which of their matches count, and a score: columns over k (the pattern's number), value, start, end, text,
    near (what stands around, in lower case) and iso (the value as a date). distinct: places that several patterns find
    count once."""

    patterns: Sequence[str]
    kind: str | Callable[[Column], Column]
    score: Callable[[Column], Column]
    width: int = 50
    keep: Callable[[Column], Column] | None = None
    distinct: bool = False

    def hits(self, found: Column, first: int) -> Column:
        if not self.distinct:
            return found
        places = F.array_distinct(F.transform(found, lambda x: F.shiftleft(x["start"].cast("long"), 32) + x["end"]))
        each = F.transform(places, lambda n: F.struct(F.shiftright(n, 32).cast("int").alias("start"), n.bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("end")))
        return F.transform(each, lambda x: F.struct(F.lit(first).alias("k"), F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]).alias("value"), x["start"].alias("start"), x["end"].alias("end")))


def _is_name(k: Column) -> Column:
    near = F.lower(context(F.col("text"), F.col("start"), F.col("end"), 20))
    plain = ~F.arrays_overlap(F.split(F.lower("value"), r"\s+"), F.array(*map(F.lit, C.NOT_NAMES))) & (F.length("value") <= 50)
    return F.when(F.col("value").rlike(r"\s"), plain).otherwise(near.rlike("|".join(C.NAME_PREFIXES)))


def _date_score(k: Column) -> Column:
    start = F.col("start")
    before = F.lower(F.substring(F.col("text"), F.greatest(start - 20, F.lit(0)) + 1, F.least(start, F.lit(20))))
    return scores.date(F.col("value"), F.col("near"), before, start < F.length("text") * 0.2, F.lit(True))


def _of(score: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda k: score(F.col("value"), F.col("near"))


def _nth(*values: str | float) -> Callable[[Column], Column]:
    return lambda k: F.get(F.array(*map(F.lit, values)), k)


PROCEDURES = Detector([C.CPT], "cpt_code", _of(scores.cpt), keep=lambda k: F.col("value").cast("int").between(100, 99999))
DIAGNOSES = Detector([C.ICD], "icd10_code", _of(scores.icd))
AMOUNTS = Detector(C.MONEY, "monetary_amount", _of(scores.money), 30)
PROVIDER_NUMBERS = Detector([C.NPI], "npi", _of(scores.npi), keep=lambda k: scores.is_npi(F.col("value")))
IDENTIFIERS = Detector([C.SSN, C.PHONE, C.EMAIL], _nth("ssn", "phone", "email"), _nth(0.9, 0.8, 0.85), keep=lambda k: (k != 1) | (F.length(F.regexp_replace("value", r"[^0-9]", "")) == 10))
DATES = Detector(DATE_PATTERNS, "date", _date_score, 30, keep=lambda k: F.col("iso").isNotNull(), distinct=True)
NAMES = Detector([C.NAME], "name", _of(scores.name), 30, keep=_is_name)


def detected(texts: DataFrame, *detectors: Detector, as_of: Column | None = None) -> DataFrame:
    """The rows of several detectors, from one pass over the texts; dates need as_of."""
    first = [sum(len(d.patterns) for d in detectors[:i]) for i in range(len(detectors))]
    k, text, start, end = map(F.col, ("k", "text", "start", "end"))

    def chosen(of: Callable[[Detector, Column], Column]) -> Column:
        out = of(detectors[-1], k - first[-1])
        for d, n, after in reversed([*zip(detectors, first, first[1:])]):
            out = F.when(k < after, of(d, k - n)).otherwise(out)
        return out

    groups = {f"found{i}": d.patterns for i, d in enumerate(detectors)}
    got = searched(texts.select("doc_id", "text"), groups, first={f"found{i}": n for i, n in enumerate(first)})
    found_by = [d.hits(F.col(f"found{i}"), n) for i, (d, n) in enumerate(zip(detectors, first))]
    hits = F.concat(*found_by) if len(found_by) > 1 else found_by[0]
    every = got.select("doc_id", "text", F.inline_outer(hits)).where("k is not null")
    if any(d is DATES for d in detectors):
        read = standard_date(F.col("value"), as_of)
        every = every.withColumn("iso", chosen(lambda d, _: read if d is DATES else F.lit(None).cast("date")))
    if any(d.keep for d in detectors):
        every = every.where(chosen(lambda d, n: d.keep(n) if d.keep else F.lit(True)))
    every = every.withColumn("near", F.lower(context(text, start, end, chosen(lambda d, _: F.lit(d.width)))))
    around = context(text, start, end, chosen(lambda d, _: F.lit(50 if d is NAMES else d.width)))
    kind = chosen(lambda d, n: F.lit(d.kind) if isinstance(d.kind, str) else d.kind(n))
    value = chosen(lambda d, _: F.date_format("iso", "yyyy-MM-dd") if d is DATES else F.col("value"))
    return every.select("doc_id", kind.alias("field_type"), value.alias("value"), F.round(chosen(lambda d, n: d.score(n)), 4).alias("confidence"), "start", "end", around.alias("context"))


def procedures(texts: DataFrame) -> DataFrame:
    return detected(texts, PROCEDURES)


def diagnoses(texts: DataFrame) -> DataFrame:
    return detected(texts, DIAGNOSES)


def amounts(texts: DataFrame) -> DataFrame:
    """A bag: the three patterns overlap, and every match of each counts."""
    return detected(texts, AMOUNTS)


def provider_numbers(texts: DataFrame) -> DataFrame:
    return detected(texts, PROVIDER_NUMBERS)


def identifiers(texts: DataFrame) -> DataFrame:
    """Social security numbers, phones of ten digits and e-mail addresses."""
    return detected(texts, IDENTIFIERS)


def dates(texts: DataFrame, as_of: Column) -> DataFrame:
    """Dates by five patterns, each place once, that can be read; the value is the ISO date."""
    return detected(texts, DATES, as_of=as_of)


def names(texts: DataFrame) -> DataFrame:
    """Capitalised words: one needs a title near it; of several none may be a common word."""
    return detected(texts, NAMES)


def addresses(texts: DataFrame) -> DataFrame:
    """Street addresses that a city, state and ZIP code follow within 200 characters; the value reaches to the ZIP."""
    hits = found(texts, STREET).withColumn("value", F.regexp_extract(F.substring(F.col("text"), F.col("start") + 1, F.lit(200)), TOWN, 0)).where("value != ''")
    hits = hits.withColumn("end", F.col("start") + F.length("value"))
    around = context(F.col("text"), F.col("start"), F.col("end"), 30)
    return hits.select("doc_id", F.lit("address").alias("field_type"), "value", F.round(scores.address(F.col("value")), 4).alias("confidence"), "start", "end", around.alias("context"))


def detections(texts: DataFrame, as_of: Column) -> DataFrame:
    """All detectors, with the ordinal of their type."""
    every = detected(texts, PROCEDURES, DIAGNOSES, DATES, IDENTIFIERS, AMOUNTS, PROVIDER_NUMBERS, NAMES, as_of=as_of).unionByName(addresses(texts))
    types = [["cpt_code"], ["icd10_code"], ["date"], ["ssn", "phone", "email"], ["monetary_amount"], ["npi"], ["name"], ["address"]]
    return every.withColumn("ord", F.coalesce(*(F.when(F.col("field_type").isin(t), k) for k, t in enumerate(types))))


def by_type(found_rows: DataFrame) -> DataFrame:
    """doc_id, field_type and values: an array by confidence, the highest first, then by place."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col("start"), F.col("end"), F.col("value"))))
    return found_rows.groupBy("doc_id", "field_type").agg(F.transform(best, lambda x: x["value"]).alias("values"))


def best_matches(found_rows: DataFrame, most: int = 5) -> DataFrame:
    """The best detections of each type of a text."""
    order = Window.partitionBy("doc_id", "field_type").orderBy(F.desc("confidence"), "start", "end", "value")
    return found_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def holds_personal_data(found_rows: DataFrame) -> DataFrame:
    return found_rows.groupBy("doc_id").agg(F.bool_or(F.col("field_type").isin("ssn", "phone", "email", "name")).alias("phi_detected"))
