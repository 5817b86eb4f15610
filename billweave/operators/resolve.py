"""Similarity, pairs, groups and merging of records.

Similarity of names is native (Levenshtein over the longer length) or, as an Arrow UDF, the matching-blocks ratio.
Weighted similarities divide by the weights of the fields that both records have; `literal` divides by their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 for equal strings in any case, 0 for wholly different ones; null counts as empty."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)


def matching_ratio(a: Column, b: Column, fold: bool = True) -> Column:
    """Twice the characters in matching blocks over all characters, by batches in Python: no built-in computes it."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        fold_one = (lambda s: (s or "").lower()) if fold else (lambda s: s or "")
        return pd.Series([SequenceMatcher(None, fold_one(p), fold_one(q)).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def weighted(parts: Sequence[tuple[float, Column, Column]], literal: bool = False) -> Column:
    """Sum of weight times similarity over the parts whose condition holds, over their weights (literal: their number)."""
    total = reduce(lambda a, b: a + b, [F.when(on, F.lit(w) * sim).otherwise(0.0) for w, on, sim in parts])
    base = reduce(lambda a, b: a + b, [F.when(on, 1.0 if literal else w).otherwise(0.0) for w, on, _ in parts])
    return F.when(base > 0, total / base).otherwise(0.0)


def _both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def page_similarity(x: str, y: str, literal: bool = False) -> Column:
    """Names .4, dates of birth .3, ids .3 of records under two aliases."""
    name = [F.trim(F.concat_ws(" ", F.col(f"{p}.first_name"), F.col(f"{p}.last_name"))) for p in (x, y)]
    parts = [(0.4, (name[0] != "") & (name[1] != ""), levenshtein_ratio(*name))]
    for w, c in ((0.3, "date_of_birth"), (0.3, "patient_id")):
        a, b = F.col(f"{x}.{c}"), F.col(f"{y}.{c}")
        parts.append((w, _both(a, b), (a == b).cast("double")))
    return weighted(parts, literal)


def document_similarity(x: str, y: str, literal: bool = False) -> Column:
    """First names .25, last names .25, dates of birth .3, ids .2."""
    parts = [(0.25, _both(F.col(f"{x}.{c}"), F.col(f"{y}.{c}")), levenshtein_ratio(F.col(f"{x}.{c}"), F.col(f"{y}.{c}"))) for c in ("first_name", "last_name")]
    for w, c in ((0.3, "date_of_birth"), (0.2, "patient_id")):
        a, b = F.col(f"{x}.{c}"), F.col(f"{y}.{c}")
        parts.append((w, _both(a, b), (a == b).cast("double")))
    return weighted(parts, literal)


def code_similarity(cpt_a: Column, cpt_b: Column, icd_a: Column, icd_b: Column) -> Column:
    """Jaccard of procedures and diagnoses, .6 and .4 where both records have both, else the greater."""

    def jaccard(a: Column, b: Column) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)

    cpt, icd = jaccard(cpt_a, cpt_b), jaccard(icd_a, icd_b)
    have = [(F.size(a) > 0) & (F.size(b) > 0) for a, b in ((cpt_a, cpt_b), (icd_a, icd_b))]
    return F.when(have[0] & have[1], 0.6 * cpt + 0.4 * icd).otherwise(F.greatest(F.when(have[0], cpt).otherwise(0.0), F.when(have[1], icd).otherwise(0.0)))


def page_duplicates(records: DataFrame, least: float = 0.8, literal: bool = False) -> DataFrame:
    """doc_id, page_no, a, b, similarity of pairs of records of one page: idx a < b."""
    x, y = records.alias("x"), records.alias("y")
    pairs = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.page_no") == F.col("y.page_no")) & (F.col("x.idx") < F.col("y.idx")))
    return pairs.select("x.doc_id", "x.page_no", F.col("x.idx").alias("a"), F.col("y.idx").alias("b"), F.round(page_similarity("x", "y", literal), 4).alias("similarity")).where(F.col("similarity") > least)


def adjacent_pairs(records: DataFrame, score: Column, least: float) -> DataFrame:
    """Pairs of records of a page and the next one whose score (over aliases x and y) is above `least`."""
    x, y = records.alias("x"), records.withColumn("before", F.col("page_no") - 1).alias("y")
    pairs = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.page_no") == F.col("y.before")))
    return pairs.select("x.doc_id", F.col("x.page_no").alias("page_a"), F.col("x.idx").alias("a"), F.col("y.page_no").alias("page_b"), F.col("y.idx").alias("b"), F.round(score, 4).alias("similarity")).where(F.col("similarity") > least)


def cross_page_pairs(records: DataFrame, least: float = 0.7, literal: bool = False) -> DataFrame:
    return adjacent_pairs(records, page_similarity("x", "y", literal), least)


def code_pairs(records: DataFrame, least: float = 0.6) -> DataFrame:
    return adjacent_pairs(records, code_similarity(F.col("x.cpt_codes"), F.col("y.cpt_codes"), F.col("x.icd10_codes"), F.col("y.icd10_codes")), least)


def pair_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first pairs, and those of the second that are not among them."""
    keys = ["doc_id", "page_a", "a", "page_b", "b"]
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def groups(pairs: DataFrame) -> DataFrame:
    """doc_id, node and group (its smallest node) of pairs(doc_id, a, b): full closure within a document.

    A fold over a document's pairs, which are few: each pair unites the groups that hold one of its two.
    """
    kind = "array<array<int>>"
    listed = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))).alias("ps"))

    def step(acc: Column, p: Column) -> Column:
        def has(g: Column) -> Column:
            return F.array_contains(g, p["a"]) | F.array_contains(g, p["b"])

        united = F.array_union(F.flatten(F.filter(acc, has)), F.array(p["a"], p["b"]))
        return F.concat(F.filter(acc, lambda g: ~has(g)), F.array(united)).cast(kind)

    got = listed.select("doc_id", F.explode(F.aggregate("ps", F.array().cast(kind), step)).alias("nodes"))
    return got.select("doc_id", F.array_min("nodes").alias("group"), F.explode("nodes").alias("node"))


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """doc_id, node and group by first-come assignment: a pair joins the first group that holds one of its two; two
    groups are never united. A fold over a document's pairs in order: of `ord`, if there, then a and b."""
    kind = "array<array<int>>"
    order = F.col("ord") if "ord" in pairs.columns else F.lit(0)
    listed = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("ord"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))).alias("ps"))

    def step(acc: Column, p: Column) -> Column:
        first = F.filter(F.transform(acc, lambda g, i: F.when(F.array_contains(g, p["a"]) | F.array_contains(g, p["b"]), i)), lambda i: i.isNotNull())
        at = F.get(first, F.lit(0))
        joined = F.transform(acc, lambda g, i: F.when(i == at, F.array_union(g, F.array(p["a"], p["b"]))).otherwise(g))
        return F.when(F.size(first) > 0, joined).otherwise(F.concat(acc, F.array(F.array(p["a"], p["b"])))).cast(kind)

    got = listed.select("doc_id", F.posexplode(F.aggregate("ps", F.array().cast(kind), step)).alias("group", "nodes"))
    return got.select("doc_id", "group", F.explode("nodes").alias("node"))


def merged(records: DataFrame, grouped: DataFrame) -> DataFrame:
    """One record for each group: the most confident one, its gaps filled from the others, codes united, pages listed."""
    order = F.struct(-F.col("confidence"), F.col("node"))
    got = records.join(grouped, ["doc_id", "node"])
    return got.groupBy("doc_id", "group").agg(F.min_by("node", order).alias("node"), *_in_order(order), F.array_sort(F.collect_set("page_no")).alias("page_numbers"), F.max("confidence").alias("confidence"))


def _in_order(order: Column) -> list[Column]:
    """Aggregates of a group's records: the first filled field by the order, and all codes once each."""
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("first_name", "last_name", "date_of_birth", "patient_id")]
    listed = [F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(c).alias("codes")))) for c in ("cpt_codes", "icd10_codes")]
    return filled + [F.array_distinct(F.flatten(F.transform(x, lambda r: r["codes"]))).alias(c) for x, c in zip(listed, ("cpt_codes", "icd10_codes"))]


def leaders(records: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, idx and leader: in order, a record without a leader leads itself and all later free ones alike to it.

    Greedy and order-dependent, so each document's pairs are folded in order; a document holds few records.
    """
    x, y = records.alias("x"), records.alias("y")
    alike = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.idx") < F.col("y.idx")) & (document_similarity("x", "y") > least))
    pairs = alike.groupBy(F.col("x.doc_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("x.idx").cast("int").alias("a"), F.col("y.idx").cast("int").alias("b")))).alias("ps"))
    kind = "array<struct<a:int,b:int>>"

    def step(acc: Column, p: Column) -> Column:
        taken = F.exists(acc, lambda q: (q["b"] == p["a"]) | (q["b"] == p["b"]))
        return F.when(taken, acc).otherwise(F.array_append(acc, p)).cast(kind)

    led = pairs.select("doc_id", F.inline(F.aggregate("ps", F.array().cast(kind), step))).select("doc_id", F.col("b").alias("idx"), F.col("a").alias("led"))
    return records.select("doc_id", "idx").join(led, ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("led", "idx").alias("leader"))


def merged_by_completeness(records: DataFrame, led: DataFrame) -> DataFrame:
    """One record for each leader: the more complete record's fields go first; codes are united."""
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in ("first_name", "last_name", "date_of_birth", "patient_id")]) + (F.size("cpt_codes") > 0).cast("int") + (F.size("icd10_codes") > 0).cast("int")
    order = F.struct(-F.col("filled"), F.col("idx"))
    got = records.join(led, ["doc_id", "idx"]).withColumn("filled", filled)
    return got.groupBy("doc_id", "leader").agg(*_in_order(order), F.array_sort(F.collect_set("page_no")).alias("source_pages"))


def optimised(records: DataFrame, least: float = 0.7, least_codes: float = 0.6) -> DataFrame:
    """Records of adjacent pages merged where their codes tell more than their names do.

    In documents in which pairs alike by codes add any to those alike by person, linked records become one; all other
    documents keep their records. page_numbers lists the pages; the order is page_no and idx.
    """
    placed = records.withColumn("node", F.col("page_no").cast("int") * 65536 + F.col("idx").cast("int"))
    alike = cross_page_pairs(placed, least)
    keys = ["doc_id", "page_a", "a", "page_b", "b"]
    more = code_pairs(placed, least_codes).join(alike.select(*keys), keys, "left_anti")
    pairs = alike.unionByName(more).join(more.select("doc_id").distinct(), "doc_id", "left_semi")
    nodes = pairs.select("doc_id", (F.col("page_a").cast("int") * 65536 + F.col("a").cast("int")).alias("a"), (F.col("page_b").cast("int") * 65536 + F.col("b").cast("int")).alias("b"))
    grouped = groups(nodes)
    out = ["doc_id", "node", "first_name", "last_name", "date_of_birth", "patient_id", "cpt_codes", "icd10_codes", "page_numbers", "confidence"]
    united = merged(placed, grouped).select(*out)
    single = placed.join(grouped.select("doc_id", "node"), ["doc_id", "node"], "left_anti").withColumn("page_numbers", F.array("page_no")).select(*out)
    every = united.unionByName(single)
    return every.select("doc_id", F.expr("node div 65536").cast("int").alias("page_no"), (F.col("node") % 65536).alias("idx"), *out[2:], (F.size("page_numbers") > 1).alias("spans_multiple_pages"))
