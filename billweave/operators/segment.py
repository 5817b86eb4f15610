"""Segmentation: where a text begins to speak of another person, and the segments between such places.

Boundaries are rows (doc_id, start, end, kind, confidence, method, ord): method and ord order equal starts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.functions import constants as C
from billweave.functions.text import NUMBERED, bonus, bound, context, count_of, has_any
from billweave.operators.detect import found_any, searched

BOUNDARY = ["doc_id", "start", "end", "kind", "confidence", "method", "ord"]
# The patterns of labelled codes.
LABELLED = [
    r"(?i)(?:CPT|PROCEDURE)[\s#:]*(\d{5})", r"(?i)(?:CODE|PROC)[\s#:]*(\d{5})", r"(?i)\b(\d{5})\s*[-–]\s*[A-Za-z]",
    r"(?i)(?:ICD|DIAGNOSIS)[\s#:-]*([A-Z]\d{2}(?:\.[A-Z0-9]{1,3})?)", r"(?i)(?:DX|DIAG)[\s#:]*([A-Z]\d{2}(?:\.[A-Z0-9]{1,3})?)", r"(?i)\b([A-Z]\d{2}(?:\.[A-Z0-9]{1,3})?)\s*[-–]\s*[A-Za-z]",
]
# Codes that count where one of the words follows on their line.
FOLLOWED = [(r"(?i)\b(\d{5})\b", "CPT|PROCEDURE|BILLING"), (r"(?i)\b([A-Z]\d{2}(?:\.[A-Z0-9]{1,3})?)\b", "ICD|DIAGNOSIS")]


# Patterns that match where the labelled and followed codes of procedures begin, two each, and the others. Only
# letters stand in a match of one that do not begin a match of the other, so that none is lost.
CODE_STARTS = [rf"(?i)\b\d{{5}}(?:\s*[-–]\s*[A-Za-z]|\b(?=[^\n]*(?:{FOLLOWED[0][1]})))", LABELLED[5]]
OTHER_STARTS = [r"(?i)(?:CPT|PROCEDURE|CODE|PROC)[\s#:]*\d{5}", LABELLED[3], LABELLED[4], rf"{FOLLOWED[1][0]}(?=[^\n]*(?:{FOLLOWED[1][1]}))"]
#: Demographic labels by their first three letters, which tell them apart, wherever one begins.
LABEL_STARTS = r"(?i)\b(?=(?:" + "|".join(p.removeprefix(r"\b").removesuffix(r"\b") for p in C.DEMOGRAPHIC) + r")\b)[A-Z]{3}"


def _boundaries(hits: DataFrame, kind: str, confidence: Column, method: int, end: Column | None = None, order: Column | None = None) -> DataFrame:
    stop = F.lit(None).cast("int") if end is None else end
    return hits.select("doc_id", "start", stop.alias("end"), F.lit(kind).alias("kind"), F.round(confidence, 4).alias("confidence"), F.lit(method).alias("method"), (F.col("start") if order is None else order).alias("ord"))


def near_demographics(text: Column, start: Column, end: Column) -> Column:
    """At least two kinds of demographic labels within 50 characters."""
    found = F.regexp_extract_all(context(text, start, end, 50), F.lit(LABEL_STARTS), F.lit(0))
    return F.size(F.array_distinct(F.transform(found, F.upper))) >= 2


@dataclass(frozen=True)
class Part:
    """A detector of boundaries: its patterns, which of their matches count, and their columns, over k (the pattern's number),
    value, start, end and text."""

    method: int
    kind: str
    patterns: Sequence[str]
    confidence: Callable[[Column], Column]
    keep: Callable[[Column], Column] | None = None
    end: Callable[[], Column] | None = None
    order: Callable[[Column], Column] = lambda k: k
    least: int = 1


def _keyword_score(k: Column) -> Column:
    strong = F.upper("value").isin(C.STRONG_KEYWORDS)
    terms = bound(F.lower(context(F.col("text"), F.col("start"), F.col("end"), 50)), lambda near: count_of(near, C.PATIENT_TERMS))
    return F.least(F.lit(1.0), 0.7 + F.when(strong, 0.2).otherwise(0.0) + F.least(F.lit(0.2), 0.05 * terms))


def _keywords(least: float) -> Part:
    """Whole words exclude each other, so that one pattern finds all."""
    order = F.array_position(F.array(*map(F.lit, C.BOUNDARY_KEYWORDS)), F.upper("value")).cast("int") - 1
    return Part(0, "keyword_separator", [r"(?i)\b(?:" + "|".join(C.BOUNDARY_KEYWORDS) + r")\b"], _keyword_score, lambda k: F.round(_keyword_score(k), 4) >= least, order=lambda k: order)


def _tail() -> Column:
    return F.substring_index(F.substring(F.col("text"), F.col("end") + 1, F.length("text")), "\n", 1)


def _fills_line(k: Column) -> Column:
    head = F.substring_index(F.substring(F.col("text"), F.lit(1), F.col("start")), "\n", -1)
    return F.length("value") / F.length(F.trim(F.concat(head, F.col("value"), _tail()))) > 0.7


IDENTIFIED = Part(1, "form_structure", C.PATIENT_IDS + C.PATIENT_NAMES, lambda k: F.when(k < len(C.PATIENT_IDS), 0.85).otherwise(0.8), lambda k: near_demographics(F.col("text"), F.col("start"), F.col("end")))
REPEATED = Part(2, "pattern_repeat", C.REPEATED_FIELDS, lambda k: F.lit(0.7), least=2)
RULES = Part(3, "form_structure", C.SEPARATORS, lambda k: F.lit(0.6), _fills_line, lambda: F.col("end") + F.length(_tail()))


def _line_score(k: Column) -> Column:
    line = F.col("value")
    upper = (F.upper(line) == line) & (F.lower(line) != line)
    return F.least(F.lit(1.0), 0.5 + bonus(line.contains(":"), 0.2) + bonus(upper, 0.1) + bonus(line.rlike(C.LINE_FIELDS), 0.15))


def _lines(least: float) -> Part:
    """Lines that name a person's field; their number stands as the end."""
    return Part(4, "text_block", [], _line_score, lambda k: F.round(_line_score(k), 4) >= least, order=lambda k: F.col("end"))


def _line_hits(first: int) -> Column:
    """The lines with a word of a person's field as matches; a line starts where the lines before it, with their ends, stop."""
    lines = F.split("text", "\n", -1)
    begin = F.aggregate(lines, F.array(F.lit(0)), lambda at, x: F.array_append(at, F.element_at(at, -1) + F.length(x) + 1))
    each = F.zip_with(F.transform(lines, lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("ord"))), begin, lambda x, at: F.struct(F.lit(first).alias("k"), x["line"].alias("value"), at.alias("start"), x["ord"].alias("end")))
    return F.coalesce(F.filter(each, lambda x: F.coalesce(bound(F.lower(x["value"]), lambda low: has_any(low, C.LINE_INDICATORS)), F.lit(False))), F.array().cast(NUMBERED))


def _parted(texts: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """The boundaries of several detectors, from one pass over the texts."""
    k, names = F.col("k"), [f"found{p.method}" for p in parts]
    first = [sum(max(1, len(p.patterns)) for p in parts[:i]) for i in range(len(parts))]

    def chosen(of: Callable[[Part, Column], Column]) -> Column:
        out = of(parts[-1], k - first[-1])
        for p, n, after in reversed([*zip(parts, first, first[1:])]):
            out = F.when(k < after, of(p, k - n)).otherwise(out)
        return out

    groups = {name: p.patterns for name, p in zip(names, parts) if p.patterns}
    got = searched(texts.select("doc_id", "text"), groups, {name: p.least for name, p in zip(names, parts)}, first=dict(zip(names, first)))
    found = [F.col(name) if p.patterns else _line_hits(n) for name, p, n in zip(names, parts, first)]
    every = got.select("doc_id", "text", F.inline_outer(F.concat(*found) if len(found) > 1 else found[0])).where("k is not null")
    kept = every.where(chosen(lambda p, n: p.keep(n) if p.keep else F.lit(True)))
    none = F.lit(None).cast("int")
    return kept.select(
        "doc_id", "start", chosen(lambda p, _: none if p.end is None else p.end()).alias("end"), chosen(lambda p, _: F.lit(p.kind)).alias("kind"), F.round(chosen(lambda p, n: p.confidence(n)), 4).alias("confidence"),
        chosen(lambda p, _: F.lit(p.method)).alias("method"), chosen(lambda p, n: p.order(n)).alias("ord"),
    )


def keyword_boundaries(texts: DataFrame, least: float = 0.8) -> DataFrame:
    return _parted(texts, [_keywords(least)])


def identifier_boundaries(texts: DataFrame) -> DataFrame:
    """Labelled identifiers, and a little less sure labelled names, among other labels of a person."""
    return _parted(texts, [IDENTIFIED])


def repeated_boundaries(texts: DataFrame) -> DataFrame:
    """Fields that a text holds more than once."""
    return _parted(texts, [REPEATED])


def rule_boundaries(texts: DataFrame) -> DataFrame:
    """Runs of ten separators or more that fill most of their line."""
    return _parted(texts, [RULES])


def line_boundaries(texts: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines that name a person's field; a line starts where the lines before it, with their ends, stop."""
    return _parted(texts, [_lines(least)])


def labelled_codes(texts: DataFrame) -> DataFrame:
    """Codes with a label or a description, or with a word about codes after them on their line: doc_id, start, end."""
    followed = [rf"{code}(?=[^\n]*(?:{words}))" for code, words in FOLLOWED]
    return found_any(texts, LABELLED + followed).select("doc_id", "start", "end")


def _starts(*hits: str) -> Column:
    return F.sort_array(F.array_distinct(F.transform(F.concat(*hits) if len(hits) > 1 else F.col(hits[0]), lambda x: x["start"])))


def with_islands(texts: DataFrame, gap: int, parted: bool = False) -> DataFrame:
    """texts with the islands of their labelled codes, as an array of cluster, first, last and codes; texts with four codes
    at least, islands of two. parted: only of texts with a gap between islands; others may have an empty array."""
    got = searched(texts, {"codes_": CODE_STARTS})
    on = None
    if parted:
        # Where the codes that are found first leave no gap, not even to the ends of the text, no other code can make one.
        far = bound(_starts("codes_"), lambda s: F.exists(F.zip_with(F.concat(F.array(F.lit(0)), s), F.concat(s, F.array(F.length("text"))), lambda a, b: b - a), lambda n: n > gap))
        got, on = got.withColumn("far_", far), {"others_": F.col("far_")}
    got = searched(got, {"others_": OTHER_STARTS}, on=on)
    starts = _starts("codes_", "others_") if not parted else F.when(F.col("far_"), _starts("codes_", "others_"))

    def islands(s: Column) -> Column:
        fresh = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x - F.get(s, i - 1) > gap), i)), lambda i: i.isNotNull())

        def island(b: Column) -> Column:
            each = F.transform(b, lambda i, c: bound(F.coalesce(F.get(b, c + 1), F.size(s)), lambda after: F.struct(c.alias("cluster"), F.get(s, i).alias("first"), F.get(s, after - 1).alias("last"), (after - i).cast("long").alias("codes"))))
            return F.filter(each, lambda x: x["codes"] >= 2)

        return F.when(F.size(s) >= 4, bound(fresh, island))

    return got.select(*texts.columns, bound(starts, islands).alias("islands"))


def code_clusters(texts: DataFrame, gap: int = 300) -> DataFrame:
    """Islands of labelled codes: doc_id, cluster, first, last and codes; texts with four codes at least, islands of two."""
    return with_islands(texts.select("doc_id", "text"), gap).select("doc_id", F.inline_outer("islands")).where("cluster is not null")


def cluster_boundaries(texts: DataFrame, least_gap: int = 200, large_gap: int = 500, gap: int = 300) -> DataFrame:
    """Gaps between islands, moved to the line start within 100 characters before the second one."""
    pairs = bound(F.col("islands"), lambda s: F.transform(s, lambda x, i: F.struct(x["cluster"].alias("cluster"), x["first"].alias("first"), F.get(s, i - 1)["last"].alias("before"))))
    got = with_islands(texts.select("doc_id", "text"), gap, parted=True)
    gaps = got.select("doc_id", "text", F.inline_outer(pairs)).where(F.col("first") - F.col("before") > least_gap)
    between = F.lower(F.substring(F.col("text"), F.col("before") + 1, F.col("first") - F.col("before")))
    named = bound(between, lambda x: has_any(x, [w.lower() for w in C.BOUNDARY_KEYWORDS]))
    score = 0.7 + bonus(named, 0.2) + bonus(F.col("first") - F.col("before") > large_gap, 0.1)
    window = F.substring(F.col("text"), F.greatest(F.col("first") - 100, F.lit(0)) + 1, F.least(F.col("first"), F.lit(100)))
    line = F.length(F.regexp_extract(window, r"(?s)^.*\n", 0))
    start = F.when(line > 0, F.greatest(F.col("first") - 100, F.lit(0)) + line).otherwise(F.col("first"))
    return _boundaries(gaps.withColumn("start", start), "text_block", F.least(F.lit(1.0), score), 5, order=F.col("cluster"))


def boundaries(texts: DataFrame) -> DataFrame:
    """All detectors in their order: one pass for those whose matches are boundaries, one for the gaps between clusters."""
    every = _parted(texts, [_keywords(0.8), IDENTIFIED, REPEATED, RULES, _lines(0.5)])
    return every.unionByName(cluster_boundaries(texts).select(*BOUNDARY))


def sifted(found_rows: DataFrame, distance: int = 100, most: int = 9) -> DataFrame:
    """One boundary of those within `distance` of the last one kept, the strictly most confident; the first `most` stay.

    Kept ones stand `distance` apart, so only the last kept one can be in conflict: a fold over the ordered array.
    """
    each = F.array_sort(F.collect_list(F.struct("start", "method", "ord", "confidence", "kind")))
    kind = "array<struct<start:int,method:int,ord:int,confidence:double,kind:string>>"

    def step(kept: Column, b: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (b["start"] - last["start"] < distance)
        swapped = F.array_append(F.slice(kept, 1, F.size(kept) - 1), b)
        return F.when(near & (b["confidence"] > last["confidence"]), swapped).when(near, kept).otherwise(F.array_append(kept, b))

    listed = found_rows.groupBy("doc_id").agg(each.cast(kind).alias("bs"))
    kept = F.aggregate("bs", F.array().cast(kind), step)
    return listed.select("doc_id", F.posexplode(F.slice(kept, 1, most)).alias("idx", "b")).select("doc_id", "idx", "b.start", "b.kind", "b.confidence")


def segments(texts: DataFrame, kept: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, seg_idx, start, end, text and confidence. Without boundaries the whole text; a head before the first one."""
    listed = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "confidence"))).alias("bs"))
    both = texts.where("text is not null").join(listed, "doc_id", "left")
    size = F.length("text")
    none = F.array(F.struct(F.lit(0).alias("start"), F.lit(1.0).alias("confidence")))
    head = F.when(F.col("bs")[0]["start"] > 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(0.8).alias("confidence")))).otherwise(F.array().cast("array<struct<start:int,confidence:double>>"))
    starts = F.when(F.col("bs").isNull(), none).otherwise(F.concat(head, "bs"))
    each = both.select("doc_id", "text", size.alias("size"), starts.alias("starts")).select("doc_id", "text", "size", F.posexplode("starts").alias("k", "s"), "starts")
    end = F.coalesce(F.get("starts", F.col("k") + 1)["start"], F.col("size"))
    cut = each.select("doc_id", "k", F.col("s.start").alias("start"), end.alias("end"), F.substring(F.col("text"), F.col("s.start") + 1, end - F.col("s.start")).alias("text"), F.col("s.confidence").alias("confidence"), (F.size("starts") == 1).alias("alone"))
    long = cut.where((F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > least) | (F.col("alone") & (F.col("confidence") == 1.0)))
    order = Window.partitionBy("doc_id").orderBy("start", "k")
    return long.withColumn("seg_idx", F.row_number().over(order) - 1).select("doc_id", "seg_idx", "start", "end", "text", "confidence")


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id and text of pages(doc_id, page_no, text), with a page break between."""
    listed = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), C.PAGE_BREAK).alias("text"))


def split_pages(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.posexplode(F.split("text", C.PAGE_BREAK)).alias("page_no", "text"))


def grid_chunks(pages: DataFrame, most_width: int, most_height: int, overlap: float = 0.1, most_tokens: int | None = None, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, chunk_index and box (x1, y1, x2, y2) of pages(keys, width, height): a grid with overlapping inner edges.

    With most_tokens, pages also have tokens; a grid whose cells would hold more has more columns and rows, by the
    square root of the excess.
    """
    nx, ny = F.ceil(F.col("width") / most_width), F.ceil(F.col("height") / most_height)
    if most_tokens is not None:
        excess = F.greatest(F.lit(1.0), F.sqrt(F.coalesce(F.col("tokens"), F.lit(0)) / (nx * ny) / most_tokens))
        nx, ny = F.ceil(nx * excess), F.ceil(ny * excess)
    cells = pages.select(*keys, "width", "height", nx.cast("int").alias("nx"), ny.cast("int").alias("ny"))
    cells = cells.withColumn("row", F.explode(F.expr("sequence(0, ny - 1)"))).withColumn("col", F.explode(F.expr("sequence(0, nx - 1)")))
    w, h = F.col("width") / F.col("nx"), F.col("height") / F.col("ny")
    dx, dy = F.floor(w * overlap), F.floor(h * overlap)
    x1 = F.when(F.col("col") > 0, F.floor(F.col("col") * w) - dx).otherwise(0)
    y1 = F.when(F.col("row") > 0, F.floor(F.col("row") * h) - dy).otherwise(0)
    x2 = F.when(F.col("col") < F.col("nx") - 1, F.floor((F.col("col") + 1) * w) + dx).otherwise(F.col("width"))
    y2 = F.when(F.col("row") < F.col("ny") - 1, F.floor((F.col("row") + 1) * h) + dy).otherwise(F.col("height"))
    return cells.select(*keys, (F.col("row") * F.col("nx") + F.col("col")).cast("int").alias("chunk_index"), *(x.cast("int").alias(n) for x, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))))


BLOCKS = "array<struct<y:int,x:int,w:int,h:int,tokens:int,pack:int,total:int>>"


def layout_chunks(blocks: DataFrame, most_width: int, most_height: int, most_tokens: int, padding: int = 10) -> DataFrame:
    """page_id, chunk_index, box, tokens and whole of blocks(page_id, x, y, w, h, tokens, width, height), with the page's size.

    Blocks are packed from top to bottom, then left to right, until most_tokens; a pack's box has a margin inside its
    page. A block that is too large by itself ends the pack before it and is cut as a grid (whole is false; its tokens are
    the block's). One page's blocks are folded at a time.
    """
    block = F.struct(*(F.col(c).cast("int").alias(c) for c in ("y", "x", "w", "h", "tokens")), F.lit(0).alias("pack"), F.col("tokens").cast("int").alias("total"))
    listed = blocks.groupBy("page_id", "width", "height").agg(F.array_sort(F.collect_list(block)).cast(BLOCKS).alias("bs"))

    def step(packed: Column, b: Column) -> Column:
        last = F.element_at(packed, -1)
        fresh = (b["tokens"] > most_tokens) | (last["tokens"] > most_tokens) | (last["total"] + b["tokens"] > most_tokens)
        placed = F.struct(b["y"], b["x"], b["w"], b["h"], b["tokens"], (last["pack"] + fresh.cast("int")).alias("pack"), F.when(fresh, b["tokens"]).otherwise(last["total"] + b["tokens"]).alias("total"))
        return F.when(F.size(packed) == 0, F.array(b)).otherwise(F.concat(packed, F.array(placed))).cast(BLOCKS)

    packed = listed.select("page_id", "width", "height", F.inline(F.aggregate("bs", F.array().cast(BLOCKS), step)))
    packs = packed.groupBy("page_id", "width", "height", "pack").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("below"), F.sum("tokens").cast("int").alias("tokens"), F.max("tokens").alias("largest"))
    fit = packs.where(F.col("largest") <= most_tokens).select(
        "page_id", "pack", F.lit(0).alias("cell"), F.greatest(F.col("x") - padding, F.lit(0)).alias("x1"), F.greatest(F.col("y") - padding, F.lit(0)).alias("y1"),
        F.least(F.col("right") + padding, F.col("width")).cast("int").alias("x2"), F.least(F.col("below") + padding, F.col("height")).cast("int").alias("y2"), "tokens", F.lit(True).alias("whole"),
    )
    large = packs.where(F.col("largest") > most_tokens).select("page_id", "pack", "x", "y", "tokens", (F.col("right") - F.col("x")).alias("width"), (F.col("below") - F.col("y")).alias("height"))
    keys = ("page_id", "pack", "x", "y", "tokens")
    cut = grid_chunks(large, most_width, most_height, most_tokens=most_tokens, keys=keys).select("page_id", "pack", F.col("chunk_index").alias("cell"), *((F.col(c) + F.col(c[0])).alias(c) for c in ("x1", "y1", "x2", "y2")), "tokens", F.lit(False).alias("whole"))
    order = Window.partitionBy("page_id").orderBy("pack", "cell")
    return fit.unionByName(cut).select("page_id", (F.row_number().over(order) - 1).alias("chunk_index"), "x1", "y1", "x2", "y2", "tokens", "whole")


def needs_chunks(width: Column, height: Column, tokens: Column, most_width: int, most_height: int, most_tokens: int) -> Column:
    return (width > most_width) | (height > most_height) | (tokens > most_tokens)


def combined_chunks(chunks: DataFrame, gap: int = 20) -> DataFrame:
    """page_id and text of chunks(page_id, x1, y1, y2, text): by y and x, a blank line where more than `gap` is free."""
    lines = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    order = Window.partitionBy("page_id").orderBy("y1", "x1")
    each = chunks.withColumn("lines", lines).where("lines != ''").withColumn("far", F.lead("y1").over(order) - F.col("y2") > gap).withColumn("k", F.row_number().over(order))
    part = F.concat(F.col("lines"), F.when(F.col("far"), "\n").otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("k", part.alias("part"))))
    return each.groupBy("page_id").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "\n").alias("text"))


def kept_boxes(boxes: DataFrame, most: int = 10, least_width: float = 0.1, least_height: float = 0.05, most_overlap: float = 0.5) -> DataFrame:
    """page_id and kept boxes of boxes(page_id, ord, x1, y1, x2, y2, width, height): large ones, none over half another kept."""
    big = boxes.where((F.col("x2") - F.col("x1") >= least_width * F.col("width")) & (F.col("y2") - F.col("y1") >= least_height * F.col("height")))
    kind = "array<struct<ord:int,x1:int,y1:int,x2:int,y2:int>>"
    listed = big.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2"))).cast(kind).alias("bs"))
    from billweave.functions.scores import iou

    kept = F.aggregate("bs", F.array().cast(kind), lambda acc, b: F.when((F.size(acc) < most) & ~F.exists(acc, lambda a: iou(a, b) > most_overlap), F.array_append(acc, b)).otherwise(acc))
    return listed.select("page_id", F.inline(kept))


# Labelled values of a person, and words that open another one.
PERSON_VALUES = [r"(?i)Name:\s*([A-Za-z\s]+)", r"(?i)DOB:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(?i)Patient\s+ID:\s*(\w+)", r"(?i)MRN:\s*(\w+)"]
NEW_PERSON = [r"(?i)Patient\s*Information", r"(?i)Patient\s*Demographics", r"(?i)New\s*Patient", r"(?i)Insurance\s*Information"]


def different_people(before: Column, after: Column, least: float = 0.7) -> Column:
    """Whether two texts seem to be about different people: a labelled value of the one is unlike one of the other
    (by edits over the longer length), or the second opens a new person."""

    def values(text: Column) -> Column:
        every = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PERSON_VALUES))
        return F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != "")

    def unlike(a: Column, b: Column) -> Column:
        return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) < least

    opened = reduce(lambda a, b: a | b, [after.rlike(p) for p in NEW_PERSON])
    return F.coalesce(F.exists(values(before), lambda a: F.exists(values(after), lambda b: unlike(a, b))) | opened, F.lit(False))


def sifted_again(found_rows: DataFrame, texts: DataFrame, distance: int = 100, most: int = 10) -> DataFrame:
    """Of boundaries at most `distance` apart the more confident; none between a label and its value; then the `most`
    confident ones, in order."""
    kind = "array<struct<start:int,method:int,ord:int,confidence:double,kind:string>>"
    listed = found_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "method", "ord", "confidence", "kind"))).cast(kind).alias("bs"))

    def step(kept: Column, b: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (b["start"] - last["start"] <= distance)
        swapped = F.array_append(F.slice(kept, 1, F.size(kept) - 1), b)
        return F.when(near & (b["confidence"] > last["confidence"]), swapped).when(near, kept).otherwise(F.array_append(kept, b))

    kept = listed.select("doc_id", F.inline(F.aggregate("bs", F.array().cast(kind), step))).join(texts.select("doc_id", "text"), "doc_id")
    head = F.substring(F.col("text"), F.greatest(F.col("start") - 50, F.lit(0)) + 1, F.least(F.col("start"), F.lit(50)))
    tail = F.substring(F.col("text"), F.col("start") + 1, F.lit(50))
    whole = kept.where(~(head.rlike(r":\s*$") & tail.rlike(r"^\s*[A-Za-z0-9]")))
    best = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "start")
    top = whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return top.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).select("doc_id", "idx", "start", "kind", "confidence")


def page_break_boundaries(texts: DataFrame, width: int = 200) -> DataFrame:
    """Page breaks between texts about different people."""
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    before = F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))
    other = different_people(before, F.substring(text, end + 1, F.lit(width)))
    return _boundaries(found_any(texts, [C.BROKEN_PAGE]).where(other), "page_break", F.lit(0.7), 6, end)


def header_boundaries(texts: DataFrame) -> DataFrame:
    """Headers of forms that a text holds more than once; surer with a word that separates people around them."""
    words = r"(?i)\b(?:" + "|".join(C.BOUNDARY_KEYWORDS) + r")\b"
    score = F.when(context(F.col("text"), F.col("start"), F.col("end"), 100).rlike(words), 0.85).otherwise(0.7)
    return _boundaries(found_any(texts, C.FORM_HEADERS, least=2), "form_structure", score, 7, order=F.col("k"))


def demographic_boundaries(texts: DataFrame, gap: int = 200, least: int = 3) -> DataFrame:
    """The starts of blocks of at least `least` labelled fields, each less than `gap` characters after the one before."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "k")
    fields = found_any(texts, C.PERSON_FIELDS).select("doc_id", "k", "start", "end")
    marked = fields.withColumn("fresh", F.coalesce((F.col("start") - F.lag("end").over(order) >= gap).cast("int"), F.lit(0)))
    blocks = marked.withColumn("block", F.sum("fresh").over(order)).groupBy("doc_id", "block").agg(F.min("start").alias("start"), F.count("*").alias("n"))
    return _boundaries(blocks.where(F.col("n") >= least), "text_block", F.lit(0.8), 8)


def enhanced(texts: DataFrame, kept: DataFrame, doubt: float = 0.8) -> DataFrame:
    """Boundaries kept(doc_id, idx, start, kind, confidence) after a second look at texts with none, or with one below
    `doubt`: page breaks, repeated headers and blocks of fields are added and all are sifted again. Other texts keep
    theirs. A text in which nothing is found has no row."""
    mine = Window.partitionBy("doc_id")
    seen = kept.withColumn("sure", (F.count("*").over(mine) > 1) | F.coalesce(F.max("confidence").over(mine) >= doubt, F.lit(False)))
    sure = seen.where("sure").drop("sure")
    weak = texts.select("doc_id", "text").join(sure.select("doc_id"), "doc_id", "left_anti")
    first = seen.where("not sure").select("doc_id", "start", F.lit(None).cast("int").alias("end"), "kind", "confidence", F.lit(-1).alias("method"), F.col("idx").alias("ord"))
    every = reduce(DataFrame.unionByName, [first, page_break_boundaries(weak), header_boundaries(weak), demographic_boundaries(weak)])
    return sure.unionByName(sifted_again(every, weak))
