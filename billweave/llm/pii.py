"""Personal data by bootstrapped contextual extraction.

Fixed patterns give the seeds: e-mail and IP addresses, card and phone numbers. The words around every seed, and around
every other string of such a shape, are its lexical patterns; strings and patterns make a graph, which Spark scores in
rounds: a pattern is trusted for a kind as far as the strings that it surrounds are known to be of that kind (the lower
bound of the share's confidence interval), a string that a trusted pattern surrounds and whose shape allows the kind
becomes known, and known strings count as seeds in the next round, until a round makes none known. Strings known in the
end, wherever they stand, are added to the spans; spans of the fixed patterns stay as they are. Secrets (long tokens that
are assigned to a name like `token` or `password`) seed a kind of their own, which is among the spans only.

Offsets are in code points, ends exclusive. Defined results: null and empty texts have no spans; rows repeated in the
input are rows of the output, with equal spans; of two kinds that trust a string alike the first listed one counts; other
columns, whatever their names, are kept out of the way (`redacted` keeps them all); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import Bits, bits_of, saved, ship, slices, text_bytes

#: The first four have fixed patterns; secrets are found by what stands around them alone.
KINDS = ["email", "ip", "card", "phone", "secret"]
EMAIL, IP, CARD, PHONE, SECRET = range(5)
#: Lower bound of a pattern's share of known strings (one-sided, 95 %).
TRUST, Z = 0.85, 1.645
MAP_LOG2 = 24

# The patterns of the seeds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Strings that may be personal data, told by their context: numbers with seven digits or more, and addresses spelt out.
NUMBER = re.compile(r"(?<![\w.@/])\(?[0-9][0-9\x20().\-]{5,}[0-9](?![\w@/])")
DOTTED = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![\w.])")
SPELT = re.compile(r"(?<![\w.])[A-Za-z0-9][\w.%+-]{0,63}\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
# Long tokens of letters and digits, and those of them that a name in front marks as secret.
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{20,}(?![A-Za-z0-9_+/\-])")
ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|api[_\x20-]?key|access[_\x20-]?key)[\"']?\x20{0,2}(?:=|:)\x20{0,2}[\"']?$", re.IGNORECASE)
#: What SPELT can take instead of an @; every match of the other patterns has a digit or an @.
HINTS = (b"(at)", b"[at]", b" at ")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @: the same as the leftmost ones, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def seeds(text: str) -> list[tuple[int, int, int]]:
    """kind, start and end of the matches of the fixed patterns, by kind and start."""
    out = [(EMAIL, a, b) for a, b in emails(text)]
    out += [(IP, m.start(), m.end()) for m in ADDRESS.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, m.start(), m.end()))
    for m in DIALLED.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((PHONE, m.start(), m.end()))
    return out


def secrets(text: str) -> list[tuple[int, int, int]]:
    """Long tokens that are assigned to a name of secrets."""
    return [(SECRET, m.start(), m.end()) for m in TOKEN.finditer(text) if ASSIGNED.search(text[max(0, m.start() - 20) : m.start()])]


def others(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """start, end and possible kinds (bits) of strings in such shapes that touch no seed."""
    found = []
    for pattern in (SPELT, DOTTED, NUMBER, TOKEN):
        for m in pattern.finditer(text):
            if pattern is NUMBER:
                many = sum(c.isdigit() for c in m.group())
                kinds = (7 <= many <= 15) << PHONE | (13 <= many <= 19) << CARD
            else:
                kinds = 1 << {SPELT: EMAIL, DOTTED: IP, TOKEN: SECRET}[pattern]
            if kinds:
                found.append((m.start(), m.end(), kinds))
    out, taken = [], sorted((a, b) for _, a, b in known)
    for a, b, kinds in sorted(found):
        if not any(x < b and a < y for x, y in taken):
            out.append((a, b, kinds))
            taken.append((a, b))
    return out


def name(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, start: int, end: int) -> list[int]:
    """Names of the lexical patterns around a string: words before it, the word after it, and both."""
    before = [x for w in text[max(0, start - 80) : start].split()[-3:] if (x := w.strip(".,;()\"'").lower())][-2:]
    after = [x for w in text[end : end + 40].split()[:2] if (x := w.strip(".,;()\"'").lower())][:1]
    out = []
    if before:
        out.append("<" + before[-1])
    if len(before) == 2:
        out.append("<" + " ".join(before))
    if after:
        out.append(">" + after[0])
    if before and after:
        out.append(before[-1] + "<>" + after[0])
    return [name(x) for x in out]


def examined(text: str) -> tuple[list[dict], list[dict]]:
    """Matches of the fixed patterns, and every string of the graph with its patterns (kind -1: not a seed)."""
    fixed = seeds(text)
    base = [{"kind": k, "start": a, "end": b} for k, a, b in fixed]
    known = fixed + [x for x in secrets(text) if not any(x[1] < b and a < x[2] for _, a, b in fixed)]
    graph = [{"kind": k, "start": a, "end": b, "kinds": 1 << k, "string": name(text[a:b]), "patterns": contexts(text, a, b)} for k, a, b in known]
    graph += [{"kind": -1, "start": a, "end": b, "kinds": bits, "string": name(text[a:b]), "patterns": contexts(text, a, b)} for a, b, bits in others(text, known)]
    return base, graph


def worth_a_look(data: np.ndarray, off: np.ndarray, raw: bytes) -> np.ndarray:
    """Whether a text has a digit, an @ or a spelt-out one; without them no pattern matches."""
    flag = (data - np.uint8(48) < 10) | (data == 64)
    many = np.concatenate([[0], np.cumsum(flag)])
    out = many[off[1:]] > many[off[:-1]]
    for hint in HINTS:
        at = raw.find(hint)
        while at >= 0:
            k = int(np.searchsorted(off, at, "right")) - 1
            out[k] = True
            at = raw.find(hint, int(off[k + 1]))
    return out


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
STRING = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("kinds", pa.int32()), ("string", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, off = text_bytes(batch.column("text"))
        raw = data.tobytes().lower()
        look = worth_a_look(data, off, raw)
        base: list[list] = [[] for _ in range(batch.num_rows)]
        graph: list[list] = [[] for _ in range(batch.num_rows)]
        hashes = np.zeros(batch.num_rows, np.int64)
        column = batch.column("text")
        for k in np.flatnonzero(look).tolist():
            text = column[k].as_py()
            base[k], graph[k] = examined(text)
            hashes[k] = name(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hashes), pa.array(base, pa.list_(SPAN)), pa.array(graph, pa.list_(STRING))], ["doc_id", "hash", "base", "graph"])


EXAMINED = "doc_id long, hash long, base array<struct<kind:int,start:int,end:int>>, graph array<struct<kind:int,start:int,end:int,kinds:int,string:long,patterns:array<long>>>"


def known_strings(strings: DataFrame) -> DataFrame:
    """string and kind of the strings that the graph makes known, seeds left out.

    strings: rows (kind, kinds, string, patterns) of all seeds and other strings. Known strings only grow, so it ends.
    """
    edges = saved(strings.select("kind", "kinds", "string", F.explode("patterns").alias("pattern")).distinct(), "edges")
    known = edges.where("kind >= 0").select("string", "kind").distinct()
    total = edges.select("pattern", "string").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    unseen = edges.where("kind < 0").select("string", "kinds", "pattern")
    added = None
    share = f"(p + {Z * Z / 2} / n - {Z} * sqrt(p * (1 - p) / n + {Z * Z / 4} / (n * n))) / (1 + {Z * Z} / n)"
    while True:
        hits = edges.select("pattern", "string").distinct().join(known, "string").groupBy("pattern", "kind").agg(F.count("*").alias("hits"))
        trusted = hits.join(total, "pattern").withColumn("p", F.col("hits") / F.col("n")).withColumn("trust", F.expr(share)).where(f"trust >= {TRUST}").select("pattern", "kind", "trust")
        found = unseen.join(trusted, "pattern").where("shiftright(kinds, kind) & 1 = 1").groupBy("string", "kind").agg(F.max("trust").alias("trust"))
        best = found.groupBy("string").agg(F.min(F.struct(-F.col("trust"), "kind")).alias("best")).select("string", F.col("best.kind").alias("kind"))
        fresh = saved(best.join(known, "string", "left_anti"), "known")
        if fresh.isEmpty():
            break
        known = known.union(fresh)
        added = fresh if added is None else added.union(fresh)
    return added if added is not None else known.limit(0)


def found_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with their seeds, and (doc_id, hash, added) of the rows in which strings became known."""
    ship(docs.sparkSession)
    facts = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(examine, EXAMINED), "examined")
    strings = facts.where("size(graph) > 0").select("doc_id", "hash", F.explode("graph").alias("s")).select("doc_id", "hash", "s.*")
    known = known_strings(strings.select("kind", "kinds", "string", "patterns"))
    span = F.struct("kind", "start", "end").alias("span")
    marked = strings.where(f"kind = {SECRET}").select("doc_id", "hash", span)
    added = strings.where("kind < 0").drop("kind").join(known, "string").select("doc_id", "hash", span).union(marked).distinct()
    return facts, saved(added.groupBy("doc_id", "hash").agg(F.collect_list("span").alias("added")), "added")  # of one text


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row: arrays of (kind, start, end) by kind and start; spans holds base as well."""
    facts, added = found_spans(docs)
    both = facts.alias("f").join(added.alias("a"), F.expr("f.hash = a.hash and f.doc_id <=> a.doc_id"), "left")
    spans = F.sort_array(F.concat("f.base", F.coalesce("a.added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return both.select("f.doc_id", F.sort_array("f.base").alias("base"), spans.alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its spans, from the left and the longest first, replaced by the names of their kinds."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k, a, b in spans), key=lambda x: (x[0], -x[1], x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, with personal data masked in text; n_chars, if there, follows."""
    spark = docs.sparkSession
    _, added = found_spans(docs)
    held = spark.sparkContext.broadcast(bits_of(added, "hash", MAP_LOG2))
    names = docs.columns
    own = "_" * (1 + max([0, *map(len, names)]))  # before names of columns that docs doesn't have
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def mask(batch: pa.RecordBatch, rows: np.ndarray, more: dict[int, list] | None) -> pa.RecordBatch:
        column = batch.column("text")
        data, off = text_bytes(column)
        look = worth_a_look(data, off, data.tobytes().lower())
        texts = column.to_pylist()
        sizes = {}
        for k in np.flatnonzero(look).tolist():
            spans = seeds(texts[k]) + (more[k] if more else [])
            if spans:
                texts[k] = masked(texts[k], spans)
                sizes[k] = len(texts[k])
        columns = []
        for c in names:
            if c == "text":
                columns.append(pa.array(texts, column.type))
            elif c == "n_chars" and sizes:
                columns.append(pa.array([sizes.get(k, v) for k, v in enumerate(batch.column(c).to_pylist())], batch.column(c).type))
            else:
                columns.append(batch.column(c))
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(rows))

    def split(batches: Iterator[pa.RecordBatch], wanted: Bits, inside: bool) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = np.array([name(x) if x else 0 for x in batch.column("text").to_pylist()], np.int64)
            on = wanted.has(hashes.view(np.uint64)) == inside
            if not on.any():
                continue
            if inside:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hashes)], [*names, f"{own}hash"]).filter(pa.array(on))
            else:
                yield mask(batch, on, None)

    def mask_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            more = [[(x["kind"], x["start"], x["end"]) for x in row or []] for row in batch.column(f"{own}added").to_pylist()]
            yield mask(batch, np.ones(batch.num_rows, bool), more)

    plain = docs.mapInArrow(lambda b: split(b, held.value, False), docs.schema)
    few = docs.mapInArrow(lambda b: split(b, held.value, True), f"{kinds}, `{own}hash` long")
    extra = added.select(F.col("doc_id").alias(f"{own}doc"), F.col("hash").alias(f"{own}h"), F.col("added").alias(f"{own}added"))
    joined = few.join(extra, F.expr(f"`{own}hash` = `{own}h` and doc_id <=> `{own}doc`"), "left").select(*(F.col(f"`{c}`") for c in [*names, f"{own}added"]))
    return plain.union(joined.mapInArrow(mask_joined, docs.schema))
