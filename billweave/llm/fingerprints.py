"""Document fingerprints by content-defined chunking.

A gear hash over the last eight bytes proposes boundaries; normalised chunking asks for more bits before the target size
than after it, so that chunk sizes gather near the target, and a cut resynchronises after insertions and deletions. The
fingerprint is the set of the chunks' digests with their lengths, and the likeness of one text to another is the share of
its distinct chunks, weighted by length, that the other has: containment.

The gear hash is a sum of shifted byte values, so it is computed for all positions at once by doubling; chunks of all
texts of a batch are then cut in step.

Defined results: null counts as the empty text, whose fingerprint is the empty string; an empty text is like an empty one
(1) and like no other (0); equal texts have equal fingerprints; a text shorter than the least chunk is one chunk; other
columns, whatever their names, are kept out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import byte_values, mix, powers, ship, slices, text_bytes

LEAST, TARGET, MOST = 8, 32, 128
#: Bits that must be zero for a cut before and after the target size.
STRICT_BITS, LOOSE_BITS = 6, 4
#: Characters of a fingerprint: six for a digest of 36 bits, two for the length.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
ENTRY = 8


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last eight bytes at each position (fewer at the start)."""
    h = (byte_values(False, 7) >> np.uint64(32)).astype(np.uint32)[data]
    for step in (1, 2, 4):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of every chunk."""
    h = gear(data) >> np.uint32(8)
    loose = np.flatnonzero((h & np.uint32((1 << LOOSE_BITS) - 1)) == 0)
    strict = loose[(h[loose] & np.uint32((1 << STRICT_BITS) - 1)) == 0] + 1
    loose = loose + 1
    far = np.int64(len(data) + MOST + 1)
    strict, loose = np.append(strict, far), np.append(loose, far)
    doc = np.flatnonzero(off[:-1] < off[1:])
    at, end = off[:-1][doc], off[1:][doc]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(doc):
        cut = strict[np.searchsorted(strict, at + LEAST)]
        late = cut > at + TARGET
        if late.any():
            cut[late] = np.minimum(loose[np.searchsorted(loose, at[late] + TARGET)], at[late] + MOST)
        np.minimum(cut, end, out=cut)
        out.append((doc, at, cut))
        more = cut < end
        doc, at, end = doc[more], cut[more], end[more]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def entries(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted distinct keys: text number (20 bits), digest (36 bits) and length (8 bits) of each chunk."""
    doc, start, end = chunks(data, off)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(False, 11)[data] * up[: len(data)], out=total[1:])
    digest = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    keys = doc.astype(np.uint64) << np.uint64(44) | (digest >> np.uint64(28)) << np.uint64(8) | (end - start).astype(np.uint64)
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def as_text(keys: np.ndarray, n: int) -> list[str]:
    """The fingerprint strings of n texts."""
    out = np.empty((len(keys), ENTRY), np.uint8)
    for k in range(6):
        out[:, k] = ALPHABET[((keys >> np.uint64(38 - 6 * k)) & np.uint64(63)).astype(np.int64)]
    out[:, 6] = ALPHABET[((keys >> np.uint64(6)) & np.uint64(3)).astype(np.int64)]
    out[:, 7] = ALPHABET[(keys & np.uint64(63)).astype(np.int64)]
    whole = out.tobytes().decode("ascii")
    at = (ENTRY * np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))).tolist()
    return list(map(whole.__getitem__, map(slice, at, at[1:])))


def from_text(fingerprint: str) -> dict[str, int]:
    """Digest and length of each chunk of a fingerprint."""
    place = {chr(c): k for k, c in enumerate(ALPHABET)}
    parts = [fingerprint[k : k + ENTRY] for k in range(0, len(fingerprint), ENTRY)]
    return {p[:6] + p[6:]: place[p[6]] * 64 + place[p[7]] for p in parts}


def likeness(fingerprint: str, other: str) -> float:
    """The share of a fingerprint's chunks, by length, that another has."""
    own, its = from_text(fingerprint), from_text(other)
    if not own:
        return float(not its)
    return sum(v for k, v in own.items() if k in its) / sum(own.values())


def contained(keys: np.ndarray, others: np.ndarray, n: int) -> np.ndarray:
    """likeness() of n texts to as many others, from keys with equal numbers."""
    doc = (keys >> np.uint64(44)).astype(np.int64)
    size = (keys & np.uint64(255)).astype(np.float64)
    at = np.minimum(np.searchsorted(others, keys), max(len(others) - 1, 0))
    hit = others[at] == keys if len(others) else np.zeros(len(keys), bool)
    total = np.bincount(doc, size, n)
    shared = np.bincount(doc[hit], size[hit], n)
    its = np.bincount((others >> np.uint64(44)).astype(np.int64), minlength=n)
    return np.where(total > 0, shared / np.maximum(total, 1), (its == 0).astype(float))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint (string) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = as_text(entries(*text_bytes(batch.column("text"))), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, extra, doc_id, text) in order; the first extra row of a bucket is the one after its last."""
    pending: pa.Table | None = None
    for piece in slices(batches):
        rows = pa.Table.from_batches([piece])
        rows = pa.concat_tables([pending, rows]) if pending is not None else rows
        rows = rows.combine_chunks()
        batch = rows.to_batches()[0]
        n = batch.num_rows
        pending = rows.slice(n - 1)
        extra = batch.column("extra").to_numpy(zero_copy_only=False)
        out = np.flatnonzero(~extra[:-1])  # each has the row after it in its bucket
        if len(out):
            yield _edited(batch, out)


def _edited(batch: pa.RecordBatch, out: np.ndarray) -> pa.RecordBatch:
    data, off = text_bytes(batch.column("text"))
    raw = data.tobytes()
    place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(place, off)
    n_chars = np.diff(first)
    replaced = n_chars[out] // 3
    keep_to = np.minimum(place[first[out] + n_chars[out] - replaced], off[out + 1])
    head_to = np.minimum(place[first[out + 1] + np.minimum(replaced, n_chars[out + 1])], off[out + 2])
    texts = [raw[a:b] + raw[c:d] for a, b, c, d in zip(off[out].tolist(), keep_to.tolist(), off[out + 1].tolist(), head_to.tolist())]
    keys = entries(data, off)
    numbers = (keys >> np.uint64(44)).astype(np.int64)
    to = np.full(batch.num_rows + 1, -1)
    to[out] = np.arange(len(out))  # renumbered as in the output

    def renumbered(shift: int) -> np.ndarray:
        new = to[numbers - shift]
        kept = (new >= 0) & (numbers >= shift)
        return new[kept].astype(np.uint64) << np.uint64(44) | keys[kept] & np.uint64((1 << 44) - 1)

    own, following = renumbered(0), renumbered(1)
    joined = b"".join(texts)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    edited = entries(np.frombuffer(joined, np.uint8), ends)
    columns = [
        batch.column("doc_id").take(pa.array(out)), pa.array(n_chars[out]), pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
        pa.array(as_text(own, len(out))), pa.array(as_text(edited, len(out))), pa.array(contained(own, edited, len(out))), pa.array(contained(own, following, len(out))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints_beside_edits(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint beside that of its edited text, and its likeness to that and to the next document's.

    The edited text has its last third (rounded down, in code points) replaced by as many first code points of the next
    document, or all: by descending doc_id, null ids last, equal ids by descending text; after the last comes the first.

    Documents are dealt once, by ranges of doc_id; the first of each range goes to the range before as well, so that no
    task needs more than its own rows.
    """
    ship(docs.sparkSession)
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    least = -(2**63)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("order"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / (3 * parts) for k in range(1, 3 * parts)]
    bounds = source.select(F.percentile_approx("order", shares, 20 * parts).alias("at")).first().at or []
    splits = [-float("inf"), *(sorted({float(x) for x in bounds}) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="value", outputCol="bucket")
    source = cut.transform(source.withColumn("value", F.col("order").cast("double"))).withColumn("bucket", F.col("bucket").cast("int")).drop("value")
    firsts = sorted(((r.bucket, r.first) for r in source.groupBy("bucket").agg(F.max("order").alias("first")).collect()), reverse=True)  # one for each range
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = [(firsts[k][1], firsts[k - 1][0]) for k in range(len(firsts))]  # the first one's is the last range
    also = F.broadcast(spark.createDataFrame(before, "order long, also int"))
    dealt = source.join(also, "order", "left").withColumn("to", F.explode(F.expr("case when also is null then array(struct(bucket as b, false as extra)) else array(struct(bucket as b, false as extra), struct(also as b, true as extra)) end")))
    dealt = dealt.select(F.col("to.b").alias("bucket"), F.col("to.extra").alias("extra"), "order", "doc_id", "text")
    sorted_rows = dealt.repartition("bucket").sortWithinPartitions(F.desc("bucket"), "extra", F.desc("order"), F.desc("doc_id"), F.desc("text"))
    return sorted_rows.select("bucket", "extra", "doc_id", "text").mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
