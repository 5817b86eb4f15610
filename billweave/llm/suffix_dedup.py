"""Removal of long byte strings that occur more than once, by external induced suffix sorting of shards.

Every window of `length` bytes is dealt by content: its anchor is the least hash of its grams, so equal windows have
equal anchors wherever they stand. Neighbouring windows with one anchor travel together as a piece. Anchors that occur
once need no sorting. Pieces that are equal as a whole are repeats at once, and only one of each goes on; the pieces of
an anchor meet in a shard, and an induced suffix sort of the shard (billweave.llm.induced_sort) finds the windows that
share `length` bytes with another. A shard is written to the task's own temporary folder and may be far larger than
memory; tables between steps are in the shared folder.

`shared_passages` tells the rows that share a shorter passage with another row, which is too short to be removed: from
the same pieces, by the bytes beside their anchors, without sorting.

Texts are UTF-8 bytes, null counts as empty, and matches never cross rows. Windows are judged on the input, repeated rows
included, so each of two equal long rows is removed whole. Texts under `length` bytes have no window. Other columns,
whatever their names, are kept out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import Bits, bits_of, byte_values, mix, powers, saved, ship, slices, text_bytes
from billweave.llm.induced_sort import repeated_starts

LENGTH = 400
GRAM = 32
#: Bytes of a passage (some fifty words) that rows share; see shared_passages().
PASSAGE = 250
#: A longer text is cut into blocks that overlap by a window less one byte.
BLOCK_BYTES = 4 << 20
MAP_LOG2 = 24
#: Bytes of pieces that a shard is to hold; an anchor that alone has more makes a larger one.
SHARD_BYTES = 3 << 20


def pieces(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """start, end, anchor hash, digest, and hashes of the bytes on the left and the right of the anchor, of the pieces
    of all windows of the texts.

    The bytes beside the anchor are so many that each window has all of one side's; 0 where a piece has fewer.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    nothing = (none, none, *[none.astype(np.uint64)] * 4)
    if n < length:
        return nothing
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values(False, 5)[data] * up[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    least = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)  # the place breaks ties, the first wins
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    least = np.minimum(least[: n - length + 1], least[rest : rest + n - length + 1])
    edge = np.zeros(n + 2, np.int64)
    long = off[1:] - off[:-1] >= length
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, off[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[: n - length + 1]))
    if not len(window):
        return nothing
    at = (least[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
    first = np.flatnonzero(fresh)
    start = window[first]
    end = window[np.append(first[1:], len(window)) - 1] + length

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

    side, place = (length - GRAM) // 2, at[first]
    left = np.where(place - side >= start, hashed(np.maximum(place - side, 0), place), np.uint64(0))
    after = np.minimum(place + GRAM, n)
    right = np.where(after + side <= end, hashed(after, np.minimum(after + side, n)), np.uint64(0))
    return start, end, grams[place], hashed(start, end), left, right


def text_hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def blocks(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """The texts as they are, or a long one in overlapping blocks: bytes, offsets, number of the first text, place."""
    if len(off) > 2 or len(data) <= BLOCK_BYTES:
        yield data, off, 0, 0
        return
    step = max(BLOCK_BYTES, 2 * length)
    for at in range(0, max(1, len(data) - length + 1), step):
        part = data[at : at + step + length - 1]
        yield part, np.array([0, len(part)]), 0, at


PIECE = "doc_id long, hash long, start int, end int, anchor long, digest long, `left` long, `right` long"


def described(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, off = text_bytes(batch.column("text"))
        raw = data.tobytes()
        hashes = np.array([text_hash(raw[a:b]) if b - a >= length else 0 for a, b in zip(off.tolist(), off[1:].tolist())], np.int64)
        for part, cut, number, place in blocks(data, off, length):
            start, end, *hashed = pieces(part, cut, length)
            if not len(start):
                continue
            doc = np.searchsorted(cut, start, "right") - 1
            base = cut[doc] - place
            columns = [batch.column("doc_id").take(pa.array(doc + number)), pa.array(hashes[doc + number]), pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in hashed)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "start", "end", "anchor", "digest", "left", "right"])


def sides(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The names of an anchor with the bytes on one side of it, of all pieces of a text: each once a text and slice."""
    for part in described(batches, length):
        anchor, left, right = (part.column(c).to_numpy().view(np.uint64) for c in ("anchor", "left", "right"))
        names = np.concatenate([mix(anchor * np.uint64(3) + left), mix(anchor * np.uint64(5) + right)]).view(np.int64)
        there = np.concatenate([left != 0, right != 0])
        rows = pa.table({"doc_id": pa.concat_arrays([part.column("doc_id")] * 2), "hash": pa.concat_arrays([part.column("hash")] * 2), "side": pa.array(names)}).filter(pa.array(there))
        yield from rows.group_by(["doc_id", "hash", "side"]).aggregate([]).select(["doc_id", "hash", "side"]).to_batches()


def texts_in(batches: Iterator[pa.RecordBatch], wanted: Bits, inside: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, hash and text of the rows whose hash may be wanted (inside), or of all others."""
    for batch in slices(batches):
        data, off = text_bytes(batch.column("text"))
        raw = data.tobytes()
        hashes = np.array([text_hash(raw[a:b]) for a, b in zip(off.tolist(), off[1:].tolist())], np.int64)
        on = wanted.has(hashes.view(np.uint64)) == inside
        if on.any():
            rows = np.flatnonzero(on)
            text = pa.array([raw[off[k] : off[k + 1]] for k in rows.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(hashes[rows]), text], ["doc_id", "hash", "text"])


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces that are listed beside each text."""
    names = ["anchor", "digest", "doc_id", "hash", "start", "alone", "bytes"]
    for batch in slices(batches):
        out: list[list] = [[] for _ in names]
        for doc, h, text, listed in zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), batch.column("text"), batch.column("listed").to_pylist()):
            raw = text.as_buffer().to_pybytes()
            for x in listed:
                for o, v in zip(out, (x["anchor"], x["digest"], doc, h, x["start"], x["alone"], raw[x["start"] : x["end"]])):
                    o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)


def sorted_shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the pieces that stand alone for their digest, as byte ranges of their rows.

    The shard's bytes go to a file of this task; only numbers for each piece stay in memory.
    """
    ends: list[np.ndarray] = []
    facts: list[pa.Table] = []
    size = 0
    with tempfile.TemporaryDirectory(prefix="shard-") as folder:
        path = os.path.join(folder, "bytes")
        with open(path, "wb") as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                data, off = text_bytes_of_binary(batch.column("bytes"))
                data.tofile(f)
                ends.append(off[1:] + size)
                size += len(data)
                facts.append(pa.Table.from_batches([batch.select(["doc_id", "hash", "start", "alone"])]))
        if not size:
            return
        text = np.memmap(path, np.uint8, "r")
        stop = np.concatenate(ends)
        found = repeated_starts(text, stop, length, folder)
        del text
    piece = np.searchsorted(stop, found, "right")
    rows = pa.concat_tables(facts).combine_chunks()
    alone = rows.column("alone").to_numpy()
    begin = np.concatenate([[0], stop[:-1]])
    keep = alone[piece]
    found, piece = found[keep], piece[keep]
    if not len(found):
        return
    fresh = np.concatenate([[True], (piece[1:] != piece[:-1]) | (found[1:] != found[:-1] + 1)])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(found)) - 1
    which = piece[first]
    base = rows.column("start").to_numpy()[which] - begin[which]
    take = pa.array(which)
    yield from pa.table({"doc_id": rows.column("doc_id").take(take), "hash": rows.column("hash").take(take), "from": pa.array((found[first] + base).astype(np.int32)), "to": pa.array((found[last] + base + length).astype(np.int32))}).to_batches(max_chunksize=1 << 16)


def text_bytes_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(column.view(pa.large_string() if pa.types.is_large_binary(column.type) else pa.string()))


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, hash (of the text), from and to: byte ranges to remove. Ranges of a row may overlap."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = saved(source.mapInArrow(lambda b: described(b, length), PIECE), "pieces")
    twice = every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    shared = saved(every.join(twice, "anchor"), "shared")
    alike = saved(shared.groupBy("anchor", "digest").agg(F.count("*").alias("times"), F.min(F.struct("hash", "doc_id", "start", "end")).alias("one"), F.min("left").alias("left"), F.min("right").alias("right")), "alike")
    whole = shared.join(alike.where("times > 1").select("anchor", "digest"), ["anchor", "digest"]).select("doc_id", "hash", F.col("start").alias("from"), F.col("end").alias("to"))
    # a window that two different pieces share holds all bytes on the left of their anchor or all on its right
    sides = [alike.where(F.col(c) != 0).groupBy("anchor", c).agg(F.count("*").alias(f"same_{c}")).where(F.col(f"same_{c}") > 1) for c in ("left", "right")]
    several = alike.join(sides[0], ["anchor", "left"], "left").join(sides[1], ["anchor", "right"], "left").where("same_left is not null or same_right is not null")
    # one of each different piece of an anchor, listed by the text that it is cut from
    listed = several.select("one.doc_id", "one.hash", F.struct("anchor", "digest", "one.start", "one.end", (F.col("times") == 1).alias("alone")).alias("piece"))
    listed = saved(listed.groupBy("doc_id", "hash").agg(F.collect_list("piece").alias("listed")), "listed")  # of one text
    held = spark.sparkContext.broadcast(bits_of(listed, "hash", MAP_LOG2))
    texts = source.mapInArrow(lambda b: texts_in(b, held.value, True), "doc_id long, hash long, text binary").dropDuplicates(["doc_id", "hash"])
    together = texts.alias("t").join(listed.alias("l"), F.expr("t.hash = l.hash and t.doc_id <=> l.doc_id")).select("t.doc_id", "t.hash", "t.text", "l.listed")
    cut = together.mapInArrow(cut_pieces, "anchor long, digest long, doc_id long, hash long, start int, alone boolean, bytes binary")
    size = listed.select(F.explode("listed").alias("p")).agg(F.coalesce(F.sum(F.col("p.end") - F.col("p.start")), F.lit(0)).alias("bytes")).first().bytes
    parts = cut.repartition(max(1, -(-size // SHARD_BYTES)), "anchor").mapInArrow(lambda b: sorted_shard(b, length), "doc_id long, hash long, `from` int, `to` int")
    return saved(whole.union(parts), "removals")


def shared_passages(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """doc_id and hash (of the text) of the rows that share a passage with a row of another id or text.

    All rows that share `length` bytes are among them, and none that shares less than an anchor with one side of it: two
    windows that are equal have one anchor and all bytes on its left or on its right, GRAM + (length - GRAM) // 2 in all.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = saved(source.mapInArrow(lambda b: sides(b, length), "doc_id long, hash long, side long").withColumn("row", F.xxhash64("doc_id", "hash")), "sides")
    both = found.groupBy("side").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo != hi").select("side")
    return saved(found.join(both, "side", "left_semi").select("doc_id", "hash").distinct(), "passages")


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their removed ranges merged: spans, and the bytes that stay."""
    for batch in slices(batches):
        out: list[list] = [[], [], []]
        for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
            raw = text.as_buffer().to_pybytes()
            spans: list[list[int]] = []
            for x in sorted((r["from"], r["to"]) for r in ranges or []):
                if spans and x[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], x[1])
                else:
                    spans.append(list(x))
            stay, at = [], 0
            for a, b in spans:
                stay.append(raw[at:a])
                at = b
            stay.append(raw[at:])
            for o, v in zip(out, (len(raw), spans, b"".join(stay))):
                o.append(v)
        columns = [batch.column("doc_id"), batch.column("hash"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.list_(pa.int64()))), pa.array(out[2], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, hash (of the text), n_bytes, spans (removed runs, array of [from, to)) and kept (binary: the other bytes) of
    every row."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = removals(docs, length)
    held = spark.sparkContext.broadcast(bits_of(gone.select("hash").distinct(), "hash", MAP_LOG2))
    ranges = gone.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))  # of one text
    kind = "doc_id long, hash long, text binary"
    touched = source.mapInArrow(lambda b: texts_in(b, held.value, True), kind).alias("t").join(ranges.alias("r"), F.expr("t.hash = r.hash and t.doc_id <=> r.doc_id"), "left").select("t.doc_id", "t.hash", "t.text", "r.ranges")
    others = source.mapInArrow(lambda b: texts_in(b, held.value, False), kind)
    schema = "doc_id long, hash long, n_bytes long, spans array<array<long>>, kept binary"
    plain = others.select("doc_id", "hash", F.length("text").cast("long").alias("n_bytes"), F.array().cast("array<array<long>>").alias("spans"), F.col("text").alias("kept"))
    return touched.mapInArrow(kept, schema).union(plain)
