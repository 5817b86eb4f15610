"""Shared pieces: tables in the shared folder, Arrow batches of text, and vectorised hashing of words."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy stages treat at once; their temporaries are some tens of times as large.
SLICE_BYTES = 1 << 20

#: Rows of an Arrow batch at most.
ROWS_SENT = 2500

#: Bits of the fixed-size map of ids by which rows are taken out.
ID_BITS = 1 << 23

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); an own one where that is unset, on one machine
    only: elsewhere executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="billweave-"))
    return _own_dir[0]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each application: their Python need not have it.

    Rows go to Python `ROWS_SENT` at a time: a batch is held whole on both sides, and texts may be long.
    """
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_SENT or int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_SENT))
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="billweave-")) / "billweave_sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # unlike snappy it holds no buffers outside the heap
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs, all their columns, whose doc_id is not in ids(doc_id), and those whose doc_id is; a null is in none.

    Rows that a bitmap of ID_BITS rules out stay where they are; only the others, with their texts, are shuffled for the exact
    join. Its condition names the bitmap's bucket, else the optimiser would move that join below the bitmap.
    """
    ids = saved(ids, "ids")
    slot = "pmod(xxhash64(cast({} as long)), {})".format
    marks = ids.select(F.expr(slot("doc_id", ID_BITS)).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    at, other = slot("d.doc_id", ID_BITS), slot("i.doc_id", ID_BITS)
    marked = docs.alias("d").join(F.broadcast(marks.alias("m")), F.expr(f"bitmap_bucket_number({at}) = m.bucket"), "left")  # ID_BITS / 8 bytes at most
    byte = f"cast(conv(hex(substring(m.bits, cast(bitmap_bit_position({at}) div 8 as int) + 1, 1)), 16, 10) as int)"
    in_map = F.expr(f"d.doc_id is not null and m.bits is not null and getbit({byte}, cast(bitmap_bit_position({at}) % 8 as int)) = 1")
    maybe, same = marked.where(in_map), F.expr(f"d.doc_id = i.doc_id and m.bucket = bitmap_bucket_number({other})")
    apart = marked.where(~in_map).select("d.*").union(maybe.join(ids.alias("i"), same, "left_anti").select("d.*"))
    return apart, maybe.join(ids.alias("i"), same, "left_semi").select("d.*")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes of `column`; a longer text is a piece of its own.

    After the last piece the worker gives back what it has freed, so that idle workers stay small.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Returns memory that was freed to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(fold: bool, seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte; with fold, A-Z have those of a-z."""
    values = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    if fold:
        values[65:91] = values[97:123]
    return values


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, off: np.ndarray, is_word: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text: their 64-bit hashes, byte starts and ends, and the n + 1 word offsets of the texts.

    is_word says for each of 256 bytes whether it belongs to a word; words do not cross texts.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(off), np.int64)
    flag = np.empty(n + 1, bool)
    np.take(is_word, data, out=flag[:n])
    flag[n] = False
    begin = flag[:n].copy()
    begin[1:] &= ~flag[: n - 1]
    first = off[:-1][(off[:-1] < off[1:])]
    begin[first] = flag[first]
    close = flag[:n] & ~flag[1:]
    last = first - 1
    last = last[last >= 0]
    close[last] = flag[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word shingles in order, and their n + 1 offsets; a shorter text has its whole sequence."""
    n = np.diff(counts)
    many = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    off = np.zeros(len(counts), np.int64)
    np.cumsum(many, out=off[1:])
    start = np.repeat(counts[:-1] - off[:-1], many) + np.arange(off[-1])
    size = np.repeat(np.minimum(n, width), many)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    out = size.astype(np.uint64)
    for k in range(width):
        w = padded[start + k]
        if k:
            w = np.where(k < size, w, np.uint64(0))
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out, off


class Bits:
    """A set of 64-bit keys as a bitmap of fixed size: it has every key put in, and some others."""

    def __init__(self, packed: bytes, log2: int):
        self.packed, self.log2 = np.frombuffer(packed, np.uint8), log2

    @staticmethod
    def slot(keys: np.ndarray, log2: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - log2)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys, self.log2)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def bits_of(df: DataFrame, column: str, log2: int) -> Bits:
    """The bitmap of a long column. Each task sends its own bits as parts of 8 KB, OR-ed together by part."""
    width = 1 << 16  # bits in a part

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (log2 - 3), np.uint8)
        for batch in batches:
            at = np.unique(Bits.slot(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), log2))
            np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        step = min(width, 1 << log2) >> 3
        parts = own.reshape(-1, step)
        full = np.flatnonzero(parts.any(1))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([parts[k].tobytes() for k in full], pa.binary())], ["part", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(bits, np.uint8)
                held[part] = held[part] | x if part in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    out = df.where(df[column].isNotNull()).select(df[column].cast("long")).mapInArrow(local, "part int, bits binary").repartition("part").mapInArrow(merged, "part int, bits binary")
    step = min(width, 1 << log2) >> 3
    whole = np.zeros(1 << (log2 - 3), np.uint8)
    for row in out.collect():  # at most 2**log2 bits
        whole[row.part * step : (row.part + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return Bits(whole.tobytes(), log2)
