"""N-gram Jaccard join: a size-aware heavy-light set join over word shingles, and its linked groups.

Sets that are equal are one node. Light sets (few shingles) are joined by enumerating their fixed-size subsets: two of
them link exactly if they share a subset of the size that the threshold asks for, so that nothing is left to verify.
Heavy sets go by inverted lists: the rarest shingles of each set, as many as the threshold needs to be sure of a shared
one, are posted; sets that share a list are verified on their whole sets. The boundary between light and heavy is the
size at which the estimated cost of subsets and postings is lowest, over a histogram of all set sizes.

How rare a shingle is comes from a count sketch of fixed width over all documents. It only sets the order; every order
gives whole results.

Lists are never expanded into all pairs. First each member of a list is paired with one leader of about its size; sets
that this links form groups, and only pairs of different groups are taken from the lists after that, until every such
pair has been decided. So large groups of copies cost a pair for each member, and still no link between groups is lost.

Defined results: null texts, and texts without words, have an empty set and link with nothing; a text with fewer words
than `width` has its whole sequence as its only shingle; rows repeated in the input are rows of the output; rows without an
id link like others, and have the least id that links reach, if any; other columns, whatever their names, are kept out of
the way; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import bits_of, byte_values, mix, parted, saved, shingle_hashes, ship, slices, text_bytes, word_hashes
from billweave.llm.components import components

#: Bytes between words: space and \t to \r.
BETWEEN = [0x20, *range(9, 14)]
SKETCH_LOG2 = 20
#: Sets of at most so many shingles may become light.
MOST_LIGHT = 24
#: Lists of at least so many sets are joined by nearest pairs before all their remaining pairs are looked at; of a list
#: so many sets at once are compared for that.
LONG_LIST, TOGETHER = 16, 2048
NEAREST_ROUNDS = 4
#: Cost of verifying a candidate pair, in postings.
VERIFY_COST = 8.0


@dataclass(frozen=True)
class Threshold:
    """Jaccard of at least num / den, in whole numbers."""

    num: int = 85
    den: int = 100

    def overlap(self, n, m):
        """Least shared shingles of linked sets of n and m shingles."""
        return -(-(self.num * (n + m)) // (self.num + self.den))

    def posted(self, n):
        """So many of the first shingles of a set of n hold one of any linked set."""
        return n - -(-(self.num * n) // self.den) + 1

    def sizes(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def subsets(self, n: int) -> list[tuple[int, int]]:
        """Sizes m of the sets that one of n shingles may link with, and of the subsets by which it meets those."""
        return [(m, int(self.overlap(n, m))) for m in self.sizes(n) if self.overlap(n, m) <= min(n, m)]


def doc_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the n + 1 offsets."""
    data, off = text_bytes(batch.column("text"))
    is_word = np.ones(256, bool)
    is_word[BETWEEN] = False
    words, _, _, counts = word_hashes(data, off, is_word, byte_values(True))
    hashes, at = shingle_hashes(words, counts, width)
    sets, sizes = [], np.zeros(len(off), np.int64)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        x = np.sort(hashes[a:b])
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        sets.append(x)
        sizes[k + 1] = len(x)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def node_of(shingles: np.ndarray) -> int:
    """The name of a set: 64 bits of a digest of its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)


#: Columns of a set's parity bits: 64 each.
PARITY = [f"odd{k}" for k in range(16)]


def parities(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each set 1024 bits: whether an odd number of its shingles falls into a slot, as rows of longs.

    Where two sets' bits differ, the sets differ by a shingle at least: the count is never above the true difference.
    """
    slots = 64 * len(PARITY)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = doc * slots + ((flat >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)
    odd = (np.bincount(at, minlength=(len(off) - 1) * slots) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, slots), axis=1, bitorder="little").view(np.int64)


def may_be_alike(t: Threshold, a: str, n: str, b: str, m: str) -> str:
    """Whether the parities of two sets (columns a.odd*, b.odd*) allow a link: a test that drops no linked pair."""
    differ = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in PARITY)
    return f"({differ} <= {n} + {m} - 2 * (({t.num} * ({n} + {m}) + {t.num + t.den - 1}) div {t.num + t.den}))"


#: Counters of the sketch that travel together.
PART = 1 << 12


def described(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of each row its id, set size and node; at the end of a task the sketch of its shingles, as rows with a part."""
    count = np.zeros(1 << SKETCH_LOG2, np.uint32)
    names = ["doc_id", "n", "node", *PARITY, "part", "counts"]
    for batch in slices(batches):
        flat, off = doc_sets(batch, width)
        np.add.at(count, bucket(flat), 1)
        n = np.diff(off)
        nodes = [node_of(flat[a:b]) if b > a else None for a, b in zip(off, off[1:])]
        odd = [pa.array(x) for x in parities(flat, off).T]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(nodes, pa.int64()), *odd, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
    parts = count.reshape(-1, PART)
    full = np.flatnonzero(parts.any(1))
    if len(full):
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, *[none] * len(PARITY), pa.array(full.astype(np.int32)), pa.array([parts[k].tobytes() for k in full], pa.binary())], names)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' parts of the sketch, added up and put on a logarithmic scale of one byte."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
            held[part] = held[part] + x if part in held else x
    if held:
        levels = [np.minimum(255, np.log2(x + 1.0) * 8).astype(np.uint8).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])


def light_subsets(shingles: np.ndarray, size: int) -> np.ndarray:
    """Names of all subsets of the given size: sums of their hashes, which depend on no order."""
    from itertools import combinations

    left_out = len(shingles) - size
    total = shingles.sum(dtype=np.uint64)
    if left_out == 0:
        return np.array([total], np.uint64)
    at = np.array(list(combinations(range(len(shingles)), left_out)))
    return total - shingles[at].sum(1, dtype=np.uint64)


def meeting_names(shingles: np.ndarray, n: int, m: int, size: int) -> np.ndarray:
    """Names under which a set of n shingles meets those of m: its subsets, apart for each pair of sizes."""
    return mix(light_subsets(shingles, size) + np.uint64((min(n, m) << 32 | max(n, m)) * 0x9E3779B97F4A7C15 % 2**64))


def postings(batches: Iterator[pa.RecordBatch], width: int, rank: np.ndarray, boundary: int, t: Threshold) -> Iterator[pa.RecordBatch]:
    """token, node, n, pos of every distinct set of a task.

    pos -1 marks a subset by which a light set meets those of its own size, -2 one for those of another size.
    """
    seen: set[int] = set()
    heavy_from = t.sizes(boundary + 1).start if boundary else 1
    for batch in slices(batches):
        flat, off = doc_sets(batch, width)
        tokens, nodes, sizes, places = [], [], [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            x, n = flat[a:b], b - a
            if not n or (node := node_of(x)) in seen:
                continue
            if len(seen) >= 200_000:  # only saves rows that are merged later anyway
                seen.clear()
            seen.add(node)
            own = []
            if n <= boundary:
                for m, c in t.subsets(n):
                    if m <= boundary:
                        sub = meeting_names(x, n, m, c)
                        own.append((sub, np.full(len(sub), -1 if m == n else -2)))
            if n >= heavy_from:
                p = int(t.posted(n))
                key = rank[bucket(x)].astype(np.uint64) << np.uint64(56) | x >> np.uint64(8)
                first = x[np.argpartition(key, p - 1)[:p]] if p < n else x
                first = first[np.argsort(rank[bucket(first)].astype(np.uint64) << np.uint64(56) | first >> np.uint64(8), kind="stable")]
                own.append((first, np.arange(p)))
            for token, place in own:
                tokens.append(token)
                places.append(place)
                nodes.append(np.full(len(token), node))
                sizes.append(np.full(len(token), n))
        if tokens:
            columns = [np.concatenate(tokens).view(np.int64), np.concatenate(nodes), np.concatenate(sizes).astype(np.int32), np.concatenate(places).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["token", "node", "n", "pos"])


def shared_lists(batches: Iterator[pa.RecordBatch], t: Threshold) -> Iterator[pa.RecordBatch]:
    """Postings that stand in lists of two sets at least, each with a leader of its list: the first of about its size.

    The input comes sorted by token, pos < 0, n and node; a list may be of any length, as only its leader is held.
    """
    names = ["token", "node", "n", "pos", "leader", "leader_n", "leader_pos"]
    held: list[np.ndarray] | None = None  # the last posting, if its list may go on
    lead: tuple[int, int, int] | None = None
    held_shared = False
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        token, node, n, pos = cols
        if len(token) < 2:
            held = cols
            continue
        repeat = np.concatenate([[False], (token[1:] == token[:-1]) & (node[1:] == node[:-1]) & (pos[1:] == pos[:-1])])
        if repeat.any():
            token, node, n, pos = (c[~repeat] for c in (token, node, n, pos))
        same = np.zeros(len(token) + 1, bool)  # in one list with the posting before
        same[1:-1] = (token[1:] == token[:-1]) & ((pos[1:] < 0) == (pos[:-1] < 0))
        shared = same[:-1] | same[1:]
        shared[0] |= held_shared
        last = len(token) - 1  # kept for the next batch
        out: list[list] = [[], [], []]
        at = np.flatnonzero(shared[:last])
        for k in at.tolist():
            fresh = not same[k] and not (k == 0 and held_shared)
            if fresh or lead is None or pos[k] >= 0 and 100 * int(n[k]) > 106 * lead[1] and lead[1] > 0:
                lead = (int(node[k]), int(n[k]), int(pos[k]))
            for o, v in zip(out, lead):
                o.append(v)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (token, node, n, pos)] + [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names)
        held = [c[last:] for c in (token, node, n, pos)]
        held_shared = bool(same[last]) or last == 0 and held_shared
    if held is not None and held_shared and lead is not None:
        k = [c[0] for c in held]
        if k[3] >= 0 and 100 * int(k[2]) > 106 * lead[1]:
            lead = (int(k[0 + 1]), int(k[2]), int(k[3]))
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((*map(int, k), *lead), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names)


def nearest_pairs(batches: Iterator[pa.RecordBatch], t: Threshold) -> Iterator[pa.RecordBatch]:
    """For each set of a list the one of another group whose parities differ least, if they allow a link.

    The input (token, node, n, comp, odd*) comes sorted by token; `TOGETHER` sets are compared at a time, so a list of
    any length takes bounded memory. What this leaves out is looked at later.
    """
    held: list[np.ndarray] | None = None

    def compared(token, node, n, comp, *odd) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for lo in range(a, b, TOGETHER):
                hi = min(b, lo + TOGETHER)
                if hi - lo < 2:
                    continue
                size = n[lo:hi].astype(np.int64)
                both = size[:, None] + size[None, :]
                room = both - 2 * -(-(t.num * both) // (t.num + t.den))
                room -= sum(np.bitwise_count(x[lo:hi, None] ^ x[None, lo:hi]).astype(np.int64) for x in odd)
                ok = (room >= 0) & (comp[lo:hi, None] != comp[None, lo:hi]) & (t.den * np.minimum(size[:, None], size[None, :]) >= t.num * np.maximum(size[:, None], size[None, :]))
                room[~ok] = -1
                best = room.argmax(1)
                at = np.flatnonzero(room[np.arange(hi - lo), best] >= 0)
                yield node[lo:hi][at], node[lo:hi][best[at]]

    def rows(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on
        last += (len(cols[0]) - last) // TOGETHER * TOGETHER
        yield from rows(compared(*(c[:last] for c in cols)))
        held = [c[last:] for c in cols]
    if held is not None:
        yield from rows(compared(*held))


def whole_sets(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[pa.RecordBatch]:
    """node and shingles (packed 64-bit hashes) of the rows whose doc_id may be wanted, and of rows without one."""
    import pyarrow.compute as pc

    for batch in batches:
        ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        batch = batch.filter(pa.array(wanted.has(ids.view(np.uint64)) | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)))
        for part in slices(iter([batch])):
            flat, off = doc_sets(part, width)
            rows = [(node_of(flat[a:b]), flat[a:b].tobytes()) for a, b in zip(off, off[1:]) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles"])


def linked(batches: Iterator[pa.RecordBatch], t: Threshold) -> Iterator[pa.RecordBatch]:
    """a, b and whether the whole sets link."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(t.den * shared >= t.num * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def light_boundary(sizes: dict[int, int], t: Threshold) -> int:
    """The set size up to which sets are light: the one with the least estimated cost over the histogram of sizes."""

    def cost(boundary: int) -> float:
        total, heavy_from = 0.0, t.sizes(boundary + 1).start if boundary else 1
        for n, many in sizes.items():
            if n <= boundary:
                total += many * sum(comb(n, c) for m, c in t.subsets(n) if m <= boundary)
            if n >= heavy_from:
                # a posting of a small set meets about as many others as there are sets of its size to each shingle
                total += many * t.posted(n) * (1 + VERIFY_COST / max(n, 1))
        return total

    return min(range(MOST_LIGHT + 1), key=cost)


def near_in_size(t: Threshold, n: str, m: str) -> str:
    return f"{t.den} * least({n}, {m}) >= {t.num} * greatest({n}, {m})"


def may_link(t: Threshold, n: str, pos: str, m: str, qos: str) -> str:
    """Whether sets of n and m shingles, n <= m, that share the one at these places of their orders can link by it.

    The first shingle that linked sets share has so few before it in either that the rest can make up the overlap.
    """
    overlap = f"(({t.num} * ({n} + {m}) + {t.num + t.den - 1}) div {t.num + t.den})"
    return f"({t.den} * {n} >= {t.num} * {m} and {pos} <= {n} - {overlap} and {qos} <= {m} - {overlap})"


def least_met(t: Threshold, n: str, m: str) -> str:
    """So many posted shingles linked sets of n and m shingles share at least.

    If the posted shingles of the one end before the other's in the order, all that they share up to there are posted in
    both, and beyond there the first has only its remaining ones to share.
    """
    overlap = f"(({t.num} * ({n} + {m}) + {t.num + t.den - 1}) div {t.num + t.den})"
    remaining = f"(({t.num} * greatest({n}, {m}) + {t.den - 1}) div {t.den} - 1)"
    return f"({overlap} - {remaining})"


def jaccard_groups(docs: DataFrame, width: int = 5, t: Threshold = Threshold(80, 100)) -> DataFrame:
    """doc_id, n_shingles, node (name of the set, null if empty) and component_id of every row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = saved(source.mapInArrow(lambda b: described(b, width), ", ".join(["doc_id long, n long, node long", *(f"{c} long" for c in PARITY), "part int, counts binary"])), "sets")
    rows = facts.where("part is null").select("doc_id", "n", "node")
    # the sketch and the histogram have fixed sizes
    rank = np.zeros(1 << SKETCH_LOG2, np.uint8)
    for r in facts.where("part is not null").select("part", "counts").repartition("part").mapInArrow(summed, "part int, levels binary").collect():
        rank[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.levels, np.uint8)
    sizes = {r.n: r.many for r in rows.where(f"n between 1 and {2 * MOST_LIGHT}").groupBy("n").agg(F.countDistinct("node").alias("many")).collect()}
    boundary = light_boundary(sizes, t)
    ranks = spark.sparkContext.broadcast(rank)
    posted = source.mapInArrow(lambda b: postings(b, width, ranks.value, boundary, t), "token long, node long, n int, pos int")
    lists = posted.repartition("token").sortWithinPartitions("token", F.col("pos") < 0, "n", "node", "pos").mapInArrow(lambda b: shared_lists(b, t), "token long, node long, n int, pos int, leader long, leader_n int, leader_pos int")
    lists = saved(lists, "lists")
    first = saved(facts.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), *(F.min(c).alias(c) for c in PARITY)), "first")
    parity = first.drop("first")

    def decided(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with ok: whether their whole sets link. Few pairs get here that do not."""
        pairs = saved(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        held = spark.sparkContext.broadcast(bits_of(first.join(wanted, "node", "left_semi").select("first"), "first", 24))
        sets = source.mapInArrow(lambda b: whole_sets(b, width, held.value), "node long, shingles binary").dropDuplicates(["node"])
        got = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        return saved(got.select("a", "b", "sa", "sb").mapInArrow(lambda b: linked(b, t), "a long, b long, ok boolean"), "decided")

    heavy = lists.where("pos >= 0")
    led = heavy.where(f"node != leader and {near_in_size(t, 'n', 'leader_n')}").groupBy(F.col("leader").alias("a"), F.col("node").alias("b"), "leader_n", "n").agg(F.count("*").alias("met"))
    # a pair may meet in lists that others lead: half of what is needed will do, and the last round misses nothing
    led = led.where(f"2 * met >= {least_met(t, 'n', 'leader_n')}")
    both = led.join(parity.alias("x"), F.expr("a = x.node")).join(parity.alias("y"), F.expr("b = y.node"))
    tried = decided(both.where(may_be_alike(t, "x", "leader_n", "y", "n")).select("a", "b"))
    # light sets that share a subset link if their sizes are those that it stands for; then all of its list are connected
    two_sizes = lists.where("pos = -2").groupBy("token").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo != hi").select("token")
    light = lists.where("node != leader")
    light = light.where("pos = -1").union(light.where("pos = -2").join(two_sizes, "token", "left_semi").select(*light.columns))
    links = saved(light.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct().union(tried.where("ok").select("a", "b")), "links")
    comp = components(links)
    heavy = heavy.select("token", "node", "n", "pos")
    overlap = f"(({2 * t.num} * n + {t.num + t.den - 1}) div {t.num + t.den})"
    k = 0
    while k <= NEAREST_ROUNDS:
        # lists whose sets are in more than one group
        grouped = heavy.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        last = k == NEAREST_ROUNDS
        mixed = grouped.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).where("lo != hi" if last else f"lo != hi and many >= {LONG_LIST}").select("token")
        grouped = grouped.join(mixed, "token").join(parity, "node")
        if last:
            # the smaller set of a linked pair has a shared shingle early; most lists of frequent shingles have no such set
            grouped = saved(grouped, "grouped")
            x, y = grouped.where(f"pos <= n - {overlap}").alias("x"), grouped.alias("y")
            smaller = "(x.n < y.n or x.n = y.n and x.node < y.node)"
            met = x.join(y, F.expr(f"x.token = y.token and x.comp != y.comp and {smaller} and {may_link(t, 'x.n', 'x.pos', 'y.n', 'y.pos')} and {may_be_alike(t, 'x', 'x.n', 'y', 'y.n')}"))
            pairs = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        else:
            in_order = grouped.select("token", "node", "n", "comp", *PARITY, "pos").repartition("token").sortWithinPartitions("token", "pos", "node").drop("pos")
            pairs = in_order.mapInArrow(lambda b: nearest_pairs(b, t), "a long, b long").distinct()
        known = tried.select("a", "b").union(tried.select("b", "a"))
        found = decided(pairs.join(known, ["a", "b"], "left_anti"))
        new = found.where("ok").select("a", "b")
        tried = tried.union(found)
        if not new.isEmpty():
            links = links.union(new)
            comp = components(links)
            k += 1
        else:
            k = NEAREST_ROUNDS if k < NEAREST_ROUNDS else k + 1  # nothing new: on to the last round, or done
    named = rows.join(comp, "node", "left").withColumn("group", F.coalesce("comp", "node"))
    smallest = named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("smallest", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, t: Threshold = Threshold(80, 100)) -> DataFrame:
    """The rows of docs without those that a linked or equal one with a smaller doc_id stands for.

    Empty texts and rows without an id stay; of rows with equal id and text one stays.
    """
    groups = saved(jaccard_groups(docs, width, t), "groups")
    gone = groups.where("doc_id is not null and doc_id != component_id").select("doc_id").distinct()
    kept = parted(docs, gone)[0]
    twice = groups.where("node is not null and doc_id is not null").groupBy("doc_id", "node").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id").distinct()
    if twice.isEmpty():
        return kept
    kept, repeated = parted(kept, twice)
    return kept.union(repeated.dropDuplicates(["doc_id", "text"]))
