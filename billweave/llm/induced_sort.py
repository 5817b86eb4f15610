"""External induced suffix sorting with common-prefix values, for finding strings that occur twice.

The text is a sequence of pieces, each ended by a separator of its own. Suffixes are classed as L or S; the LMS suffixes
are ordered by naming their substrings and recursing on the string of names; then two scans induce all others. A scan
keeps its suffixes in disk-backed priority queues: keyed by first symbol, first in first out within a key, written to
files beyond a memory limit and read back in blocks. Each tuple carries, beside its position, the length of the prefix
it shares with the tuple before it (up to a cap); pushing a suffix takes one more than the least of those values since
the last push to the same key, so common prefixes come from induction as well and no suffix is compared again.

Only order and common prefixes up to `length` bytes matter here, so suffixes that agree on more may stand in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Suffixes handled at once, and bytes that the queues of a scan keep in memory.
BLOCK = 1 << 17
QUEUE_BYTES = 64 << 20


class BucketQueue:
    """A priority queue over small integer keys, first in first out within a key; spills to one file for each key."""

    def __init__(self, folder: str, name: str, position: np.dtype, limit: int = QUEUE_BYTES):
        self.kind = np.dtype([("pos", position), ("lcp", np.uint16)])
        self.folder, self.name, self.limit = folder, name, limit
        self.held: dict[int, list[np.ndarray]] = {}
        self.bytes = 0
        self.spilled: set[int] = set()

    def _file(self, key: int) -> str:
        return os.path.join(self.folder, f"{self.name}-{key}")

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty(len(pos), self.kind)
        rows["pos"], rows["lcp"] = pos, lcp
        self.held.setdefault(key, []).append(rows)
        self.bytes += rows.nbytes
        if self.bytes > self.limit:
            for k, parts in self.held.items():
                with open(self._file(k), "ab") as f:
                    for x in parts:
                        x.tofile(f)
                self.spilled.add(k)
            self.held, self.bytes = {}, 0

    def has(self, key: int) -> bool:
        return key in self.spilled or key in self.held

    def last(self, key: int) -> int:
        if key in self.held:
            return int(self.held[key][-1]["pos"][-1])
        with open(self._file(key), "rb") as f:
            f.seek(-self.kind.itemsize, os.SEEK_END)
            return int(np.fromfile(f, self.kind, 1)["pos"][0])

    def _parts(self, key: int) -> list[np.ndarray]:
        parts = [np.memmap(self._file(key), self.kind, "r")] if key in self.spilled else []
        return parts + self.held.get(key, [])

    def blocks(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and common prefixes of a key, in the order they came; small pushes are put together."""
        waiting: list[np.ndarray] = []
        many = 0
        for part in self._parts(key):
            for k in range(0, len(part), BLOCK):
                waiting.append(part[k : k + BLOCK])
                many += len(waiting[-1])
                if many >= BLOCK:
                    rows = np.concatenate(waiting)
                    yield rows["pos"].astype(np.int64), rows["lcp"].copy()
                    waiting, many = [], 0
        if waiting:
            rows = np.concatenate(waiting)
            yield rows["pos"].astype(np.int64), rows["lcp"].copy()

    def blocks_back(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same from the last to the first; each comes with its common prefix with the one after it (0 at the end)."""
        after = np.uint16(0)
        for part in reversed(self._parts(key)):
            for k in range(len(part), 0, -BLOCK):
                rows = np.asarray(part[max(0, k - BLOCK) : k])[::-1]
                lcp = np.concatenate([[after], rows["lcp"][:-1]]).astype(np.uint16)
                after = rows["lcp"][-1]
                yield rows["pos"].astype(np.int64), lcp

    def drop(self, key: int) -> None:
        for x in self.held.pop(key, []):
            self.bytes -= x.nbytes
        if key in self.spilled:
            self.spilled.discard(key)
            os.remove(self._file(key))


def lowest(values: np.ndarray) -> list[np.ndarray]:
    """A sparse table of range minima."""
    table, span = [values], 1
    while 2 * span <= len(values):
        table.append(np.minimum(table[-1][: len(values) - 2 * span + 1], table[-1][span : len(values) - span + 1]))
        span *= 2
    return table


def range_min(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the table's values from a to b, both included (a <= b)."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for k in np.unique(level):
        on = level == k
        out[on] = np.minimum(table[k][a[on]], table[k][b[on] - (1 << int(k)) + 1])
    return out


class Scan:
    """One inducing scan: takes suffixes of a bucket in order and pushes those before them."""

    def __init__(self, symbols: np.ndarray, queue: BucketQueue, cap: int, upward: bool, marks: np.ndarray):
        self.symbols, self.queue, self.cap, self.upward, self.marks = symbols, queue, cap, upward, marks
        self.pending = np.zeros(int(symbols.max()) + 1, np.uint16)
        self.before = -1

    def open(self) -> None:
        self.pending[:] = 0
        self.before = -1

    def take(self, bucket: int, pos: np.ndarray, lcp: np.ndarray, layer: BucketQueue | None, layer_key: int, keep: BucketQueue | None = None) -> None:
        """The next suffixes of the bucket. Those before them go to their buckets' queues, or, if they begin with the
        same symbol, to the next layer of this one."""
        if keep is not None:
            keep.push(bucket, pos, lcp)
        twin = np.flatnonzero(lcp >= self.cap)
        if len(twin):
            self.marks[pos[twin]] = True
            self.marks[pos[twin[twin > 0] - 1]] = True
            if twin[0] == 0 and self.before >= 0:
                self.marks[self.before] = True
        self.before = int(pos[-1])
        first = pos > 0
        key = self.symbols[np.maximum(pos - 1, 0)].astype(np.int64)
        go = first & (key > 0) & ((key > bucket) if self.upward else (key < bucket))
        if layer is not None:
            go |= first & (key == bucket)
        at = np.flatnonzero(go)
        whole = lcp.min()
        if not len(at):
            np.minimum(self.pending, whole, out=self.pending)
            return
        key = key[at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        table = lowest(lcp)
        least = range_min(table, np.where(fresh, 0, np.concatenate([[0], at[:-1] + 1])), at)
        least[fresh] = np.minimum(least[fresh], self.pending[key[fresh]])
        new = np.minimum(least.astype(np.int64) + 1, self.cap).astype(np.uint16)
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(key))
        np.minimum(self.pending, whole, out=self.pending)
        last = at[ends - 1]
        rest = np.full(len(last), self.cap, np.uint16)
        inner = last + 1 < len(lcp)
        if inner.any():
            rest[inner] = range_min(table, last[inner] + 1, np.full(int(inner.sum()), len(lcp) - 1))
        self.pending[key[starts]] = rest
        for a, b in zip(starts.tolist(), ends.tolist()):
            k = int(key[a])
            if k == bucket:
                layer.push(layer_key, pos[at[a:b]] - 1, new[a:b])
            else:
                self.queue.push(k, pos[at[a:b]] - 1, new[a:b])


def s_types(symbols: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; separators (is_end) are, and are alone of their symbol."""
    n = len(symbols)
    up = np.zeros(n, bool)
    up[:-1] = symbols[:-1] < symbols[1:]
    fixed = np.ones(n, bool)
    fixed[:-1] = symbols[:-1] != symbols[1:]
    up[is_end] = True
    fixed[is_end] = True
    fixed[-1] = up[-1] = True
    where = np.where(fixed, np.arange(n), n)
    return up[np.minimum.accumulate(where[::-1])[::-1]]


def lms_places(s_type: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1


def refined(names: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Splits groups of equal names by a key of their active members; a name is the number of smaller items.

    Returns the active members that still share their name.
    """
    if not len(active):
        return active
    group = names[active]
    span = int(key.max()) + 1
    # one number to sort by where it fits: that is much faster, and members that tie may stand in any order
    order = np.argsort(group * span + key) if (int(group.max()) + 1) * span < 2**62 else np.lexsort((key, group))
    a, k, g = active[order], key[order], group[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new = new_group | np.concatenate([[True], k[1:] != k[:-1]])
    place = np.arange(len(a))
    group_start = np.maximum.accumulate(np.where(new_group, place, 0))
    start = np.maximum.accumulate(np.where(new, place, 0))
    names[a] = g + (start - group_start)
    size = np.diff(np.append(np.flatnonzero(new), len(a)))
    return a[np.repeat(size, size) > 1]


def name_substrings(symbols: np.ndarray, s_type: np.ndarray, lms: np.ndarray, is_end: np.ndarray, most: int) -> np.ndarray:
    """Names of the LMS substrings (from one LMS place to the next, included), in their order.

    At most about `most` symbols are compared. Separators compare by place.
    """
    n, count = len(symbols), len(lms)
    names = np.zeros(count, np.int64)
    active = np.arange(count)
    end = np.append(lms[1:], n - 1)
    offset = 0
    while len(active) > 0 and offset < most:
        at = lms[active] + offset
        inside = at <= end[active]
        active, at = active[inside], at[inside]
        if not len(active):
            break
        own = symbols[at].astype(np.int64) * 2 + s_type[at]
        ends = is_end[at]
        own = np.where(ends, at, own + n)  # a separator is smaller than any other symbol, and unlike any
        active = refined(names, active, own)
        offset += 1
    return names


def order_suffixes(symbols: np.ndarray, is_end: np.ndarray, most: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, as far as about `most` symbols tell; ties keep equal ranks."""
    n = len(symbols)
    names = np.zeros(n, np.int64)
    active = refined(names, np.arange(n), np.where(is_end, np.arange(n), symbols + n))
    if not len(active) or most <= 1:
        return names
    s_type = s_types(symbols, is_end)
    lms = lms_places(s_type)
    rank_at = np.full(n, -1, np.int64)
    if len(lms):
        inner = name_substrings(symbols, s_type, lms, is_end, most)
        rank_at[lms] = order_suffixes(inner, is_end[lms], max(1, most // 2))
    # each suffix is its symbols with their types up to the next LMS place, then that one's rank
    active = refined(names, np.arange(n), np.where(is_end, np.arange(n), symbols * 2 + s_type + 2 * n))
    offset = 1
    while len(active) and offset <= most:
        at = active + offset
        inside = at < n
        active, at = active[inside], at[inside]
        reached = rank_at[at] >= 0
        key = np.where(is_end[at], at, symbols[at] * 2 + s_type[at] + 2 * n) * (n + 1) + np.where(reached, rank_at[at], 0)
        done = active[reached]
        active = refined(names, active, key)
        active = active[~np.isin(active, done, assume_unique=True)] if len(done) else active
        offset += 1
    return names


def shared_prefix(raw: np.ndarray, a: np.ndarray, b: np.ndarray, stops: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of suffixes a and b, up to cap; none goes on over a separator (stops: their places)."""
    out = np.zeros(len(a), np.int64)
    most = np.minimum(cap, np.minimum(stops[np.searchsorted(stops, a)] - a, stops[np.searchsorted(stops, b)] - b))
    active = np.arange(len(a))
    eight = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (len(raw) - 7,), (1,))  # any eight bytes in a row
    while len(active):
        x, y = a[active] + out[active], b[active] + out[active]
        differ = eight[x] ^ eight[y]
        equal = differ == 0
        out[active] += np.where(equal, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
        active = active[equal & (out[active] < most[active])]
    return np.minimum(out, most)


def repeated_starts(text: np.ndarray, ends: np.ndarray, length: int, folder: str | None = None, limit: int = QUEUE_BYTES) -> np.ndarray:
    """Places of `text` at which a string of `length` bytes starts that starts at another place too.

    ends: where the pieces of the text end (the last is its size); no string goes over an end. Arrays beyond `limit`
    bytes and the queues are kept in files of `folder`.
    """
    work = tempfile.mkdtemp(prefix="induced-", dir=folder)
    try:
        return _repeated_starts(text, np.asarray(ends, np.int64), length, work, limit)
    finally:
        shutil.rmtree(work, ignore_errors=True)


def _array(work: str, name: str, size: int, kind, limit: int) -> np.ndarray:
    if size * np.dtype(kind).itemsize <= limit:
        return np.zeros(size, kind)
    return np.memmap(os.path.join(work, name), kind, "w+", shape=(size,))


def _repeated_starts(text: np.ndarray, ends: np.ndarray, length: int, work: str, limit: int) -> np.ndarray:
    pieces, n = len(ends), len(text) + len(ends)
    if not pieces or not len(text):
        return np.zeros(0, np.int64)
    symbols = _array(work, "symbols", n, np.int16, limit)
    raw = _array(work, "raw", n + 8, np.uint8, limit)  # eight more, for reading by eights
    is_end = _array(work, "ends", n, bool, limit)
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(pieces)
    stops = ends + place
    is_end[stops] = True
    for a in range(0, pieces, 4096):
        b = min(pieces, a + 4096)
        inside = np.ones(int(ends[b - 1] - starts[a]) + b - a, bool)
        base = int(starts[a]) + a
        inside[ends[a:b] + place[a:b] - base] = False
        symbols[base : base + len(inside)][inside] = text[starts[a] : ends[b - 1]].astype(np.int16) + 1
        raw[base : base + len(inside)][inside] = text[starts[a] : ends[b - 1]]
    s_type = s_types(symbols, is_end)
    lms = lms_places(s_type)
    position = np.dtype(np.int32 if n < 2**31 else np.int64)
    marks = _array(work, "marks", n, bool, limit)
    # LMS suffixes in order, with the prefixes that neighbours share
    rank = order_suffixes(name_substrings(symbols, s_type, lms, is_end, length), is_end[lms], max(1, length // 2))
    sorted_lms = lms[np.argsort(rank, kind="stable")]
    del rank
    lcp = np.zeros(len(sorted_lms), np.uint16)
    for k in range(1, len(sorted_lms), BLOCK):
        upto = min(len(sorted_lms), k + BLOCK)
        lcp[k:upto] = shared_prefix(raw, sorted_lms[k - 1 : upto - 1], sorted_lms[k:upto], stops, length)
    first = symbols[sorted_lms]
    most = int(symbols.max())
    bounds = np.searchsorted(first, np.arange(most + 2))
    left = BucketQueue(work, "l", position, limit)
    order = BucketQueue(work, "order", position, limit)
    scan = Scan(symbols, left, length, True, marks)
    for bucket in range(most + 1):
        scan.open()
        _layers(scan, bucket, left, work, position, limit, order)
        a, b = int(bounds[bucket]), int(bounds[bucket + 1])
        for k in range(a, b, BLOCK):
            pos, values = sorted_lms[k : min(b, k + BLOCK)], lcp[k : min(b, k + BLOCK)].copy()
            if k == a:
                values[0] = _seam(raw, stops, scan.before, int(pos[0]), length)
            scan.take(bucket, pos, values, None, 0)
    del sorted_lms, lcp, first
    right = BucketQueue(work, "s", position, limit)
    scan = Scan(symbols, right, length, False, marks)
    # the suffixes before separators' successors are separators themselves, which need no inducing
    for bucket in range(most, 0, -1):
        scan.open()
        _layers(scan, bucket, right, work, position, limit, None)
        seam = True
        if order.has(bucket):
            for pos, values in order.blocks_back(bucket):
                if seam:
                    values[0] = _seam(raw, stops, scan.before, int(pos[0]), length)
                    seam = False
                scan.take(bucket, pos, values, None, 0)
            order.drop(bucket)
    found = np.flatnonzero(marks)
    return found - np.searchsorted(ends + place, found)


def _seam(raw: np.ndarray, stops: np.ndarray, a: int, b: int, cap: int) -> int:
    if a < 0:
        return 0
    return int(shared_prefix(raw, np.array([a]), np.array([b]), stops, cap)[0])


def _layers(scan: Scan, bucket: int, queue: BucketQueue, work: str, position: np.dtype, limit: int, keep: BucketQueue | None) -> None:
    """Takes a bucket's queue, then the suffixes that those induce in the same bucket, and so on: runs of one symbol."""
    source, key, depth = queue, bucket, 0
    layer = BucketQueue(work, f"{queue.name}-layer", position, limit)
    while source.has(key):
        for k, (pos, lcp) in enumerate(source.blocks(key)):
            if k == 0:
                lcp[0] = min(depth, scan.cap)
            scan.take(bucket, pos, lcp, layer, depth + 1, keep)
        source.drop(key)
        source, depth = layer, depth + 1
        key = depth
