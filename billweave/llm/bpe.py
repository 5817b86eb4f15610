"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays of code-point classes: each symbol is a transition function of a small
automaton, the functions are composed by an associative scan, and token starts follow from the state before a
symbol, the symbol and the next one; no regular expression runs. The slices are looked up in a cache of merged
pieces. Byte offsets of the tokens are retained, and decoding cuts documents by them.

Defined results: null and empty texts have no tokens; any text is encoded whole. Rows are independent, so ties,
repeated rows and empty tables need no care; other columns are dropped unless named in `keep`.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from billweave.llm.common import byte_values, mix, powers, ship, slices, text_bytes

#: Entries of the cache of merged pieces in a worker; it is emptied between slices when full.
CACHE_PIECES = 200_000
#: Bytes of the longest pieces that are merged as rows of a matrix; longer ones are merged by a heap.
LONG_PIECE = 40
NONE = np.int32(2**31 - 1)

# Symbols: classes of code points as the automaton sees them.
SPACE, WHITE, DIGIT, OTHER, QUOTE, LETTER, END1, R, V, E, L, FIRST = range(12)
# States: what the code point before was.
AT_START, AFTER_SPACE, AFTER_WHITE, IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED = range(11)
# Letters and numbers that Unicode 16 added, as ranges; older tables of Python lack them.
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: White space of Unicode.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _next_state(state: int, symbol: int) -> int:
    if symbol == FIRST:
        return AT_START
    if symbol == SPACE:
        return AFTER_SPACE
    if symbol == WHITE:
        return AFTER_WHITE
    if symbol == DIGIT:
        return IN_DIGITS
    if symbol == OTHER:
        return IN_OTHER
    if symbol == QUOTE:  # it opens a token unless other characters or a space hold it
        return IN_OTHER if state in (AFTER_SPACE, IN_OTHER, AFTER_QUOTE) else AFTER_QUOTE
    if state == AFTER_QUOTE:
        return {END1: CONTRACTED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(symbol, IN_LETTERS)
    if (state, symbol) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        return CONTRACTED
    return IN_LETTERS


class Automaton:
    """The functions that symbols and their compositions are, numbered, with the table of compositions."""

    def __init__(self) -> None:
        states = range(CONTRACTED + 1)
        found = [tuple(_next_state(s, symbol) for s in states) for symbol in range(FIRST + 1)]
        number = {f: k for k, f in reversed(list(enumerate(found)))}
        self.of_symbol = [number[f] for f in found]
        known = list(dict.fromkeys(found))
        number = {f: k for k, f in enumerate(known)}
        self.of_symbol = np.array([number[f] for f in found], np.uint8)
        pairs: dict[tuple[int, int], int] = {}
        done = 0
        while done < len(known):
            done = len(known)
            for a, f in enumerate(list(known)):
                for b, g in enumerate(list(known)):
                    if (a, b) not in pairs:
                        h = tuple(g[f[s]] for s in states)
                        if h not in number:
                            number[h] = len(known)
                            known.append(h)
                        pairs[a, b] = number[h]
        self.compose = np.zeros((len(known), len(known)), np.uint8)
        for (a, b), c in pairs.items():
            self.compose[a, b] = c
        self.constant = np.array([len(set(f)) == 1 for f in known])
        self.value = np.array([f[0] for f in known], np.uint8)

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol: an inclusive scan by doubling, which ends where functions are constant."""
        f = self.of_symbol[symbols]
        f[0] = self.of_symbol[FIRST] if symbols[0] == FIRST else f[0]
        step, left = 1, np.flatnonzero(~self.constant[f])
        while len(left) and step < len(f):
            left = left[left >= step]
            f[left] = self.compose[f[left - step], f[left]]  # the right side is read before it is written
            left = left[~self.constant[f[left]]]
            step *= 2
        return self.value[f]


_made: dict[str, object] = {}


def automaton() -> Automaton:
    if "automaton" not in _made:
        _made["automaton"] = Automaton()
    return _made["automaton"]


def class_table() -> np.ndarray:
    """The symbol of each code point."""
    if "classes" not in _made:
        out = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                out[cp] = LETTER
            elif kind == "N":
                out[cp] = DIGIT
        for ranges, symbol in ((LETTERS_16, LETTER), (NUMBERS_16, DIGIT)):
            for a, b in ranges:
                out[a : b + 1] = symbol
        out[WHITE_SPACE] = WHITE
        out[0x20], out[ord("'")] = SPACE, QUOTE
        for letters, symbol in (("stmd", END1), ("r", R), ("v", V), ("e", E), ("l", L)):
            out[[ord(x) for x in letters]] = symbol
        _made["classes"] = out
    return _made["classes"]


def token_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens start, for the texts that off cuts from data."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    firsts = np.searchsorted(place, off[:-1][off[:-1] < off[1:]])
    # a FIRST symbol before every text, and one at the end
    shift = np.zeros(len(points), np.int64)
    shift[firsts] = 1
    at = np.arange(len(points)) + np.cumsum(shift)
    symbols = np.full(len(points) + len(firsts) + 1, FIRST, np.uint8)
    symbols[at] = class_table()[points]
    states = automaton().states(symbols)
    before, own, after = states[at - 1], symbols[at], symbols[at + 1]
    is_white = own <= WHITE
    starts_white = (before != AFTER_SPACE) & (before != AFTER_WHITE) | (after > WHITE) & (after != FIRST)
    letter = own >= LETTER
    in_mark = (before == IN_OTHER) | (before == AFTER_QUOTE)
    contraction = (before == AFTER_QUOTE) & ((own == END1) | ((own == R) | (own == V)) & (after == E) | (own == L) & (after == L))
    contraction |= (states[at] == CONTRACTED) & (before != AFTER_QUOTE)
    # after 'r without e the letters go on; the token began at r
    letters_on = (before == IN_LETTERS) | (before == QUOTE_R) | (before == QUOTE_V) | (before == QUOTE_L)
    starts_letter = letter & ~letters_on & (before != AFTER_SPACE) & ~contraction
    starts_digit = (own == DIGIT) & (before != IN_DIGITS) & (before != AFTER_SPACE)
    starts_mark = ((own == OTHER) | (own == QUOTE)) & ~in_mark & (before != AFTER_SPACE)
    flag = np.where(is_white, starts_white, starts_letter | starts_digit | starts_mark)
    return place[flag]


def distinct_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct piece, and for every piece the number of its distinct one (told apart by 64-bit hashes)."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(False)[data] * up[: len(data)], out=total[1:])
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    _, one_of, which = np.unique(hashes, return_index=True, return_inverse=True)
    return one_of, which


def gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The concatenation of the which-th runs of flat, whose run sizes are given."""
    begin = np.cumsum(sizes) - sizes
    many = sizes[which]
    ends = np.cumsum(many)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[which] - (ends - many), many)
    return flat[at]


class Vocabulary:
    """Ranks with what merging many pieces at once needs: each mergeable pair of ids with the id it becomes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.words[rank] = token
        self.sizes = np.array([len(x) for x in self.words], np.int64)
        self.flat = np.frombuffer(b"".join(self.words), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pair, self.becomes = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
        two = np.full((256, 256), NONE, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                two[token[0], token[1]] = rank
        self.two = two
        self.cache: dict[bytes, bytes] = {}

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two ids make, or NONE."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.becomes[at], NONE)

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """The merged form of distinct pieces. All of them are held until they are put together, also more than the cache takes."""
        held = {x: self.cache[x] for x in pieces if x in self.cache}
        fresh = self.merged([x for x in pieces if x not in held])
        if len(self.cache) + len(fresh) > CACHE_PIECES:
            self.cache.clear()
        if len(fresh) <= CACHE_PIECES:
            self.cache.update(fresh)
        held.update(fresh)
        return list(map(held.__getitem__, pieces))

    def merged(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The merged form of each of pieces. Those of one length are merged in step, as rows of a matrix."""
        out: dict[bytes, bytes] = {}
        by_size: dict[int, list[bytes]] = {}
        for x in pieces:
            by_size.setdefault(len(x), []).append(x)
        for size, group in by_size.items():
            if size == 1 or size > LONG_PIECE or len(group) < 8 or not len(self.pair):
                for x in group:
                    rank = self.ranks.get(x)
                    out[x] = np.array([rank] if rank is not None else merge(x, self.ranks), "<u4").tobytes()
                continue
            for k in range(0, len(group), 1 << 15):
                self._merge_rows(group[k : k + (1 << 15)], size, out)
        return out

    def _merge_rows(self, group: list[bytes], size: int, out: dict[bytes, bytes]) -> None:
        n = len(group)
        raw = np.frombuffer(b"".join(group), np.uint8).reshape(n, size)
        ids = self.of_byte[raw]
        rank = np.full((n, size), NONE, np.int32)
        rank[:, :-1] = self.two[raw[:, :-1], raw[:, 1:]]
        after = np.tile(np.arange(1, size + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, size - 1, dtype=np.int16), (n, 1))
        alive = np.ones((n, size), bool)
        rows = np.arange(n)
        while True:
            at = rank[rows].argmin(1)  # the leftmost of the lowest
            low = rank[rows, at]
            more = low < NONE
            rows, at, low = rows[more], at[more], low[more]
            if not len(rows):
                break
            gone = after[rows, at]
            then = after[rows, gone]
            ids[rows, at] = low
            alive[rows, gone] = False
            rank[rows, gone] = NONE
            after[rows, at] = then
            rank[rows, at] = NONE
            has = then < size
            r, a, t = rows[has], at[has], then[has]
            before[r, t] = a
            rank[r, a] = self.joined(low[has], ids[r, t])
            prior = before[rows, at]
            has = prior >= 0
            r, p = rows[has], prior[has]
            rank[r, p] = self.joined(ids[r, p], low[has])
        packed = ids[alive].astype("<u4").tobytes()
        ends = np.concatenate([[0], 4 * np.cumsum(alive.sum(1))]).tolist()
        out.update(zip(group, map(packed.__getitem__, map(slice, ends, ends[1:]))))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank, the leftmost on a tie, is merged until none has a rank."""
    end = list(range(1, len(piece) + 1))  # by the start of a part
    before = list(range(-1, len(piece) - 1))
    alive = bytearray(b"\x01") * len(piece)
    heap = [(r, i, i + 2) for i in range(len(piece) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= len(piece) or end[j] != stop or not alive[j]:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < len(piece):
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < len(piece):
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    if _made.get("ranks") is not ranks:
        _made.update(ranks=ranks, vocabulary=Vocabulary(ranks))
    vocabulary = _made["vocabulary"]
    sizes = vocabulary.sizes
    for batch in slices(batches):
        data, off = text_bytes(batch.column("text"))
        raw = data.tobytes()
        starts = token_starts(data, off)
        one_of, which = distinct_pieces(data, starts)
        cuts = np.append(starts, len(raw))
        pieces = list(map(raw.__getitem__, map(slice, cuts[one_of].tolist(), cuts[one_of + 1].tolist())))
        packed = vocabulary.of(pieces)
        numbers = gather(np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) >> 2, which)
        ids = numbers.astype("<u4").tobytes()
        # offsets of the tokens in the decoded bytes, and of the documents in the ids
        ends = np.cumsum(sizes[numbers])
        decoded = gather(vocabulary.flat, sizes, numbers).tobytes()
        doc = np.searchsorted(ends, off, "right")
        doc[0], doc[-1] = 0, len(numbers)
        base = np.concatenate([[0], ends])
        begin = base[:-1] - np.repeat(off[:-1], np.diff(doc))
        columns = [batch.column(c) for c in keep]
        columns.append(pa.array([ids[4 * a : 4 * b] for a, b in zip(doc, doc[1:])], pa.binary()))
        columns.append(pa.array([begin[a:b].astype("<u4").tobytes() for a, b in zip(doc, doc[1:])], pa.binary()))
        columns.append(pa.array([decoded[base[a] : base[b]] for a, b in zip(doc, doc[1:])], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "offsets", "decoded"])


def encode_documents(docs: DataFrame, vocabulary: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` and, for every row: ids and offsets (binary, little-endian unsigned 32-bit integers: the tokens, and
    the byte of the text at which each starts) and decoded (binary: the bytes that the ids stand for).

    vocabulary: path of a rank file on the driver; it is sent to the executors once (50,000 entries, about 1 MB).
    """
    ship(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kept = [c for c in keep if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids binary", "offsets binary", "decoded binary"])
    source = docs.select(*kept, docs[text].alias("text"))
    names = list(keep)
    return source.mapInArrow(lambda batches: encode(batches, ranks.value, names), schema)
