"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel counts common subsequences of three letters and lets each letter that they span weigh less (decay), so an
insult with gaps or inserted characters stays near the plain one. A text is a bag of words (letters only: other marks
inside a word are dropped, and letters set apart by spaces are joined); its kernel with a landmark is the greatest of its
words, in units of the landmark's own, at most 1, raised to a power. Landmarks are strings inside the words, their edges
included, that the labelled texts tie to toxicity, chosen greedily until they cover the toxic texts; features are mapped through the inverse
root of the landmarks' own kernel matrix, a squared-hinge machine is fitted on them and its margin is calibrated to a
probability.

The fit uses at most `SAMPLE` labelled rows, those with the smallest crc32 of the id; scoring covers whole texts.

Defined results: null and empty texts get the score of a text without words; rows are scored one by one, so repeated rows
get equal scores; a row whose label is null, or without a labelled text, trains nothing; if no labelled text is toxic or
none is clean, or no string is tied to toxicity, every text gets the (smoothed) share of toxic labels; other columns,
whatever their names, are kept out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import byte_values, saved, ship, slices, text_bytes, word_hashes

SAMPLE = 10_000
ORDER, DECAY, POWER = 3, 0.4, 2
#: The byte that stands for a word's edge.
EDGE = 1
#: Most landmarks, and how many of them are to cover each toxic text.
LANDMARKS, COVER = 64, 3
#: Lengths of landmarks in letters and edges; words and strings that are looked at for them.
SHORTEST, LONGEST_MARK, WORDS, STRINGS = 4, 12, 3000, 2000
#: A landmark must stand in so many distinct toxic texts, and in so many times the share of the clean ones.
LEAST_TEXTS, LEAST_LIFT = 3, 20.0
#: Bytes of a word that are compared at once; a longer one is compared in windows that overlap.
LONGEST, OVERLAP = 40, 16
#: A word is compared with a landmark if it has this share of its pairs of neighbouring letters, so far apart at most.
PAIRS_SHARED, REACH = 0.6, 3
#: Words whose kernel rows a Python worker holds.
WORDS_HELD = 300_000

_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[65:91] = _KEEP[97:123] = _KEEP[128:] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]


def squeezed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, digits and white space only; single letters set apart by one white space each are joined."""
    for _ in range(2):
        kept = _KEEP[data] | _WHITE[data]
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kept, out=before[1:])
        data, off = _LOWER[data[kept]], before[off]
        if len(data) < 5:
            return data, off
        # a white byte between two one-letter words: x_y with white space or an edge on the other sides
        white = np.ones(len(data) + 4, bool)
        white[2:-2] = _WHITE[data]
        edge = np.zeros(len(data) + 5, bool)
        edge[off + 2] = True  # a text starts here
        single = ~white[2:-2] & (white[1:-3] | edge[2:-3]) & (white[3:-1] | edge[3:-2])
        join = np.zeros(len(data), bool)
        join[1:-1] = white[3:-3] & single[:-2] & single[2:] & ~edge[3:-4] & ~edge[4:-3]
        if not join.any():
            return data, off
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~join, out=before[1:])
        data, off = data[~join], before[off]
        break
    return data, off


def distinct_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, starts and ends of the distinct words of a batch, and which text has which of them (once each)."""
    hashes, starts, ends, counts = word_hashes(data, off, _KEEP, byte_values(False, 3))
    names, one_of, which = np.unique(hashes, return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(counts))
    pairs = np.unique(doc.astype(np.int64) * max(len(one_of), 1) + which)
    return names, starts[one_of], ends[one_of], pairs // max(len(one_of), 1), pairs % max(len(one_of), 1)


def matrix(words: list[bytes] | None = None, data: np.ndarray | None = None, starts=None, ends=None) -> np.ndarray:
    """Words as rows of bytes, padded with zeros."""
    if words is not None:
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
    size = ends - starts
    out = np.zeros((len(size), int(size.max(initial=1))), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = data[np.repeat(starts, size) + place]
    return out


def edged(rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Rows of letters with an edge before and after, where the flags say so."""
    out = np.zeros((len(rows), rows.shape[1] + 2), np.uint8)
    out[:, 0] = np.where(before, EDGE, 0)
    out[:, 1:-1] = rows
    out[np.arange(len(rows)), (rows > 0).sum(1) + 1] = np.where(after, EDGE, 0)
    return out


def kernel(s: np.ndarray, mark: bytes) -> np.ndarray:
    """The subsequence kernel of each row of s (bytes padded with zeros) with a landmark."""
    t = np.frombuffer(mark, np.uint8)[:, None]
    m, letters = len(t), np.ascontiguousarray(s.T)
    lag = np.arange(m)[:, None] - np.arange(m)[None, :]
    carry = np.where(lag >= 0, DECAY ** lag.clip(0), 0.0).astype(np.float32) * np.float32(DECAY * DECAY)
    prior = [np.ones((m + 1, len(s)), np.float32)] + [np.zeros((m + 1, len(s)), np.float32) for _ in range(ORDER - 1)]  # K' of each length up to this letter of s
    total = np.zeros(len(s), np.float32)
    for letter in letters:
        same = (letter == t).astype(np.float32)
        met = [prior[k][:m] * same for k in range(ORDER)]
        total += met[-1].sum(0)
        for k in range(ORDER - 1):
            prior[k + 1] *= np.float32(DECAY)
            prior[k + 1][1:] += carry @ met[k]
    return total * np.float32(DECAY * DECAY)


def similarity(s: np.ndarray, mark: bytes) -> np.ndarray:
    """The kernel in units of the landmark's own, at most 1, raised to the power."""
    return np.minimum(kernel(s, mark) / kernel(np.frombuffer(mark, np.uint8)[None, :], mark)[0], 1.0) ** POWER


def pair_bits(words: np.ndarray, reach: int) -> np.ndarray:
    """64 bits of the pairs of letters at most `reach` apart in each row; different pairs may share a bit."""
    out = np.zeros(len(words), np.uint64)
    letters = np.ascontiguousarray(words.T).astype(np.uint32)
    first, second = letters * np.uint32(2654435761), letters * np.uint32(2246822519)
    for gap in range(1, reach + 1):
        for k in range(len(letters) - gap):
            bit = np.left_shift(np.uint64(1), ((first[k] + second[k + gap]) >> np.uint32(26)).astype(np.uint64))
            out |= np.where((letters[k] > 0) & (letters[k + gap] > 0), bit, np.uint64(0))
    return out


def alike(rows: np.ndarray, mark: bytes, share: float = PAIRS_SHARED, reach: int = REACH) -> np.ndarray:
    """Whether a row has `share` of the landmark's pairs of neighbouring letters, at most `reach` apart."""
    letters = np.ascontiguousarray(rows.T)
    pairs = set(zip(mark, mark[1:]))
    at = {x: letters == x for x in set(mark)}
    many = np.zeros(len(rows), np.int8)
    for a, b in pairs:
        many += np.logical_or.reduce([(at[a][:-gap] & at[b][gap:]).any(0) for gap in range(1, min(reach, len(letters) - 1) + 1)])
    return many >= int(np.ceil(share * len(pairs)))


class Rows:
    """Kernel rows of words already met, by the words' hashes: sorted hashes, and the row of each in `values` or -1.

    A row that is near zero throughout is not held. Over `WORDS_HELD` words all are let go; then they are computed anew.
    """

    def __init__(self, width: int):
        self.names, self.place, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros((0, width), np.float32)

    def missing(self, names: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, names)
        return np.flatnonzero(self.names[np.minimum(at, len(self.names) - 1)] != names) if len(self.names) else np.arange(len(names))

    def add(self, names: np.ndarray, values: np.ndarray) -> None:
        strong = values.max(1, initial=0) > 1e-3
        place = np.where(strong, len(self.values) + np.cumsum(strong) - 1, -1).astype(np.int32)
        at = np.searchsorted(self.names, names)
        self.names, self.place = np.insert(self.names, at, names), np.insert(self.place, at, place)
        self.values = np.concatenate([self.values, values[strong]])

    def of(self, names: np.ndarray) -> np.ndarray:
        return self.place[np.searchsorted(self.names, names)] if len(names) else np.zeros(0, np.int32)


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray  # of the landmarks' kernel values, the Nyström map included
    bias: float
    slope: float
    offset: float
    met: Rows | None = field(default=None, repr=False, compare=False)  # of this process

    def __getstate__(self) -> dict:
        return {**self.__dict__, "met": None}

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Similarity of words to each landmark.

        A word without `PAIRS_SHARED` of a landmark's letter pairs counts as unlike it. A very long word is compared in
        windows; only its own ends count as edges.
        """
        marks = [(k, mark, pair_bits(matrix([mark]), 1)[0], len(set(zip(mark, mark[1:])))) for k, mark in enumerate(self.landmarks)]
        value = np.zeros((len(starts), len(self.landmarks)), np.float32)
        size = ends - starts
        for low, high in ((1, 8), (9, 16), (17, LONGEST), (LONGEST + 1, len(data))):
            of = np.flatnonzero((size >= low) & (size <= high))
            begin, stop = starts[of], ends[of]
            if low > LONGEST:  # windows of the few very long words
                many = -(-(size[of] - OVERLAP) // (LONGEST - OVERLAP))
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                begin = np.repeat(begin, many) + within * (LONGEST - OVERLAP)
                stop = np.minimum(begin + LONGEST, np.repeat(stop, many))
                of = np.repeat(of, many)
            for j in range(0, len(of), 1 << 14):
                part = of[j : j + (1 << 14)]
                first, last = begin[j : j + (1 << 14)], stop[j : j + (1 << 14)]
                rows = edged(matrix(data=data, starts=first, ends=last), first == starts[part], last == ends[part])
                bits = pair_bits(rows, REACH)
                for k, mark, mark_bits, pairs in marks:
                    # pairs that share a bit are counted once here, so no row is lost to it
                    need = int(np.ceil(PAIRS_SHARED * pairs)) - (pairs - int(mark_bits.bit_count()))
                    hit = np.flatnonzero(np.bitwise_count(bits & mark_bits) >= need)
                    hit = hit[alike(rows[hit], mark)]
                    if len(hit):
                        np.maximum.at(value[:, k], part[hit], similarity(rows[hit], mark))
        return value

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The greatest similarity of each text's words to each landmark."""
        out = np.zeros((len(off) - 1, len(self.landmarks)), np.float32)
        if not self.landmarks:
            return out
        data, off = squeezed(data, off)
        names, starts, ends, doc, word = distinct_words(data, off)
        if self.met is None or len(self.met.names) > WORDS_HELD:
            self.met = Rows(len(self.landmarks))
        fresh = self.met.missing(names)
        if len(fresh):
            self.met.add(names[fresh], self.rows(data, starts[fresh], ends[fresh]))
        place = self.met.of(names)[word]
        kept = place >= 0
        np.maximum.at(out, doc[kept], self.met.values[place[kept]])
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias if len(self.landmarks) else np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights and bias of the squared-hinge support vector machine, by Newton steps; both classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y, 1.0, -1.0)
    share = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-8
    w = np.zeros(x.shape[1])
    for _ in range(50):
        margin = sign * (x @ w)
        on = margin < 1
        grad = ridge * w - 2 * (x[on] * (share * sign * (1 - margin))[on, None]).sum(0)
        hess = np.diag(ridge) + 2 * (x[on] * share[on, None]).T @ x[on]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins (Platt), with smoothed targets."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def chosen_marks(picked: DataFrame, strings: list[str], bad: int, good: int) -> list[bytes]:
    """The strings that, added one by one, cover the most toxic texts not yet covered enough; the longest on a tie."""
    sought = [x.encode() for x in strings]

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, off = squeezed(*text_bytes(batch.column("text")))
            raw = np.where(_WHITE[data], np.uint8(EDGE), data).tobytes()
            edge = bytes([EDGE])
            texts = (edge + raw[a:b] + edge for a, b in zip(off.tolist(), off[1:].tolist()))
            found = [[k for k, x in enumerate(sought) if x in text] for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    rows = picked.mapInArrow(holds, "toxic int, found array<int>").collect()  # at most the sample
    toxic = [set(r.found) for r in rows if r.toxic]
    clean = np.zeros(len(strings), np.int64)
    for r in rows:
        if not r.toxic:
            clean[r.found] += 1
    where: dict[int, set[int]] = {}
    for k, found in enumerate(toxic):
        for x in found:
            where.setdefault(x, set()).add(k)
    usable = {x: docs for x, docs in where.items() if len(docs) >= LEAST_TEXTS and len(docs) / bad >= LEAST_LIFT * clean[x] / good}
    covered = np.zeros(len(toxic), np.int64)
    out: list[bytes] = []
    while usable and len(out) < LANDMARKS:
        gain = {x: sum(covered[k] < COVER for k in docs) for x, docs in usable.items()}
        best = max(usable, key=lambda x: (gain[x], len(strings[x]), strings[x]))
        if gain[best] < LEAST_TEXTS:
            break
        out.append(sought[best])
        for k in usable.pop(best):
            covered[k] += 1
        # strings inside one another tell the same
        usable = {x: docs for x, docs in usable.items() if strings[x] not in strings[best] and strings[best] not in strings[x]}
    return out


def trains(doc_id: str = "doc_id") -> Column:
    """Whether a row's label may be learned: crc32 of the id as text modulo 5 is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic)."""
    ship(docs.sparkSession)
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = labels.where(trains()).where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(order, "doc_id").limit(sample)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(saved(chosen, "chosen")), "doc_id")  # at most `sample` small rows
    picked = saved(picked.groupBy("text").agg(F.max("toxic").alias("toxic")), "picked")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, off = squeezed(*text_bytes(batch.column("text")))
            _, starts, ends, doc, word = distinct_words(data, off)
            size = ends - starts
            raw = data.tobytes()
            spelt = np.array([raw[a:b].decode("utf-8", "replace") if ORDER <= b - a <= LONGEST else "" for a, b in zip(starts.tolist(), ends.tolist())], object)
            fine = (size[word] >= ORDER) & (size[word] <= LONGEST)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[doc[fine]]
            yield pa.RecordBatch.from_arrays([pa.array(spelt[word[fine]], pa.string()), pa.array(toxic)], ["word", "toxic"])

    many = picked.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    bad, good = int(many.t), int(many.n - many.t)
    plain = Model([], np.zeros(0), 0.0, 1.0, float(np.log((bad + 1) / (good + 1))))
    if not bad or not good:
        return plain
    tied = picked.mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    lift = (F.col("bad") + 0.0) / bad / ((F.col("all") - F.col("bad") + 0.5) / good)
    tied = tied.where((F.col("bad") >= 2) & (lift >= LEAST_LIFT / 4)).orderBy(F.desc("bad"), "word").limit(WORDS)
    weight: dict[str, int] = {}
    for r in tied.collect():
        for size in range(SHORTEST, LONGEST_MARK + 1):
            word = f"{chr(EDGE)}{r.word}{chr(EDGE)}"
            for k in range(len(word) - size + 1):
                weight[word[k : k + size]] = weight.get(word[k : k + size], 0) + r.bad
    strings = sorted((x for x, w in weight.items() if w >= LEAST_TEXTS), key=lambda x: (-weight[x], -len(x), x))[:STRINGS]
    landmarks = chosen_marks(picked, strings, bad, good)
    if not landmarks:
        return plain
    model = Model(landmarks, np.zeros(len(landmarks)), 0.0, 1.0, 0.0)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = model.features(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("toxic")], ["x", "toxic"])

    got = picked.mapInArrow(featured, "x binary, toxic int").toArrow()  # at most `sample` rows of 1 KB
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, len(landmarks)).astype(np.float64)
    y = got.column("toxic").to_numpy().astype(bool)
    marks = matrix(landmarks)
    own = np.stack([similarity(marks, mark) for mark in landmarks]).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    w = fit_machine(x @ root, y)
    weights = root @ w[:-1]
    slope, offset = calibrate(x @ weights + w[-1], y)
    return Model(landmarks, weights, float(w[-1]), slope, offset)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = held.value.score(held.value.features(*text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, that score under the threshold."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = held.value.score(held.value.features(*text_bytes(batch.column("text"))))
            if (scores < threshold).any():
                yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
