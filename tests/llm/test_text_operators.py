"""The text operators against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "Zeta", "eta", "théta", "iota", "kappa", "la", "mu", "nu"]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def texts():
    out = [None, "", " \t\n", "one", "two words", "x" * 3000]
    for _ in range(12):
        base = prose(random.choice([6, 9, 30, 120]))
        out.append(base)
        for _ in range(3):
            words = base.split()
            words[random.randrange(len(words))] = random.choice(["neu", "ny"])
            out.append(" ".join(words))
        out.append(base.upper())
    out += [out[10]] * 5
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 0) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, token string, hash int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def plain(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def lowered(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_groups(docs, width, num):
    from billweave.llm.ngram_join import Threshold, jaccard_groups

    sets = {}
    for k, t in plain(docs).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(docs, width, Threshold(num, 100)).collect()}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("boundary", [0, 9, 18])
def test_light_and_heavy_agree(spark, monkeypatch, boundary):
    """Small sets give the same groups wherever the boundary lies."""
    from billweave.llm import ngram_join

    rng = random.Random(11)
    rows = []
    for k in range(120):
        n = rng.randint(1, 18)
        base = set(rng.sample(range(24), n)) if k % 3 == 0 else set(rows[-1][1])
        if k % 3:
            base.discard(rng.choice(sorted(base)))
            base |= {rng.randrange(26) for _ in range(rng.randint(1, 2))}
        rows.append((k, tuple(sorted(base))))
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in rows:
        for b, y in rows:
            if a < b and 100 * len(set(x) & set(y)) >= 85 * len(set(x) | set(y)):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    monkeypatch.setattr(ngram_join, "light_boundary", lambda sizes, t: boundary)
    docs = spark.createDataFrame([(k, " ".join(f"w{v}" for v in x)) for k, x in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(docs, 1, ngram_join.Threshold(85, 100)).collect()}
    assert got == {k: find(k) for k, _ in rows}


def test_rows_without_an_id_link(spark):
    from billweave.llm.ngram_join import Threshold, jaccard_groups

    words = [f"w{k}" for k in range(200)]
    a, b, c = words[:], words[:], words[:]
    b[100] = "x"
    c[100], c[3] = "x", "y"
    rows = [(7, " ".join(a)), (None, " ".join(b)), (9, " ".join(c)), (None, "alone"), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, Threshold(98, 100)).collect()), key=str)
    assert got == sorted([(7, 200, 7), (None, 200, 7), (9, 200, 7), (None, 1, None), (None, 0, None)], key=str)


def test_keep_one(docs, empty):
    from billweave.llm.ngram_join import jaccard_groups, keep_one

    kept = keep_one(docs)
    assert kept.columns == docs.columns
    heads = {r.component_id for r in jaccard_groups(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == heads
    assert keep_one(empty).count() == 0


def test_fingerprints(docs, empty):
    from billweave.llm.fingerprints import fingerprint_documents, fingerprints_beside_edits, likeness

    rows = sorted(plain(docs).items(), reverse=True)
    alone = {r.doc_id: r.fingerprint for r in fingerprint_documents(docs).collect()}
    got = {r.doc_id: r for r in fingerprints_beside_edits(docs).collect()}
    assert len(got) == len(rows)
    for k, (doc, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)]
        n = len(text)
        edited = text[: n - n // 3] + other[1][: n // 3]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (n, hashlib.sha256(edited.encode()).hexdigest(), alone[doc])
        assert r.near_next == pytest.approx(likeness(alone[doc], alone[other[0]]))
        assert r.near_edited == pytest.approx(likeness(r.fingerprint, r.edited_fingerprint))
    shifted = likeness(*(fingerprint_documents(docs.limit(1).select("doc_id", F.lit(x).alias("text"))).first().fingerprint for x in (prose_long, "inserted " + prose_long)))
    assert shifted > 0.9
    assert fingerprints_beside_edits(empty).count() == 0


prose_long = " ".join(f"word{k * 7919 % 1000}" for k in range(400))


def simple_seeds(text):
    from billweave.llm.pii import luhn

    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_seeds_match_the_patterns():
    from billweave.llm.pii import seeds

    for _ in range(20_000):
        t = "".join(random.choice(["a", "1", "0", "4", "25", "@", ".", "-", " ", "+", "(", ")", "_", "é", "%", "9"]) for _ in range(random.randint(0, 40)))
        assert sorted(seeds(t)) == simple_seeds(t), t


def test_context_finds_unseen(spark):
    from billweave.llm.pii import personal_data, redacted

    rows = [(k, f"{prose(3)} phone number +1 ({100 + k}) 555-{1000 + k} {prose(2)}") for k in range(60)]
    rows += [(100, "my phone number 555-7788 today"), (101, "a plain 555-7788 99 count"), (102, None), (103, "order 12345678 came")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in got[100].spans] == [(3, 16, 24)]
    assert not got[100].base and not got[103].spans and not got[102].spans
    masked = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert masked[100] == "my phone number [PHONE] today" and masked[102] is None and masked[103] == "order 12345678 came"


def brute_known(rows):
    """The graph's fixpoint in plain Python: (string, kind) that become known. rows: (kind, kinds, string, patterns)."""
    from billweave.llm.pii import TRUST, Z

    edges = {(p, s) for _, _, s, ps in rows for p in ps}
    known = {(s, k) for k, _, s, ps in rows if k >= 0 and ps}
    seeds = {s for s, _ in known}
    while True:
        trust = {}
        for p in {p for p, _ in edges}:
            held = {s for q, s in edges if q == p}
            n = len(held)
            for kind in range(5):
                hits = sum((s, kind) in known for s in held)
                x = hits / n
                low = (x + Z * Z / 2 / n - Z * (x * (1 - x) / n + Z * Z / 4 / n / n) ** 0.5) / (1 + Z * Z / n)
                if hits and low >= TRUST:
                    trust[p, kind] = low
        fresh, have = set(), {s for s, _ in known}
        for s in {s for k, _, s, _ in rows if k < 0} - have:
            best = min(((-trust[p, kind], kind) for k, kinds, t, ps in rows if k < 0 and t == s for p in ps for kind in range(5) if kinds >> kind & 1 and (p, kind) in trust), default=None)
            if best:
                fresh.add((s, best[1]))
        if not fresh:
            return {x for x in known if x[0] not in seeds}
        known |= fresh


def test_graph_against_brute_force(spark):
    """Chains of patterns that take more rounds than a few: every link is found, and none besides."""
    from billweave.llm.pii import known_strings

    rng, rows, at = random.Random(3), [], 1000
    for chain in range(6):  # each pattern is trusted once the strings of the one before are known
        group = [(3, 8, at + k, [chain * 10]) for k in range(20)]
        at += 20
        for step in range(7):
            strings = list(range(at, at + 20))
            at += 20
            group += [(-1, 8 if rng.random() < 0.9 or step < 3 else 4, s, [chain * 10 + step, chain * 10 + step + 1]) for s in strings]
        rows += group
    rows += [(rng.choice([-1, 0, 1, 2, 3, 4]), rng.choice([1, 2, 4, 8, 16, 12]), rng.randrange(40), [rng.randrange(500, 508)]) for _ in range(200)]
    rows += [(2, 4, 5000 + k, [900]) for k in range(80)] + [(-1, 12, 6000, [900]), (-1, 1, 6001, [900]), (-1, 4, 6002, [])]
    got = known_strings(spark.createDataFrame(rows, "kind int, kinds int, string long, patterns array<long>"))
    assert {(r.string, r.kind) for r in got.collect()} == brute_known(rows)


def test_secrets_are_spans(spark):
    from billweave.llm.pii import personal_data, redacted

    rows = [(k, f'so token = "{hashlib.sha1(str(k).encode()).hexdigest()}" it is') for k in range(3)] + [(9, "the value abcdefghijklmnopqrst0123456789 stands"), (10, ""), (10, ""), (None, "ab")]
    docs = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in rows], "doc_id long, text string, __hash string, __added string, n_chars int")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1].spans] == [(4, 12, 52)] and not got[1].base and not got[9].spans
    masked = redacted(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    assert {r.text for r in masked.where("doc_id < 3").collect()} == {'so token = "[SECRET]" it is'}
    assert {r.n_chars for r in masked.where("doc_id < 3").collect()} == {27}
    assert personal_data(docs.limit(0)).count() == 0 and redacted(docs.limit(0)).count() == 0


def test_known_strings_in_texts_without_digits(spark):
    from billweave.llm.pii import personal_data, redacted

    rows = [(k, f"write by email jane{k}@example.com please") for k in range(60)]
    rows += [(100, "7 write by email john at example.com please"), (101, "Ask John, or john at example.com today"), (102, "by email mary AT example.net please"), (103, "we met at noon. yes")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in personal_data(docs).collect()}
    assert got[100] == [(0, 17, 36)] and got[101] == [(0, 13, 32)] and got[102] == [(0, 9, 28)] and not got[103]
    masked = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert masked[101] == "Ask John, or [EMAIL] today" and masked[102] == "by email [EMAIL] please" and masked[103] == rows[-1][1]


def test_every_candidate_is_worth_a_look():
    import pyarrow as pa

    from billweave.llm.common import text_bytes
    from billweave.llm.pii import examined, worth_a_look

    parts = ["a", "K", "ſ", "é", ".", " ", "-", " at ", " AT ", "(at)", "[At]", " dot ", "(dot)", "[DOT]", "@", "7", "555-7788", "b.c"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 8))) for _ in range(20_000)]
    data, off = text_bytes(pa.array(texts))
    look = worth_a_look(data, off, data.tobytes().lower())
    assert not [t for t, x in zip(texts, look) if not x and any(examined(t))]


def test_toxicity(spark):
    from billweave.llm.toxicity import score_documents, train, trains, without_toxic

    insults = ["blockhead", "nitwit", "dunderhead"]
    rows, labels = [(10_000, None, "n"), (10_001, "", "n")], []
    for k in range(400):
        toxic = k % 5 == 0
        words = prose(30).split() + ([random.choice(insults), random.choice(insults)] if toxic else [])
        random.shuffle(words)
        rows.append((k, " ".join(words), "n"))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(docs, known)
    got = score_documents(docs, model).join(known, "doc_id", "left").withColumn("held", ~trains()).collect()
    held = [r for r in got if r.held and r.toxic is not None]
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in held) >= 0.97 * len(held)
    assert all(r.score < 0.5 for r in got if r.toxic is None)
    extra = spark.createDataFrame([(1, "you are such a nit-wit and n i t w i t you"), (2, "you blockkhead blockhhead")], "doc_id long, text string")
    assert all(r.score >= 0.5 for r in score_documents(extra, model).collect())
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns and 10_000 in {r.doc_id for r in kept.collect()}
    nothing = train(docs, known.limit(0))
    assert score_documents(docs.limit(3), nothing).count() == 3


def plain_kernel(s, t, decay=0.4):
    """Weighted common subsequences of three letters, by listing them."""
    import itertools

    def listed(x):
        out = collections.defaultdict(list)
        for at in itertools.combinations(range(len(x)), 3):
            out[tuple(x[k] for k in at)].append(at[-1] - at[0] + 1)
        return out

    a, b = listed(s), listed(t)
    return sum(decay ** (i + j) for key in a if key in b for i in a[key] for j in b[key])


def test_kernel_against_plain_sums():
    from billweave.llm.toxicity import alike, kernel, matrix

    rng = random.Random(8)
    for _ in range(60):
        mark = bytes(rng.choice(b"\1abcd") for _ in range(rng.randint(3, 9)))
        words = [bytes(rng.choice(b"\1abcde") for _ in range(rng.randint(1, 10))) for _ in range(6)] + [mark]
        rows = matrix(words)
        assert kernel(rows, mark) == pytest.approx([plain_kernel(w, mark) for w in words], rel=1e-4, abs=1e-7)
        pairs = set(zip(mark, mark[1:]))
        want = [sum(any(a == w[i] and b == w[j] for i in range(len(w)) for j in range(i + 1, min(i + 4, len(w)))) for a, b in pairs) >= np.ceil(0.6 * len(pairs)) for w in words]
        if rows.shape[1] > 1:
            assert alike(rows, mark).tolist() == want


def test_rows_of_words_are_held_and_let_go(monkeypatch):
    """Features don't depend on what a worker has met before, nor on how much it may hold."""
    import pyarrow as pa

    from billweave.llm import toxicity
    from billweave.llm.common import text_bytes

    marks = [b"\1nitwit\1", b"\1block", b"ckhea"]
    parts = [prose(40) + " " + random.choice(["nitwit", "n i t w i t", "blokkhead", "x" * 50 + "blockhead" + "y" * 40, "no"]) for _ in range(40)] + ["", "ab", "block" + "z" * 100]
    whole = toxicity.Model(marks, np.zeros(3), 0.0, 1.0, 0.0).features(*text_bytes(pa.array(parts)))
    assert whole.max(0).min() > 0.5
    for held in (300_000, 3):
        monkeypatch.setattr(toxicity, "WORDS_HELD", held)
        model = toxicity.Model(marks, np.zeros(3), 0.0, 1.0, 0.0)
        got = np.concatenate([model.features(*text_bytes(pa.array([x]))) for x in parts])
        assert np.array_equal(got, whole)


def test_removal_of_repeats(docs, empty, spark):
    from billweave.llm.suffix_dedup import without_repeats

    long = docs.withColumn("text", F.concat(F.repeat(F.coalesce("text", F.lit("")), 3), F.lit("é" * 30)))
    length = 60
    raw = {k: t.encode() for k, t in plain(long).items()}
    seen = collections.Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    got = {r.doc_id: r for r in without_repeats(long, length).collect()}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        assert bytes(got[k].kept) == bytes(c for c, x in zip(b, gone) if not x)
        assert len(got[k].spans) == sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
    assert without_repeats(empty).count() == 0


def test_shared_passages(docs, empty, spark):
    """All rows that share 90 bytes with another are found, and none that shares under 61 (32 and a side of 29)."""
    from billweave.llm.suffix_dedup import shared_passages

    rng = random.Random(2)

    def letters(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    common, short = letters(90), letters(55)
    rows = [(k, letters(rng.randint(0, 300)) + common + letters(rng.randint(0, 300))) for k in range(6)]
    rows += [(k, letters(200) + short + letters(200)) for k in range(10, 16)] + [(20, letters(200)), (21, rows[0][1][:150]), (22, None), (23, "ab " * 100), (23, "ab " * 100), (24, letters(120) * 3)]
    table = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, hash string").repartition(3)
    raw = [(k, (t or "").encode()) for k, t in rows]
    share = {n: collections.defaultdict(set) for n in (61, 90)}
    for k, b in raw:
        for n, seen in share.items():
            for i in range(len(b) - n + 1):
                seen[b[i : i + n]].add((k, b))
    want = {n: {k for v in seen.values() if len(v) > 1 for k, _ in v} for n, seen in share.items()}
    got = {r.doc_id for r in shared_passages(table, 90).collect()}
    assert want[90] <= got <= want[61] and want[90] >= set(range(6)) and not got & set(range(10, 16))
    assert shared_passages(empty).count() == 0


def test_induced_sorting(monkeypatch):
    from billweave.llm import induced_sort

    for k in range(400):
        length, letters = random.choice([1, 2, 3, 5, 8]), random.choice([1, 2, 3, 5])
        pieces = [bytes(random.choice(range(97, 97 + letters)) for _ in range(random.randint(1, random.choice([3, 10, 40])))) for _ in range(random.randint(1, 8))]
        ends, places, at = np.cumsum([len(p) for p in pieces]), collections.defaultdict(list), 0
        for p in pieces:
            for i in range(len(p) - length + 1):
                places[p[i : i + length]].append(at + i)
            at += len(p)
        monkeypatch.setattr(induced_sort, "BLOCK", random.choice([2, 3, 7, 1 << 17]))
        got = induced_sort.repeated_starts(np.frombuffer(b"".join(pieces), np.uint8), ends, length, limit=random.choice([10, 1000, 1 << 20]))
        assert got.tolist() == sorted(i for v in places.values() if len(v) > 1 for i in v)


def test_contamination(docs, empty, spark):
    from billweave.llm.decontamination import contamination, without_contaminated

    have = plain(docs)
    long = [t for t in have.values() if len(t.split()) > 20]
    items = [(1, " ".join(long[0].split()[3:20])), (2, prose(25)), (3, "Two WORDS!"), (4, None), (5, "..."), (6, long[1] + " tail"), (6, long[1] + " tail"), (None, "one")]
    table = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for name, t in items:
        w = pattern.findall(lowered(t or ""))
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add("" if name is None else str(name))
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in contamination(docs, table).collect()}
    for k, t in have.items():
        w, hit, names = pattern.findall(lowered(t)), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(w[i : i + size])]
        assert got[k] == (len(w), len(hit), sorted(names)), k
    assert contamination(empty, table).count() == 0
    assert contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0
    assert without_contaminated(docs, table).columns == docs.columns


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_that_stay_are_not_shuffled(spark):
    """Also when the ids that go are too many to be sent to all executors."""
    from billweave.llm.decontamination import without_contaminated
    from billweave.llm.ngram_join import keep_one

    rows = [(k, " ".join(random.randbytes(8).hex() for _ in range(100))) for k in range(300)]
    rows += [(300 + k, t) for k, t in rows[:20]] + [(None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    items = spark.createDataFrame([(k, rows[k][1]) for k in range(20, 30)], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kept, want in ((without_contaminated(docs, items), {*range(20), *range(30, 320), None}), (keep_one(docs), {*range(300), None})):
            at = shuffled(spark)
            assert {r.doc_id for r in kept.collect()} == want
            assert shuffled(spark) - at < sum(len(t) for _, t in rows) / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("log2", [1, 23])
def test_rows_parted_by_ids(spark, monkeypatch, log2):
    """Against a plain look-up; names of columns, types of ids and a map that is full change nothing."""
    from billweave.llm import common

    monkeypatch.setattr(common, "ID_BITS", 1 << log2)
    rows = [(k, k % 7, "x", b"y", "z", "i") for k in [*range(-40, 40), 2**40, 40_000, 5, 5]] + [(None, 0, None, None, None, None)]
    for kind in ("long", "string"):
        docs = spark.createDataFrame(rows, "doc_id long, slot int, bucket string, bits binary, d string, m string").withColumn("doc_id", F.col("doc_id").cast(kind)).select("d", "m", "doc_id", "slot", "bucket", "bits")
        for gone in ([], [0, 5, -40, 39, 40_000, 77, 2**50]):
            ids = spark.createDataFrame([(k,) for k in gone], "doc_id long")
            have = docs.collect()
            for got, inside in zip(common.parted(docs, ids), (False, True)):
                assert got.schema == docs.schema
                want = [r for r in have if (r.doc_id is not None and int(r.doc_id) in gone) == inside]
                assert sorted(map(repr, got.collect())) == sorted(map(repr, want))


def test_near_matches(spark):
    from billweave.llm.common import saved
    from billweave.llm.decontamination import build_index, item_terms, near_matches, phrase_matches

    item = " ".join(f"w{k}" for k in range(13))
    near = " ".join(f"w{k}" + (" so" if k in (4, 9) else "") for k in range(13))
    docs = spark.createDataFrame([(1, item), (2, near), (3, "w1 " + "so " * 60 + "w9 w12")], "doc_id long, text string")
    terms = item_terms(spark.createDataFrame([(1, item)], "item_id long, text string"))
    vocabulary = saved(terms.select("word").distinct().select("word", (F.monotonically_increasing_id() + 1).alias("term")), "v")
    terms = saved(terms.join(vocabulary, "word"), "t")
    index = build_index(docs, vocabulary)
    names = {r.doc: r.doc_id for r in index.where("term = 0").collect()}
    assert {names[r.doc] for r in phrase_matches(index, terms).collect()} == {1}
    assert {names[r.doc] for r in near_matches(index, terms).collect()} == {1, 2}


def test_byte_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    from billweave.llm.bpe import encode, encode_documents, load_ranks

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = load_ranks(path)
    assert base64.b64encode(next(iter(ranks)))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in encode_documents(docs, path, keep=["doc_id", "text"]).collect():
        text = r.text or ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == other.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        starts = np.frombuffer(r.offsets, "<u4").tolist()
        assert starts == np.concatenate([[0], np.cumsum([len(other.decode_single_token_bytes(k)) for k in ids])])[:-1].astype(int).tolist()
    assert encode_documents(empty, path).count() == 0
    import pyarrow as pa

    odd = ["".join(random.choice(" \n\t'srelvtmdabé1½!?　​ 漢😀") for _ in range(random.randint(0, 60))) for _ in range(3000)]
    odd += ["'s", "''s 's\n's", "it'll we're they've I'm he'd 'r 'v 're", " \n b \n", "a" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(odd))), pa.array(odd)], ["doc_id", "text"])
    for out in encode(iter([batch]), ranks, ["doc_id"]):
        for k, ids in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(odd[k]), odd[k]


def test_byte_bpe_beyond_the_cache(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    import tiktoken

    from billweave.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    texts = ["the cat and the dog", "the cat " + " ".join(f"piece{k}q{k * 7919}x" for k in range(300)), "the dog ran", " ".join(f"the w{chr(97 + k)}" for k in range(26)), "the cat"]
    slices = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x])], ["doc_id", "text"]) for k, x in enumerate(texts)]
    got = [np.frombuffer(out.column(1)[0].as_py(), "<u4").tolist() for out in bpe.encode(iter(slices), ranks, ["doc_id"])]
    assert got == [other.encode_ordinary(x) for x in texts]
    assert len(bpe._made["vocabulary"].cache) <= 50
