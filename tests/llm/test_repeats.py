import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from graphlaw.llm import queries as Q
from graphlaw.llm import repeats
from graphlaw.llm.fmindex import FMIndex, drop_repeated_words
from graphlaw.llm.suffixes import drop_earlier_bytes, suffix_array
from tests.conftest import DATA
from tests.llm.cases import COLUMNS, frame


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        text = [rng.randrange(1, rng.choice([2, 3, 5, 30]) + 1) for _ in range(rng.randrange(60))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    for text in ([1] * 300, [1, 2] * 200, list(range(1, 200)), list(range(200, 0, -1))):
        text = [*text, 0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([]) == []


def test_fm_index_counts():
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(1, 6, 400), 0, rng.integers(1, 6, 100), 0]
    index = FMIndex(text, 6, 8)
    for _ in range(300):
        m = int(rng.integers(1, 9))
        at = int(rng.integers(0, 390))
        want = text[at : at + m] if rng.random() < 0.7 else rng.integers(1, 6, m)
        low, high = np.array([0]), np.array([len(text)])
        for c in want[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        assert high[0] - low[0] == sum((text[i : i + m] == want).all() for i in range(len(text) - m + 1))


def brute_words(rows, window):
    place = Counter()
    texts = [(t or "").encode().split() for _, t in rows]
    for w in texts:
        place.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, texts, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if place[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, window):
    last = repeats.LAST_KEY
    first = {}
    texts = [((last if k is None else k), (t or "").encode()) for k, t in rows]
    for d, b in texts:
        for i in range(len(b) - window + 1):
            x = b[i : i + window]
            first[x] = min(first.get(x, (d, i)), (d, i))
    out = []
    for (key, _), (d, b) in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (d, i):
                gone[i : i + window] = True
        runs = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((key, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got_words(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=str)


def got_bytes(df):
    rows = df.collect()
    assert all(sum(s.e - s.s for s in r.spans) == r.n_removed for r in rows)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=str)


def pieces(n=150, seed=4):
    """Documents built of passages in many arrangements: long and short repeats, inside documents and across."""
    rng = random.Random(seed)
    words = [f"{a}{b}{i}" for a in "bdé" for b in "ao" for i in range(30)]
    stock = [" ".join(rng.choices(words, k=rng.randrange(3, 60))) for _ in range(25)]
    rows = []
    for i in range(n):
        parts = [rng.choice(stock) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randrange(1, 50))) for _ in range(rng.randrange(1, 7))]
        rows.append((rng.randrange(n) if i % 9 == 0 else 1000 + i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    return [*rows, (5000, "la " * 300), (5001, "la " * 200), (5002, "ab" * 400), (None, stock[0] + " " + stock[1]), (None, "la " * 99), (7, None), (8, "")]


@pytest.fixture(scope="module")
def planted(spark):
    rows = pieces()
    rows += rows[:5]
    return rows, spark.createDataFrame([(k, t, None, None, None) for k, t in rows], COLUMNS)


@pytest.mark.parametrize("hot", [False, True])
def test_op5_equals_brute_force(planted, hot, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", 3 if hot else 4000)
    rows, df = planted
    for window in (35, 8, *((120, 400) if not hot else ())):
        assert got_words(drop_repeated_words(df, window)) == brute_words(rows, window)


@pytest.mark.parametrize("hot", [False, True])
def test_op8_equals_brute_force(planted, hot, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", 3 if hot else 4000)
    rows, df = planted
    for window in (100, *((300,) if not hot else ())):
        assert got_bytes(drop_earlier_bytes(df, window)) == brute_bytes(rows, window)


def test_a_common_passage_between_different_words(spark, monkeypatch):
    """Anchors at its edges stand in as many different segments as there are documents."""
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", 5)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(70)]
    some = lambda: [word() for _ in range(rng.randrange(5, 40))]
    rows = [(i, " ".join(some() + passage[rng.randrange(12) : 70 - rng.randrange(12)] + some())) for i in range(60)]
    rows += [(100, " ".join(passage[:40])), (101, " ".join(passage[10:44])), (None, " ".join(passage))]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], COLUMNS)
    assert got_words(drop_repeated_words(df)) == brute_words(rows, 35)
    assert got_bytes(drop_earlier_bytes(df)) == brute_bytes(rows, 100)


def test_keys_of_text(spark):
    rows = [(None if k is None else f"k{k:06}", t) for k, t in pieces(40, 8)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert got_words(drop_repeated_words(df)) == brute_words(rows, 35)
    key = lambda k: "z" if k is None else k
    want = brute_bytes([(key(k), t) for k, t in rows], 100)
    assert got_bytes(drop_earlier_bytes(df).selectExpr("coalesce(doc_id, 'z') doc_id", "n_bytes", "n_removed", "spans", "kept")) == want
    assert drop_repeated_words(df).schema["doc_id"].dataType.simpleString() == "string"


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(60):
        segs = [rng.integers(1, rng.integers(2, 6), rng.integers(1, 25)) for _ in range(rng.integers(2, 12))]
        sizes, c = np.array([len(s) for s in segs]), rng.integers(1, 3, len(segs))
        begin = np.r_[0, np.cumsum(sizes + 1)][:-1]
        text, weight = np.concatenate([np.r_[s, 0] for s in segs]), np.concatenate([np.r_[np.full(len(s), n), 0] for s, n in zip(segs, c, strict=True)])
        index = FMIndex(text, int(text.max()) + 1, int(sizes.max()), weight)
        count = lambda x: sum(n * sum((s[i : i + len(x)] == x).all() for i in range(len(s) - len(x) + 1)) for s, n in zip(segs, c, strict=True))  # noqa: E731, B023
        want = [max(m for m in range(len(s) - i + 1) if not m or count(s[i : i + m]) > 1) for s in segs for i in range(len(s))]
        assert index.matching_statistics(text, begin, sizes).tolist() == want


def test_long_texts_are_cut_in_overlapping_parts(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 3000).astype(np.uint64)
    edges = np.array([0, 10, 2600, 3000])
    got = repeats.segments(codes, edges, repeats.Units(35, 12, True, 1))
    got |= repeats.parts_of(got["place"])
    for d in range(3):
        at = [p + i for p, n, o in zip(got["p"], got["n"], got["doc"], strict=True) if o == d for i in range(n)]
        assert sorted(at) == list(range(max(0, edges[d + 1] - edges[d] - 34)))


def test_queries_on_their_table(spark):
    sf = str(DATA / "sf0.001")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in Q.op5_substring_dedup(spark, sf).collect()), key=str) == brute_words(docs, 35)
    assert sorted((tuple(r) for r in Q.op8_suffix_dedup(spark, sf).collect()), key=str) == brute_bytes(docs, 100)


def test_awkward(spark):
    df = frame(spark, extra=True)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got_words(drop_repeated_words(df)) == brute_words(rows, 35)
    assert got_bytes(drop_earlier_bytes(df)) == brute_bytes(rows, 100)
    for f in (drop_repeated_words, drop_earlier_bytes):
        assert f(frame(spark, [])).collect() == []


def test_texts_under_one_key_stay_apart(spark):
    """Two texts without a key whose hashes agree in their low 25 bits: what goes from one doesn't go from the other."""
    xxhash = pytest.importorskip("xxhash")
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, clean = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(70))
    low = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() & ((1 << 25) - 1)
    seen = {low(t): t for t in (f"{passage} a{i}" for i in range(20_000))}
    other = next(t for t in (f"{clean} b{i}" for i in range(1_000_000)) if low(t) in seen)
    rows = [(1, passage), (None, seen[low(other)]), (None, other)]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], COLUMNS)
    assert got_words(drop_repeated_words(df)) == brute_words(rows, 35)
    assert got_bytes(drop_earlier_bytes(df)) == brute_bytes(rows, 100)


def test_counter_of_ranges():
    assert repeats.covered(50, [(0, 2), (30, 1), (5, 1)], 10) == [(0, 15), (30, 40)]
