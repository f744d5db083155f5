import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphlaw.llm import neardup
from graphlaw.llm import queries as Q
from graphlaw.llm.neardup import components, counted, dart_signatures, drop_near_duplicates, mark_near_duplicates
from tests.conftest import DATA
from tests.llm.cases import COLUMNS, frame


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0, 3, 60), rng.uniform(0, 3, 60)
    a[:10], b[20:30] = 0, 0
    e, w = np.r_[names, names], np.r_[a, b]
    sig = dart_signatures(e, w, np.repeat([0, 1], 60), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    # a set is a bag of weights 1, its repeats don't matter
    s = dart_signatures(np.r_[names, names[:5]], None, np.zeros(65, np.int64), 1, 200)
    assert (s == dart_signatures(names, None, np.zeros(60, np.int64), 1, 200)).all()
    assert (dart_signatures(names[:0], None, np.zeros(0, np.int64), 2, 8) == 2**64 - 1).all()


def test_counted():
    e, c, d = counted(np.array([5, 3, 5, 3], np.uint64), np.array([0, 0, 0, 1]))
    assert (e.tolist(), c.tolist(), d.tolist()) == ([3, 5, 3], [1, 2, 1], [0, 0, 1])


def bags(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    s = [bags(t) for _, t in rows]
    n = [b.total() for b in s]
    for i in range(len(rows)):
        for j in range(i):
            both = (s[i] & s[j]).total() if min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) - 1e-9 else 0
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= 0.8 * (n[i] + n[j] - both) - 1e-9:
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        out[find(i)].append(key)
    return sorted(sorted(x) for x in out.values())


def classes_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.class_id].append(r.doc_id)
    assert all(min(x) == c for c, x in out.items())
    return sorted(sorted(x) for x in out.values())


@pytest.fixture(scope="module")
def chained(spark):
    """Groups of near copies whose members are linked through others only, and copies."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(12):
        text = rng.choices(words, k=rng.randrange(40, 200))
        for _ in range(14):
            texts.append(" ".join(text))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
    texts += [t for t in texts[:40]] + ["a b", "a b", "a b c", "", " ", None, " "]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_op10_equals_brute_force(spark, chained):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in chained], COLUMNS)
    rows = mark_near_duplicates(df).collect()
    assert classes_of(rows) == brute_classes(chained)
    size = {r.class_id: r.class_rows for r in rows}
    assert sum(size.values()) == len(chained)
    kept = drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(size) and kept.columns == df.columns


def test_op10_on_its_table(spark):
    sf = str(DATA / "sf0.001")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert classes_of(Q.op10_dart_minhash(spark, sf).collect()) == brute_classes(docs)


def test_op10_one_family_of_edited_and_extended_copies(spark, monkeypatch):
    """Mostly common shingles, unequal sizes near the limit, words that recur: all links are found, and with them all classes."""
    monkeypatch.setattr(neardup, "COMMON", 200)
    rng = random.Random(13)
    words = [f"w{i}" for i in range(500)]
    base, lines = rng.choices(words, k=240), [rng.choices(words, k=12) for _ in range(6)]
    texts = []
    for _ in range(140):
        t = list(base)
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(t))
            t[at:at] = rng.choice(lines)
        texts.append(" ".join(t[: rng.randrange(190, len(t) + 1)]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    assert classes_of(mark_near_duplicates(df).collect()) == brute_classes(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.uid: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[a] == got[b] for a, b in edges)
    assert len({got[0], got[100]}) == 2 and {v for k, v in got.items() if k < 200} == {got[0], got[100]}


def test_op10_awkward(spark):
    df = frame(spark, extra=True)
    assert mark_near_duplicates(df).count() == 17
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == 11
    assert drop_near_duplicates(frame(spark, [])).collect() == [] == mark_near_duplicates(frame(spark, [])).collect()
    twice = frame(spark, [(None, "x y", None, None, 1), (None, "x y", None, None, 2), (None, None, None, None, None)])
    assert drop_near_duplicates(twice).count() == 2
