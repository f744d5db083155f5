import hashlib
import itertools
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from graphlaw.llm import omh
from graphlaw.llm import queries as Q
from graphlaw.llm.decontaminate import decontaminate, find_leaks, mark_leaks
from tests.conftest import DATA
from tests.llm.cases import COLUMNS, frame

xxhash = pytest.importorskip("xxhash")
SF = str(DATA / "sf0.001")
MASK64 = (1 << 64) - 1


def toks(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_leaks(docs, items):
    """Every diagonal of every document with every item."""
    out = {}
    for i, text in docs:
        d, found = toks(text), set()
        for item, t in items:
            t = toks(t)
            need = min(13, -(-len(t) * 8 // 10))
            if len(t) >= 5 and any(sum(1 for j, w in enumerate(t) if 0 <= g + j < len(d) and d[g + j] == w) >= need for g in range(-len(t), len(d))):
                found.add(item)
        out[i] = sorted(found)
    return out


def test_op2_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 30_000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r.item_ids for r in Q.op2_spaced_seed_decontamination(spark, SF).collect()}
    want = brute_leaks(docs, items)
    assert {i: got[i] for i, _ in docs} == want and any(want.values())


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate((30, 18, 25, 6, 7))] + [(90, "of the"), (91, None), (92, "")]
    docs = []
    for i in range(60):
        body = rng.choices(words, k=rng.randrange(5, 120))
        if i % 2:
            item = items[i % 5][1].upper().split()
            if len(item) > 10:
                for p in rng.sample(range(len(item)), len(item) // 8):
                    item[p] = "changed"
            at = rng.randrange(len(body))
            body = body[:at] + [f"{w}," for w in item] + body[at:]
        docs.append((i, " ".join(body), "en", "s", 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    return spark.createDataFrame(docs, COLUMNS), bench, brute_leaks([d[:2] for d in docs], items)


@pytest.mark.parametrize("limit", [300_000, 0])
def test_op2_substitutions_by_either_join(planted, limit):
    docs, bench, want = planted
    got = {r.doc_id: r.leaked_items for r in mark_leaks(docs, bench, broadcast_seeds=limit).collect()}
    assert got == want and sum(map(bool, want.values())) >= 30


@pytest.mark.parametrize("limit", [300_000, 0])
def test_op2_finds_every_pattern_of_substitutions(spark, limit):
    """Every pattern up to 14 tokens; of longer items 300 with just the tokens needed. No more may be found than agree."""
    rng = random.Random(5)
    items, docs = [], []
    long = (30, 31, 45, 60) if limit == 0 else (30, 31, 45, 60, 75, 150)
    for n in [*range(5, 21), 24, *long]:
        item = [f"i{n}x{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        need = min(13, -(-n * 8 // 10))
        full = list(itertools.combinations(range(n), n - need)) if n < 15 else [rng.sample(range(n), n - need) for _ in range(300)]
        for gone in [*full, rng.sample(range(n), n - need + 1)]:
            docs.append((len(docs), " ".join(f"d{j}" if j in gone else w for j, w in enumerate(item)), [n] if n - len(gone) >= need else []))
    # tokens that agree sit as far apart as they can
    docs += [(len(docs) + k, " ".join(f"i{n}x{j}" if j % ((n - 1) // 12) == 0 and j <= 12 * ((n - 1) // 12) else f"d{j}" for j in range(n)), [n]) for k, n in enumerate(long)]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.leaked_items for r in mark_leaks(df, bench, broadcast_seeds=limit).collect()}
    assert got == {i: w for i, _, w in docs}


@pytest.mark.parametrize("limit", [300_000, 0])
def test_op2_rows_of_one_item_with_different_texts(spark, limit):
    texts = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 20), ("b", 9))]
    docs = spark.createDataFrame([(i, f"x y {t} z") for i, t in enumerate(texts)], "doc_id long, text string")
    for order in (texts, texts[::-1]):
        bench = spark.createDataFrame([("one", t) for t in order], "item_id string, text string")
        assert [r.leaked_items for r in mark_leaks(docs, bench, broadcast_seeds=limit).orderBy("doc_id").collect()] == [["one"], ["one"]]


def test_op2_awkward(spark, planted):
    df = frame(spark, extra=True)
    out = decontaminate(df, planted[1])
    assert out.columns == df.columns and out.count() == 17
    assert decontaminate(df, planted[1].limit(0)).count() == 17
    assert decontaminate(frame(spark, []), planted[1]).collect() == []
    fox = spark.createDataFrame([(1, "The QUICK brown fox jumps over the lazy dog!", None)], "item_id long, text string, hash string")
    kept = decontaminate(df, fox).collect()
    assert len(kept) == 17 - 6 and find_leaks(df, fox).count() == 2


def spark_hash(*values):
    """The 64-bit hash of the engine: each value is hashed with the hash so far as seed."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Small) else "<q", v)
            h = xxhash.xxh64(raw, seed=h & MASK64).intdigest()
    return h - (1 << 64) if h >> 63 else h


class Small(int):
    pass


def brute_print(text):
    """Each order sorts all elements from its own bin on; its two least, in text order, are the tuple."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    tokens = words if len(words) >= 16 else list(text or "")
    hashes = [spark_hash(w) for w in tokens]
    seen, all_ = {}, []
    for i in range(len(hashes)):
        kmer = spark_hash(*hashes[i : i + 3])
        nth = seen[kmer] = seen.get(kmer, -1) + 1
        all_.append((spark_hash(kmer, Small(nth)) & ((1 << 32) - 1), i))
    out = []
    for order in range(64 if all_ else 0):
        two = sorted(sorted(all_, key=lambda x: (((x[0] >> 26) - order) % 64, x))[:2], key=lambda x: x[1])
        out.append((spark_hash(*[h for h, _ in two]) & 0xFFFF) - 0x8000)
    return out


def test_op7_fingerprints_equal_brute_force(spark):
    rng = random.Random(9)
    texts = ["", None, "a", "aaaaaaa", "one two three", " ".join("ab" for _ in range(50)), "日本語😀" * 9, " ".join(rng.choices(["x", "y", "z"], k=300)), *(" ".join(rng.choices("the of and cat dog sun".split(), k=rng.randrange(200))) for _ in range(40))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.f for r in df.select("i", omh.fingerprint(F.coalesce("text", F.lit(""))).alias("f")).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_op7_likeness_falls_with_edit_distance(spark):
    """Changed words lower it, and so does moving passages, which leaves the set of k-mers nearly alone; short texts too."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    pairs = []
    for n in (12, 40, 400):
        for _ in range(20):
            a = rng.choices(words, k=n)
            b = list(a)
            for p in rng.sample(range(n), max(1, n // 50)):
                b[p] = "changed"
            cuts = [a[i : i + n // 4] for i in range(0, n, n // 4)]
            c = sum(cuts[::-1], [])
            d = rng.choices(words, k=n)
            pairs += [(n, kind, " ".join(a), " ".join(x)) for kind, x in (("same", a), ("few", b), ("moved", c), ("other", d))]
    df = spark.createDataFrame(pairs, "n int, kind string, a string, b string")
    near = df.select("n", "kind", omh.likeness(omh.fingerprint(F.col("a")), omh.fingerprint(F.col("b"))).alias("x")).groupBy("n", "kind").agg(F.avg("x").alias("x")).collect()
    got = {(r.n, r.kind): r.x for r in near}
    for n in (12, 40, 400):
        assert got[n, "same"] == 1 and got[n, "few"] > got[n, "moved"] + 0.1 and got[n, "moved"] > got[n, "other"], got
        assert got[n, "few"] > 0.4 and got[n, "other"] < 0.1, got
    share = lambda a, b: 1 - edit_distance(a.split(), b.split()) / max(len(a.split()), 1)
    assert all(share(a, b) > 0.9 for n, kind, a, b in pairs if kind == "few")


def test_op7(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in Q.op7_order_minhash(spark, SF).collect()}
    assert len(got) == len(docs)
    for (i, text), (_, follow) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(text) // 3
        edited = text[: len(text) - n] + follow[:n]
        said = lambda t: "".join(f"{x + 0x8000:04X}" for x in brute_print(t))
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if len(text) < 3000:
            assert (got[i].fingerprint, got[i].edited_fingerprint) == (said(text), said(edited))
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    rows = list(got.values())
    assert sum(r.near_edited for r in rows) / len(rows) > 0.2 + sum(r.near_next for r in rows) / len(rows)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_op7_ranges_and_ties(spark, kind):
    """Many small ranges, repeated ids, null ids, rows that repeat key and text: every row has its next."""
    rows = [(f"k{i // 2 if i % 7 else i:04}" if kind == "string" else i // 2 if i % 7 else i, f"text {i}") for i in range(300)] + [(None, "none"), (None, None)]
    rows += rows[20:23] * 2
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    out = omh.edited_by_next(df, lambda t: F.length(t), rows_per_task=40).collect()
    order = sorted(((k is not None, k or "", spark_hash(t or ""), t or "") for k, t in rows), key=lambda r: (r[0], r[1] or 0, r[2]) if kind == "long" else r, reverse=True)
    want = sorted((a[3], a[3][: len(a[3]) - len(a[3]) // 3] + b[3][: len(a[3]) // 3], len(b[3])) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((r.text, r.edited, r.next_value) for r in out) == want


def test_op7_awkward(spark):
    out = omh.edited_by_next(frame(spark, extra=True), omh.fingerprint)
    assert out.count() == 17 and out.where("edited is null or next_value is null").count() == 0
    assert omh.edited_by_next(frame(spark, []), omh.fingerprint).collect() == []
    one = omh.edited_by_next(frame(spark, [(5, "alone", None, None, 1)]), omh.fingerprint).collect()
    assert [(r.doc_id, r.edited) for r in one] == [(5, "alona")]
