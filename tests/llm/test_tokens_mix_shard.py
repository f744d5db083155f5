import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphlaw.llm import queries as Q
from graphlaw.llm.mix import mix, mixed_documents
from graphlaw.llm.shard import histogram_sort
from graphlaw.llm.tokens import MergeTable, TokenCounter, count_tokens
from tests.conftest import DATA
from tests.llm.cases import COLUMNS, frame

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
SF = str(DATA / "sf0.001")


def library(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    rng = random.Random(5)
    alphabet = "aab eE'stré日😀\n\t  .,!0123<|>"
    texts = ["", " ", "aaaaaaa", "a" * 5000, "<|endoftext|>", "x<|endoftext|> y", "<|endoftext", "don't we'll I'M", "　 \x1c  ", "ab" * 4000, *("".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(800))]
    assert TokenCounter(MergeTable(PATH)).counts(texts) == library(texts)


def test_op3_on_its_table(spark):
    rows = Q.op3_token_counts(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    assert len(rows) == len(texts)
    assert all((r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(texts[r.doc_id].encode()), want[r.doc_id] > 1024) for r in rows)


def test_op3_awkward(spark):
    df = count_tokens(frame(spark, extra=True), PATH)
    rows = df.collect()
    assert len(rows) == 17 and {r.n_tokens for r in rows if r.doc_id in (0, 1, 100)} == {0}
    assert count_tokens(frame(spark, []), PATH).collect() == []


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def check_mix(rows, whole=None):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
    return {s: (taken[s], want[s]) for s in sizes}


def test_op4(spark):
    df = mix(spark.read.parquet(f"{SF}/documents.parquet"), keep=["doc_id", "source"])
    rows = df.collect()
    for took, target in check_mix(rows).values():
        assert abs(took - target) <= 0.5
    again = {r.doc_id: r.taken for r in Q.op4_mix_sources(spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    for r in rows:
        assert sum(t.words for t in r.takes) == r.taken
        assert all(0 <= t.begin and t.begin + t.words <= r["size"] for t in r.takes)
    slots = defaultdict(int)
    for r in rows:
        for t in r.takes:
            slots[r.source, t.slot] += t.words
    assert max(slots.values()) <= 128


def test_op4_blocks_follow_from_the_permutation(spark):
    """Every pass but the last has every block once, the last one some, and what slots take adds up to the target."""
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(90))), "en", rng.choice(["a", "b", "c", "d", None]), 0) for i in range(300)]
    out = mix(spark.createDataFrame(rows, COLUMNS), block=16).collect()
    for took, target in check_mix(out).values():
        assert abs(took - target) <= 0.5
    words = defaultdict(Counter)
    shards = defaultdict(set)
    for r in out:
        for t in r.takes:
            words[r.source, t["pass"]][t.slot] += t.words
            shards[r.source, t.slot].add(t.shard)
    assert all(len(s) == 1 for s in shards.values())
    for s in {r.source for r in out}:
        # a shard's slots are a range, and no shard's count is far from its share
        own = [next(iter(v)) for (source, _), v in sorted(shards.items(), key=lambda x: x[0][1]) if source == s]
        assert own == sorted(own)
        n = Counter(own)
        assert all(abs(n[j] - len(own) / 8) <= 4.5 * (len(own) * 7 / 64) ** 0.5 for j in range(8))
    for s in {r.source for r in out}:
        size = sum(r["size"] for r in out if r.source == s)
        passes = sorted(p for x, p in words if x == s)
        assert passes == list(range(len(passes)))
        for p in passes[:-1]:
            assert sum(words[s, p].values()) == size and sorted(words[s, p]) == list(range(p * len(words[s, p]), (p + 1) * len(words[s, p])))
        last = words[s, passes[-1]]
        assert sum(n < 16 for n in last.values()) <= 2
    # no word is taken twice in a pass
    for r in out:
        seen = Counter((t["pass"], w) for t in r.takes for w in range(t.begin, t.begin + t.words))
        assert all(n == 1 for n in seen.values())


def test_op4_awkward(spark):
    odd = frame(spark).selectExpr("*", "map('k', doc_id) m", "array(map(1, 2)) n")
    assert mix(odd, block=16).count() == 17 and mixed_documents(odd, block=16).columns == odd.columns
    df = frame(spark, extra=True)
    out = mix(df, block=16)
    check_mix(out.collect())
    assert out.count() == 17 and set(df.columns) <= set(out.columns)
    assert mix(frame(spark, [])).collect() == []
    assert [r.taken for r in mix(frame(spark, [(1, None, None, None, None)])).collect()] == [0]


def check_shards(rows, n=8, size="size"):
    slots, bytes_ = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r[size]
        assert 0 <= r["shard"] < n
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return [bytes_[i] for i in range(n)]


def test_op9(spark):
    rows = Q.op9_histogram_shards(spark, str(DATA / "sf0.01")).collect()
    assert len(rows) == 1000
    by = check_shards(rows)
    assert max(by) - min(by) <= 2 * max(r["size"] for r in rows)
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_op9_shards_follow_the_order_of_hashes(spark):
    """Splitters by sorting everything: shards are ranges of the order, each begins where the bytes below are nearest to its share."""
    rows = [(i, f"text {i % 900} " * (1 + i % 900 % 13), None, None, i) for i in range(2000)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("size", F.length("text").cast("long"))
    out = histogram_sort(df, F.col("size"), [F.col("text")], [F.col("doc_id")], tolerance=0, group_tolerance=1).select("size", "shard", "slot", "text", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(7), "doc_id").alias("t")).collect()
    out.sort(key=lambda r: (r.k, r.t))
    assert [(r.shard, r.slot) for r in out] == sorted((r.shard, r.slot) for r in out)
    ideal, below, cut, edges = sum(r["size"] for r in out) / 8, 0, [], []
    for a, b in zip([None, *out], [*out, None]):
        if a is None or b is None or a.k != b.k:
            edges.append(below)
        if a is not None and b is not None and a.shard != b.shard:
            cut.append(below)
            assert a.k != b.k
        below += b["size"] if b is not None else 0
    assert len(cut) == 7 and all(abs(c - ideal * j) == min(abs(e - ideal * j) for e in edges) for j, c in enumerate(cut, 1))


def test_op9_hot_group(spark):
    """A group of equal keys with most of all bytes is cut between its ties; small tasks still number gaplessly."""
    rows = [(i, "same text" if i % 3 else f"t{i}", None, None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("size", F.length("text").cast("long"))
    out = histogram_sort(df, F.col("size"), [F.col("text")], [F.col("doc_id")], rows_per_task=100).collect()
    by = check_shards(out)
    assert max(by) <= 1.02 * min(by)


def test_op9_awkward(spark):
    df = frame(spark, extra=True).drop("size")
    out = histogram_sort(df, F.octet_length(F.coalesce("text", F.lit(""))) + 1, [F.col("text")], [F.col("doc_id")])
    assert out.count() == 17
    check_shards(out.collect(), size="slot")
    empty = histogram_sort(frame(spark, []), F.lit(1), [F.col("text")], [F.col("doc_id")])
    assert empty.collect() == [] and empty.columns[-2:] == ["shard", "slot"]
