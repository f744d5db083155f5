from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from graphlaw.llm import toxicity
from graphlaw.llm.mix import mixed_documents
from graphlaw.sources import shared
from tests.conftest import DATA
from tests.llm.cases import frame
from tests.llm.test_decontaminate_omh import brute_leaks
from tests.llm.test_neardup import brute_classes
from tests.llm.test_tokens_mix_shard import brute_targets, check_shards

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, f in P.STAGES:
        done = P.written(f(spark, docs, SF), "test")
        docs = done
        out.append(done.collect())
    return out


def test_stages_follow_brute_force(spark, steps):
    start, calm, single, clean, mixed, shards = steps
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = dict(zip((r.doc_id for r in start), model.score([r.text for r in start]), strict=True))
    assert {r.doc_id for r in calm} == {i for i, s in scores.items() if s < 0.5} and len(calm) < len(start)
    groups = brute_classes([(r.doc_id, r.text) for r in calm])
    assert sorted(r.doc_id for r in single) == sorted(min(g) for g in groups)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = brute_leaks([(r.doc_id, r.text) for r in single], items)
    assert {r.doc_id for r in clean} == {i for i, x in leaks.items() if not x} and any(leaks.values())
    for rows in (calm, single, clean):
        by = {r.doc_id: r for r in start}
        assert all(by[r.doc_id] == r for r in rows)


def test_mixing_takes_runs_near_the_targets(steps):
    clean, mixed = steps[3], steps[4]
    by, sizes, took, each = {r.doc_id: r for r in clean}, Counter(), Counter(), Counter()
    for r in clean:
        sizes[r.source] += len(r.text.encode().split())
    for r in mixed:
        d = by[r.doc_id]
        assert (r.lang, r.source) == (d.lang, d.source) and r.n_chars == (d.n_chars if r.text == d.text else len(r.text))
        assert r.text == d.text or r.text.encode() in b" ".join(d.text.encode().split())
        took[r.source] += len(r.text.encode().split())
        each[r.doc_id] += len(r.text.encode().split())
    assert all(n <= 2 * len(by[i].text.encode().split()) for i, n in each.items())
    for s, target in brute_targets(sizes).items():
        assert abs(took[s] - target) <= 129


def test_sharding_keeps_every_row(steps):
    mixed, shards = steps[4], steps[5]
    assert Counter(tuple(r) for r in mixed) == Counter(tuple(r)[:-2] for r in shards)
    sizes = defaultdict(int)
    for r in shards:
        sizes[r.shard] += len(r.text.encode()) + 1
    check_shards([{"shard": r.shard, "slot": r.slot, "size": 1} for r in shards])
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len(r.text.encode()) for r in shards)


def test_run_and_columns(spark):
    out = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() > 100


def test_awkward_and_empty(spark):
    for rows in (None, []):
        docs = frame(spark, rows)
        for _, f in P.STAGES:
            docs = P.written(f(spark, docs, SF), "test")
        assert (docs.count() > 0) == (rows is None)
    odd = frame(spark, extra=True)
    out = mixed_documents(odd, block=16)
    assert out.columns == odd.columns and out.count() > 0


def test_the_drivers_heap_is_given_back_between_tables(spark, monkeypatch):
    gateway, runtime = spark.sparkContext._gateway, spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    ballast = gateway.jvm.java.nio.ByteBuffer.allocate(1_000_000_000)
    grown = runtime.totalMemory()
    gateway.detach(ballast)
    monkeypatch.setattr(shared, "HEAP_SHARE", 0.1, raising=False)
    assert grown > 0.1 * runtime.maxMemory()
    assert P.written(spark.range(3), "test").count() == 3
    assert runtime.totalMemory() < grown - 400_000_000
