"""All operators on rows with text ids, columns of types that can't be hashed or compared, and a text of 25 000 words."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from graphlaw.llm import omh, pii, toxicity
from graphlaw.llm.decontaminate import decontaminate, mark_leaks
from graphlaw.llm.fmindex import drop_repeated_words
from graphlaw.llm.mix import mix, mixed_documents
from graphlaw.llm.neardup import drop_near_duplicates, mark_near_duplicates
from graphlaw.llm.shard import histogram_sort
from graphlaw.llm.suffixes import drop_earlier_bytes
from tests.llm.cases import frame


@pytest.fixture(scope="module")
def odd(spark):
    df = frame(spark)
    long = spark.range(1).selectExpr("cast(500 as long) doc_id", "array_join(transform(sequence(1, 25000), i -> concat('v', i % 3001)), ' ') text", "'en' lang", "'s0' source", "0L n_chars")
    df = df.unionByName(long).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return df.selectExpr("*", "map('k', text) m", "array(named_struct('a', map(1, 2))) n", "cast(null as binary) b").repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("i1", "The QUICK brown fox jumps over the lazy dog!"), ("i2", " ".join(f"v{i}" for i in range(40, 80)))], "item_id string, text string")


def tokens(df):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from graphlaw.llm.tokens import count_tokens

    del tokenizers
    return count_tokens(df, public.path("byte_bpe_50k.json"))


WAYS = {
    "op1": lambda df, b: toxicity.score_toxicity(df, toxicity.fit_on(df, df.selectExpr("doc_id", "cast(length(doc_id) % 2 as int) toxic"))),
    "op2": lambda df, b: mark_leaks(df, b),
    "op3": lambda df, b: tokens(df),
    "op4": lambda df, b: mix(df, block=16),
    "op5": lambda df, b: drop_repeated_words(df),
    "op6": lambda df, b: pii.find_pii(df, pii.fit_judge(df)),
    "op7": lambda df, b: omh.edited_by_next(df, omh.fingerprint),
    "op8": lambda df, b: drop_earlier_bytes(df),
    "op9": lambda df, b: histogram_sort(df, F.octet_length(F.coalesce("text", F.lit(""))) + 1, [F.col("text")], [F.col("doc_id")]),
    "op10": lambda df, b: mark_near_duplicates(df),
}


@pytest.mark.parametrize("name", WAYS)
def test_every_row_has_its_result(odd, bench, name):
    rows = WAYS[name](odd, bench).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


def test_columns_stay(odd, bench):
    leaks = {r.doc_id: r.leaked_items for r in mark_leaks(odd, bench, keep=["doc_id"]).collect()}
    assert leaks["d500"] == ["i2"] and leaks["d3"] == ["i1"]
    for out in (decontaminate(odd, bench), drop_near_duplicates(odd), mixed_documents(odd, block=16)):
        assert out.columns == odd.columns and out.count() > 0


def test_stages(spark, odd, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    odd.selectExpr("doc_id", "cast(length(doc_id) % 2 as int) toxic").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for _, stage in P.STAGES:
        docs = P.written(stage(spark, docs, str(tmp_path)), "odd")
    assert docs.columns == [*odd.columns, "shard", "slot"] and docs.count() > 0
