"""The opN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlaw.llm import omh, pii, toxicity
from graphlaw.llm.common import read, text_of
from graphlaw.llm.decontaminate import mark_leaks
from graphlaw.llm.fmindex import drop_repeated_words
from graphlaw.llm.mix import mix
from graphlaw.llm.neardup import mark_near_duplicates
from graphlaw.llm.oracles import SQL
from graphlaw.llm.shard import histogram_sort
from graphlaw.llm.suffixes import drop_earlier_bytes
from graphlaw.llm.tokens import count_tokens


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("takes")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with whether it holds a benchmark item, and which."""
    marked = mark_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), F.col("leaked_items").alias("item_ids"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_words(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit_judge(docs))
    n = {f"n_{k}": F.size(F.array_remove(F.col("base.k"), k)) for k in pii.BASE}
    n = {name: (F.size("base") - rest).cast("long") for name, rest in n.items()}
    digest = F.sha2(pii.joined(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *[v.alias(k) for k, v in n.items()], digest.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = omh.edited_by_next(read(spark, sf_dir, "documents"), omh.fingerprint)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        omh.as_text(F.col("value")).alias("fingerprint"),
        omh.as_text(F.col("edited_value")).alias("edited_fingerprint"),
        omh.likeness(F.col("value"), F.col("edited_value")).alias("near_edited"),
        omh.likeness(F.col("value"), F.col("next_value")).alias("near_next"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_earlier_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = text_of(docs)
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"))
    placed = histogram_sort(narrow, F.col("size"), [F.col("group")], [F.col("doc_id")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_spaced_seed_decontamination, op3_token_counts, op4_mix_sources, op5_substring_dedup, op6_pii, op7_order_minhash, op8_suffix_dedup, op9_histogram_shards, op10_dart_minhash)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
