"""A corpus from raw documents in five stages, each written as a table and read again.

Any column of documents may be null, texts may be empty or very long, rows may recur,
tables may be empty, and further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlaw.llm import decontaminate, mix, neardup, shard, toxicity
from graphlaw.llm.common import read, row_hash, text_of, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more for toxicity go; null texts score as empty ones, repeated rows alike. Without documents nothing is fitted and nothing goes."""
    model = toxicity.fit_on(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, column="__score").where("__score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least doc_id, null ids last; null and empty texts are one class."""
    return neardup.drop_near_duplicates(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or runs of their words, as often as the sources' targets take them; a null source is one of its own, texts without words are never taken."""
    return mix.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, of near equal bytes, and its slot there; null texts count one byte, columns may be of any type."""
    text = text_of(docs)
    return shard.histogram_sort(docs, F.octet_length(text) + 1, [text], [row_hash(docs)])


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("decontamination", contaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Hashes, a fitted model and random draws decide; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
