"""What the training-data operators share: reading, the shared folder, key columns, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from graphlaw.sources.shared import drop, numbered, shared_dir, written

__all__ = ["SPACE", "WORD", "drop", "long_keys", "n_words", "named_keys", "numbered", "read", "row_hash", "shared_dir", "text_of", "words_of", "written"]

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text, in order; no empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _has_map(kind: ST.DataType) -> bool:
    if isinstance(kind, ST.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return _has_map(kind.elementType) if isinstance(kind, ST.ArrayType) else isinstance(kind, ST.MapType | ST.VariantType)


def row_hash(df: DataFrame, *seed: int) -> Column:
    """A hash of all columns of a row; those of types that can't be hashed go in as JSON."""
    columns = [F.to_json(F.struct(df[f.name])) if _has_map(f.dataType) else df[f.name] for f in df.schema.fields]
    return F.xxhash64(*map(F.lit, seed), *columns)


def long_keys(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(docs with a long key and text, names): integers stay as they are; keys of other types become their numbers in order, which names (key, d) tells."""
    if isinstance(docs.schema[key].dataType, ST.IntegralType):
        return docs.select(docs[key], docs[text]), None
    keys = docs.select(docs[key].alias("__key")).where("__key is not null").distinct()
    names = numbered(keys, [F.col("__key")], "__d")
    rows = docs.select(docs[key].alias("__key"), docs[text].alias("__text")).join(names, "__key", "left")
    return rows.select(F.col("__d").alias(key), F.col("__text").alias(text)), names


def named_keys(out: DataFrame, names: DataFrame | None, key: str) -> DataFrame:
    """out, by the keys that long_keys replaced."""
    if names is None:
        return out
    rest = [c for c in out.columns if c != key]
    found = out.join(names, out[key] == names["__d"], "left")
    return found.select(F.col("__key").alias(key), *[out[c] for c in rest])
