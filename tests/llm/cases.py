"""Fixtures of awkward rows."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    """Nulls in every column, empty and odd texts, ties, repeated rows, a long text."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    texts = [None, "", " \n\t", base, base, base.upper(), "one", "a\x1cb c", "日本語 テキスト 😀 ünï", "x" * 3000, " ".join(f"w{i % 977}" for i in range(9000)), "<|endoftext|> hi<|endoftext|>"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (100, None, None, None, None), (101, base, None, None, None), (3, base, "en", "s0", len(base)), (3, base, "en", "s0", len(base)), (None, "no id here", "en", "s1", 10)]


def frame(spark, rows=None, extra=False):
    df = spark.createDataFrame(awkward() if rows is None else rows, COLUMNS)
    if extra:
        for c in ("size", "shard", "slot", "n_bytes", "score", "count", "spans", "hash", "key", "start", "uid", "id", "label", "features", "a", "cls"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df
