"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask picks some of the tokens in a span and ignores the others, so a seed
survives substitutions at the ignored places. The masks follow from the rule:
cut an item of n tokens into as many equal parts as two tokens each can't fill
up to the tokens needed, and some part has three that agree, two of them within
half a part. So pairs (or triples) of that reach find every item that the rule
counts. Seeds of test items and of documents are joined by hash; around each hit
the item is laid along its diagonal, and the tokens that agree are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlaw.llm.common import text_of

#: A document is contaminated where this many tokens of an item agree on one diagonal, or this share of a shorter item.
AGREE, SHARE = 13, 0.8
#: Items of fewer tokens are no evidence; seeds of items that are broadcast at most.
LEAST_TOKENS, BROADCAST_SEEDS = 5, 300_000
#: Widest part in which a hit's third token is looked for at once; in wider ones all hits are counted.
NEAR = 12


def token_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower case."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_for(items: DataFrame) -> DataFrame:
    """items (n, need) with width, a part's size, and gap, the most between two seed tokens; if less than three tokens are needed, width is 1: single tokens."""
    parts = F.floor((F.col("need") - 1) / 2)
    width = F.when(F.col("need") < 3, 1).otherwise(F.ceil(F.col("n") / parts)).cast("int")
    return items.withColumn("width", width).withColumn("gap", F.floor((F.col("width") - 1) / 2).cast("int"))


def with_seeds(rows: DataFrame, h: str, gap: Column, width: Column | None = None, single: Column | None = None) -> DataFrame:
    """A row for every position of the array h and every mask that fits there: the columns of rows, pos, d and seed.

    Masks are pairs of tokens up to gap apart or, given a width, triples in so many
    tokens; where single holds, also the token alone. All come as rows; the
    seeds are then plain expressions over them, which are compiled together with the join that follows.
    """
    at = rows.select("*", F.posexplode(h).alias("pos", "__x"))
    up = lambda low, high: F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    one = F.when(F.lit(False) if single is None else single, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    token = lambda d: F.get(h, F.col("pos") + F.col(d))
    at = at.select("*", F.explode(F.concat(one, up(F.lit(1), gap if width is None else width - 2))).alias("d")).where(F.col("pos") + F.col("d") < F.size(h))
    if width is None:
        return at.select(*rows.columns, "pos", "d", F.xxhash64("d", "__x", token("d")).alias("seed"))
    at = at.select("*", F.explode(F.when(F.col("d") == 0, F.array(F.lit(0))).otherwise(up(F.col("d") + 1, width - 1))).alias("d2")).where(F.col("pos") + F.col("d2") < F.size(h))
    return at.select(*rows.columns, "pos", "d", F.xxhash64("d", "d2", "__x", token("d"), token("d2")).alias("seed"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", agree: int = AGREE, share: float = SHARE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Contaminated texts: key (two hashes of the text), items (ids, sorted).

    Equal texts are one row, and texts of any length are whole. Null and empty texts
    are never contaminated; null, empty and very short items (below LEAST_TOKENS
    tokens) match nothing. Items that equal or share a text are all reported, and
    rows of one item with different texts all count. Either table may be empty.
    """
    items = benchmark.select(benchmark[item_id].alias("item"), token_hashes(text_of(benchmark, item_text)).alias("t")).where(F.size("t") >= LEAST_TOKENS)
    items = items.select("item", F.xxhash64("t").alias("b"), "t", F.size("t").alias("n")).distinct()
    items = masks_for(items.withColumn("need", F.least(F.lit(agree), F.ceil(F.lit(share) * F.col("n"))).cast("int")))
    texts = items.drop("item").dropDuplicates(["b"])
    gap, width, single = (x or 0 for x in texts.agg(F.max("gap"), F.max("width"), F.max((F.col("width") == 1).cast("int"))).first())
    tested = with_seeds(texts, "t", F.col("gap"), single=F.col("width") == 1)
    broadcast = tested.count() <= broadcast_seeds

    t = text_of(docs, text)
    hashed = docs.select(F.xxhash64(t).alias("k1"), F.xxhash64(t, F.lit(1)).alias("k2"), token_hashes(t).alias("h"))
    diagonal = F.col("pos") - F.col("item_pos")
    if broadcast:
        needles = tested.select("seed", "b", F.col("pos").alias("item_pos"))
        hits = with_seeds(hashed, "h", F.lit(gap), single=F.lit(bool(single))).join(F.broadcast(needles), "seed").join(F.broadcast(texts.select("b", "t", "n", "need")), "b")
        if width <= NEAR:
            # the third token of the part
            agrees = lambda o: F.when(F.get("h", F.col("pos") + o) == F.get("t", F.col("item_pos") + o), 1).otherwise(0)
            hits = hits.where((F.col("need") < 3) | (sum((agrees(o) for o in range(2 - width, width)), F.lit(0)) >= 3))
    else:
        triples = with_seeds(texts, "t", F.col("gap"), F.col("width"), F.col("width") == 1)
        needles = triples.select("seed", "b", F.col("pos").alias("item_pos"))
        once = hashed.dropDuplicates(["k1", "k2"])
        rows = with_seeds(once, "h", F.lit(gap), F.lit(width), F.lit(bool(single))).select("k1", "k2", "pos", "seed")
        hits = rows.join(needles.hint("merge"), "seed").select("k1", "k2", "b", diagonal.cast("int").alias("pos"), F.lit(0).alias("item_pos")).distinct()
        hits = hits.join(once.hint("merge"), ["k1", "k2"]).join(texts.select("b", "t", "n", "need"), "b")
    # of each hit only the tokens that the item lies along go on, as a generated row, since a filter would be
    # moved before a mere projection, to rows that hold the whole document; compared here, only leaks are shuffled
    skip, ahead = F.greatest(-diagonal, F.lit(0)), F.greatest(diagonal, F.lit(0))
    size = F.least(F.col("n") - skip, F.size("h") - ahead)
    beside = F.struct(F.slice("h", ahead + 1, size).alias("h"), F.slice("t", skip + 1, size).alias("t"))
    lines = hits.select("k1", "k2", "b", "need", F.explode(F.array(beside)).alias("x"))
    same = F.size(F.filter(F.zip_with("x.h", "x.t", lambda x, y: x == y), lambda x: x))
    found = lines.where(same >= F.col("need")).select("k1", "k2", "b").distinct()
    leaks = found.join(items.select("item", "b"), "b")
    return leaks.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))


def text_keys(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    t = text_of(docs, text)
    return {"k1": F.xxhash64(t), "k2": F.xxhash64(t, F.lit(1))}


def mark_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, **how) -> DataFrame:
    """The kept columns (all if None) of every row of docs with leaked_items: ids of the benchmark items that its text holds, an empty array if none."""
    keep = [c for c in (keep or docs.columns) if c != "leaked_items"]
    leaks = find_leaks(docs, benchmark, **how)
    rows = docs.select(*[docs[c].alias(f"__c{i}") for i, c in enumerate(keep)], *[v.alias(k) for k, v in text_keys(docs).items()])
    found = rows.join(leaks, ["k1", "k2"], "left")
    none = F.array().cast(leaks.schema["items"].dataType)
    return found.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)], F.coalesce("items", none).alias("leaked_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows whose texts hold a benchmark item; columns and repeated rows stay as they are."""
    return mark_leaks(docs, benchmark, **how).where(F.size("leaked_items") == 0).drop("leaked_items")
