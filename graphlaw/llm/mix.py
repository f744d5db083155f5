"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents one after another in the order of a hash,
are packed into blocks of fixed length. Every source gets as many slots as its
target fills. How many of them each output shard gets is drawn first: multinomial
counts, given that they add up to the target. A shard's slots then follow those of
the shard before; slot t of a source takes block perm(t), perm being a keyed
pseudorandom permutation of the source's block numbers (swap-or-not rounds, which
need no table), and the blocks are joined by number. The last slot of a source takes as much of its block as
the target still lacks, so a source's words are its target, rounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlaw.llm.common import n_words, row_hash, text_of, words_of, written
from graphlaw.llm.omh import let

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Rounds of the permutation.
ROUNDS = 24
MIX_COLUMNS = ["size", "source_size", "target", "taken", "takes"]


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """totals (source, source_size) with sid and target. One row a source, so its windows are small.

    Sources by code point, null last, weigh weights in turn. Pouring share of all
    words by weight until cap times its size fills a source, and the rest on, ends
    where target = min(cap * size, level * weight); with sources in the order in
    which they fill, the level is the largest of (rest / weight left).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    t = totals.withColumn("sid", F.row_number().over(order) - 1).withColumn("w", w).withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    fills = Window.orderBy(F.col("full") / F.col("w"), "sid")
    before, every = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    rest = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    left = F.sum("w").over(fills.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", rest / left)
    return t.withColumn("target", F.least("full", F.max("level").over(every) * F.col("w"))).select("source", "sid", "source_size", "target")


def permuted(t: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """A keyed pseudorandom permutation of 0 to n-1: in each round t and (K - t) mod n are swapped if a hash of the larger of them says so. back: its inverse, the rounds from the last on."""

    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), r, *key), F.lit(2)) == 1, other).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, t.cast("long"), one)


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = 128, n_shards: int = 8, seed: int = 11, rows_per_task: int = 5_000, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all if None) with size, source_size, target, taken and takes.

    takes holds structs (shard, slot, pass, begin, words): words of the document
    from its word begin on stand in that slot of that output shard. No block is
    used over ceil(cap) times, so no document is taken more often than that.
    Null texts and texts without words have size 0 and are never taken; a null
    source is a source of its own, the last. Repeated rows are documents of their
    own. Columns of docs named like the new ones are replaced; they may be of any type. Texts of any
    length are whole. An empty table gives an empty table.
    """
    keep = [c for c in (keep or docs.columns) if c not in MIX_COLUMNS]
    named = {f"__c{i}": docs[c] for i, c in enumerate(keep)}
    narrow = docs.select(*[c.alias(k) for k, c in named.items()], docs[source].alias("source"), n_words(text_of(docs, text)).alias("size"), row_hash(docs).alias("h"))
    sized = written(narrow.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    n = sized.count()
    cells = 2 ** max(0, math.ceil(math.log2(max(1, n / rows_per_task))))
    sized = sized.withColumn("cell", F.pmod(F.col("h"), F.lit(cells)))
    per_cell = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    totals = targets(per_cell.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, cap)
    totals = totals.withColumn("blocks", F.ceil(F.col("source_size") / block))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("cell_from", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)))
    per_cell = per_cell.alias("p").join(totals.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "cell", "cell_from", "sid", "source_size", "target")
    in_cell = Window.partitionBy("source", "cell").orderBy("h", "uid")
    begins = (F.col("cell_from") + F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start")
    s, p = sized.alias("s"), per_cell.alias("p")
    laid = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.cell") == F.col("p.cell"))).select("uid", *named, "s.source", "s.cell", "h", "size", "sid", "source_size", "target", "cell_from")
    laid = written(laid.select("uid", *named, "size", "sid", "source_size", "target", begins), "laid")

    chunk = 4096
    # a fixed number of partitions: rows as few as these would else be gathered into one task before they multiply
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # whole passes over a source's blocks, then as many words of one more as the target lacks
    full = totals.where("source_size > 0").withColumn("goal", F.round("target").cast("long"))
    full = full.select("sid", "blocks", "source_size", F.floor(F.col("goal") / F.col("source_size")).alias("passes"), (F.col("goal") % F.col("source_size")).alias("rest"))
    # the slot of that pass in which the last block, which may be short, stands
    last = permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("sid"), F.col("passes").cast("int"), back=True)
    lacks = F.col("blocks") * block - F.col("source_size")
    whole = F.ceil(F.col("rest") / block)
    some = F.when(F.col("rest") == 0, 0).when(last >= whole, whole).otherwise(F.ceil((F.col("rest") + lacks) / block))
    full = full.select("sid", "blocks", "passes", "rest", lacks.alias("lacks"), last.alias("last"), (F.col("passes") * F.col("blocks") + some).alias("slots"))
    own = ["sid", "blocks", "passes", "rest", "lacks", "last"]

    def each_slot(sources: DataFrame, columns: list[str]) -> DataFrame:
        cut = sources.where("slots > 0").select(*columns, "slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / chunk))).alias("part")).repartition(parts, "sid", "part")
        return cut.select(*columns, F.explode(F.sequence(F.col("part") * chunk, F.least(F.col("slots"), (F.col("part") + 1) * chunk) - 1)).alias("slot"))

    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("sid"), F.col("slot")), F.lit(n_shards)).cast("int")
    counts = each_slot(full, ["sid"]).groupBy("sid").agg(F.array(*[F.count_if(drawn == j) for j in range(n_shards)]).alias("counts"))
    # where each shard's slots end
    ends = F.transform("counts", lambda _, j: F.aggregate(F.slice("counts", F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    slots = each_slot(full.join(counts.select("sid", ends.alias("ends")), "sid"), [*own, "ends"])
    nth = F.col("slot") - F.col("passes") * F.col("blocks")
    left = F.col("rest") - nth * block + F.when(F.col("last") < nth, F.col("lacks")).otherwise(0)
    slots = slots.withColumn("limit", F.when(nth < 0, block).otherwise(F.least(F.lit(block), left)))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("slot")))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("int")
    at = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), turn)
    slots = slots.select("sid", at.alias("block"), F.struct(shard.alias("shard"), "slot", turn.alias("pass"), "limit").alias("use"))

    whole = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block")
    pieces = laid.where("size > 0").select("uid", "sid", "start", "size", whole)
    begin = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    into = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    pieces = pieces.select("uid", "sid", "block", into.alias("into"), begin.alias("begin"), (end - begin).alias("words"))
    # slots are counted by the sources' totals, so the planner takes their table for a small one
    used = pieces.join(slots.hint("merge"), ["sid", "block"]).withColumn("words", F.least("words", F.col("use.limit") - F.col("into"))).where("words > 0")
    used = used.select("uid", F.struct("use.shard", "use.slot", "use.pass", "begin", "words").alias("take"))
    taken = used.groupBy("uid").agg(F.sum("take.words").alias("taken"), F.sort_array(F.collect_list("take")).alias("takes"))
    out = laid.join(taken, "uid", "left")
    none = F.array().cast(taken.schema["takes"].dataType)
    return out.select(*[F.col(k).alias(c) for k, c in zip(named, keep, strict=True)], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("takes", none).alias("takes"))


def runs(takes: Column) -> Column:
    """Takes of one document that follow one another in one pass, joined: array of (pass, begin, end)."""
    flat = F.sort_array(F.transform(takes, lambda t: F.struct(t["pass"].alias("pass"), t["begin"].alias("begin"), (t["begin"] + t["words"]).alias("end"))))

    def merged(a: Column) -> Column:
        follows = lambda t, u: (t["pass"] == u["pass"]) & (t["end"] == u["begin"])
        first = F.filter(a, lambda t, i: (i == 0) | ~F.coalesce(follows(F.get(a, i - 1), t), F.lit(False)))
        last = F.filter(a, lambda t, i: ~F.coalesce(follows(t, F.get(a, i + 1)), F.lit(False)))
        return F.zip_with(first, last, lambda x, y: F.struct(x["pass"].alias("pass"), x["begin"].alias("begin"), y["end"].alias("end")))

    return let(flat, merged)


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", n_chars: str = "n_chars", **how) -> DataFrame:
    """The mix as rows like those of docs: a document taken whole is itself, else each run of its words that a pass takes is a row.

    Such a run has the columns of its document, its words joined by one space as
    text, and the code points of that as n_chars, if there is such a column. Rows
    without words are never taken. What mix() says of nulls and repeated rows holds.
    """
    keys = [row_hash(docs), row_hash(docs, 1)]
    slim = docs.select(docs[text].alias("text"), docs[source].alias("source"), keys[0].alias("h1"), keys[1].alias("h2"))
    taken = mix(slim, keep=["h1", "h2"], **how).where("taken > 0").select("h1", "h2", "size", F.explode(runs(F.col("takes"))).alias("run"))
    taken = taken.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("size").alias("__size"), F.col("run").alias("__run"))
    rows = docs.withColumns({"__h1": keys[0], "__h2": keys[1]}).dropDuplicates(["__h1", "__h2"]).join(taken, ["__h1", "__h2"])
    whole = (F.col("__run.begin") == 0) & (F.col("__run.end") == F.col("__size"))
    piece = F.array_join(F.slice(words_of(text_of(docs, text)), F.col("__run.begin").cast("int") + 1, (F.col("__run.end") - F.col("__run.begin")).cast("int")), " ")
    rows = rows.withColumn(text, F.when(whole, F.col(text)).otherwise(piece))
    if n_chars in docs.columns:
        rows = rows.withColumn(n_chars, F.when(whole, F.col(n_chars)).otherwise(F.length(text)).cast(docs.schema[n_chars].dataType))
    return rows.select(*docs.columns)
