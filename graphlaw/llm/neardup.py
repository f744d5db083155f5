"""Near duplicates by DartMinHash.

Every element of a weighted set has a region: its weight across, ranks upward.
Darts, whose places only the hash of the element decides, fall on the regions at
an even rate; each belongs to one of the coordinates of the signature, and the
earliest dart of a coordinate stays. Two sets agree in a coordinate with the
probability of their weighted Jaccard similarity. Only darts up to a rank that
almost surely fills all coordinates are thrown, so a signature costs about
(coordinates * log coordinates) darts whatever the size of the set.

Bands of the signature are joined. Within a bucket only a pivot is compared with
the others, the one that meets most others anywhere. Where classes then still
share a bucket, its nodes meet once more by elements that similar sets must have
in common, so no link between different texts is lost, while the pairs of a group
are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlaw.llm.arrays import Texts, U, Words, mixed, shingles, slices
from graphlaw.llm.common import drop, text_of, written

#: Coordinates of a signature; a band takes ROWS of them, and each is in DEALS bands. A pair of similarity
#: 0.8 misses all bands in less than one of ten thousand cases, one of 0.3 meets in one of a hundred.
WORDS, SIMILARITY, COORDINATES, ROWS, DEALS = 5, 0.8, 140, 7, 3
#: Bytes of text that are worked on at a time; elements that count as common at most.
BLOCK, COMMON = 1 << 20, 10_000


def dart_signatures(element: np.ndarray, weight: np.ndarray | None, owner: np.ndarray, n: int, coordinates: int, seed: int = 1) -> np.ndarray:
    """Signatures (n, coordinates) of n weighted sets given as (element hash, weight, owner); weight None: 1 each.

    Sets without positive weight have rows of the largest number.
    """
    none = U(2**64 - 1)
    out = np.full(n * coordinates, none)
    total = np.bincount(owner, weight, n)
    ceiling = np.zeros(n)
    ceiling[total > 0] = (np.log(coordinates) + 2) / total[total > 0]
    todo = total > 0
    element = mixed(element + U(seed))
    while todo.any():
        pick = todo[owner]
        e, d = element[pick], owner[pick]
        if weight is None:
            room = None
        else:
            # a region of weight w is cut into columns of width 1, the last one narrower
            w = weight[pick]
            columns = np.ceil(w).astype(np.int64)
            nth = np.arange(columns.sum()) - np.repeat(np.cumsum(columns) - columns, columns)
            e, d, room = mixed(np.repeat(e, columns) + nth.astype(np.uint64) * U(0x9E3779B9)), np.repeat(d, columns), np.repeat(w, columns) - nth
        rank = np.zeros(len(e))
        while len(e):
            e = mixed(e + U(0x632BE59BD9B4E019))
            rank = rank - np.log(((e >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / coordinates
            live = rank <= ceiling[d]
            e, d, rank = e[live], d[live], rank[live]
            dart = mixed(e ^ U(0xA0761D6478BD642F))
            at = d * coordinates + (dart >> U(32)).astype(np.int64) % coordinates
            # ranks are positive, so their bits sort as they do; the low half names the dart
            packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (dart & U(0xFFFFFFFF))
            if room is not None:
                room = room[live]
                hit = ((mixed(dart + U(7)) >> U(11)).astype(np.float64) * 2.0**-53) < room
                at, packed = at[hit], packed[hit]
            np.minimum.at(out, at, packed)
        todo &= (out.reshape(n, coordinates) == none).any(1)
        ceiling[todo] *= 2
    return out.reshape(n, coordinates)


def band_keys(signatures: np.ndarray, rows: int, deals: int) -> np.ndarray:
    """Hashes of the bands: deals times, the coordinates are shuffled (always alike) and cut into bands of rows."""
    n, coordinates = signatures.shape
    rng = np.random.default_rng(17)
    picks = np.concatenate([rng.permutation(coordinates)[: coordinates // rows * rows].reshape(-1, rows) for _ in range(deals)])
    low = signatures & U(0xFFFFFFFF)
    key = np.arange(len(picks), dtype=np.uint64)[None, :].repeat(n, 0)
    for r in range(rows):
        key = mixed(key * U(0x9E3779B97F4A7C15) + low[:, picks[:, r]] + U(1))
    return key


def counted(element: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each owner with how often they occur: (element, count, owner)."""
    order = np.lexsort((element, owner))
    e, d = element[order], owner[order]
    new = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (d[1:] != d[:-1])]) if len(e) else np.zeros(0, np.int64)
    return e[new], np.diff(np.r_[new, len(e)]).astype(np.float64), d[new]


def _signed(docs: DataFrame, k: int, coordinates: int, rows: int, deals: int, weighted: bool) -> DataFrame:
    """docs (k1, k2, id, t) -> (k1, k2, id, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("t")
            for a, b in slices(column, BLOCK):
                element, owner = shingles(Words(Texts(column, a, b)), k)
                weight = None
                if weighted:
                    element, weight, owner = counted(element, owner)
                n = b - a
                keys = band_keys(dart_signatures(element, weight, owner, n, coordinates), rows, deals).view(np.int64)
                some = np.bincount(owner, minlength=n) > 0
                offsets = np.r_[0, np.cumsum(some * keys.shape[1])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
                part = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), part.column("id"), lists], names=["k1", "k2", "id", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"k1 long, k2 long, id {kind}, bands array<long>")


def _alike(pairs: DataFrame, texts: DataFrame, k: int, similarity: float, weighted: bool) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough, exactly."""
    t = texts.withColumnRenamed("t", "ta").withColumnRenamed("uid", "a")
    u = texts.withColumnRenamed("t", "tb").withColumnRenamed("uid", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("ta", "tb"):
                column, got = batch.column(name), []
                for a, b in slices(column, BLOCK):
                    e, c, d = counted(*shingles(Words(Texts(column, a, b)), k))
                    cut = np.searchsorted(d, np.arange(1, b - a))
                    got += zip(np.split(e, cut), np.split(c, cut), strict=True)
                sides.append(got)
            good = []
            for (x, cx), (y, cy) in zip(*sides, strict=True):
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both = np.minimum(cx[i], cy[j]).sum() if weighted else len(i)
                size = cx.sum() + cy.sum() if weighted else len(x) + len(y)
                good.append(bool(size) and both >= similarity * (size - both) - 1e-9)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.join(t, "a").join(u, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _meeting(nodes: DataFrame, texts: DataFrame, labels: DataFrame, k: int, similarity: float, weighted: bool) -> DataFrame:
    """All pairs (a, b) of the nodes that can be similar enough and lie in different classes.

    Similar sets share an element of their first ones, in any order common to all:
    as many as may be missing, and one more. Here the elements that fewest nodes have
    come first, so edited copies of one text meet by what their edits have in
    common and not by the text itself. Elements that no other node has bound what a
    node can share at all: with a partner of nearly its size it may lack less than with a
    smaller one, so nodes meet by size as well.
    """
    wanted = texts.join(nodes, "uid", "left_semi")

    def elements(batches: Iterator[pa.RecordBatch], pick: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, uid = batch.column("t"), batch.column("uid").to_numpy()
            for a, b in slices(column, BLOCK):
                e, c, d = counted(*shingles(Words(Texts(column, a, b)), k))
                w = c if weighted else np.ones(len(e))
                e = e.view(np.int64)
                late, whole = np.zeros(len(e), bool), np.bincount(d, w, b - a)[d]
                if pick is not None:
                    late = np.isin(e, pick)
                    order = np.lexsort((e, late, d))
                    e, w, d, late = e[order], w[order], d[order], late[order]
                    begin = np.r_[0, np.cumsum(w)][:-1]
                    before = begin - begin[np.searchsorted(d, d)]
                    keep = ~late | (before <= whole * (1 - similarity) + 1e-9)
                    e, w, d, late, whole = e[keep], w[keep], d[keep], late[keep], whole[keep]
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(uid[a + d]), pa.array(w), pa.array(late), pa.array(whole)], names=["e", "uid", "w", "late", "whole"])

    kind = "e long, uid long, w double, late boolean, whole double"
    parts = wanted.mapInArrow(lambda x: elements(x, None), kind)
    counts = written(parts.groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("uid"), F.min("w").alias("w")), "elements")
    total = counts.agg(F.sum("c")).first()[0] or 0
    # by this bound at most COMMON elements
    common = np.array([r["e"] for r in counts.where(F.col("c") > max(2, total / COMMON)).select("e").collect()], np.int64)
    alone = counts.where("c = 1").groupBy("uid").agg(F.sum("w").alias("alone"))
    size = parts.groupBy("uid").agg(F.max("whole").alias("n"))
    share = similarity / (1 + similarity)  # of both sizes together, that the common part must reach
    nodes = size.join(alone, "uid", "left").select("uid", "n", F.coalesce("alone", F.lit(0.0)).alias("u"))
    hopeful = written(nodes.where(F.col("u") <= F.col("n") * (1 - similarity) + 1e-9), "hopeful")
    rows = wanted.join(hopeful, "uid", "left_semi").mapInArrow(lambda x: elements(x, common), kind).select("e", "uid", "w", "late")
    rows = rows.join(counts.where("c > 1").select("e", "c"), "e").join(hopeful, "uid")
    # common elements in the order in which they were kept above
    ahead = Window.partitionBy("uid").orderBy("late", F.when(F.col("late"), 0).otherwise(F.col("c")), "e").rowsBetween(Window.unboundedPreceding, -1)
    lacking = F.coalesce(F.sum("w").over(ahead), F.lit(0.0)) + F.col("u")
    first = rows.withColumn("lacking", lacking).where(F.col("lacking") <= F.col("n") * (1 - similarity) + 1e-9)
    step = float(np.log(1.03))
    first = first.join(labels, "uid", "left").select("e", "uid", F.coalesce("root", "uid").alias("root"), "n", "lacking", (F.col("lacking") <= F.col("n") * (1 - 2 * share) + 1e-9).alias("short"))
    first = written(first, "first")
    major = first.groupBy("e", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("e").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("c", "root")).alias("major")).where("roots > 1").drop("roots")
    split = written(first.join(major, "e"), "split")
    # what stands before the first element that two have in common they don't share: that bounds the common part
    # for this row of the pair, and the sizes that the larger of the two leaves possible for the smaller
    small = split.where("short").select("e", F.floor(F.log("n") / step).alias("class"), *[F.col(c).alias(f"x_{c}") for c in ("uid", "root", "n", "lacking")], (F.col("root") == F.col("major")).alias("x_major"))
    most = F.least(F.lit(1.0), (1 - F.col("lacking") / F.col("n")) / share - 1)
    classes = F.sequence(F.floor(F.log(F.col("n") * similarity) / step - 1e-6), F.floor(F.log(F.col("n") * most) / step + 1e-6))
    large = split.where(most >= similarity - 1e-9).select("e", F.explode(classes).alias("class"), *[F.col(c).alias(f"y_{c}") for c in ("uid", "root", "n", "lacking")], (F.col("root") == F.col("major")).alias("y_major"))
    fit = (F.col("x_root") != F.col("y_root")) & (F.col("x_n") <= F.col("y_n")) & (F.least(F.col("x_n") - F.col("x_lacking"), F.col("y_n") - F.col("y_lacking")) >= (F.col("x_n") + F.col("y_n")) * share - 1e-6)
    meet = lambda x, y: x.join(y, ["e", "class"]).where(fit).select(F.least("x_uid", "y_uid").alias("a"), F.greatest("x_uid", "y_uid").alias("b"))
    return meet(small.where("not x_major"), large).unionByName(meet(small.where("x_major"), large.where("not y_major"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(uid, root) of every node that edges (a, b) name: root is the same within a component. Edges are contracted round by round; only counts reach the driver."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.select(F.col("a").alias("uid")).distinct().withColumn("root", F.col("uid")), "labels")
    old: list[DataFrame] = []
    for _ in range(max_rounds):
        edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
        drop(*old)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        # one jump: where a's target moves on itself, a moves along
        jump = to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.a")).select(F.col("x.a").alias("old"), F.col("y.to").alias("new"))
        jump = written(jump, "jumps")
        moved = labels.join(jump, F.col("root") == F.col("old"), "left").select("uid", F.coalesce("new", "root").alias("root"))
        old, labels = [edges, jump, labels], written(moved, "labels")
        x, y = jump.toDF("a", "na"), jump.toDF("b", "nb")
        edges = edges.join(x, "a").join(y, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    raise RuntimeError("the components did not settle")


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, similarity: float = SIMILARITY, coordinates: int = COORDINATES, rows: int = ROWS, deals: int = DEALS, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(classes, documents).

    classes: k1, k2 (hashes of a text) with class (long), class_id (the least key
    of the class), class_rows and class_texts. documents: key, k1, k2. Texts are linked
    where their k-word shingles, as bags (not weighted: as sets), have that weighted
    Jaccard similarity or more (the least counts by the greatest, summed up); classes are the components. Equal texts are one class;
    texts without words, and null as empty, are only alike if equal. Texts of
    fewer than k words are one shingle. Any column may be null; a class whose keys
    are all null has a null class_id. Repeated rows are in one class.
    """
    t = text_of(docs, text)
    keyed = docs.select(docs[key].alias("id"), F.xxhash64(t).alias("k1"), F.xxhash64(t, F.lit(1)).alias("k2"), t.alias("t"))
    signed = _signed(keyed.select("k1", "k2", "id", "t"), k, coordinates, rows, deals, weighted)
    nodes = signed.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    band = nodes.select("uid", F.explode("bands").alias("key"))
    shared = band.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = buckets = written(band.join(shared, "key"), "members")
    # the pivot of a bucket is the node that meets most others anywhere: of a group of edited copies, the one in their middle
    central = buckets.groupBy("uid").agg(F.sum("c").alias("meets"))
    pivots = buckets.join(central, "uid").groupBy("key").agg(F.max_by("uid", F.struct("meets", "uid")).alias("pivot"))
    buckets = written(buckets.join(pivots, "key").select("key", "uid", "pivot"), "buckets")
    wanted = buckets.select("uid").distinct().join(nodes.select("uid", "k1", "k2", "id"), "uid")
    texts = keyed.alias("d").join(wanted.alias("w"), (F.col("d.k1") == F.col("w.k1")) & (F.col("d.k2") == F.col("w.k2")) & F.col("d.id").eqNullSafe(F.col("w.id"))).select("w.uid", "d.t")
    texts = written(texts.dropDuplicates(["uid"]), "texts")
    pairs = written(buckets.where("uid != pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct(), "pairs")
    edges = written(_alike(pairs, texts, k, similarity, weighted), "links")
    labels = components(edges)
    # what the pivots are linked with is settled; where a bucket still has several classes, its others meet one another
    placed = buckets.where("uid != pivot").select("key", "uid").join(labels, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    split = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key")
    open_ = written(placed.join(split, "key", "left_semi").select("uid").distinct(), "open")
    used: list[DataFrame] = []
    if not open_.isEmpty():
        fresh = written(_meeting(open_, texts, labels, k, similarity, weighted).join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = written(_alike(fresh, texts, k, similarity, weighted), "links")
        used += [fresh, more]
        if not more.isEmpty():
            used.append(labels)
            labels = components(edges.unionByName(more))
    rooted = nodes.join(labels, "uid", "left").withColumn("class", F.coalesce("root", "uid")).select("k1", "k2", "id", "n", "class")
    totals = rooted.groupBy("class").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("class_texts"))
    classes = written(rooted.select("k1", "k2", "class").join(totals, "class"), "classes")
    drop(*used, nodes, members, buckets, texts, pairs, edges, labels, open_)
    return classes, keyed.select(F.col("id").alias(key), "k1", "k2")


def mark_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """A row for every row of docs: its key, class_id, class_rows (rows of the class) and class_texts (its different texts)."""
    classes, rows = near_classes(docs, **how)
    return rows.join(classes, ["k1", "k2"]).drop("k1", "k2", "class")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """docs with one row of each class: the one with the least key, nulls last. Columns stay as they are."""
    classes, rows = near_classes(docs, text=text, key=key, **how)
    rank = F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("i"), "k1", "k2")
    ranked = rows.join(classes, ["k1", "k2"]).groupBy("class", rank.alias("r")).agg(F.count(F.lit(1)).alias("same"))
    first = ranked.groupBy("class").agg(F.min("r").alias("r"), F.min_by("same", "r").alias("same"))
    first = written(first.select(F.col("r.i").alias("__i"), F.col("r.k1").alias("__k1"), F.col("r.k2").alias("__k2"), F.col("same").alias("__same")), "first")
    t = text_of(docs, text)
    keyed = docs.withColumns({"__h1": F.xxhash64(t), "__h2": F.xxhash64(t, F.lit(1))})
    kept = keyed.join(first, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")) & docs[key].eqNullSafe(F.col("__i")))
    drop(classes)
    # rows that repeat key and text: any one of them
    once, again = kept.where("__same = 1"), kept.where("__same > 1").dropDuplicates(["__i", "__k1", "__k2"])
    return once.unionByName(again).select(*docs.columns)
