"""Recursion and graph algorithms by rounds of joins over written tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlaw.sources.shared import drop, written

#: Rounds after which a fixpoint is given up, with an error.
MAX_ROUNDS = 1000
#: Tables of a total that are merged into one.
MERGE = 12


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def semi_naive(start: dict[str, list[DataFrame]], more: Callable[[dict[str, DataFrame], dict[str, DataFrame]], dict[str, list[DataFrame]]], max_rounds: int = MAX_ROUNDS) -> dict[str, DataFrame]:
    """The least fixpoint of some relations that build on one another.

    more(total, fresh) gives what follows from the rows found in the last round;
    a round keeps only what is new, so cycles end. Each round's rows are a table in the
    shared folder, and only whether there are any reaches the driver.
    """
    parts = {n: [written(_union(f).distinct(), "round")] for n, f in start.items()}
    fresh = {n: p[0] for n, p in parts.items()}
    for _ in range(max_rounds):
        total = {n: _union(p) for n, p in parts.items()}
        found = more(total, fresh)
        fresh = {}
        for n, frames in found.items():
            names = total[n].columns
            if frames:
                new = _union(frames).distinct().join(total[n], names, "left_anti")
                fresh[n] = written(new, "round")
            else:
                fresh[n] = total[n].limit(0)
        if all(f.isEmpty() for f in fresh.values()):
            return total
        for n, f in fresh.items():
            parts[n].append(f)
            if len(parts[n]) > MERGE:
                merged = written(_union(parts[n]), "total")
                drop(*(x for x in parts[n] if x is not f))
                parts[n] = [merged]
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """All pairs (src, dst) joined by a path of one edge or more, in rounds that double the length of the paths.

    A round joins only the pairs found in the last one with all: what two old pairs give is known.
    """
    total = fresh = written(edges.select("src", "dst").distinct(), "closure")
    for _ in range(max_rounds):
        ahead = fresh.toDF("src", "mid").join(total.toDF("mid", "dst"), "mid").select("src", "dst")
        behind = total.toDF("src", "mid").join(fresh.toDF("mid", "dst"), "mid").select("src", "dst")
        new = written(ahead.unionByName(behind).distinct().join(total, ["src", "dst"], "left_anti"), "paths")
        if new.isEmpty():
            return total
        grown = written(total.unionByName(new), "closure")
        drop(total, fresh)
        total, fresh = grown, new
    raise RuntimeError(f"no closure after {max_rounds} rounds")


def on_cycle(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Nodes from which a path leads back to them.

    Nodes without an edge in or out can't be on a cycle and are taken off, round by
    round; only among what is left, mostly the cycles and the paths between them, are
    paths looked for.
    """
    left = written(edges.select("src", "dst").distinct(), "edges")
    n = left.count()
    for _ in range(max_rounds):
        if not n:
            return left.select(F.col("src").alias("node"))
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        inner = written(inner.select("src", "dst"), "edges")
        m = inner.count()
        drop(left)
        left, n, before = inner, m, n
        if m == before:
            return closure(left).where("src = dst").select(F.col("src").alias("node"))
    raise RuntimeError(f"no cycles after {max_rounds} rounds")


def reach_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the labels of all nodes that a node reaches, its own included. Smaller than a closure: labels travel back along the edges."""

    def more(total: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> dict[str, list[DataFrame]]:
        step = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).join(fresh["r"].withColumnRenamed("node", "to"), "to")
        return {"r": [step.select("node", "label")]}

    return semi_naive({"r": [labels.select("node", "label")]}, more)["r"]


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): the least node of each undirected component. Nodes are those of edges; no edges, no rows.

    Every round each node takes over the least of its neighbours and then that one's own
    choice, and the edges are drawn together; the number of rounds grows with the
    logarithm of the size.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    labels = written(both(now).select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    old: list[DataFrame] = []
    for _ in range(max_rounds):
        now = written(now.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop(*old)
        if now.isEmpty():
            return labels
        to = both(now).groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        jump = written(to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.a")).select(F.col("x.a").alias("old"), F.col("y.to").alias("new")), "jumps")
        moved = written(labels.join(jump, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
        old, labels = [now, jump, labels], moved
        now = now.join(jump.toDF("a", "na"), "a").join(jump.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    raise RuntimeError(f"no components after {max_rounds} rounds")
