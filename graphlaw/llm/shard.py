"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the key, hash of the tie columns). The splitters of
that order are found by counting the exact bytes between candidate boundaries on
all partitions at once and looking closer only where a splitter must lie, until
each is within tolerance; then every row moves once, to its shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the key that each round of probes resolves: at most 2**10 counts a splitter reach the driver.
STEP = 10
#: Cells that rows are numbered in, about, at most: their counts are broadcast, one row each.
MOST_CELLS = 100_000


def _probe(df: DataFrame, key: str, goals: list[float], slack: float) -> list[tuple[int, int, float, float]]:
    """For each goal (bytes below) the value v of key, how it was left: (v, exact bits, bytes below v, bytes in v's cell)."""
    found: list[tuple[int, int, float, float] | None] = [None] * len(goals)
    cells, shift = {None: (0.0, list(range(len(goals))))}, 64
    while cells:
        was, shift = shift, max(0, shift - STEP)
        at = F.shiftright(F.col(key), shift) if shift else F.col(key)
        part = df if None in cells else df.where(F.shiftright(F.col(key), was).isin(list(cells)))
        rows = part.groupBy(at.alias("cell")).agg(F.sum("__size").alias("size")).collect()
        by: dict[int | None, list[tuple[int, float]]] = {}
        for r in sorted(rows, key=lambda r: r["cell"]):
            by.setdefault(None if None in cells else r["cell"] >> (was - shift), []).append((r["cell"], float(r["size"])))
        inner: dict[int, tuple[float, list[int]]] = {}
        for parent, (below, wanted) in cells.items():
            for g in wanted:
                at_below, cell, size = below, 0, 0.0
                for cell, size in by[parent]:
                    if at_below + size >= goals[g]:
                        break
                    at_below += size
                if size <= slack or not shift:
                    found[g] = (cell << shift, 64 - shift, at_below, size)
                else:
                    inner.setdefault(cell, (at_below, []))[1].append(g)
        cells = inner
    return found  # type: ignore[return-value]


def _splitters(df: DataFrame, n_shards: int, tolerance: float, group_tolerance: float) -> list[tuple[int, int | None]]:
    """The least (key, tie) of shards 1 and up; tie None: the whole key belongs above the splitter."""
    total = float(df.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("n")).first()["n"])
    if not total or n_shards < 2:
        return []
    ideal = total / n_shards
    goals = [ideal * j for j in range(1, n_shards)]
    out: list[tuple[int, int | None]] = []
    for goal, (value, bits, below, size) in zip(goals, _probe(df, "__key", goals, tolerance * ideal), strict=True):
        low = goal - below <= below + size - goal
        if size <= tolerance * ideal or min(goal - below, below + size - goal) <= group_tolerance * ideal:
            # no key is cut: the nearer edge of the cell
            out.append((value, None) if low else (value + (1 << (64 - bits)), None))
        else:
            tie, tie_bits, tie_below, tie_size = _probe(df.where(F.col("__key") == value), "__tie", [goal - below], tolerance * ideal)[0]
            over = goal - below - tie_below > tie_below + tie_size - (goal - below)
            out.append((value, tie + (1 << (64 - tie_bits)) * over))
    return sorted(out, key=lambda s: (s[0], -(2**64) if s[1] is None else s[1]))


def _at_least(splitter: tuple[int, int | None]) -> Column:
    value, tie = splitter
    if value >= 2**63:
        return F.lit(False)
    key = F.col("__key")
    if tie is None:
        return key >= F.lit(value)
    return (key > F.lit(value)) | ((key == F.lit(value)) & (F.col("__tie") >= F.lit(tie) if tie < 2**63 else F.lit(False)))


def histogram_sort(df: DataFrame, size: Column, key: list[Column], tie: list[Column], n_shards: int = 8, tolerance: float = 0.002, group_tolerance: float = 0.02, rows_per_task: int = 5_000) -> DataFrame:
    """df with shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in its shard); shards have near equal sums of size.

    Rows of equal key stay in one shard wherever the splitter can move by at most
    group_tolerance of a shard for it; a larger group is cut between its ties.
    Rows equal in key and tie (repeated rows) stay together, in a shard as in the
    task that numbers them. Nulls are hashed as nulls and are one key; texts of any
    length are whole. Columns of df named shard or slot are replaced. An empty table
    gives an empty table. Each row moves once, whatever their number.
    """
    base = df.drop("shard", "slot").withColumns({"__size": size, "__key": F.xxhash64(*key), "__tie": F.xxhash64(F.lit(7), *tie)})
    probes = base.select("__size", "__key", "__tie")
    splitters = _splitters(probes, n_shards, tolerance, group_tolerance)
    shard = sum((_at_least(s).cast("int") for s in splitters), F.lit(0)).cast("int") if splitters else F.lit(0)
    n = probes.count()
    rows_per_task = max(rows_per_task, math.ceil(n / MOST_CELLS))
    bits = max(0, math.ceil(math.log2(max(1, n / rows_per_task))))
    bucket = F.shiftright(F.col("__key"), 64 - bits) if bits else F.lit(0).cast("long")
    cell = ["shard", "__bucket"]
    placed = base.withColumns({"shard": shard, "__bucket": bucket})
    # buckets that equal keys overfill are cut by the tie
    cuts = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).alias("__cuts"))
    # a bucket lies in one shard, but for those with a splitter: at most 2**bits + n_shards rows here, and n / rows_per_task more below
    sub = F.floor((F.shiftright(F.col("__tie"), 40) + (1 << 23)) * F.col("__cuts") / (1 << 24)).cast("long")
    cut = placed.join(F.broadcast(cuts), cell).withColumn("__sub", sub).drop("__cuts")
    ahead = Window.partitionBy("shard").orderBy("__bucket", "__sub")
    offsets = cut.groupBy(*cell, "__sub").count().withColumn("__from", F.sum("count").over(ahead) - F.col("count")).drop("count")
    own = Window.partitionBy(*cell, "__sub").orderBy("__key", "__tie")
    out = cut.withColumn("__nth", F.row_number().over(own)).join(F.broadcast(offsets), [*cell, "__sub"])
    return out.withColumn("slot", (F.col("__from") + F.col("__nth") - 1).cast("long")).select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")
