"""Probes: standard readings of any graph. Each gives (as, note, focus): what kind of observation, its text, and the nodes, or fewer columns of figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlaw.operators import readings
from graphlaw.operators.check import check
from graphlaw.plans.registry import Registry
from graphlaw.sources.store import GraphStore


def _within(df: DataFrame, column: str, focus: DataFrame | None) -> DataFrame:
    return df if focus is None else df.join(focus.select(F.col("n").alias(column)).distinct(), column, "left_semi")


def survey(store: GraphStore, focus: DataFrame | None = None) -> DataFrame:
    """(tag, n): nodes of each kind, most first."""
    return _within(store.nodes.where("tag is not null").select("eid", "tag").distinct(), "eid", focus).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def _relations(store: GraphStore) -> DataFrame:
    """(rid, src, kind, dst): a relation that is held twice is one."""
    return store.edges.select("rid", "src", "kind", "dst").distinct()


def patterns(store: GraphStore, focus: DataFrame | None = None) -> DataFrame:
    """(source, kind, target, n): kinds of nodes and relations that occur together more than once, most first."""
    edges = _within(_within(_relations(store), "src", focus), "dst", focus)
    tags = store.nodes.select("eid", "tag").distinct()
    both = edges.join(tags.toDF("src", "source"), "src").join(tags.toDF("dst", "target"), "dst")
    return both.groupBy("source", "kind", "target").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "source", "kind", "target")


def totals(store: GraphStore) -> DataFrame:
    """(structures, relations): how many there are."""
    nodes = store.nodes.where("tag is not null").agg(F.count_distinct("eid").alias("structures"))
    return nodes.crossJoin(F.broadcast(store.edges.agg(F.count_distinct("rid").alias("relations"))))  # one row each


def consistency(store: GraphStore, tag: str, kind: str = "child", focus: DataFrame | None = None) -> DataFrame:
    """(name, modules): names of nodes of a kind that lie in several modules, with the modules' names, sorted."""
    own = _within(store.nodes.where(F.col("tag") == tag), "eid", focus).select(F.col("eid").alias("dst"), "name")
    held = store.edges.where(F.col("kind") == kind).join(own, "dst").join(store.nodes.select(F.col("eid").alias("src"), F.col("name").alias("module")), "src")
    return held.groupBy("name").agg(F.array_sort(F.collect_set("module")).alias("modules")).where(F.size("modules") > 1).orderBy("name")


def callers(store: GraphStore, focus: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(eid, degree): the nodes with most relations in and out; of equals the lower id first."""
    ends = _relations(store).select(F.explode(F.array("src", "dst")).alias("eid")).where("eid is not null")
    return _within(ends.groupBy("eid").agg(F.count(F.lit(1)).alias("degree")), "eid", focus).orderBy(F.desc("degree"), "eid").limit(top)


def _gaps(store: GraphStore, names: DataFrame) -> DataFrame:
    """Nodes found again by name, so that a twin of the same name is in the focus as well."""
    ops = store.nodes.where("tag = 'code/Operation'").select("name", "eid")
    return names.join(ops, "name").groupBy(F.col("name").alias("note")).agg(F.array_sort(F.collect_set("eid")).alias("focus")).select(F.lit("gap").alias("as"), "note", "focus").orderBy("note")


#: Probes of the whole graph. As in survey and the others a focus is a frame of n, but these read it only after all: observations that it doesn't meet are left out.
PROBES: dict[str, Callable[[GraphStore, Registry, DataFrame | None], DataFrame]] = {
    "survey": lambda s, r, f: survey(s, f),
    "patterns": lambda s, r, f: patterns(s, f),
    "consistency": lambda s, r, f: consistency(s, "code/Operation", focus=f),
    "callers": lambda s, r, f: callers(s, f),
    "integrity": lambda s, r, f: _meeting(check(s, r), F.transform("offenders", lambda x: x.cast("long")), f),
    "coverage": lambda s, r, f: _meeting(_gaps(s, readings.uncovered_operations(s, r)), F.col("focus"), f),
    "drift": lambda s, r, f: _meeting(_gaps(s, readings.drifted_operations(s, r)), F.col("focus"), f),
    "type-drift": lambda s, r, f: _meeting(_gaps(s, readings.type_drifted_operations(s, r)), F.col("focus"), f),
}


def _meeting(df: DataFrame, nodes: Column, focus: DataFrame | None) -> DataFrame:
    """The rows that name a node of the focus; all without a focus."""
    if focus is None:
        return df
    rows = df.withColumn("__row", F.struct(*df.columns))
    met = rows.select("__row", F.explode(nodes).alias("n")).join(focus.select("n").distinct(), "n", "left_semi")
    return met.select("__row").distinct().select("__row.*")


def register(name: str, probe: Callable[[GraphStore, Registry, DataFrame | None], DataFrame]) -> None:
    PROBES[name] = probe


def run(store: GraphStore, reg: Registry, name: str, focus: DataFrame | None = None) -> DataFrame:
    if name not in PROBES:
        raise KeyError(f"unknown probe {name}; there are {', '.join(sorted(PROBES))}")
    return PROBES[name](store, reg, focus)


def run_all(store: GraphStore, reg: Registry) -> dict[str, DataFrame]:
    return {name: run(store, reg, name) for name in sorted(PROBES)}


def finding(store: GraphStore, reg: Registry, name: str, focus: DataFrame | None = None) -> DataFrame:
    """(lens, as, note, focus): what a probe observed, as a table: what kind of thing, in words, and the nodes that it is about."""
    df = run(store, reg, name, focus)
    none = F.array().cast("array<long>")
    if name == "survey":
        own = _within(store.nodes.select("eid", "tag"), "eid", focus).groupBy("tag").agg(F.array_sort(F.collect_set("eid")).alias("nodes"))
        rows = df.join(own, "tag").select(F.lit("kind").alias("as"), F.concat(F.col("n").cast("string"), F.lit(" × "), "tag").alias("note"), F.col("nodes").alias("focus"))
    elif name == "patterns":
        rows = df.select(F.lit("pattern").alias("as"), F.concat_ws(" ", "source", F.concat(F.lit("-"), "kind", F.lit("->")), "target", F.concat(F.lit("× "), F.col("n").cast("string"))).alias("note"), none.alias("focus"))
    elif name == "consistency":
        held = store.nodes.where("tag = 'code/Operation'").groupBy("name").agg(F.array_sort(F.collect_set("eid")).alias("nodes"))
        rows = df.join(held, "name").select(F.lit("repeated").alias("as"), F.concat("name", F.lit(": "), F.array_join("modules", ", ")).alias("note"), F.col("nodes").alias("focus"))
    elif name == "callers":
        named = df.join(store.nodes.select("eid", "name", "tag"), "eid", "left")
        rows = named.select(F.lit("hotspot").alias("as"), F.concat(F.col("degree").cast("string"), F.lit(" edges: "), F.coalesce("name", F.lit("(value)")), F.lit(" ("), F.coalesce("tag", F.lit("?")), F.lit(")")).alias("note"), F.array("eid").alias("focus"))
    elif name == "integrity":
        rows = df.select(F.lit("violation").alias("as"), F.concat_ws(": ", "structure", "law").alias("note"), F.transform("offenders", lambda x: x.cast("long")).alias("focus"))
    else:
        rows = df.select("as", "note", "focus")
    return rows.select(F.lit(name).alias("lens"), "as", "note", "focus")


def finding_text(found: DataFrame) -> DataFrame:
    """(text): a finding's notes, sorted."""
    return found.select(F.col("note").alias("text")).orderBy("text")
