"""Lenses: stored selections of nodes; refining them, and gating on them."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlaw import terms as T
from graphlaw.operators.check import engine
from graphlaw.plans.registry import Registry
from graphlaw.sources.store import GraphStore


def focus(store: GraphStore, reg: Registry, clauses: Any) -> DataFrame:
    """(n): the nodes that the clauses bind ?n to."""
    return engine(store, reg).body(T.clauses(clauses), {"n"}).select("n").distinct()


def evaluate(store: GraphStore, reg: Registry, lens: int) -> DataFrame | None:
    """A stored lens's focus, None where it has no query."""
    clauses = (store.entity(lens) or {}).get("val/query")
    return None if clauses is None else focus(store, reg, clauses)


def refine(store: GraphStore, reg: Registry, nodes: DataFrame, clauses: Any) -> DataFrame:
    """Those of the nodes that match the clauses as well."""
    return nodes.select("n").distinct().join(focus(store, reg, clauses), "n", "left_semi")


def union(*foci: DataFrame) -> DataFrame:
    """(n): the nodes of any of the foci."""
    return reduce(lambda a, b: a.unionByName(b), [f.select("n") for f in foci]).distinct()


def run_checks(store: GraphStore, reg: Registry) -> DataFrame:
    """(check, verdict, offender): for every check whose lens finds nodes, a row for each of them. Checks are read one by one: there are few."""
    found = engine(store, reg).q('[:find ?c ?name ?verdict ?q :where [?c :structure/of "lens/Check"] [?c :entity/name ?name] [?c :val/verdict ?verdict] (gates ?c ?lens) [?lens :val/query ?q]]').orderBy("name").collect()
    rows = [focus(store, reg, r["q"]).select(F.lit(r["name"]).alias("check"), F.lit(r["verdict"]).alias("verdict"), F.col("n").alias("offender")) for r in found]
    out = store.spark.createDataFrame([], "check string, verdict string, offender long")
    for df in rows:
        out = out.unionByName(df)
    return out
