"""Projections: a selection of nodes rendered as text, and contexts laid over a base projection."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlaw.operators import lens, render
from graphlaw.plans.registry import Registry
from graphlaw.sources.store import GraphStore


def _names(store: GraphStore) -> DataFrame:
    return store.nodes.select("eid", F.coalesce("name", "entity_id").alias("text"))


def _docs(store: GraphStore) -> DataFrame:
    return store.nodes.select("eid", F.concat_ws("\n", F.coalesce("name", "entity_id"), "doc").alias("text"))


#: (projection, tag) -> (eid, text) of every node of that tag; other tags show their names.
RENDERS: dict[tuple[str, str], Callable[[GraphStore], DataFrame]] = {
    ("Blueprint", "code/Operation"): render.operations,
    ("Blueprint", "type/Schema"): lambda s: render.schema_forms(s).withColumnRenamed("form", "text"),
    ("Docs", "code/Operation"): _docs,
    ("Docs", "type/Schema"): lambda s: render.schema_forms(s).withColumnRenamed("form", "text"),
}


def register(projection: str, tag: str, texts: Callable[[GraphStore], DataFrame]) -> None:
    RENDERS[projection, tag] = texts


def texts(store: GraphStore, projection: str, nodes: DataFrame) -> DataFrame:
    """(n, text) of the nodes (n) in a base projection."""
    own = nodes.select("n").distinct().join(store.nodes.select(F.col("eid").alias("n"), "tag"), "n")
    out = own.join(_names(store).toDF("n", "plain"), "n")
    for (base, tag), f in RENDERS.items():
        if base == projection:
            rendered = f(store).toDF("n", "said").withColumn("tag", F.lit(tag))
            out = out.join(rendered, ["n", "tag"], "left").withColumn("plain", F.coalesce("said", "plain")).drop("said")
    return out.select("n", F.col("plain").alias("text"))


def compose(store: GraphStore, name: str) -> tuple[str, list[str]]:
    """A projection's base and the contexts laid over it, innermost first: it contextualizes another, down to one that doesn't."""
    contexts: list[str] = []
    seen = set()
    while name not in seen:
        seen.add(name)
        row = store.nodes.where((F.col("tag") == "lens/Projection") & (F.col("name") == name)).agg(F.min("eid").alias("e")).first()["e"]
        if row is None:
            return name, contexts[::-1]
        context = (store.entity(row) or {}).get("val/context")
        if context:
            contexts.append(context)
        under = store.edges.where((F.col("src") == row) & (F.col("kind") == "contextualizes")).join(store.nodes.select(F.col("eid").alias("dst"), "name"), "dst").agg(F.min("name").alias("b")).first()["b"]
        if under is None:
            return name, contexts[::-1]
        name = under
    raise ValueError(f"projection {name} contextualizes itself")


def materialize(store: GraphStore, registry: Registry, projection: str, selection: Any) -> DataFrame:
    """(n, text): the nodes that a selection finds (clauses over ?n, or a frame of n), in a projection, each under its contexts."""
    nodes = selection if isinstance(selection, DataFrame) else lens.focus(store, registry, selection)
    base, contexts = compose(store, projection)
    out = texts(store, base, nodes)
    return out.withColumn("text", F.concat_ws("\n", *map(F.lit, contexts), "text")) if contexts else out


def module(store: GraphStore, registry: Registry, projection: str, name: str) -> DataFrame:
    """All that is in a module of that name."""
    return materialize(store, registry, projection, f'[(in-module ?n "{name}")]')


def of_foci(store: GraphStore, projection: str, foci: DataFrame) -> DataFrame:
    """(n, text): all nodes of a column focus of id arrays, those of several foci once."""
    return materialize(store, Registry(), projection, foci.select(F.explode("focus").alias("n")).distinct())


def unused_structures(store: GraphStore) -> DataFrame:
    """(name): reflected structures that no node is an instance of, but for the one that stands for any, realized ones and facets that others include."""
    tags = store.attr("tag", "string", frozenset({"grammar/Structure"})).select(F.col("e").alias("eid"), F.col("v").alias("tag"))
    own = store.nodes.where("tag = 'grammar/Structure' and name is not null").select("eid", "name").join(tags, "eid").where("tag != 'Any'")
    used = store.nodes.select("tag").where("tag is not null").distinct()
    realized = store.attr("realizes", "string").select(F.col("e").alias("eid"))
    included = store.edges.where("kind = 'includes'").select(F.col("dst").alias("eid"))
    return own.join(used, "tag", "left_anti").join(realized, "eid", "left_anti").join(included, "eid", "left_anti").select("name").distinct()
