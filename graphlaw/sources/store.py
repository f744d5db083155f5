"""The graph store: nodes, addressable relations and scalar values, as DataFrames.

Values lie in one frame a type (long, double, string, boolean, timestamp), so
that every clause scans the columns of one type and joins compare like with
like. Entity ids are longs throughout.
"""

from __future__ import annotations

import datetime
import itertools
import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlaw.sources.shared import written

NODES = "eid long, entity_id string, tag string, name string, doc string"
EDGES = "rid long, rel_id string, src long, kind string, dst long, label string, ord int, payload string"
TYPES = {"long": "long", "double": "double", "string": "string", "boolean": "boolean", "timestamp": "timestamp"}
#: Attributes that are columns of nodes and edges.
NODE_ATTRS = {"structure/of": "tag", "entity/name": "name", "entity/doc": "doc", "entity/id": "entity_id"}
EDGE_ATTRS = {"rel/from": "src", "rel/kind": "kind", "rel/to": "dst", "rel/label": "label", "rel/order": "ord", "rel/id": "rel_id", "rel/payload": "payload"}


def classify(v: Any) -> str:
    """The type of frame that a value goes to. Booleans are tested before integers, and false is a value."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "long"
    if isinstance(v, float):
        return "double"
    if isinstance(v, datetime.datetime):
        return "timestamp"
    return "string"


def as_text(v: Any) -> str:
    """A value that isn't of a type of its own, as text: lists, maps and the like as JSON."""
    if isinstance(v, str):
        return v
    return json.dumps(sorted(v, key=str) if isinstance(v, set | frozenset) else v, default=str) if isinstance(v, list | tuple | dict | set | frozenset) else str(v)


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


Tags = frozenset[str] | None


@dataclass(frozen=True)
class Row:
    """frame: one row a node, with eid and the node's columns, a column for each attribute (values: attribute -> column, type), and the target of each relation that is a foreign key (links: kind -> column)."""

    frame: DataFrame
    values: dict[str, tuple[str, str]]
    links: dict[str, str]


class GraphStore:
    closed = False

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, attrs: dict[str, DataFrame] | None = None, attr_types: dict[str, str] | None = None):
        """attrs: a frame (e, a, v) for each type. attr_types: the type of each attribute, where it is known without a look at the data."""
        self.spark, self.nodes, self.edges = spark, nodes, edges
        self.attrs = {t: (attrs or {}).get(t) for t in TYPES}
        self._types = {k: {v} for k, v in attr_types.items()} if attr_types is not None else None

    @property
    def attr_types(self) -> dict[str, set[str]]:
        """The types in which each attribute occurs. One row an attribute reaches the driver."""
        if self._types is None:
            self._types = {}
            for t, df in self.attrs.items():
                for r in df.select("a").distinct().collect() if df is not None else ():
                    self._types.setdefault(r["a"], set()).add(t)
        return self._types

    def attr(self, name: str, kind: str, tags: Tags = None) -> DataFrame:
        """(e, v): the values of an attribute in one type. tags: the entities asked for have one of these, so others may be left out."""
        df = self.attrs[kind]
        if df is None:
            return self.spark.createDataFrame([], f"e long, v {TYPES[kind]}")
        return df.where(F.col("a") == name).select("e", "v")

    def nodes_of(self, tags: Tags = None) -> DataFrame:
        """The nodes; given tags, at least those that have one of them."""
        return self.nodes

    def edges_of(self, kinds: Tags = None, sources: Tags = None, targets: Tags = None) -> DataFrame:
        """The relations; given kinds or the tags of their ends, at least those."""
        return self.edges

    def ends(self, kind: str) -> tuple[Tags, Tags]:
        """The tags that the ends of a kind of relations can have, where that is known."""
        return None, None

    def holders(self, attribute: str) -> Tags:
        """The tags of the nodes that can have an attribute, where that is known."""
        return None

    def row(self, tag: str) -> Row | None:
        """All that one row holds of a node, where the nodes of a tag are rows of a table."""
        return None

    def values(self, tag: str, attributes: list[str]) -> DataFrame:
        """(eid, an array by attribute and type): the nodes of a tag with all values of some attributes, one row a node, columns named attribute/type."""
        found = None
        for kind, df in self.attrs.items():
            own = [a for a in attributes if kind in self.attr_types.get(a, ())]
            if df is None or not own:
                continue
            wide = df.where(F.col("a").isin(own)).groupBy(F.col("e").alias("eid")).agg(*[F.collect_list(F.when(F.col("a") == a, F.col("v"))).alias(f"{a}/{kind}") for a in own])
            found = wide if found is None else found.join(wide, "eid", "full")
        own = self.nodes_of(frozenset({tag})).where(F.col("tag") == tag).select("eid").distinct()
        return own if found is None else own.join(found, "eid", "left")

    # building

    @classmethod
    def empty(cls, spark: SparkSession) -> GraphStore:
        return cls(spark, spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), {}, {})

    @classmethod
    def from_maps(cls, spark: SparkSession, nodes: Iterable[dict], rels: Iterable[dict], base: int = 0) -> GraphStore:
        """From node maps (id, tag, name, doc, val/…) and relation maps (id, from, kind, to, label, order, payload) whose ends are node ids.

        Repeated node ids merge, the last value of an attribute staying; of
        repeated relation ids the last one stays. A relation to an unknown id is
        kept with dst null.
        """
        merged: dict[str, dict] = {}
        for n in nodes:
            merged.setdefault(n["id"], {}).update({k: v for k, v in n.items() if v is not None})
        kept = {r["id"]: r for r in rels}
        ids = {x: base + i for i, x in enumerate([*merged, *kept])}
        rows = [(ids[i], i, n.get("tag"), n.get("name"), n.get("doc")) for i, n in merged.items()]
        links = [(ids[i], i, ids.get(r["from"]), r["kind"], ids.get(r["to"]), r.get("label"), r.get("order"), r.get("payload")) for i, r in kept.items()]
        values: dict[str, list] = {}
        types: dict[str, set[str]] = {}
        for i, n in merged.items():
            for k, v in n.items():
                if k.startswith("val/"):
                    t = classify(v)
                    values.setdefault(t, []).append((ids[i], k[4:], v if t != "string" else as_text(v)))
                    types.setdefault(k[4:], set()).add(t)
        attrs = {t: spark.createDataFrame(v, f"e long, a string, v {TYPES[t]}") for t, v in values.items()}
        out = cls(spark, spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES), attrs, {})
        out._types = types
        return out

    @classmethod
    def from_tx(cls, spark: SparkSession, maps: Iterable[dict]) -> GraphStore:
        """From transaction maps: attributes with a db/id. Negative ids are names within the transaction; maps of one entity/id (or rel/id) are one entity.

        Ends of relations are such ids, or lookups ("entity/id", id).
        """
        maps = list(maps)
        name = lambda m: m.get("entity/id") or m.get("rel/id") or f"#{m['db/id']}"
        known = {m["db/id"]: name(m) for m in maps if "db/id" in m}
        end = lambda x: x[1] if isinstance(x, tuple | list) else known.get(x, f"#{x}")
        nodes, rels = [], []
        for m in maps:
            if "rel/kind" in m:
                rels.append({"id": name(m), "from": end(m["rel/from"]), "kind": m["rel/kind"], "to": end(m["rel/to"]), "label": m.get("rel/label"), "order": m.get("rel/order"), "payload": m.get("rel/payload")})
            else:
                values = {k: v for k, v in m.items() if k.startswith("val/")}
                nodes.append({"id": name(m), "tag": m.get("structure/of"), "name": m.get("entity/name"), "doc": m.get("entity/doc"), **values})
        return cls.from_maps(spark, nodes, rels)

    def close(self) -> None:
        """No query runs on a closed store."""
        self.closed = True

    def __enter__(self) -> GraphStore:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    @classmethod
    def from_datoms(cls, spark: SparkSession, datoms: Iterable[tuple[int, str, Any]]) -> GraphStore:
        """From facts (entity, attribute, value), which are unique by all three: an attribute may have several values.

        A node or relation with several values of one of its own columns has a row for
        each combination of them.
        """
        facts: dict[int, dict[str, list[Any]]] = {}
        for e, a, v in datoms:
            held = facts.setdefault(e, {}).setdefault(a, [])
            if not any(type(x) is type(v) and x == v for x in held):
                held.append(v)
        rows = lambda e, f, names: [(e, *x) for x in itertools.product(*(f.get(a, [None]) for a in names))]
        node_attrs, edge_attrs = ("entity/id", "structure/of", "entity/name", "entity/doc"), ("rel/id", "rel/from", "rel/kind", "rel/to", "rel/label", "rel/order", "rel/payload")
        nodes, rels = [], []
        values: dict[str, list] = {}
        types: dict[str, set[str]] = {}
        for e, f in facts.items():
            if any(k.startswith("rel/") for k in f):
                rels += rows(e, f, edge_attrs)
            else:
                nodes += rows(e, f, node_attrs)
            for a, vs in f.items():
                for v in vs if a.startswith("val/") else ():
                    if v is not None:
                        t = classify(v)
                        values.setdefault(t, []).append((e, a[4:], v if t != "string" else as_text(v)))
                        types.setdefault(a[4:], set()).add(t)
        attrs = {t: spark.createDataFrame(v, f"e long, a string, v {TYPES[t]}") for t, v in values.items()}
        out = cls(spark, spark.createDataFrame(nodes, NODES), spark.createDataFrame(rels, EDGES), attrs, {})
        out._types = types
        return out

    def insert(self, other: GraphStore) -> GraphStore:
        """Both graphs; equal rows are one."""
        attrs = {}
        for t in TYPES:
            both = [x for x in (self.attrs[t], other.attrs[t]) if x is not None]
            if both:
                attrs[t] = union(both).dropDuplicates(["e", "a", "v"])
        out = GraphStore(self.spark, self.nodes.unionByName(other.nodes).distinct(), self.edges.unionByName(other.edges).distinct(), attrs, {})
        types = {k: set(v) for k, v in self.attr_types.items()}
        for k, v in other.attr_types.items():
            types.setdefault(k, set()).update(v)
        out._types = types
        return out

    def fold(self, nodes: Iterable[dict], rels: Iterable[dict]) -> GraphStore:
        """Node and relation maps onto this graph: ids that it has keep their entity, new ones come after the largest."""
        nodes, rels = list(nodes), list(rels)
        fresh = GraphStore.from_maps(self.spark, nodes, rels, self.max_eid() + 1)
        known = self.nodes.select("entity_id", F.col("eid").alias("known")).where("entity_id is not null")
        old = fresh.nodes.join(known, "entity_id").select(F.col("eid").alias("was"), F.col("known").alias("now"))
        to = lambda df, c: df.join(old, df[c] == old["was"], "left").withColumn(c, F.coalesce("now", c)).drop("was", "now")
        ends = {r["from"] for r in rels} | {r["to"] for r in rels}
        outside = known.where(F.col("entity_id").isin(list(ends))) if ends else known.limit(0)
        edges = to(to(fresh.edges, "src"), "dst")
        named = self.spark.createDataFrame([(r["id"], r["from"], r["to"]) for r in rels], "rel_id string, f string, t string")
        for column, end in (("src", "f"), ("dst", "t")):
            fill = named.join(outside, named[end] == outside["entity_id"]).select("rel_id", F.col("known").alias("k"))
            edges = edges.join(fill, "rel_id", "left").withColumn(column, F.coalesce(column, "k")).drop("k")
        edges = edges.join(self.edges.select("rel_id"), "rel_id", "left_anti").select(*self.edges.columns)
        new = fresh.nodes.join(old, fresh.nodes["eid"] == old["was"], "left_anti")
        attrs = {t: to(df, "e").select("e", "a", "v") for t, df in fresh.attrs.items() if df is not None}
        return self.insert(GraphStore(self.spark, new.select(*self.nodes.columns), edges, attrs, {k: next(iter(v)) for k, v in fresh.attr_types.items()}))

    def stored(self) -> GraphStore:
        """This graph as tables in the shared folder, for many queries over a graph that was put together."""
        attrs = {t: written(df, f"attrs-{t}") for t, df in self.attrs.items() if df is not None}
        out = GraphStore(self.spark, written(self.nodes, "nodes"), written(self.edges, "edges"), attrs, {})
        out._types = {k: set(v) for k, v in self.attr_types.items()}
        return out

    def max_eid(self) -> int:
        """The largest id of a node or relation, -1 where there is none."""
        both = self.nodes.select(F.col("eid").alias("i")).unionByName(self.edges.select(F.col("rid").alias("i")))
        return both.agg(F.coalesce(F.max("i"), F.lit(-1)).alias("m")).first()["m"]

    def add_relations(self, kind: str, pairs: DataFrame) -> GraphStore:
        """Relations of a kind for the distinct pairs (src, dst), self-relations left out, with ids after the largest."""
        top = self.max_eid() + 1
        new = pairs.where("src != dst").select("src", "dst").distinct().withColumn("rid", F.monotonically_increasing_id() + top)
        empty = {c: F.lit(None).cast("string") for c in ("label", "payload")}
        new = new.withColumns({"kind": F.lit(kind), "ord": F.lit(None).cast("int"), "rel_id": F.concat_ws("|", "src", F.lit(kind), "dst"), **empty}).select(*self.edges.columns)
        out = GraphStore(self.spark, self.nodes, self.edges.unionByName(new), self.attrs, {})
        out._types = self._types
        return out

    def entity(self, eid: int) -> dict[str, Any] | None:
        """All that is known of one entity, None if nothing is. A point lookup for the edge of the engine, not for loops."""
        out: dict[str, Any] = {}
        for df, key, names in ((self.nodes, "eid", NODE_ATTRS), (self.edges, "rid", EDGE_ATTRS)):
            for r in df.where(F.col(key) == eid).limit(1).collect():
                out |= {a: r[c] for a, c in names.items() if r[c] is not None}
        for df in self.attrs.values():
            out |= {f"val/{r['a']}": r["v"] for r in df.where(F.col("e") == eid).collect()} if df is not None else {}
        return out | {"db/id": eid} if out else None

    def lookup(self, attribute: str, value: Any) -> int | None:
        """The least id of an entity that has this value of the attribute."""
        if attribute in NODE_ATTRS:
            found = self.nodes.where(F.col(NODE_ATTRS[attribute]) == value).agg(F.min("eid"))
        else:
            found = self.attr(attribute.removeprefix("val/"), classify(value)).where(F.col("v") == F.lit(value)).agg(F.min("e"))
        return found.first()[0]
