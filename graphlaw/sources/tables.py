"""Ordinary tables as a graph: rows become nodes, foreign keys relations, columns values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlaw.sources.store import TYPES, GraphStore, Row, Tags, union

#: Ids of one table's rows lie in a range of their own.
SPAN = 1 << 48
KINDS = {"bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "double": "double", "float": "double", "string": "string", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "timestamp"}


@dataclass
class NodeTable:
    """One node a row. key: a long column that identifies it within the table, from 0 to SPAN - 1; values: attribute -> column."""

    tag: str
    frame: DataFrame
    key: str
    name: str | None = None
    doc: str | None = None
    values: dict[str, str] = field(default_factory=dict)


@dataclass
class EdgeTable:
    """One relation a row of frame: kind, from the node of source's table with key src to that of target's with key dst."""

    kind: str
    frame: DataFrame
    source: str
    src: str
    target: str
    dst: str
    order: str | None = None
    label: str | None = None


def in_range(key: Column, base: int) -> Column:
    """The id of a key; an error where the key is out of its table's range."""
    k = key.cast("long")
    bad = F.raise_error(F.concat(F.lit("key out of range: "), k.cast("string"))).cast("long")
    return F.when((k < 0) | (k >= SPAN), bad).otherwise(k + F.lit(base))


class TableStore(GraphStore):
    """A store over tables: every frame is a projection of its table, and what a query says of kinds leaves other tables out."""

    def __init__(self, spark: SparkSession, node_tables: list[NodeTable], edge_tables: list[EdgeTable]):
        self.place = {n.tag: i for i, n in enumerate(node_tables)}
        self.node_tables = {n.tag: n for n in node_tables}
        self.edge_tables = edge_tables
        self.spark = spark
        self._types: dict[str, set[str]] = {}
        for n in node_tables:
            for a in n.values:
                self._types.setdefault(a, set()).add(self._type(n, a))
        self._frames: dict[Any, Any] = {}

    def _once(self, key: Any, make: Callable[[], Any]) -> Any:
        """What make gives, made once: frames are planned only if something asks for them."""
        if key not in self._frames:
            self._frames[key] = make()
        return self._frames[key]

    @property
    def nodes(self) -> DataFrame:
        return self._once("nodes", lambda: union(map(self._node, self.node_tables.values())) if self.node_tables else GraphStore.empty(self.spark).nodes)

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: union(map(self._edge, range(len(self.edge_tables)))) if self.edge_tables else GraphStore.empty(self.spark).edges)

    @property
    def attrs(self) -> dict[str, DataFrame | None]:
        def all_() -> dict[str, DataFrame | None]:
            found: dict[str, list[DataFrame]] = {}
            for n in self.node_tables.values():
                for a in n.values:
                    found.setdefault(self._type(n, a), []).append(self._values(n, a))
            return {t: union(found[t]) if t in found else None for t in TYPES}

        return self._once("attrs", all_)

    def _eid(self, tag: str, column: Column) -> Column:
        return in_range(column, self.place[tag] * SPAN)

    @staticmethod
    def _type(n: NodeTable, attribute: str) -> str:
        kind = dict(n.frame.dtypes)[n.values[attribute]]
        return KINDS["double" if kind.startswith("decimal") else kind]

    def _named(self, n: NodeTable) -> list[Column]:
        text = lambda c: n.frame[c].cast("string") if c else F.lit(None).cast("string")
        return [self._eid(n.tag, n.frame[n.key]).alias("eid"), F.concat_ws("/", F.lit(n.tag), n.frame[n.key]).alias("entity_id"), F.lit(n.tag).alias("tag"), text(n.name).alias("name"), text(n.doc).alias("doc")]

    def _node(self, n: NodeTable) -> DataFrame:
        return self._once(("node", n.tag), lambda: n.frame.select(*self._named(n)))

    def _values(self, n: NodeTable, attribute: str) -> DataFrame:
        return self._once(("values", n.tag, attribute), lambda: self._plan_values(n, attribute))

    def _plan_values(self, n: NodeTable, attribute: str) -> DataFrame:
        c, t = n.values[attribute], self._type(n, attribute)
        return n.frame.where(n.frame[c].isNotNull()).select(self._eid(n.tag, n.frame[n.key]).alias("e"), F.lit(attribute).alias("a"), n.frame[c].cast(TYPES[t]).alias("v"))

    def _edge(self, i: int) -> DataFrame:
        return self._once(("edge", i), lambda: self._plan_edge(i))

    def _plan_edge(self, i: int) -> DataFrame:
        e = self.edge_tables[i]
        src, dst = self._eid(e.source, e.frame[e.src]), self._eid(e.target, e.frame[e.dst])
        order: Column = e.frame[e.order].cast("int") if e.order else F.lit(None).cast("int")
        label = e.frame[e.label].cast("string") if e.label else F.lit(None).cast("string")
        name = F.concat_ws("|", F.lit(e.kind), src, dst, order, label)
        # an id by content: a relation that a table holds twice has one id
        rid = F.xxhash64(name, F.lit(i)).bitwiseAND((1 << 62) - 1) + (1 << 62)
        return e.frame.select(rid.alias("rid"), name.alias("rel_id"), src.alias("src"), F.lit(e.kind).alias("kind"), dst.alias("dst"), label.alias("label"), order.alias("ord"), F.lit(None).cast("string").alias("payload"))

    def attr(self, name: str, kind: str, tags: Tags = None) -> DataFrame:
        own = [n for n in self.node_tables.values() if name in n.values and self._type(n, name) == kind and (tags is None or n.tag in tags)]
        if not own:
            return self.spark.createDataFrame([], f"e long, v {TYPES[kind]}")
        return union(self._values(n, name) for n in own).select("e", "v")

    def nodes_of(self, tags: Tags = None) -> DataFrame:
        own = [n for n in self.node_tables.values() if tags is None or n.tag in tags]
        return union(map(self._node, own)) if own else self.nodes.limit(0)

    def _fitting(self, kinds: Tags, sources: Tags, targets: Tags) -> list[int]:
        fits = lambda x, some: some is None or x in some
        return [i for i, e in enumerate(self.edge_tables) if fits(e.kind, kinds) and fits(e.source, sources) and fits(e.target, targets)]

    def edges_of(self, kinds: Tags = None, sources: Tags = None, targets: Tags = None) -> DataFrame:
        own = self._fitting(kinds, sources, targets)
        return union(map(self._edge, own)) if own else self.edges.limit(0)

    def ends(self, kind: str) -> tuple[Tags, Tags]:
        own = [self.edge_tables[i] for i in self._fitting(frozenset({kind}), None, None)]
        return frozenset(e.source for e in own), frozenset(e.target for e in own)

    def holders(self, attribute: str) -> Tags:
        return frozenset(n.tag for n in self.node_tables.values() if attribute in n.values)

    def row(self, tag: str) -> Row | None:
        return self._once(("row", tag), lambda: self._plan_row(tag)) if tag in self.node_tables else None

    def _plan_row(self, tag: str) -> Row:
        n = self.node_tables[tag]
        values = {a: (f"val/{a}", self._type(n, a)) for a in n.values}
        columns = [n.frame[c].cast(TYPES[values[a][1]]).alias(f"val/{a}") for a, c in n.values.items()]
        links = {}
        for i in self._fitting(None, frozenset({tag}), None):
            e = self.edge_tables[i]
            if e.frame is n.frame and e.src == n.key and len(self._fitting(frozenset({e.kind}), frozenset({tag}), None)) == 1:
                links[e.kind] = f"rel/{e.kind}"
                columns.append(self._eid(e.target, n.frame[e.dst]).alias(f"rel/{e.kind}"))
        return Row(n.frame.select(*self._named(n), *columns), values, links)

    def values(self, tag: str, attributes: list[str]) -> DataFrame:
        row = self.row(tag)
        if row is None:
            return super().values(tag, attributes)
        own = [a for a in attributes if a in row.values]
        held = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.array(F.col(f"`{c}`")))
        return row.frame.select("eid", *[held(row.values[a][0]).alias(f"{a}/{row.values[a][1]}") for a in own])


def from_tables(spark: SparkSession, nodes: list[NodeTable], edges: list[EdgeTable]) -> TableStore:
    """A store over tables: nothing is copied or shuffled. Relations that lie in the frame of their source's nodes (the same object), by its key, are read with the node."""
    return TableStore(spark, nodes, edges)


def key_of(eid: Column) -> Column:
    """The key in its table of a node's id."""
    return F.pmod(eid, F.lit(SPAN))
